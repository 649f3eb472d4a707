"""Tables written for later use, and dense numbers for their rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names and read back; a cluster must name one.

    This cuts lineage, computes ``df`` once and survives lost executors.
    """
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(named or '/tmp/checkpoints').rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[str], name: str = "place") -> tuple[DataFrame, int]:
    """``df`` with a dense number from 0 in ``order``, and the number of rows.

    A sample sort: rows go to range partitions, each is sorted by itself, and the driver adds up the partitions' sizes.
    """
    tagged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    tagged = saved(tagged)
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    first = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[part] if before else F.lit(0)
    return tagged.withColumn(name, (first + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at"), sum(n for _, n in sizes)


def summed(parts: DataFrame, by: Sequence[str], col: str, length: int) -> DataFrame:
    """(by, col): arrays of ``length`` numbers that tasks have sent, added up place by place, a few tasks' first and then the rest."""
    add = F.aggregate("_r", F.array_repeat(F.lit(0.0), length), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q)).alias(col)
    some = parts.withColumn("_some", F.spark_partition_id() % 32).groupBy(*by, "_some").agg(F.collect_list(col).alias("_r")).select(*by, add)
    return some.groupBy(*by).agg(F.collect_list(col).alias("_r")).select(*by, add)
