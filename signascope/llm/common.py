"""Small helpers shared by the operators: the shared folder and cutting lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage and survives lost executors, unlike a cache or a local checkpoint.  The files stay until the shared
    folder is cleared: lazy results read them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 256):
    """Arrow batches of at most ``rows`` rows: what a task makes of each is let go before the next."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id):
    """True for the third of the documents that no classifier may learn from (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root): the smallest vertex that each vertex of ``edges`` (a, b) can reach.

    Labels fall along edges and then jump to their label's label, until no label moves; each round is written to
    the shared folder, so its lineage is short and it outlives executors.
    """
    both = edges.select("a", "b").where("a <> b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), name)
    while True:
        low = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("root").alias("low"))
        fell = materialise(labels.join(low, "v").select("v", "root", F.least("root", "low").alias("new")), name)
        jump = fell.select(F.col("v").alias("new"), F.col("new").alias("far"))
        moved = materialise(fell.join(jump, "new", "left").select("v", F.least("new", F.coalesce("far", "new")).alias("new"), "root"), name)
        labels = moved.select("v", F.col("new").alias("root"))
        if moved.where("new <> root").isEmpty():
            return labels
