"""The model's tables, bound to the sample schema: customers as cells, brand and type of parts as genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, gene, value): quantity of each kind of part that a customer ordered."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit("|"), "p_type").alias("gene"))
    return line.join(part, "l_partkey").join(order, "l_orderkey").groupBy("cell", "gene").agg(F.sum("l_quantity").alias("value"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("|"), "p_type").alias("gene"), "p_brand", "p_type").distinct()


def type_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned: the genes of each part type."""
    return genes(spark, sf_dir).select(F.col("p_type").alias("sig"), "gene", F.lit(1.0).alias("sign"))


def signed_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed: of each part type, brands with an even number against the others."""
    even = F.substring("p_brand", -1, 1).cast("int") % 2 == 0
    return genes(spark, sf_dir).select(F.concat(F.lit("S_"), "p_type").alias("sig"), "gene", F.when(even, 1.0).otherwise(-1.0).alias("sign"))


def brand_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes(spark, sf_dir).select(F.col("p_brand").alias("mod"), "gene")


def factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, var, level): market segment and nation of each customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.inline(F.array(F.struct(F.lit("segment").alias("var"), F.col("c_mktsegment").alias("level")), F.struct(F.lit("nation").alias("var"), F.col("c_nationkey").cast("string").alias("level")))))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, feature, value): balance, order count and total price of each customer."""
    # prices are added up in the order of their keys: a sum of doubles in the order of arrival ends in other bits each time
    priced = F.array_sort(F.collect_list(F.when(F.col("o_totalprice").isNotNull(), F.struct("o_orderkey", "o_totalprice"))))
    total = F.when(F.size(priced) > 0, F.aggregate(priced, F.lit(0.0), lambda acc, x: acc + x["o_totalprice"]))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("n"), total.alias("total"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    pair = lambda name, col: F.struct(F.lit(name).alias("feature"), col.alias("value"))
    return c.select(F.col("c_custkey").alias("id"), F.inline(F.array(pair("balance", F.col("c_acctbal")), pair("orders", F.coalesce("n", F.lit(0.0))), pair("spent", F.col("total")))))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, feature, value): number of each customer's orders by priority, zeros too."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    names = o.select("feature").distinct().agg(F.collect_list("feature").alias("all"))  # five priorities
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).crossJoin(F.broadcast(names)).select("id", F.explode("all").alias("feature"))
    return every.join(o, ["id", "feature"], "left").select("id", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))


def latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def latent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, feature, value): the coordinates of each vector as features."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding"))
    return v.select("id", F.concat(F.lit("d"), F.col("pos").cast("string")).alias("feature"), F.col("col").cast("double").alias("value"))


def latent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("label").alias("var"), F.col("label").cast("string").alias("level"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pool, cell): customers of a nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pool"), F.col("c_custkey").alias("cell"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): root, regions, nations, customers."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit("root").alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"))
    return root.unionByName(r).unionByName(n).unionByName(c)


def tip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_mktsegment").alias("level"))


def milestones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m0", "m1", 2.0), ("m1", "m2", 1.0), ("m1", "m3", 3.0), ("m3", "m4", 1.5)], "a string, b string, length double")


def progressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, a, b, position): customers dealt to edges by key, at the cents of their balance; every fifth edge reversed."""
    c = table(spark, sf_dir, "customer")
    e = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("m0", "m1"), ("m1", "m2"), ("m1", "m3"), ("m3", "m4"), ("m2", "m1"))])
    own = e[(F.col("c_custkey") % 5).cast("int")]
    return c.select(F.col("c_custkey").alias("cell"), own["a"].alias("a"), own["b"].alias("b"), (F.abs(F.round(F.col("c_acctbal"), 0)).cast("long") % 100 / 100.0).alias("position"))
