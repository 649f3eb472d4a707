"""Files in and out: gene sets, MatrixMarket trios, Newick trees, result tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of set names that give a sign, in any case.
UP, DOWN = ("none", "up", "plus"), ("down", "dn", "minus", "mius")


def read_signatures(spark: SparkSession, paths: str | list[str], upper: bool = False) -> DataFrame:
    """(sig, gene, sign, source, descr) of gene sets: tab-separated name, description, gene[,value] ...

    Lines with fewer than three fields are skipped.  A name's ending after its last underscore may give a sign and is cut off; lines of
    one name merge.  A gene's own value wins over the sign; of repeated genes the last in file order wins.
    """
    lines = spark.read.text(paths).select(F.col("value"), F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("line"))
    cut = lines.withColumn("f", F.split(F.trim("value"), "\t")).where(F.size("f") >= 3)
    tail = F.lower(F.regexp_extract(F.col("f")[0], r"_([^_]*)$", 1))
    known = tail.isin(*UP, *DOWN)
    name = F.when(known, F.regexp_replace(F.col("f")[0], r"_[^_]*$", "")).otherwise(F.col("f")[0])
    sign = F.when(tail.isin(*DOWN), -1.0).otherwise(1.0)
    genes = cut.select(name.alias("sig"), sign.alias("sign"), "source", F.trim(F.col("f")[1]).alias("descr"), "line", F.posexplode(F.slice("f", 3, 1_000_000)).alias("pos", "g"))
    part = F.split("g", ",")
    gene = F.trim(part[0])
    genes = genes.withColumns({"gene": F.upper(gene) if upper else gene, "sign": F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("double"), "sign")}).where("gene <> ''")
    last = F.struct("line", "pos")
    return genes.groupBy("sig", "gene").agg(F.max_by("sign", last).alias("sign"), F.max_by("source", last).alias("source"), F.max_by("descr", last).alias("descr"))


def read_10x(spark: SparkSession, matrix: str, genes: str, barcodes: str, to_symbol: bool = True) -> DataFrame:
    """(cell, gene, value) from a MatrixMarket coordinate file and its two name files; genes of one symbol add up."""

    def numbered(path: str) -> DataFrame:
        rows = spark.sparkContext.textFile(path).zipWithIndex()  # positions need the order of lines
        return spark.createDataFrame(rows.map(lambda x: (x[1] + 1, x[0])), "k long, line string")

    lines = spark.read.text(matrix).where(~F.col("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    entry = lines.select(F.col("f")[0].cast("long").alias("i"), F.col("f")[1].cast("long").alias("j"), F.col("f")[2].cast("double").alias("value"), (F.monotonically_increasing_id() == 0).alias("head"))
    entry = entry.where("not head")
    parts = F.split("line", "\t")
    symbol = F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0]) if to_symbol else parts[0]
    g, c = numbered(genes).select(F.col("k").alias("i"), symbol.alias("gene")), numbered(barcodes).select(F.col("k").alias("j"), F.trim("line").alias("cell"))
    return entry.join(g, "i").join(c, "j").groupBy("cell", "gene").agg(F.sum("value").alias("value"))


def csc_entries(columns: DataFrame) -> DataFrame:
    """(i, j, value) from compressed columns: rows (j, indices array, data array) of a sparse matrix as HDF5 readers give them."""
    return columns.select("j", F.inline(F.arrays_zip(F.col("indices").alias("i"), F.col("data").alias("value")))).select("i", "j", "value")


def split_features(expr: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gene expression entries, protein entries) by feature_type of (gene, feature_type)."""
    full = expr.join(features, "gene")
    of = lambda kind: full.where(F.col("feature_type") == kind)
    return of("Gene Expression").select("cell", "gene", "value"), of("Antibody Capture").select("cell", F.col("gene").alias("protein"), "value")


_NEWICK = re.compile(r"\(|\)|,|;|[^(),;]+")


def parse_newick(text: str) -> list[tuple[int, int | None, str, float | None]]:
    """(node, parent, label, edge length) of a Newick string, the root first; nodes with one child are kept."""
    rows: list[list] = [[0, None, "", None]]
    at = 0
    for t in _NEWICK.findall("".join(text.split())):
        if t == "(" or t == ",":
            parent = at if t == "(" else rows[at][1]
            rows.append([len(rows), parent, "", None])
            at = len(rows) - 1
        elif t == ")":
            at = rows[at][1]
        elif t != ";":
            label, _, length = t.partition(":")
            rows[at][2:] = [label, float(length) if length else None]
    return [tuple(r) for r in rows]


def read_newick(spark: SparkSession, text: str) -> DataFrame:
    """Tree table (node, parent, label, edge_len)."""
    return spark.createDataFrame(parse_newick(text), "node long, parent long, label string, edge_len double")


def to_newick(rows: list[tuple]) -> str:
    """Newick text of (node, parent, label, edge length) rows."""
    kids: dict = {}
    for n, p, *_ in rows:
        kids.setdefault(p, []).append(n)
    by = {n: (label or "", length) for n, _, label, length in rows}
    done: dict = {}
    stack = [(n, False) for n in kids.get(None, [])]
    while stack:
        n, ready = stack.pop()
        if not ready:
            stack += [(n, True), *((k, False) for k in kids.get(n, []))]
            continue
        inner = ",".join(done.pop(k) for k in kids.get(n, []))
        done[n] = (f"({inner})" if inner else "") + by[n][0] + (f":{by[n][1]:g}" if by[n][1] is not None else "")
    return ",".join(done[n] for n in kids.get(None, [])) + ";"


def save_results(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder a table, and a manifest of their names."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"version": 1, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    said = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if said["version"] < 1:
        raise ValueError("results of an older version")
    return {name: spark.read.parquet(f"{path}/{name}") for name in said["tables"]}


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    """(name, cell) from a JSON object of lists."""
    kind = "map<string,array<string>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("name", "cells")).select("name", F.explode("cells").alias("cell"))


def selections_json(selections: DataFrame) -> DataFrame:
    by = selections.groupBy("name").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    return by.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "cells"))))).alias("json"))
