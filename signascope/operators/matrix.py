"""Sparse matrices as long tables (cell, gene, value): statistics, normalisation, gene filters, id mapping.

Absent entries are zeros; every statistic counts them through the numbers of cells and genes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORMALISATIONS = ("none", "znorm_columns", "znorm_rows", "znorm_rows_then_columns", "rank_norm_columns")


def log2p1(expr: DataFrame, scale_to: float | None = None) -> DataFrame:
    """log2(x + 1), after scaling each cell to a total of ``scale_to`` if given."""
    value = F.col("value")
    if scale_to is not None:
        totals = expr.groupBy("cell").agg(F.sum("value").alias("_total"))
        expr, value = expr.join(totals, "cell"), F.col("value") * scale_to / F.col("_total")
    return expr.select("cell", "gene", F.log2(value + 1).alias("value"))


def undo_log1p(expr: DataFrame) -> DataFrame:
    """exp(x) - 1."""
    return expr.withColumn("value", F.expm1("value"))


def clip_bottom(df: DataFrame, least: float, col: str = "value", over: tuple[str, str] | None = None) -> DataFrame:
    """Values under ``least`` become ``least``; nulls stay.

    ``over`` names the two keys of a sparse matrix, whose absent entries are zeros: with ``least`` over 0 these rise too, so
    there is a row for every pair of keys then.  The shorter side goes to all tasks as a list if it is that of genes.
    """
    clipped = F.when(F.col(col) < least, F.lit(float(least))).otherwise(F.col(col))
    if over is None or least <= 0:
        return df.withColumn(col, clipped)
    a, b = over
    every = df.select(b).distinct().agg(F.collect_list(b).alias("_all"))  # one row: the names of one axis
    full = df.select(a).distinct().crossJoin(F.broadcast(every)).select(a, F.explode("_all").alias(b))
    there = df.select(a, b, clipped.alias(col), F.lit(True).alias("_there"))
    return full.join(there, [a, b], "left").select(a, b, F.when(F.col("_there"), F.col(col)).otherwise(F.lit(float(least))).alias(col))


def drop_duplicate_genes(genes: DataFrame) -> DataFrame:
    """Gene names that occur once; of a repeated name every copy goes."""
    return genes.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("gene")


def variance(total: Column, squares: Column, n) -> Column:
    """Sample variance of n values from their sum and sum of squares."""
    return (squares - total * total / n) / (n - 1)


def stats(expr: DataFrame, by: str, others: DataFrame) -> DataFrame:
    """(by, n_detected, total, squares, n, mean, var) of each gene or cell; ``others``: one row per member of the other side."""
    n = others.agg(F.count(F.lit(1)).alias("n"))
    agg = expr.groupBy(by).agg(
        F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("n_detected"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares")
    )
    out = agg.crossJoin(F.broadcast(n))  # n is one row
    return out.withColumns({"mean": F.col("total") / F.col("n"), "var": variance(F.col("total"), F.col("squares"), F.col("n"))})


def gene_stats(expr: DataFrame) -> DataFrame:
    return stats(expr, "gene", expr.select("cell").distinct())


def cell_stats(expr: DataFrame) -> DataFrame:
    return stats(expr, "cell", expr.select("gene").distinct())


def inverse_sd(var: Column) -> Column:
    """1 / sd, and 1 where sd is 0."""
    return F.when(var <= 1e-300, F.lit(1.0)).otherwise(1 / F.sqrt(var))


def factors(expr: DataFrame, method: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(gene, ro, rs) and (cell, co, cs) such that a normalised entry is ((x + ro) rs + co) cs; None stands for 0 and 1.

    The matrix itself stays sparse: column moments after row scaling have a closed form in sums over entries.
    """
    rows = cols = None
    if method in ("znorm_rows", "znorm_rows_then_columns"):
        rows = gene_stats(expr).select("gene", (-F.col("mean")).alias("ro"), inverse_sd(F.col("var")).alias("rs"))
    if method == "znorm_columns":
        cols = cell_stats(expr).select("cell", (-F.col("mean")).alias("co"), inverse_sd(F.col("var")).alias("cs"))
    if method == "znorm_rows_then_columns":
        base = rows.agg(F.count(F.lit(1)).alias("g"), F.sum(F.col("rs") * F.col("ro")).alias("b1"), F.sum(F.pow(F.col("rs") * F.col("ro"), 2)).alias("b2"))
        x, z = F.col("value") * F.col("rs"), F.col("rs") * F.col("ro")
        cell = expr.join(rows, "gene").groupBy("cell").agg(F.sum(x).alias("s1"), F.sum(x * x + 2 * x * z).alias("s2")).crossJoin(F.broadcast(base))
        total, squares = F.col("s1") + F.col("b1"), F.col("s2") + F.col("b2")
        cols = cell.select("cell", (-total / F.col("g")).alias("co"), inverse_sd(variance(total, squares, F.col("g"))).alias("cs"))
    return rows, cols


def normalised(expr: DataFrame, method: str) -> DataFrame:
    """(cell, gene, value, z) for stored entries, and ``z0``: what an absent entry of that gene and cell becomes."""
    if method == "rank_norm_columns":
        return column_ranks(expr)
    if method not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation {method!r}")
    rows, cols = factors(expr, method)
    out = expr.join(rows, "gene") if rows is not None else expr.withColumns({"ro": F.lit(0.0), "rs": F.lit(1.0)})
    out = out.join(cols, "cell") if cols is not None else out.withColumns({"co": F.lit(0.0), "cs": F.lit(1.0)})
    put = lambda x: ((x + F.col("ro")) * F.col("rs") + F.col("co")) * F.col("cs")
    return out.select("cell", "gene", "value", put(F.col("value")).alias("z"), put(F.lit(0.0)).alias("z0"))


def column_ranks(expr: DataFrame) -> DataFrame:
    """Rank within the cell, ties by the least place; all zeros share rank 1 and push the others up."""
    n = expr.select("gene").distinct().agg(F.count(F.lit(1)).alias("g"))
    some = expr.where("value > 0")
    zeros = F.col("g") - F.count(F.lit(1)).over(Window.partitionBy("cell"))
    rank = F.rank().over(Window.partitionBy("cell").orderBy("value"))
    return some.crossJoin(F.broadcast(n)).select("cell", "gene", "value", (rank + zeros).cast("double").alias("z"), F.lit(1.0).alias("z0"))


def filter_novar(expr: DataFrame) -> DataFrame:
    return gene_stats(expr).where("var > 1e-12").select("gene")


def filter_threshold(expr: DataFrame, threshold: int) -> DataFrame:
    """Genes detected in at least ``threshold`` cells."""
    return expr.where("value > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).select("gene")


def filter_fano(expr: DataFrame, num_mad: float = 2, bins: int = 30) -> DataFrame:
    """Genes whose var/mean passes the bin's median by ``num_mad`` MAD; bins hold equal counts by mean, the last the rest."""
    s = gene_stats(expr).where("mean > 0").select("gene", "mean", (F.col("var") / F.col("mean")).alias("fano"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / bins))
    place = F.row_number().over(Window.orderBy("mean", "gene"))
    binned = s.crossJoin(F.broadcast(n)).withColumn("bin", F.when(F.col("n") < bins, 0).otherwise(F.least(F.floor((place - 1) / size), F.lit(bins - 1))))
    med = binned.groupBy("bin").agg(F.median("fano").alias("med"))
    off = binned.join(med, "bin")
    mad = off.groupBy("bin").agg(F.median(F.abs(F.col("fano") - F.col("med"))).alias("mad"))
    return off.join(mad, "bin").where(F.col("fano") > F.col("med") + num_mad * F.col("mad")).select("gene")


FILTERS = {"novar": lambda e, t, m: filter_novar(e), "threshold": lambda e, t, m: filter_threshold(e, t), "fano": lambda e, t, m: filter_fano(filter_threshold_rows(e, t), m)}


def filter_threshold_rows(expr: DataFrame, threshold: int) -> DataFrame:
    return expr.join(filter_threshold(expr, threshold), "gene", "left_semi")


def apply_filter(expr: DataFrame, name: str, threshold: int = 0, num_mad: float = 2) -> DataFrame:
    """Genes that the named filter keeps; one filter, its name in any case."""
    if not isinstance(name, str) or name.lower() not in FILTERS:
        raise ValueError(f"unknown filter {name!r}")
    return FILTERS[name.lower()](expr, threshold, num_mad)


def projection_genes(expr: DataFrame, genes: DataFrame | None = None, method: str = "fano", threshold: float = 0.05, num_mad: float = 2) -> DataFrame:
    """A given list of genes where the matrix has them, else the filter on log2(x + 1); a threshold under 1 is a share of the cells."""
    if genes is not None:
        return expr.select("gene").distinct().join(genes.select("gene").distinct(), "gene", "left_semi")
    if threshold < 1:
        threshold = round(threshold * expr.select("cell").distinct().count())
    return apply_filter(log2p1(expr), method, int(threshold), num_mad)


def convert_gene_ids(expr: DataFrame, ids: DataFrame) -> DataFrame:
    """Sums entries of genes that share a new id; ``ids``: (gene, new_id)."""
    return expr.join(ids, "gene").groupBy("cell", F.col("new_id").alias("gene")).agg(F.sum("value").alias("value"))


def pool_matrix(expr: DataFrame, pools: DataFrame) -> DataFrame:
    """Mean column of each pool; ``pools``: (pool, cell).  Absent entries count as zeros."""
    size = pools.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    total = expr.join(pools, "cell").groupBy("pool", "gene").agg(F.sum("value").alias("total"))
    return total.join(size, "pool").select("pool", "gene", (F.col("total") / F.col("n")).alias("value"))


def pool_numbers(meta: DataFrame, pools: DataFrame) -> DataFrame:
    """Mean of each numeric variable (cell, var, value) in each pool."""
    return meta.join(pools, "cell").groupBy("pool", "var").agg(F.avg("value").alias("value"))


def pool_shares(meta: DataFrame, pools: DataFrame) -> DataFrame:
    """Share of each level of each factor (cell, var, level) in each pool."""
    count = meta.join(pools, "cell").groupBy("pool", "var", "level").agg(F.count(F.lit(1)).alias("n"))
    return count.join(pools.groupBy("pool").agg(F.count(F.lit(1)).alias("size")), "pool").select("pool", "var", "level", (F.col("n") / F.col("size")).alias("share"))


def pool_factors(meta: DataFrame, pools: DataFrame) -> DataFrame:
    """The level that at least half of a pool has, else ``~``."""
    shares = pool_shares(meta, pools)
    top = shares.groupBy("pool", "var").agg(F.max("share").alias("share"), F.min_by("level", F.struct(-F.col("share"), F.col("level"))).alias("level"))
    return top.select("pool", "var", F.when(F.col("share") >= 0.5, F.col("level")).otherwise("~").alias("level"))


def wide_to_long(wide: DataFrame, gene_col: str) -> DataFrame:
    """A table with a row per gene and a column per cell as long non-zero entries."""
    cells = [c for c in wide.columns if c != gene_col]
    long = wide.select(F.col(gene_col).alias("gene"), *[F.col(c).cast("double").alias(c) for c in cells]).unpivot("gene", cells, "cell", "value")
    return long.where("value <> 0").select("cell", "gene", "value")
