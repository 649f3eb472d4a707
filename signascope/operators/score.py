"""Signature scores: signed sums over genes of normalised entries, without making the matrix dense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.operators import matrix


def process_signatures(sigs: DataFrame, expr: DataFrame, min_genes: int = 5, share: float = 0.001) -> DataFrame:
    """Signature genes (sig, gene, sign) detected in at least ``share`` of the cells; signatures left with too few genes go."""
    n = expr.select("cell").distinct().agg(F.count(F.lit(1)).alias("n_cells"))
    found = expr.where("value > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n))
    kept = sigs.join(found.where(F.col("n") >= share * F.col("n_cells")).select("gene"), "gene", "left_semi")
    sizes = kept.groupBy("sig").agg(F.count_distinct("gene").alias("k")).where(F.col("k") >= min_genes)
    return kept.join(sizes.select("sig"), "sig", "left_semi").select("sig", "gene", "sign")


def weights(sigs: DataFrame, expr: DataFrame) -> DataFrame:
    """(sig, gene, w) for genes that the matrix has; repeated genes add up."""
    return sigs.join(expr.select("gene").distinct(), "gene", "left_semi").groupBy("sig", "gene").agg(F.sum("sign").alias("w"))


def split_directions(sigs: DataFrame) -> DataFrame:
    """Signatures with both +1 and -1 also as ``<name>_UP`` and ``<name>_DOWN``."""
    both = sigs.groupBy("sig").agg(F.max(F.col("sign") == 1).alias("up"), F.max(F.col("sign") == -1).alias("down")).where("up and down").select("sig")
    some = sigs.join(both, "sig", "left_semi")
    part = lambda cond, tail: some.where(cond).select(F.concat("sig", F.lit(tail)).alias("sig"), "gene", "sign")
    return sigs.select("sig", "gene", "sign").unionByName(part("sign > 0", "_UP")).unionByName(part("sign < 0", "_DOWN"))


def scores(expr: DataFrame, sigs: DataFrame, method: str = "znorm_columns") -> DataFrame:
    """(cell, sig, score) for every cell and signature.

    score = (sum w rs x + sum w rs ro + co sum w) cs / sum |w|: only the first sum runs over entries.  Cells without any of a
    signature's genes get their score from the other terms.
    """
    w = weights(sigs, expr)
    if method == "rank_norm_columns":
        ranked = matrix.column_ranks(expr)
        sizes = w.groupBy("sig").agg(F.sum("w").alias("sw"), F.sum(F.abs("w")).alias("sa"))
        part = ranked.join(w, "gene").groupBy("cell", "sig").agg(F.sum(F.col("w") * (F.col("z") - 1)).alias("s"))
        return _all_pairs(expr, sizes, part).select("cell", "sig", ((F.coalesce("s", F.lit(0.0)) + F.col("sw")) / F.col("sa")).alias("score"))
    rows, cols = matrix.factors(expr, method)
    w = w.join(rows, "gene") if rows is not None else w.withColumns({"ro": F.lit(0.0), "rs": F.lit(1.0)})
    sizes = w.groupBy("sig").agg(F.sum("w").alias("sw"), F.sum(F.abs("w")).alias("sa"), F.sum(F.col("w") * F.col("rs") * F.col("ro")).alias("so"))
    part = expr.join(w, "gene").groupBy("cell", "sig").agg(F.sum(F.col("w") * F.col("rs") * F.col("value")).alias("s"))
    out = _all_pairs(expr, sizes, part)
    out = out.join(cols, "cell") if cols is not None else out.withColumns({"co": F.lit(0.0), "cs": F.lit(1.0)})
    score = (F.coalesce("s", F.lit(0.0)) + F.col("so") + F.col("co") * F.col("sw")) * F.col("cs") / F.col("sa")
    return out.select("cell", "sig", score.alias("score"))


def scaled(expr: DataFrame, method: str = "znorm_columns") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (cell, gene, v), cells (cell, co, cs) and genes (gene, ro) such that every score is
    (sum w v + sum w ro + co sum w) cs / sum |w| over a signature's genes."""
    cells, genes = expr.select("cell").distinct(), expr.select("gene").distinct()
    if method == "rank_norm_columns":
        entries = matrix.column_ranks(expr).select("cell", "gene", (F.col("z") - 1).alias("v"))
        return entries, cells.withColumns({"co": F.lit(1.0), "cs": F.lit(1.0)}), genes.withColumn("ro", F.lit(0.0))
    rows, cols = matrix.factors(expr, method)
    entries = expr.select("cell", "gene", F.col("value").alias("v")) if rows is None else expr.join(rows, "gene").select("cell", "gene", (F.col("value") * F.col("rs")).alias("v"))
    genes = genes.withColumn("ro", F.lit(0.0)) if rows is None else genes.join(rows, "gene", "left").select("gene", F.coalesce(F.col("rs") * F.col("ro"), F.lit(0.0)).alias("ro"))
    cells = cells.join(cols, "cell", "left").select("cell", F.coalesce("co", F.lit(0.0)).alias("co"), F.coalesce("cs", F.lit(1.0)).alias("cs")) if cols is not None else cells.withColumns({"co": F.lit(0.0), "cs": F.lit(1.0)})
    return entries, cells, genes


def _all_pairs(expr: DataFrame, sizes: DataFrame, part: DataFrame) -> DataFrame:
    """The result has a row for each cell and signature, so each cell carries the list of signatures."""
    listed = sizes.agg(F.collect_list(F.struct("sig", *[c for c in sizes.columns if c != "sig"])).alias("all"))
    cells = expr.select("cell").distinct().crossJoin(F.broadcast(listed))
    return cells.select("cell", F.inline("all")).join(part, ["cell", "sig"], "left")


def gene_importance(expr: DataFrame, sigs: DataFrame, score: DataFrame, method: str = "znorm_columns") -> DataFrame:
    """(sig, gene, importance): covariance over cells of score and normalised gene, times the gene's sign.

    With z = z0(cell) + d on stored entries only, the covariance needs sums over entries and one sum over cells.
    """
    n = expr.select("cell").distinct().agg(F.count(F.lit(1)).alias("n"))
    rows, cols = matrix.factors(expr, method)
    c = score.join(cols, "cell") if cols is not None else score.withColumns({"co": F.lit(0.0), "cs": F.lit(1.0)})
    by_sig = c.groupBy("sig").agg(F.sum("score").alias("ss"), F.sum(F.col("co") * F.col("cs")).alias("sc"), F.sum(F.col("score") * F.col("co") * F.col("cs")).alias("ssc"), F.sum("cs").alias("cs1"), F.sum(F.col("score") * F.col("cs")).alias("scs"))
    w = weights(sigs, expr)
    w = w.join(rows, "gene") if rows is not None else w.withColumns({"ro": F.lit(0.0), "rs": F.lit(1.0)})
    entry = expr.join(w, "gene").join(c, ["cell", "sig"]).withColumn("d", F.col("value") * F.col("rs") * F.col("cs"))
    sums = entry.groupBy("sig", "gene").agg(F.sum("d").alias("d1"), F.sum(F.col("d") * F.col("score")).alias("ds"))
    out = w.join(sums, ["sig", "gene"], "left").join(by_sig, "sig").crossJoin(F.broadcast(n))
    off = F.col("rs") * F.col("ro")
    total = F.coalesce("d1", F.lit(0.0)) + F.col("sc") + off * F.col("cs1")
    cross = F.coalesce("ds", F.lit(0.0)) + F.col("ssc") + off * F.col("scs")
    cov = (cross - total * F.col("ss") / F.col("n")) / (F.col("n") - 1)
    return out.select("sig", "gene", (cov * F.signum("w")).alias("importance"))
