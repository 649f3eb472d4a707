"""Tests between groups of cells: rank-sum, chi-square, one level against the rest, differential expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.functions import stats
from signascope.functions.tables import saved
from signascope.operators.graph import chi2_of_table


def _rank_sum(df: DataFrame) -> DataFrame:
    """Adds auc and p to rows with r1 (rank sum), n1, n, ties (sum t^3 - t); an empty side gives 0.5 and 1."""
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    ok = (n1 > 0) & (n2 > 0)
    z = F.when(sd > 0, (-F.abs(u - n1 * n2 / 2) + 0.5) / sd).otherwise(0.0)
    df = df.withColumns({"auc": F.when(ok, u / (n1 * n2)).otherwise(0.5), "_z": F.when(ok, z)})
    return df.withColumn("p", F.coalesce(F.least(F.lit(1.0), 2 * stats.normal("_z")), F.lit(1.0))).drop("_z")


def one_vs_rest(values: DataFrame, levels: DataFrame, ties: bool = False) -> DataFrame:
    """(feature, var, level, auc, p, fdr): rank-sum of each level's cells against the rest.

    ``values``: (id, feature, value) with a row for each cell, null where not known (such cells are left out of that feature);
    ``levels``: (id, var, level).  Features are ranked once for all levels.
    """
    # written, because ranks are found by value, and sums of doubles may come out otherwise a second time
    known = saved(values.where("value is not null"))
    ranked = stats.average_rank(known, ["feature"], "value")
    tie = known.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("t")).groupBy("feature").agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    part = ranked.join(levels, "id").groupBy("feature", "var", "level").agg(F.sum("rank").alias("r1"), F.count(F.lit(1)).alias("n1"))
    out = part.join(tie, "feature").withColumn("ties", F.col("ties") if ties else F.lit(0.0))
    out = _rank_sum(out).select("feature", "var", "level", "auc", "p")
    return stats.bh(out, "p", ["var", "level"], ["feature"])


def chi2_one_vs_rest(factors: DataFrame, levels: DataFrame) -> DataFrame:
    """(factor, var, level, v, p): association of each factor with being in a level or not."""
    pairs = factors.select("id", F.col("var").alias("factor"), F.col("level").alias("b")).join(levels.select("id", "var", "level"), "id")
    count = pairs.groupBy("factor", "b", "var", "level").agg(F.count(F.lit(1)).alias("n"))
    every = count.groupBy("factor", "b", "var").agg(F.sum("n").alias("total"))
    named = count.select("var", "level", "factor").distinct().join(every, ["factor", "var"]).join(count, ["factor", "b", "var", "level"], "left")
    inside, outside = F.coalesce("n", F.lit(0)), F.col("total") - F.coalesce("n", F.lit(0))
    keys = ["factor", "var", "level"]
    table = named.select(*keys, "b", F.explode(F.array(F.struct(F.lit(1).alias("a"), inside.alias("o")), F.struct(F.lit(0).alias("a"), outside.alias("o")))).alias("x"))
    table = table.select(*keys, F.col("x.a").alias("a"), "b", F.col("x.o").cast("double").alias("o"))
    return chi2_of_table(table, keys).select(*keys, "chi2", "v", "df", "p")


def meta_comparison(numbers: DataFrame, factors: DataFrame, levels: DataFrame) -> DataFrame:
    """(feature, var, level, stat, p, fdr): metadata of each level's cells against the rest.

    Numbers (id, feature, value) by rank-sum with ties and without missing values (stat: AUC), factors (id, var, level) by
    chi-square (stat: Cramer's V); p-values of both are adjusted together for each level.
    """
    ranked = one_vs_rest(numbers, levels, ties=True).select("feature", "var", "level", F.col("auc").alias("stat"), "p")
    tables = chi2_one_vs_rest(factors, levels).select(F.col("factor").alias("feature"), "var", "level", F.col("v").alias("stat"), "p")
    return stats.bh(ranked.unionByName(tables), "p", ["var", "level"], ["feature"])


def _side_counts(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene, value, a, b): how many cells of either side have a value of a gene.

    All that follows is made from these counts, so cells are read once and never sorted or sent by value.
    """
    side = lambda s: F.sum((F.col("side") == s).cast("long"))
    return saved(expr.join(groups, "cell").groupBy("gene", "value").agg(side("A").alias("a"), side("B").alias("b")))


def sparse_rank_sum(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene, auc, p): rank-sum per gene of group A against group B, zeros as one tie block.

    ``groups``: (cell, side) with side 'A' or 'B'.  Ranks are within A and B; a non-zero's rank is its place among non-zeros plus
    the number of zeros, and zeros share the mean of their places.
    """
    return _rank_sum_of_counts(_side_counts(expr, groups), groups)


def _rank_sum_of_counts(counts: DataFrame, groups: DataFrame) -> DataFrame:
    sizes = groups.groupBy().agg(F.sum((F.col("side") == "A").cast("long")).alias("na"), F.count(F.lit(1)).alias("n"))
    some = counts.where("value > 0").select("gene", "value", "a", (F.col("a") + F.col("b")).alias("t"))
    rank = F.col("upto") - (F.col("t") - 1) / 2
    part = stats.running_sum(some, ["gene"], "value", "t", "upto").groupBy("gene").agg(F.sum(rank * F.col("a")).alias("ra"), F.sum("a").alias("nza"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("t3"), F.sum("t").alias("nz"))
    full = part.crossJoin(F.broadcast(sizes))
    z = F.col("n") - F.col("nz")
    r1 = F.col("ra") + F.col("nza") * z + (F.col("na") - F.col("nza")) * (z + 1) / 2
    full = full.select("gene", r1.alias("r1"), F.col("na").alias("n1"), "n", (F.col("t3") + z * z * z - z).alias("ties"))
    return _rank_sum(full).select("gene", "auc", "p")


def differential(expr: DataFrame, groups: DataFrame, min_cells: int = 0) -> DataFrame:
    """(gene, log_fc, auc, p, fdr): rank-sum and log2 ratio of means with a bias of 1/sqrt(n1 n2).

    Genes must be detected in at least ``min_cells`` of all cells and in some cell of either group.
    """
    found = expr.where("value > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells).select("gene")
    counts = _side_counts(expr, groups)
    kept = counts.join(found, "gene", "left_semi")
    sizes = groups.agg(F.sum((F.col("side") == "A").cast("long")).alias("na"), F.sum((F.col("side") == "B").cast("long")).alias("nb"))
    total = lambda c: F.sum(F.when(F.col(c) > 0, F.col("value").cast("double") * F.col(c)).otherwise(0.0))
    means = kept.groupBy("gene").agg(total("a").alias("sA"), total("b").alias("sB")).crossJoin(F.broadcast(sizes))
    bias = 1 / F.sqrt(F.col("na") * F.col("nb"))
    fold = F.log2((F.col("sA") / F.col("na") + bias) / (F.col("sB") / F.col("nb") + bias))
    out = _rank_sum_of_counts(counts, groups).join(means.select("gene", fold.alias("log_fc")), "gene")
    return stats.bh(out, "p", [], ["gene"]).select("gene", "log_fc", "auc", "p", "fdr")


def groups_of(cells: DataFrame, numerator: DataFrame, denominator: DataFrame | None = None) -> DataFrame:
    """(cell, side): A for the numerator, B for the denominator or, where none is given, for all other cells."""
    a = cells.join(numerator.select("cell").distinct(), "cell", "left_semi").select("cell", F.lit("A").alias("side"))
    b = cells.join(denominator.select("cell").distinct(), "cell", "left_semi") if denominator is not None else cells
    return a.unionByName(b.join(a, "cell", "left_anti").select("cell", F.lit("B").alias("side")))


def subsample(cells: DataFrame, n: int, seed: str = "sample") -> DataFrame:
    """``n`` cells by md5 of seed and cell."""
    return cells.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("cell").cast("string")).cast("binary")), "cell").limit(n)


def enrichment(first: DataFrame, second: DataFrame, n_genes: int) -> DataFrame:
    """(sig, mod, overlap, stat, p) for every pair of sets (sig, gene) and (mod, gene) out of ``n_genes``.

    stat is the log of observed over expected overlap, 0 where there is none; p is the hypergeometric upper tail.
    """
    a = first.select("sig", "gene").distinct()
    b = second.select("mod", "gene").distinct()
    na, nb = a.groupBy("sig").agg(F.count(F.lit(1)).alias("na")), b.groupBy("mod").agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, "gene").groupBy("sig", "mod").agg(F.count(F.lit(1)).alias("overlap"))
    listed = nb.agg(F.collect_list(F.struct("mod", "nb")).alias("all"))  # a row for each pair of sets is the result
    full = na.crossJoin(F.broadcast(listed)).select("sig", "na", F.inline("all")).join(both, ["sig", "mod"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    m, k, n, o = F.greatest("na", "nb"), F.least("na", "nb"), F.lit(n_genes), F.col("overlap")
    stat = F.when(o > 0, F.log(o / (k * m / n))).otherwise(0.0)
    return full.select("sig", "mod", "overlap", stat.alias("stat"), stats.hypergeometric_tail(o, m, k, n).alias("p"))


def directional_sets(sigs: DataFrame, skip_down: bool = True) -> DataFrame:
    """(sig, gene) to hold against modules: a signature with +1 and -1 is its ``_UP`` set and, unless ``skip_down``, its ``_DOWN``
    set; one with -1 only is left out under ``skip_down``; any other is all its genes."""
    kind = sigs.groupBy("sig").agg(F.max((F.col("sign") == 1).cast("int")).alias("up"), F.max((F.col("sign") == -1).cast("int")).alias("down"), F.min((F.col("sign") == -1).cast("int")).alias("only"))
    full = sigs.join(kind, "sig")
    both = (F.col("up") == 1) & (F.col("down") == 1)
    name = F.when(both & (F.col("sign") == 1), F.concat("sig", F.lit("_UP"))).when(both & (F.col("sign") == -1), F.lit(None) if skip_down else F.concat("sig", F.lit("_DOWN"))).when(~both, F.col("sig"))
    kept = full.where(F.col("only") == 0) if skip_down else full
    return kept.select(name.alias("sig"), "gene").where("sig is not null").distinct()


def best_module(enriched: DataFrame) -> DataFrame:
    """(sig, mod): the module with the largest statistic, ties by name."""
    return enriched.groupBy("sig").agg(F.min_by("mod", F.struct(-F.col("stat"), F.col("mod"))).alias("mod"))


def overlap_signatures(enriched: DataFrame, first: DataFrame, second: DataFrame, level: float = 0.05) -> DataFrame:
    """(sig, gene, sign) of ``<sig>_OVERLAP_<mod>``: the genes that significant pairs share."""
    pairs = enriched.where(F.col("p") < level).select("sig", "mod")
    shared = pairs.join(first.select("sig", "gene", "sign"), "sig").join(second.select("mod", "gene").distinct(), ["mod", "gene"])
    return shared.select(F.concat_ws("_OVERLAP_", "sig", "mod").alias("sig"), "gene", "sign")
