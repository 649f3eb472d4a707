"""The questions a report puts to an analysis, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signascope.operators import contrast, graph, matrix, score
from signascope.plans.analysis import Dataset


def _need(data: Dataset, name: str) -> DataFrame:
    if name not in data.results:
        raise KeyError(f"the analysis has no {name}")
    return data.results[name]


def signature_scores(data: Dataset, name: str) -> DataFrame:
    """(cell, score) of a signature; ``_UP`` or ``_DOWN`` falls back on the whole signature."""
    scores = _need(data, "scores")
    own = scores.where(F.col("sig") == name)
    if own.isEmpty() and name.endswith(("_UP", "_DOWN")):
        own = scores.where(F.col("sig") == name.rsplit("_", 1)[0])
    return own.select("cell", "score")


def signature_info(data: Dataset, name: str) -> DataFrame:
    """(sig, genes) as JSON: sign and importance of each gene."""
    full = data.sigs.where(F.col("sig") == name).join(_need(data, "gene_importance"), ["sig", "gene"], "left")
    return full.groupBy("sig").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("gene", F.struct("sign", F.bround("importance", 4).alias("importance"))))))).alias("genes"))


def signature_autocorrelation(data: Dataset) -> DataFrame:
    return _need(data, "signature_autocorrelation").orderBy("p", F.desc("c"), "feature")


def meta_autocorrelation(data: Dataset) -> DataFrame:
    return _need(data, "meta_autocorrelation").orderBy("p", F.desc("c"), "feature")


#: By kind of feature: the result with its comparisons, the column with the statistic, the result with its correlations.
KINDS = {
    "signatures": ("one_vs_rest", "auc", "component_correlation"),
    "meta": ("meta_one_vs_rest", "stat", "component_correlation"),
    "modules": ("modules_one_vs_rest", "auc", "module_component_correlation"),
    "proteins": ("proteins_one_vs_rest", "auc", "protein_component_correlation"),
}


def differential(data: Dataset, var: str, kind: str = "signatures") -> DataFrame:
    """A row for each feature of a kind, a column of AUC (Cramer's V for factors) for each level of ``var``."""
    result, stat, _ = KINDS[kind]
    rows = _need(data, result).where(F.col("var") == var)
    return rows.groupBy("feature").pivot("level").agg(F.first(stat))


def correlations(data: Dataset, kind: str = "signatures") -> DataFrame:
    """A row for each feature, a column for each component; signatures and metadata are one table."""
    return _need(data, KINDS[kind][2]).groupBy("feature").pivot("comp").agg(F.first("r"))


def protein_values(data: Dataset, name: str) -> DataFrame:
    """(cell, value) of a protein."""
    return data.proteins.where(F.col("feature") == name).select(F.col("id").alias("cell"), "value")


def meta_values(data: Dataset, name: str) -> DataFrame:
    """(cell, value) of a number or (cell, level) of a factor."""
    if data.numbers is not None and not (own := data.numbers.where(F.col("feature") == name)).isEmpty():
        return own.select(F.col("id").alias("cell"), "value")
    return cell_levels(data, name)


def module_values(data: Dataset, name: str) -> DataFrame:
    """(cell, score) of a module."""
    return _need(data, "module_scores").where(F.col("sig") == name).select("cell", "score")


def module_genes(data: Dataset, name: str) -> DataFrame:
    return data.modules.where(F.col("mod") == name).select("gene").distinct()


def module_local_correlation(data: Dataset, name: str) -> DataFrame:
    """(a, b, lc, z): the module's genes against each other among neighbouring cells."""
    logs = matrix.log2p1(data.expr.join(module_genes(data, name), "gene", "left_semi"))
    return graph.local_correlation(logs.select(F.col("cell").alias("id"), F.col("gene").alias("feature"), "value"), _need(data, "knn"))


def module_enrichment(data: Dataset) -> DataFrame:
    """(sig, mod, stat, p, assigned): every pair, and whether the module is the signature's own."""
    own = _need(data, "module_assignment").withColumn("assigned", F.lit(True))
    return _need(data, "module_enrichment").join(own, ["sig", "mod"], "left").select("sig", "mod", "stat", "p", F.coalesce("assigned", F.lit(False)).alias("assigned"))


def module_autocorrelation(data: Dataset) -> DataFrame:
    return _need(data, "module_autocorrelation").orderBy("p", F.desc("c"), "feature")


def protein_autocorrelation(data: Dataset) -> DataFrame:
    return _need(data, "protein_autocorrelation").orderBy("p", F.desc("c"), "feature")


def signature_groups(data: Dataset) -> DataFrame:
    """(feature, cluster) of signatures."""
    return _need(data, "signature_clusters")


def meta_groups(data: Dataset) -> DataFrame:
    return _need(data, "meta_clusters")


def protein_groups(data: Dataset) -> DataFrame:
    """(feature, cluster): proteins are all in cluster 1."""
    return data.proteins.select("feature").distinct().withColumn("cluster", F.lit(1))


def module_groups(data: Dataset) -> DataFrame:
    """(feature, cluster): the place of a module among all module names, of ``<sig>_OVERLAP_<mod>`` that of its module."""
    names = data.modules.select("mod").distinct()
    plain = names.where(~F.contains("mod", F.lit("_OVERLAP_"))).agg(F.sort_array(F.collect_list("mod")).alias("all"))
    own = F.element_at(F.split("mod", "_OVERLAP_"), -1)
    return names.crossJoin(F.broadcast(plain)).select(F.col("mod").alias("feature"), F.array_position("all", own).cast("int").alias("cluster"))


def gene_values(data: Dataset, gene: str) -> DataFrame:
    """(cell, value): log2(x + 1) of a gene in every cell, from the raw table where there is one."""
    source = data.raw if data.raw is not None else data.expr
    own = source.where(F.col("gene") == gene).select("cell", F.log2(F.col("value") + 1).alias("value"))
    return source.select("cell").distinct().join(own, "cell", "left").select("cell", F.coalesce("value", F.lit(0.0)).alias("value"))


def gene_list(data: Dataset) -> DataFrame:
    return (data.raw if data.raw is not None else data.expr).select("gene").distinct()


def signature_expression(data: Dataset, name: str, var: str) -> DataFrame:
    """(gene, level, mean, z): mean log expression of a signature's genes by level, and its z-score over levels."""
    logs = matrix.log2p1(data.expr).join(data.sigs.where(F.col("sig") == name).select("gene").distinct(), "gene", "left_semi")
    lev = data.factors.where(F.col("var") == var).select(F.col("id").alias("cell"), "level").join(data.expr.select("cell").distinct(), "cell", "left_semi")
    size = lev.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    mean = logs.join(lev, "cell").groupBy("gene", "level").agg(F.sum("value").alias("s")).join(size, "level").select("gene", "level", (F.col("s") / F.col("n")).alias("mean"))
    g = Window.partitionBy("gene")
    return mean.withColumn("z", (F.col("mean") - F.avg("mean").over(g)) / F.stddev_samp("mean").over(g))


def levels(data: Dataset) -> DataFrame:
    return data.factors.groupBy("var").agg(F.sort_array(F.collect_set("level")).alias("levels"))


def cell_levels(data: Dataset, var: str) -> DataFrame:
    return data.factors.where(F.col("var") == var).select(F.col("id").alias("cell"), "level")


def cell_metadata(data: Dataset, cell) -> DataFrame:
    num = data.numbers.where(F.col("id") == cell).select("feature", F.col("value").cast("string").alias("value")) if data.numbers is not None else None
    fac = data.factors.where(F.col("id") == cell).select(F.col("var").alias("feature"), F.col("level").alias("value")) if data.factors is not None else None
    return num.unionByName(fac) if num is not None and fac is not None else (num or fac)


def selection_numbers(data: Dataset, cells: DataFrame) -> DataFrame:
    """(feature, least, mid, most) of a selection (cell)."""
    own = data.numbers.join(cells.select(F.col("cell").alias("id")).distinct(), "id", "left_semi")
    return own.groupBy("feature").agg(F.min("value").alias("least"), F.median("value").alias("mid"), F.max("value").alias("most"))


def selection_factors(data: Dataset, cells: DataFrame) -> DataFrame:
    """(var, level, percent, entropy) of a selection, the commonest level first."""
    own = data.factors.join(cells.select(F.col("cell").alias("id")).distinct(), "id", "left_semi").groupBy("var", "level").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("var")
    share = F.col("n") / F.sum("n").over(w)
    out = own.withColumn("share", share)
    return out.select("var", "level", (100 * F.col("share")).alias("percent"), (-F.sum(F.col("share") * F.log2("share")).over(w)).alias("entropy")).orderBy("var", F.desc("percent"), "level")


def differential_expression(data: Dataset, numerator: DataFrame, denominator: DataFrame | None = None, min_cells: int = 0, subsample: int | None = None) -> DataFrame:
    """(gene, log_fc, auc, p, fdr) of a selection against another, or against all other cells."""
    cells = data.expr.select("cell").distinct()
    if subsample:
        numerator = contrast.subsample(numerator, subsample)
        rest = denominator if denominator is not None else cells.join(numerator, "cell", "left_anti")
        denominator = contrast.subsample(rest, subsample)
    return contrast.differential(data.raw if data.raw is not None else data.expr, contrast.groups_of(cells, numerator, denominator), min_cells)


def search(names: DataFrame, terms: str, col: str = "feature") -> DataFrame:
    """Names that hold any of the comma-separated terms and none of those that start with ``!``, in any case."""
    parts = [t.strip().lower() for t in terms.split(",") if t.strip()]
    want, bar = [t for t in parts if t[0] != "!"], [t[1:] for t in parts if t[0] == "!" and len(t) > 1]
    has = lambda ts: F.exists(F.array(*map(F.lit, ts)), lambda t: F.contains(F.lower(F.col(col)), t))
    out = names.where(has(want)) if want else names
    return out.where(~has(bar)) if bar else out


def histogram(values: DataFrame, bins: int = 40) -> DataFrame:
    """(feature, bin, n) over equal bins between a feature's extremes."""
    ends = values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return values.join(ends, "feature").groupBy("feature", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def add_signatures(data: Dataset, sigs: DataFrame, min_genes: int = 5, share: float = 0.01) -> DataFrame:
    """The dataset's signatures and new ones, processed at the stricter share."""
    new = score.process_signatures(sigs, data.expr, min_genes, share)
    return new if data.sigs is None else data.sigs.select("sig", "gene", "sign").unionByName(new)


def session_info(data: Dataset) -> DataFrame:
    spark = data.expr.sparkSession
    return spark.createDataFrame([(data.has("sigs"), data.has("numbers") or data.has("factors"), data.has("tree"), data.has("proteins"), data.has("pools"))], "signatures boolean, metadata boolean, tree boolean, proteins boolean, pools boolean")
