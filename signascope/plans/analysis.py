"""The whole analysis over a bundle of tables, in the engine's order of stages.

Tables are absent (None) or long DataFrames; nothing is changed in place: ``analyze`` returns a new bundle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.functions import stats
from signascope.operators import background, contrast, graph, latent, matrix, pools, score, trajectory
from signascope.operators import tree as trees

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Parameters:
    """What changes results, with the engine's defaults."""

    normalisation: str = "znorm_columns"
    filter: str = "fano"
    threshold: float = 0.05
    num_mad: float = 2
    min_signature_genes: int = 5
    gene_share: float = 0.001
    components: int = 30
    neighbours: int | None = None  # the root of the number of cells
    cluster_neighbours: int = 30
    permutations: int = 3000
    null_size: int = 3000
    max_levels: int = 50
    max_text_levels: int = 20
    pool_above: int = 100_000  # cells beyond which they are pooled when no pools are given
    cells_per_pool: int = 10


@dataclass(frozen=True)
class Dataset:
    """expr (cell, gene, value), sigs (sig, gene, sign), numbers and proteins (id, feature, value), factors (id, var, level), modules
    (mod, gene), latent (id, vec), tree (node, parent) with the cells as tips, pools (pool, cell), milestones (a, b, length) and
    progressions (cell, a, b, position) of a trajectory."""

    expr: DataFrame
    sigs: DataFrame | None = None
    numbers: DataFrame | None = None
    factors: DataFrame | None = None
    proteins: DataFrame | None = None
    modules: DataFrame | None = None
    latent: DataFrame | None = None
    tree: DataFrame | None = None
    raw: DataFrame | None = None
    pools: DataFrame | None = None
    milestones: DataFrame | None = None
    progressions: DataFrame | None = None
    params: Parameters = field(default_factory=Parameters)
    results: dict[str, DataFrame] = field(default_factory=dict)

    def has(self, table: str) -> bool:
        return getattr(self, table) is not None

    def __repr__(self) -> str:
        there = [t for t in ("sigs", "numbers", "factors", "proteins", "modules", "latent", "tree", "raw", "pools", "milestones", "progressions") if self.has(t)]
        return f"Dataset(expr with {', '.join(there) or 'nothing else'}; results: {', '.join(self.results) or 'none'})"


def validated(data: Dataset) -> Dataset:
    """Raises on negative entries, on tables of unknown cells or genes, and where cells lack a place; of repeated (cell, gene)
    entries all copies go."""
    if not data.expr.where("value < 0").isEmpty():
        raise ValueError("expression holds negative entries")
    once = data.expr.groupBy("cell", "gene").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    cells = once.select(F.col("cell").alias("id")).distinct()
    for name in ("numbers", "factors", "proteins", "latent"):  # a row for each cell, or some for each
        table = getattr(data, name)
        if table is not None and not cells.join(table, "id", "left_anti").isEmpty():
            raise ValueError(f"{name} lack cells of the expression table")
    for name, table, col in (("the tree", data.tree, "node"), ("the pools", data.pools, "cell"), ("the trajectory", data.progressions, "cell")):
        if table is not None and not cells.join(table.select(F.col(col).alias("id")), "id", "left_anti").isEmpty():
            raise ValueError(f"{name} lack cells of the expression table")
    if data.modules is not None and data.modules.join(once.select("gene").distinct(), "gene", "left_semi").isEmpty():
        raise ValueError("no module has a gene of the expression table")
    if data.progressions is not None:
        data = replace(data, progressions=trajectory.validated(data.milestones, data.progressions))
    return replace(data, expr=once)


def metadata(wide: DataFrame, id_col: str, max_text_levels: int = 20) -> tuple[DataFrame, DataFrame]:
    """(numbers, factors) of a wide table: text with at most ``max_text_levels`` values and booleans are factors, other text is left out."""
    kinds = {c: t for c, t in wide.dtypes if c != id_col}
    text = [c for c, t in kinds.items() if t == "string"]
    counts = wide.agg(*[F.count_distinct(c).alias(c) for c in text]).first().asDict() if text else {}
    labels = [c for c in text if counts[c] <= max_text_levels] + [c for c, t in kinds.items() if t == "boolean"]
    numeric = [c for c, t in kinds.items() if t.startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal"))]
    spark = wide.sparkSession
    ident = F.col(id_col).alias("id")
    num = wide.select(ident, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot("id", numeric, "feature", "value") if numeric else spark.createDataFrame([], f"id {dict(wide.dtypes)[id_col]}, feature string, value double")
    fac = wide.select(ident, *[F.col(c).cast("string").alias(c) for c in labels]).unpivot("id", labels, "var", "level") if labels else spark.createDataFrame([], f"id {dict(wide.dtypes)[id_col]}, var string, level string")
    return num, fac


def pooled(data: Dataset) -> Dataset:
    """All tables averaged over pools (pool, cell); factors keep the level of at least half a pool, else ``~``."""
    p = data.pools
    as_cell = lambda df: df.withColumnRenamed("id", "cell")
    out = {"expr": matrix.pool_matrix(data.expr, p).withColumnRenamed("pool", "cell")}
    if data.numbers is not None:
        out["numbers"] = matrix.pool_numbers(as_cell(data.numbers).withColumnRenamed("feature", "var"), p).select(F.col("pool").alias("id"), F.col("var").alias("feature"), "value")
    if data.factors is not None:
        out["factors"] = matrix.pool_factors(as_cell(data.factors), p).withColumnRenamed("pool", "id")
    if data.latent is not None:
        flat = data.latent.select(F.col("id").alias("cell"), F.posexplode("vec")).join(p, "cell").groupBy("pool", "pos").agg(F.avg("col").alias("x"))
        out["latent"] = flat.groupBy(F.col("pool").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vec"))
    return replace(data, **out)


def latent_space(data: Dataset) -> Dataset:
    """Principal components of the filtered log matrix, unless a latent space is given."""
    if data.latent is not None:
        return data
    p, logs = data.params, matrix.log2p1(data.expr)
    genes = matrix.projection_genes(data.expr, None, p.filter, p.threshold, p.num_mad)
    scores, _ = latent.pca(logs, genes, p.components)
    vec = F.transform(F.sort_array(F.collect_list(F.struct("comp", "coord"))), lambda e: e["coord"])
    return replace(data, latent=scores.groupBy(F.col("cell").alias("id")).agg(vec.alias("vec")))


def size_groups(sigs: DataFrame, groups: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sig, grp) and (grp, k, balance): signatures in up to ``groups`` clusters of log size and balance, each with its rounded size.

    Lloyd's iterations from the smallest signature and then always the one farthest from all centres, so that runs agree;
    groups are numbered by size and balance.
    """
    s = sigs.groupBy("sig").agg(F.log10(F.count(F.lit(1))).alias("n"), F.avg((F.col("sign") >= 0).cast("double")).alias("u"))
    s = graph.saved(s.select("sig", "n", F.greatest("u", 1 - F.col("u")).alias("b")))
    first = s.orderBy("n", "b", "sig").first()
    centres = [(first["n"], first["b"])] if first else []
    far = lambda: F.array_min(F.array(*[F.pow(F.col("n") - x, 2) + F.pow(F.col("b") - y, 2) for x, y in centres]))
    while 0 < len(centres) < groups:
        r = s.withColumn("d", far()).orderBy(F.desc("d"), "sig").first()
        if r["d"] <= 0:
            break
        centres.append((r["n"], r["b"]))
    for _ in range(100):
        at = F.array_min(F.array(*[F.struct((F.pow(F.col("n") - x, 2) + F.pow(F.col("b") - y, 2)).alias("d"), F.lit(k).alias("k")) for k, (x, y) in enumerate(centres)]))["k"]
        mean = {r["k"]: (r["n"], r["b"]) for r in s.groupBy(at.alias("k")).agg(F.avg("n").alias("n"), F.avg("b").alias("b")).collect()}
        new = [mean.get(k, c) for k, c in enumerate(centres)]
        if max((abs(a - b) for x, y in zip(new, centres) for a, b in zip(x, y)), default=0.0) < 1e-12:
            break
        centres = new
    place = {k: g for g, k in enumerate(sorted(range(len(centres)), key=lambda k: centres[k]), 1)}
    at = F.array_min(F.array(*[F.struct((F.pow(F.col("n") - x, 2) + F.pow(F.col("b") - y, 2)).alias("d"), F.lit(place[k]).alias("grp")) for k, (x, y) in enumerate(centres)]))["grp"]
    rows = [(place[k], round(10 ** x), float(y)) for k, (x, y) in enumerate(centres)]
    return s.select("sig", at.alias("grp")), s.sparkSession.createDataFrame(sorted(rows), "grp int, k int, balance double")


def signature_autocorrelation(data: Dataset, sigs: DataFrame, logs: DataFrame, scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, c, p): autocorrelation of signatures (or modules) against random signatures of like size and balance."""
    p = data.params
    member, groups = size_groups(score.weights(sigs, data.expr).withColumnRenamed("w", "sign"))
    entries, cells, genes = score.scaled(logs, p.normalisation)
    null = background.random_autocorrelation(entries, cells, genes, edges, [tuple(r) for r in groups.collect()], p.null_size)
    observed = graph.autocorrelation(as_values(scores), edges)
    at = graph.saved(observed.join(member.withColumnRenamed("sig", "feature"), "feature"))
    # a signature's count is that of its group's random ones which reach it
    reached = at.join(graph.saved(null), "grp").groupBy("feature").agg(F.sum((F.col("bg") >= F.col("c")).cast("long")).alias("n"), F.count(F.lit(1)).alias("of"))
    return at.join(reached, "feature").select("feature", "c", ((F.col("n") + 1) / (F.col("of") + 1)).alias("p"))


def as_values(scores: DataFrame) -> DataFrame:
    return scores.select(F.col("cell").alias("id"), F.col("sig").alias("feature"), F.col("score").alias("value"))


def neighbour_graph(data: Dataset) -> DataFrame:
    """(i, j, rank, dist, w): the cells' neighbours by edges of the tree where there is one, else in the latent space."""
    p = data.params
    if data.tree is not None:
        tip = trees.tips(data.tree)
        k = p.neighbours or max(1, round(tip.count() ** 0.5))
        return graph.weights(trees.tree_knn(graph.saved(trees.closure(data.tree)), tip, k))
    k = p.neighbours or max(1, round(data.latent.count() ** 0.5))
    return graph.weights(graph.knn(data.latent, k))


def trajectory_graph(edges: DataFrame, progressions: DataFrame, k: int | None = None) -> DataFrame:
    """(i, j, rank, dist, w): the cells' neighbours along a trajectory."""
    k = k or max(1, round(progressions.count() ** 0.5))
    return graph.weights(trajectory.knn(edges, progressions, k))


def protein_autocorrelation(proteins: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, c, p, fdr): autocorrelation of protein abundances (id, feature, value); no permutations, so p and FDR are 1."""
    return graph.autocorrelation(proteins, edges).select("feature", "c", F.lit(1.0).alias("p"), F.lit(1.0).alias("fdr"))


def comparisons(data: Dataset, scores: DataFrame | None, modules: DataFrame | None, numbers: DataFrame | None, factors: DataFrame) -> dict[str, DataFrame]:
    """Each level of each factor against the rest: signatures and modules without ties, metadata together, proteins with ties."""
    out = {}
    if scores is not None:
        out["one_vs_rest"] = contrast.one_vs_rest(as_values(scores), factors)
    if modules is not None:
        out["modules_one_vs_rest"] = contrast.one_vs_rest(as_values(modules), factors)
    if numbers is not None:
        out["meta_one_vs_rest"] = contrast.meta_comparison(numbers, factors, factors)
    if data.proteins is not None:
        out["proteins_one_vs_rest"] = contrast.one_vs_rest(data.proteins, factors, ties=True)
    return out


def significant(auto: DataFrame, fdr: float = 0.05, least: float = 0.2) -> DataFrame:
    """Features whose FDR is under ``fdr`` and whose autocorrelation is over ``least``."""
    return auto.where((F.col("fdr") < fdr) & (F.col("c") > least))


def automatic_pools(data: Dataset) -> Dataset:
    """``data`` with pools of about ``cells_per_pool`` cells where it has more than ``pool_above`` and none are given."""
    if data.pools is not None or data.tree is not None or data.expr.select("cell").distinct().count() <= data.params.pool_above:
        return data
    own = latent_space(data)
    return replace(own, pools=graph.saved(pools.micro_clusters(own.latent, data.params.cells_per_pool)))


def consistency(data: Dataset, logs: DataFrame, scores: DataFrame | None, numbers: DataFrame | None, factors: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """(feature, c, p, fdr, kind) of signatures, numbers and factors on one graph; their p-values are adjusted together."""
    tested = []
    if scores is not None:
        tested.append(signature_autocorrelation(data, data.sigs, logs, scores, edges).withColumn("kind", F.lit("signature")))
    if factors is not None:
        tested.append(graph.factor_association(factors, edges).select(F.col("var").alias("feature"), F.col("v").alias("c"), "p", F.lit("factor").alias("kind")))
    if numbers is not None:
        tested.append(graph.permutation_p(numbers, edges, data.params.permutations).withColumn("kind", F.lit("number")))
    if not tested:
        return None
    every = tested[0]
    for more in tested[1:]:
        every = every.unionByName(more)
    return graph.saved(stats.bh(every, "p", [], ["feature"]))


def analyze(data: Dataset) -> Dataset:
    """All stages that the tables allow; results are DataFrames by name."""
    data = automatic_pools(validated(data))
    if data.pools is not None:
        data = pooled(data)
    data = latent_space(data)
    p, out = data.params, {}
    edges = graph.saved(neighbour_graph(data))
    out["knn"], out["latent"] = edges, data.latent
    near = edges if data.tree is None else graph.knn(data.latent, p.cluster_neighbours)
    out["clusters"] = graph.louvain_levels(graph.louvain_weights(near.where(F.col("rank") <= p.cluster_neighbours)))
    logs = matrix.log2p1(data.expr)
    coords = data.latent.select("id", F.posexplode("vec")).select("id", (F.col("pos") + 1).alias("comp"), F.col("col").alias("coord"))
    values = []
    if data.sigs is not None:
        data = replace(data, sigs=score.split_directions(score.process_signatures(data.sigs, data.expr, p.min_signature_genes, p.gene_share)))
        out["scores"] = graph.saved(score.scores(logs, data.sigs, p.normalisation))
        out["gene_importance"] = score.gene_importance(logs, data.sigs, out["scores"], p.normalisation)
        values.append(as_values(out["scores"]))
    numbers = data.numbers
    if data.tree is not None and data.factors is not None:
        up = graph.saved(trees.closure(data.tree))
        for r in data.factors.select("var").distinct().collect():  # one trait at a time; there are few
            own = data.factors.where(F.col("var") == r["var"]).select(F.col("id").alias("node"), "level")
            tip = trees.plasticity(data.tree, trees.node_scores(trees.fitch_sets(data.tree, own, up), up), up)
            named = graph.saved(tip.select(F.col("node").alias("id"), F.lit(r["var"] + "_plasticity").alias("feature"), F.col("plasticity").alias("value")))
            numbers = named if numbers is None else numbers.unionByName(named)
    factors = None
    if data.factors is not None:
        eligible = data.factors.groupBy("var").agg(F.count_distinct("level").alias("n")).where(f"n > 1 and n <= {p.max_levels}").select("var")
        factors = data.factors.join(eligible, "var", "left_semi")
        out["factor_autocorrelation"] = graph.factor_association(factors, edges)
    if numbers is not None:
        out["numbers"] = numbers
        values.append(numbers)
    every = consistency(data, logs, out.get("scores"), numbers, factors, edges)
    if every is not None:
        out["signature_autocorrelation"] = every.where("kind = 'signature'").drop("kind")
        out["meta_autocorrelation"] = every.where("kind <> 'signature'").drop("kind")
    if values:
        numeric = values[0] if len(values) == 1 else values[0].unionByName(values[1])
        out["signature_clusters"] = pools.signature_clusters(numeric, every)
        out["component_correlation"] = latent.correlations(numeric, coords)
    if data.progressions is not None:
        along = graph.saved(trajectory_graph(data.milestones, data.progressions, p.neighbours))
        found = consistency(data, logs, out.get("scores"), numbers, factors, along)
        out["trajectory_knn"], out["trajectory_meta"] = along, trajectory.metadata(data.progressions)
        if found is not None:
            out["trajectory_signature_autocorrelation"] = found.where("kind = 'signature'").drop("kind")
            out["trajectory_meta_autocorrelation"] = found.where("kind <> 'signature'").drop("kind")
        if values:
            out["trajectory_signature_clusters"] = pools.signature_clusters(numeric, found)
        if data.proteins is not None:
            out["trajectory_protein_autocorrelation"] = protein_autocorrelation(data.proteins, along)
    modules = None
    if data.modules is not None:
        signed = data.modules.select(F.col("mod").alias("sig"), "gene", F.lit(1.0).alias("sign"))
        modules = out["module_scores"] = graph.saved(score.scores(logs, signed, p.normalisation))
        out["module_importance"] = score.gene_importance(logs, signed, modules, p.normalisation)
        auto = graph.saved(signature_autocorrelation(data, signed, logs, modules, edges))
        out["module_autocorrelation"] = stats.bh(auto, "p", [], ["feature"])
        out["module_component_correlation"] = latent.correlations(as_values(modules), coords)
        if data.sigs is not None:
            sets = contrast.directional_sets(data.sigs)
            out["module_enrichment"] = contrast.enrichment(sets, data.modules, data.expr.select("gene").distinct().count())
            out["module_assignment"] = contrast.best_module(out["module_enrichment"])
    if data.proteins is not None:
        out["protein_autocorrelation"] = protein_autocorrelation(data.proteins, edges)
        out["protein_component_correlation"] = latent.correlations(data.proteins, coords)
    if factors is not None:
        out |= comparisons(data, out.get("scores"), modules, numbers, factors)
        if numbers is not None:
            out["meta_clusters"] = pools.meta_clusters(factors, numbers.select("feature").distinct())
    return replace(data, results={**data.results, **out})
