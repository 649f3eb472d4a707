"""Pools of like cells: coarse clusters split by k-means, and clusters of signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signascope.operators.graph import knn, louvain_levels, louvain_weights, saved

FANOUT = 16  # centres that one cluster is split into at a time
LEAST = 1e-3  # share of the spread that another iteration must take away
WHOLE = 1 << 16  # cells of a cluster that one task splits by itself, 32 MB of 64 coordinates


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``centres`` is nearest to each row of ``x``, the first of equally near ones, and its squared distance."""
    at, best = np.zeros(len(x), int), np.full(len(x), np.inf)
    for k, c in enumerate(centres):
        d = x - c
        d = np.einsum("ij,ij->i", d, d)
        closer = d < best
        at[closer], best[closer] = k, d[closer]
    return at, best


def _sums(x: np.ndarray, at: np.ndarray, many: int) -> np.ndarray:
    """Sum of the rows of ``x`` by number, and how many there are in a last column."""
    return (np.arange(many)[:, None] == at) @ np.column_stack([x, np.ones(len(x))])


class _Lloyd:
    """Lloyd's iterations of one cluster: from its first cells, until another takes away less than LEAST of the spread."""

    def __init__(self, first: np.ndarray, rounds: int):
        self.centres, self.names, self.spread, self.left = first, np.arange(1, len(first) + 1), None, rounds

    def next(self, sums: np.ndarray, spread: float) -> bool:
        """Takes the means of what is nearest to each centre; False, and no change, if that was the last iteration."""
        self.left -= 1
        if self.left <= 0 or (self.spread is not None and spread >= self.spread * (1 - LEAST)):
            return False
        used = sums[:, -1] > 0
        self.spread, self.names, self.centres = spread, self.names[used], sums[used, :-1] / sums[used, -1:]
        return True


def _vectors(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _split_whole(points: DataFrame, wanted: DataFrame, rounds: int, parts: int) -> DataFrame:
    """Clusters of ``wanted`` (cluster, centres), each split by one task."""

    def one(table):
        table = table.combine_chunks().sort_by([("h", "ascending"), ("id", "ascending")]).combine_chunks()
        x, k = _vectors(table.column("vec").chunk(0)), table.column("centres")[0].as_py()
        lloyd = _Lloyd(x[:k], rounds)
        while True:
            at, d = _nearest(x, lloyd.centres)
            if not lloyd.next(_sums(x, at, len(lloyd.centres)), d.sum()):
                break
        name = table.column("cluster")[0].as_py()
        names = pa.array([f"{name}.{k}" for k in lloyd.names.tolist()], pa.string()).take(pa.array(at))
        return pa.table({"id": table.column("id"), "cluster": names, "vec": table.column("vec"), "h": table.column("h")})

    return points.join(wanted, "cluster").repartition(parts, "cluster").groupBy("cluster").applyInArrow(one, points.schema)


def _split_large(points: DataFrame, wanted: dict[str, int], rounds: int) -> DataFrame:
    """Large clusters of ``wanted`` (centres by name), split by all tasks: an iteration is a job that sends sums by centre."""
    spark, points = points.sparkSession, saved(points.where(F.col("cluster").isin(list(wanted))))

    def by_cluster(b, some):
        of = b.column("cluster").dictionary_encode()
        for k, name in enumerate(of.dictionary.to_pylist()):
            if name in some:
                yield name, np.flatnonzero(np.asarray(of.indices) == k)

    def first(batches):
        """Of each cluster the first cells of a task by md5 and id."""
        held = {}
        for b in batches:
            for name, at in by_cluster(b, wanted):
                t = pa.Table.from_batches([b.take(pa.array(at))])
                t = pa.concat_tables([held[name], t]) if name in held else t
                held[name] = t.sort_by([("h", "ascending"), ("id", "ascending")]).slice(0, wanted[name]).combine_chunks()
        for t in held.values():
            yield from t.to_batches()

    found = points.mapInArrow(first, points.schema).toArrow().sort_by([("h", "ascending"), ("id", "ascending")]).to_pylist()
    lloyds = {c: _Lloyd(np.array([r["vec"] for r in found if r["cluster"] == c][:k], float), rounds) for c, k in wanted.items()}
    going = set(wanted)
    while going:
        sent = spark.sparkContext.broadcast({c: lloyds[c].centres for c in going})

        def sums(batches):
            total = {}
            for b in batches:
                x = _vectors(b.column("vec"))
                for name, at in by_cluster(b, sent.value):
                    near, d = _nearest(x[at], sent.value[name])
                    old = total.get(name, (0.0, 0.0))
                    total[name] = old[0] + _sums(x[at], near, len(sent.value[name])), old[1] + d.sum()
            for name, (s, d) in total.items():
                yield pa.RecordBatch.from_pydict({"cluster": [name], "sums": pa.array([s.reshape(-1)], pa.list_(pa.float64())), "spread": [float(d)]})

        made = {}
        for r in points.mapInArrow(sums, "cluster string, sums array<double>, spread double").toArrow().to_pylist():
            made.setdefault(r["cluster"], []).append((r["spread"], np.array(r["sums"])))
        sent.destroy()
        for c in list(going):
            # in an order of their own, so that the order of tasks does not decide
            tasks = sorted(made[c], key=lambda t: (t[0], t[1][0]))
            if not lloyds[c].next(sum(t[1] for t in tasks).reshape(len(lloyds[c].centres), -1), sum(t[0] for t in tasks)):
                going.remove(c)
    sent = spark.sparkContext.broadcast({c: (x.centres, x.names) for c, x in lloyds.items()})

    def named(batches):
        for b in batches:
            x, names = _vectors(b.column("vec")), np.zeros(b.num_rows, object)
            for name, at in by_cluster(b, sent.value):
                centres, own = sent.value[name]
                names[at] = np.array([f"{name}.{k}" for k in own.tolist()], object)[_nearest(x[at], centres)[0]]
            yield b.set_column(b.schema.get_field_index("cluster"), "cluster", pa.array(names.tolist(), pa.string()))

    return points.mapInArrow(named, points.schema)


def split_clusters(latent: DataFrame, clusters: DataFrame, cells: int = 100, slack: float = 0.15, rounds: int = 100) -> DataFrame:
    """(id, cluster): ``clusters`` (id, cluster) split until there are about as many as there are times ``cells`` cells.

    As long as there are fewer than (1 - ``slack``) of that number, each cluster of more than ``cells`` cells is split by k-means
    into its size over ``cells``, at most ``FANOUT`` at a time, so that a cell is held against a bounded number of
    centres however large its cluster is.  A cluster of up to ``WHOLE`` cells is split by one task, all at once; a larger one is
    worked on by all tasks.  Clusters of equal cells stay whole.
    """
    h = F.md5(F.col("id").cast("string").cast("binary"))
    points = latent.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")).join(clusters.select("id", F.col("cluster").cast("string").alias("cluster")), "id")
    points = saved(points.select("id", "cluster", "vec", h.alias("h")))
    size = saved(points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
    now, n = size.agg(F.count(F.lit(1)), F.sum("n")).first()
    target = round((n or 0) / cells)
    parts = max(4 * points.sparkSession.sparkContext.defaultParallelism, (n or 0) // WHOLE)
    while now < (1 - slack) * target:
        wanted = size.where(F.col("n") > cells).select("cluster", "n", F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.round(F.col("n") / cells))).cast("int").alias("centres"))
        large = {r["cluster"]: r["centres"] for r in wanted.where(F.col("n") > WHOLE).collect()}
        split = _split_whole(points, wanted.where(F.col("n") <= WHOLE).select("cluster", "centres"), rounds, parts)
        if large:
            split = split.unionByName(_split_large(points, large, rounds))
        points = saved(split.unionByName(points.join(wanted.select("cluster"), "cluster", "left_anti").select(*points.columns)))
        size = saved(points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
        before, now = now, size.count()
        if now == before:
            break
    return points.select("id", "cluster")


def micro_clusters(latent: DataFrame, cells: int = 10, neighbours: int | None = None) -> DataFrame:
    """(pool, cell): pools of about ``cells`` cells, communities of the neighbour graph split by k-means."""
    k = neighbours or max(1, round(latent.count() ** 0.5))
    coarse = louvain_levels(louvain_weights(knn(latent, min(k, 30))))
    fine = split_clusters(latent, coarse, cells)
    return fine.select(F.concat(F.lit("microcluster_"), "cluster").alias("pool"), F.col("id").alias("cell"))


def signature_clusters(values: DataFrame, auto: DataFrame, fdr: float = 0.05, least: float = 0.2, most: int = 15) -> DataFrame:
    """(feature, cluster): features (id, feature, value) whose autocorrelation (feature, c, fdr) is significant, in clusters of like ones.

    Up to five are one cluster; more are a mixture of spherical Gaussians over z-normalised cells, with the number of
    components (at most ``most``) by BIC.  Features that are not significant have the number after the last.  Spark makes
    the correlations; the mixture needs these only, a number for each pair of features.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    spark = values.sparkSession
    names = [r["feature"] for r in values.select("feature").distinct().join(auto, "feature").where((F.col("fdr") < fdr) & (F.col("c") > least)).select("feature").orderBy("feature").collect()]
    if len(names) > 5:
        wide = values.where(F.col("feature").isin(names)).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda e: e["value"]).alias("v"))
        wide = wide.where(F.size("v") == len(names))
        corr = Correlation.corr(wide.select(array_to_vector("v").alias("v")), "v").first()[0].toArray()
        label = spherical_mixture(np.nan_to_num(corr), wide.count(), most)
    else:
        label = np.ones(len(names), int)
    found = spark.createDataFrame(list(zip(names, (int(x) for x in label))), "feature string, cluster int")
    rest = int(label.max(initial=1)) + 1
    return values.select("feature").distinct().join(found, "feature", "left").select("feature", F.coalesce("cluster", F.lit(rest)).alias("cluster"))


def spherical_mixture(corr: np.ndarray, cells: int, most: int) -> np.ndarray:
    """Number (from 1, by first member) of the component of each of m vectors of length ``cells`` with mean 0 and deviation 1.

    All components have one variance; EM runs on inner products, from Ward's clusters; the largest BIC decides.
    """
    m, gram = len(corr), corr * (cells - 1)
    square = np.maximum(np.add.outer(np.diag(gram), np.diag(gram)) - 2 * gram, 0)
    # Ward: merge the pair whose union adds least to the sum of squares
    groups, cost = [[k] for k in range(m)], square / 2
    cost[np.diag_indices(m)] = np.inf
    alive, cuts = list(range(m)), {m: [[k] for k in range(m)]}
    while len(alive) > 1:
        sub = cost[np.ix_(alive, alive)]
        a, b = (alive[x] for x in np.unravel_index(np.argmin(sub), sub.shape))
        na, nb = len(groups[a]), len(groups[b])
        for c in alive:
            if c not in (a, b):
                nc = len(groups[c])
                cost[a, c] = cost[c, a] = ((na + nc) * cost[a, c] + (nb + nc) * cost[b, c] - nc * cost[a, b]) / (na + nb + nc)
        groups[a] = groups[a] + groups[b]
        alive.remove(b)
        cuts[len(alive)] = [list(groups[x]) for x in alive]
    best, chosen = -np.inf, np.zeros(m, int)
    for g in range(1, min(most, m - 1) + 1):
        z = np.zeros((m, g))
        for k, members in enumerate(cuts[g]):
            z[members, k] = 1
        previous = -np.inf
        for _ in range(200):
            w = z / np.maximum(z.sum(0), 1e-12)
            far = np.maximum(np.diag(gram)[:, None] - 2 * gram @ w + np.einsum("ik,ij,jk->k", w, gram, w), 0)
            var = (z * far).sum() / (m * cells)
            if var < 1e-9:  # components that hold equal vectors only have no likelihood
                break
            log = np.log(np.maximum(z.mean(0), 1e-300)) - cells / 2 * np.log(2 * np.pi * var) - far / (2 * var)
            top = log.max(1, keepdims=True)
            each = top[:, 0] + np.log(np.exp(log - top).sum(1))
            z = np.exp(log - each[:, None])
            if each.sum() - previous < 1e-8 * abs(previous):
                break
            previous = each.sum()
        if var < 1e-9:
            break
        bic = 2 * each.sum() - (g - 1 + g * cells + 1) * np.log(m)
        if bic > best:
            best, chosen = bic, z.argmax(1)
    order = {c: k + 1 for k, c in enumerate(dict.fromkeys(chosen.tolist()))}
    return np.array([order[c] for c in chosen.tolist()])


def meta_clusters(factors: DataFrame, features: DataFrame, by_factor: bool = False) -> DataFrame:
    """(feature, cluster): metadata all in cluster 1, or each factor and its ``<factor>_<level>`` features in one of its own."""
    every = features.select("feature").unionByName(factors.select(F.col("var").alias("feature"))).distinct()
    if not by_factor:
        return every.withColumn("cluster", F.lit(1))
    own = factors.select("var").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("var")) + 1).cast("int"))
    named = factors.select("var", F.explode(F.array("var", F.concat_ws("_", "var", "level"))).alias("feature")).distinct().join(own, "var")
    return every.join(named.groupBy("feature").agg(F.min("cluster").alias("cluster")), "feature", "left").select("feature", F.coalesce("cluster", F.lit(1)).alias("cluster"))
