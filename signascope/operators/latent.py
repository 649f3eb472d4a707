"""Latent spaces: principal components, correlations with components, low-dimensional layouts."""

from __future__ import annotations

from math import gcd
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.functions.tables import saved, summed


def vectors(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell, gene index, value) entries of chosen genes as (cell, idx, val) sparse rows; ``genes``: (gene)."""
    order = genes.select("gene").distinct().orderBy("gene").collect()
    index = expr.sparkSession.createDataFrame([(r["gene"], k) for k, r in enumerate(order)], "gene string, k int")
    rows = expr.join(F.broadcast(index), "gene").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("e"))
    return rows.select("cell", F.col("e.k").alias("idx"), F.col("e.value").alias("val"))


def pca(expr: DataFrame, genes: DataFrame, components: int = 30, extra: int = 10, tolerance: float = 1e-9, rounds: int = 30) -> tuple[DataFrame, np.ndarray]:
    """(cell, comp, coord) scores of the centred matrix, and the share of variance of each component.

    A randomised range finder: a gene x width block goes through the covariance, in one pass over the cells in which a task
    multiplies its rows (still sparse) and sends one gene x width sum; what is new in the image is the next block.  The
    components are those of the space that all blocks span, and the passes end when their residuals are under ``tolerance`` of
    the total variance, or the blocks span all genes; ValueError if neither comes in ``rounds``.  No gene x gene matrix is
    made; the driver holds genes x (components + extra) numbers a pass.  Of each loading the largest entry is positive.
    """
    rows = saved(vectors(expr, genes))
    g = genes.select("gene").distinct().count()
    width = min(g, components + extra)

    def through(block: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums over cells of x (x block), and of (1, x, |x|^2) in the first pass."""

        def product(batches):
            total, s, n, ss = (None if block is None else np.zeros(block.shape)), np.zeros(g), 0, 0.0
            for b in batches:
                lens = np.fromiter(map(len, b["idx"]), np.int64, len(b))
                idx = np.concatenate([*b["idx"], []]).astype(np.int64)
                val = np.concatenate([*b["val"], []])
                n += len(b)
                if block is None:
                    s += np.bincount(idx, val, g)
                    ss += float(val @ val)
                    continue
                for c, (i, v) in enumerate(zip(np.split(idx, np.cumsum(lens)[:-1]), np.split(val, np.cumsum(lens)[:-1]))):
                    total[i] += np.outer(v, v @ block[i])
            if block is None:
                yield pd.DataFrame({"k": [0], "row": [np.concatenate([[n, ss], s])]})
            else:
                yield pd.DataFrame({"k": np.arange(block.shape[1]), "row": list(total.T)})

        length = g + 2 if block is None else g
        parts = rows.mapInPandas(product, "k int, row array<double>")
        return np.array([r["row"] for r in summed(parts, ["k"], "row", length).orderBy("k").collect()])

    first = through(None)
    if not len(first) or not first[0][0] or not g:
        return expr.sparkSession.createDataFrame([], f"cell {expr.schema['cell'].dataType.simpleString()}, comp int, coord double"), np.zeros(0)
    n, center = first[0][0], first[0][2:] / first[0][0]
    whole = first[0][1] - n * float(center @ center)
    block = np.linalg.qr(np.random.default_rng(g).normal(size=(g, width)))[0]
    basis, images = np.zeros((g, 0)), np.zeros((g, 0))
    for _ in range(rounds):
        image = through(block).T - n * np.outer(center, center @ block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        val, turn = np.linalg.eigh(basis.T @ images)
        val, turn = val[::-1][:components], turn[:, ::-1][:, :components]
        vec = basis @ turn
        rest = np.linalg.norm(images @ turn - vec * val, axis=0)
        if basis.shape[1] == g or rest.max() <= tolerance * max(whole, 1e-300):
            break
        new = image
        for _ in range(2):  # once more for what rounding leaves
            new = new - basis @ (basis.T @ new)
        left, size, _ = np.linalg.svd(new, full_matrices=False)
        block = left[:, (size > 1e-13 * max(whole, 1e-300))][:, : g - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:
            break
    else:
        raise ValueError(f"components have not settled in {rounds} passes")
    val, vec = val[:components], vec[:, :components]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])

    def project(batches):
        for b in batches:
            y = np.array([v @ vec[i.astype(np.int64)] for i, v in zip(b["idx"], b["val"])]).reshape(len(b), -1) - center @ vec
            yield pd.DataFrame({"cell": np.repeat(b["cell"].to_numpy(), y.shape[1]), "comp": np.tile(np.arange(1, y.shape[1] + 1), len(y)), "coord": y.ravel()})

    kind = expr.schema["cell"].dataType.simpleString()
    return rows.mapInPandas(project, f"cell {kind}, comp int, coord double"), val / max(whole, 1e-300)


def _numbered(cells: DataFrame) -> DataFrame:
    """(cell, place): each cell's place from 0 in the written table, from the sizes of its partitions instead of one sort in one task."""
    parts = saved(cells).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = parts.sparkSession.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes], "_part int, before long")
    return parts.join(F.broadcast(before), "_part").select("cell", (F.col("before") + F.col("_row")).alias("place"))


def permutation_components(expr: DataFrame, genes: DataFrame, components: int = 50, times: int = 20, level: float = 0.05, least: int = 5) -> int:
    """How many components hold more variance than in gene-wise permuted data (z-test of the share), ``least`` at least.

    A gene's cells are permuted by place -> place x step + shift modulo their number, with steps that share no factor with it.
    """
    _, real = pca(expr, genes, components)
    cells = saved(_numbered(expr.select("cell").distinct()))
    n = cells.count()
    steps = [k for k in np.random.default_rng(n).integers(1, max(2, n), 400).tolist() if gcd(k, n) == 1][:64] or [1]
    null = []
    for t in range(times):
        step = F.array(*map(F.lit, steps))[F.pmod(F.xxhash64("gene", F.lit(-t - 1)), F.lit(len(steps))).cast("int")]
        spot = F.pmod(F.pmod(F.xxhash64("gene", F.lit(t)), F.lit(n)) + F.col("place") * step, F.lit(n))
        dealt = expr.join(cells, "cell").withColumn("place", spot).drop("cell").join(cells, "place").select("cell", "gene", "value")
        null.append(pca(dealt, genes, components)[1])
    null = np.array(null)
    z = (real - null.mean(0)) / np.maximum(null.std(0, ddof=1), 1e-12)
    over = np.flatnonzero(z < NormalDist().inv_cdf(1 - level))
    return max(least, int(over[0]) if len(over) else len(real))


def correlations(values: DataFrame, latent: DataFrame) -> DataFrame:
    """(feature, comp, r): Pearson correlation of each feature (id, feature, value) with each component (id, comp, coord), 0 where it is not defined."""
    return values.join(latent, "id").groupBy("feature", "comp").agg(F.corr("value", "coord").alias("r")).select("feature", "comp", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)).alias("r"))


def landmarks(latent: DataFrame, most: int = 1000, seed: str = "layout") -> tuple[list, np.ndarray]:
    """At most ``most`` rows (id, vec) by md5 of their id: what a layout is fitted on."""
    rows = latent.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary")), "id").limit(most).collect()
    return [r["id"] for r in rows], np.array([r["vec"] for r in rows], float)


def layout(latent: DataFrame, method: str = "mds", most: int = 1000) -> DataFrame:
    """(id, x, y): a two-dimensional layout.

    Methods: ``mds`` (classical, as isomap with a full graph), ``rbf`` (Gaussian kernel of log distances), ``tsne10``, ``tsne30``, ``ica``.
    The layout is fitted on at most ``most`` landmark rows; other rows go to the weighted mean of their three nearest landmarks.
    """
    ids, x = landmarks(latent, most)
    if method not in LAYOUTS:
        raise ValueError(f"unknown layout {method!r}")
    y = LAYOUTS[method](x)

    def put(batches):
        for b in batches:
            v = np.array(b["vec"].tolist(), float)
            d = np.sqrt(np.maximum((v**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * v @ x.T, 0))
            near = np.argsort(d, axis=1, kind="stable")[:, :3]
            w = 1 / np.maximum(np.take_along_axis(d, near, 1), 1e-9) ** 2
            xy = (y[near] * (w / w.sum(1, keepdims=True))[..., None]).sum(1)
            yield pd.DataFrame({"id": b["id"], "x": xy[:, 0], "y": xy[:, 1]})

    return latent.select("id", F.transform("vec", lambda a: a.cast("double")).alias("vec")).mapInPandas(put, f"id {latent.schema['id'].dataType.simpleString()}, x double, y double")


def _sq(x: np.ndarray) -> np.ndarray:
    s = (x**2).sum(1)
    return np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0)


def _mds(x: np.ndarray) -> np.ndarray:
    d = _sq(x)
    b = -0.5 * (d - d.mean(0) - d.mean(1)[:, None] + d.mean())
    val, vec = np.linalg.eigh(b)
    return vec[:, [-1, -2]] * np.sqrt(np.maximum(val[[-1, -2]], 0))


def _rbf(x: np.ndarray) -> np.ndarray:
    d = np.sqrt(_sq(x))
    k = np.exp(-((np.log(np.maximum(d, 1e-9)) / 0.33) ** 2))
    np.fill_diagonal(k, 1)
    k = k / k.sum(1, keepdims=True)
    u, s, _ = np.linalg.svd(k)
    return u[:, :2] * s[:2]


def _ica(x: np.ndarray, rounds: int = 100, tol: float = 1e-5) -> np.ndarray:
    x = x - x.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    z = u[:, :2] * np.sqrt(len(x))
    w = np.linalg.qr(np.random.default_rng(0).normal(size=(2, 2)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - (1 - g**2).mean(0)[:, None] * w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tol
        w = new
        if done:
            break
    return z @ w.T


def _tsne(perplexity: float):
    def run(x: np.ndarray, rounds: int = 400) -> np.ndarray:
        d, n = _sq(x), len(x)
        beta, p = np.ones(n), np.zeros((n, n))
        goal = np.log(min(perplexity, max(2, (n - 1) / 3)))
        for i in range(n):
            lo, hi, row = 0.0, np.inf, np.delete(d[i], i)
            for _ in range(50):
                q = np.exp(-(row - row.min(initial=0)) * beta[i])
                h = np.log(q.sum()) + beta[i] * ((row - row.min(initial=0)) * q).sum() / q.sum()
                if abs(h - goal) < 1e-5:
                    break
                lo, hi = (beta[i], hi) if h > goal else (lo, beta[i])
                beta[i] = (lo + hi) / 2 if np.isfinite(hi) else beta[i] * 2
            p[i, np.arange(n) != i] = q / q.sum()
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        y, v = np.random.default_rng(0).normal(size=(n, 2)) * 1e-4, np.zeros((n, 2))
        for t in range(rounds):
            q = 1 / (1 + _sq(y))
            np.fill_diagonal(q, 0)
            m = ((4 if t < 100 else 1) * p - q / q.sum()) * q
            v = (0.5 if t < 250 else 0.8) * v - 200 * 4 * (m.sum(1)[:, None] * y - m @ y)
            y = y + v
            y = y - y.mean(0)
        return y

    return run


LAYOUTS = {"mds": _mds, "isomap": _mds, "rbf": _rbf, "ica": _ica, "tsne10": _tsne(10), "tsne30": _tsne(30)}
