"""Principal trees: nodes of a spanning tree that lie in the middle of the points, by soft assignment and smoothing along the tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.functions.tables import saved, summed

SMALLEST, LARGEST = 1e-5, 1e5


@dataclass
class PrincipalTree:
    """Node positions (nodes x dimensions), edges (pairs of nodes), the mean squared distance of points to their nearest node, and
    the objective after each step."""

    nodes: np.ndarray
    edges: list[tuple[int, int]]
    mse: float
    scores: list[float]


def spanning_tree(nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the minimum spanning tree of the nodes by Borůvka: every component takes its shortest way out, ties by node numbers."""
    m = len(nodes)
    d = np.array([((nodes - x) ** 2).sum(1) for x in nodes])
    part, edges = np.arange(m), set()
    while len(set(part.tolist())) > 1:
        best: dict[int, tuple[float, int, int]] = {}
        out = np.where(part[:, None] == part[None, :], np.inf, d)
        for a in range(m):
            b = int(out[a].argmin())
            way = (float(out[a, b]), min(a, b), max(a, b))
            best[part[a]] = min(best.get(part[a], way), way)
        for _, a, b in sorted(set(best.values())):
            if part[a] != part[b]:
                edges.add((a, b))
                part[part == part[b]] = part[a]
    return sorted(edges)


def _pass(rows: DataFrame, nodes: np.ndarray, sigma: float | None):
    """One look at the points: weight and weighted sum of the points of each node, summed squared distance to the nearest node,
    and the entropy term.  ``sigma`` None gives each point to its nearest node alone.  A task sends nodes x (dimensions + 1) numbers."""
    m, dims = nodes.shape

    def task(batches):
        total, near, soft, n = np.zeros((m, dims + 1)), 0.0, 0.0, 0
        for b in batches:
            for lo in range(0, len(b), 1024):
                x = np.array(b["vec"].iloc[lo : lo + 1024].tolist(), float).reshape(-1, dims)
                d = ((x[:, None, :] - nodes[None]) ** 2).sum(2) if m * dims <= 4096 else np.maximum((x**2).sum(1)[:, None] + (nodes**2).sum(1) - 2 * x @ nodes.T, 0)
                near += float(d.min(1).sum())
                n += len(x)
                if sigma is None:
                    p = np.zeros_like(d)
                    p[np.arange(len(x)), d.argmin(1)] = 1.0
                else:
                    p = np.exp(-(d - d.min(1, keepdims=True)) / sigma)
                    p /= p.sum(1, keepdims=True)
                    soft += float((p * d).sum() + sigma * (p * np.log(np.maximum(p, 1e-300))).sum())
                total += p.T @ np.hstack([x, np.ones((len(x), 1))])
        yield pd.DataFrame({"k": [0], "row": [np.concatenate([total.ravel(), [near, soft, n]])]})

    sums = summed(rows.mapInPandas(task, "k int, row array<double>"), ["k"], "row", m * (dims + 1) + 3).first()
    row = np.array(sums["row"]) if sums else np.zeros(m * (dims + 1) + 3)
    return row[:-3].reshape(m, dims + 1), *row[-3:]


def centres(rows: DataFrame, count: int, rounds: int = 25, seed: str = "centres") -> np.ndarray:
    """Centres of ``count`` clusters of (id, vec) by Lloyd's rounds, from the distinct vectors of least md5 of their id."""
    first = rows.groupBy("vec").agg(F.min(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary"))).alias("o")).orderBy("o", "vec").limit(count)
    nodes = np.array([r["vec"] for r in first.select("vec").collect()], float)
    for _ in range(rounds if len(nodes) else 0):
        total, *_ = _pass(rows, nodes, None)
        new = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1e-300), nodes)
        if np.abs(new - nodes).max() < 1e-9:
            break
        nodes = new
    return nodes


def width(rows: DataFrame) -> float:
    """Mean squared distance to the nearest of root-of-n centres: what ``sigma`` is where it is not given."""
    n = rows.count()
    total = _pass(rows, centres(rows, max(1, round(n**0.5))), None)
    return max(total[1] / max(n, 1), 1e-12)


def fit(points: DataFrame, count: int, sigma: float | None = None, gamma: float = 1.0, tolerance: float = 1e-2, rounds: int = 50, start: np.ndarray | None = None) -> PrincipalTree:
    """A tree of ``count`` nodes through points (id, vec).

    Each step spans the nodes by their minimum tree, shares every point among the nodes by exp(-d^2 / sigma), and moves the
    nodes to the minimum of (squared edge lengths) + gamma (shared squared distances): with L the tree's Laplacian and W the
    nodes' weights, (2 / gamma L + W) nodes = weighted sums.  It ends when the objective falls by less than ``tolerance``.
    Only sums over points leave the tasks; the driver solves for the nodes, which are few.
    """
    rows = saved(points.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")))
    nodes = centres(rows, count) if start is None else np.asarray(start, float)
    if not len(nodes):
        return PrincipalTree(np.zeros((0, 0)), [], 0.0, [])
    sigma = width(rows) if sigma is None else sigma
    scores: list[float] = []
    for _ in range(rounds):
        edges = spanning_tree(nodes)
        laplacian = np.zeros((len(nodes), len(nodes)))
        for a, b in edges:
            laplacian[[a, b], [a, b]] += 1
            laplacian[a, b] -= 1
            laplacian[b, a] -= 1
        total, _, soft, n = _pass(rows, nodes, sigma)
        length = sum(((nodes[a] - nodes[b]) ** 2).sum() for a, b in edges)
        scores.append(float(length + gamma * soft))
        if len(scores) > 1 and scores[-2] - scores[-1] < tolerance:
            break
        nodes = np.linalg.solve(2 / gamma * laplacian + np.diag(np.maximum(total[:, -1], 1e-12)), total[:, :-1])
    _, near, _, n = _pass(rows, nodes, sigma)
    return PrincipalTree(nodes, spanning_tree(nodes), near / max(n, 1), scores)


def _branching(tree: PrincipalTree) -> int:
    degree = np.bincount(np.array(tree.edges, int).ravel(), minlength=len(tree.nodes)) if tree.edges else np.zeros(1, int)
    return int((degree > 2).sum())


def search(points: DataFrame, count: int | None = None, sigma: float | None = None, tolerance: float = 1e-2) -> tuple[PrincipalTree, float, list[tuple[float, float]]]:
    """(tree, gamma, curve): the tree at a gamma read off the curve of errors (gamma, mse).

    With log(n) nodes gamma goes up tenfold from 1e-5 until the error falls by 5 % in a step, and on for as long as it does.  The tree
    of ``count`` (the root of n) nodes is fitted there, and gamma goes down by the root of ten while no node branches, or
    over a tenth of the nodes and at least five do.
    """
    rows = saved(points.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")))
    n = max(1, rows.count())
    sigma = width(rows) if sigma is None else sigma
    small = centres(rows, max(1, round(np.log(n))))
    curve, gamma = [], SMALLEST
    falling = False
    while gamma <= LARGEST:
        curve.append((gamma, fit(rows, len(small), sigma, gamma, tolerance, start=small).mse))
        if len(curve) > 1:
            fell = curve[-2][1] / max(curve[-1][1], 1e-300) - 1 >= 0.05
            if falling and not fell:
                break
            falling = falling or fell
        gamma *= 10
    least = gamma = min(curve[-1][0], LARGEST) if falling else SMALLEST
    least /= 1000
    begin = centres(rows, count or max(1, round(n**0.5)))
    tree = fit(rows, len(begin), sigma, gamma, tolerance, start=begin)
    while gamma >= least and not (0 < (k := _branching(tree)) and (k <= 0.1 * len(tree.nodes) or k < 5)):
        gamma /= 10**0.5
        tree = fit(rows, len(begin), sigma, gamma, tolerance, start=begin)
    return tree, gamma, curve


def assigned(points: DataFrame, tree: PrincipalTree) -> DataFrame:
    """(id, node, d2): the nearest node of each point and the squared distance; ties to the lower node."""
    kind, nodes = points.schema["id"].dataType.simpleString(), tree.nodes

    def task(batches):
        for b in batches:
            x = np.array(b["vec"].tolist(), float).reshape(len(b), -1)
            d = np.array([((nodes - row) ** 2).sum(1) for row in x]).reshape(len(b), -1)
            yield pd.DataFrame({"id": b["id"], "node": d.argmin(1) if len(d) else [], "d2": d.min(1) if len(d) else []})

    return points.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")).mapInPandas(task, f"id {kind}, node long, d2 double")


def mean_squared_error(points: DataFrame, tree: PrincipalTree) -> DataFrame:
    """(mse): mean over points of the squared distance to the nearest node."""
    return assigned(points, tree).agg(F.avg("d2").alias("mse"))
