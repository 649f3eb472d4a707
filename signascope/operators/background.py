"""What autocorrelations are held against: permuted values, and random signatures of like size and balance.

Both come from keyed bijections of 0..n-1, a Feistel network over a power of four with cycle walking: any place of any
permutation is computed where it is needed, so no permutation is ever sorted, written or sent.

* Permutations: the edges stay where they are; each task computes the places of its edges' ends for one repetition after
  another, looks up the ranks there, and only sums by feature and repetition leave it.  Nodes with the same neighbours at the
  same weights, as the tips of a clade, are added up before they meet these.
* Random signatures: a signature's genes are the first places of a permutation of all genes.  The sparse matrix and the edges
  are written once and pass by each block of signatures; scores are made and ranked where the block is, so none is sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.functions import stats
from signascope.functions.tables import numbered, saved

ROUNDS = 6
#: Odd multipliers of the round function, small enough for signed 64-bit products.
MULTIPLIERS = (2654435761, 1597334677)
#: Ranks that are sent to every task at once, 128 MB.
SENT = 1 << 25
#: Ranks of a block of signatures in one task, 256 MB.
HELD = 1 << 25
#: Edges of a task at once, and those of one node from which on they are dealt to several.
EDGES = 1 << 19
HEAVY = 1 << 12
#: Edges of a row that passes by the blocks.
LISTED = 256


def half_bits(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _mixed(half: np.ndarray, key) -> np.ndarray:
    t = (half * MULTIPLIERS[0] + key) & 0xFFFFFFFF
    t = ((t ^ (t >> 15)) * MULTIPLIERS[1]) & 0xFFFFFFFF
    return t ^ (t >> 16)


def places(at: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Where the permutations ``key`` of 0..n-1 send ``at`` (both int64, of one shape)."""
    h = half_bits(n)
    mask, out = (1 << h) - 1, np.array(at, np.int64)
    key = np.broadcast_to(np.asarray(key, np.int64), out.shape)
    todo = np.arange(out.size)
    flat, keys = out.reshape(-1), key.reshape(-1)
    while todo.size:
        v, k = flat[todo], keys[todo]
        left, right = v >> h, v & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, k * 64 + r) & mask)
        v = (left << h) | right
        flat[todo] = v
        todo = todo[v >= n]
    return flat.reshape(out.shape)


def places_of_one(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """:func:`places` for one permutation and many ``at``: what a round adds is looked up for each half, of which there are about the root of n."""
    h = half_bits(n)
    mask, halves = (1 << h) - 1, np.arange(1 << h, dtype=np.int64)
    rounds = [_mixed(halves, key * 64 + r) & mask for r in range(ROUNDS)]
    out, todo = np.array(at, np.int64), None
    while todo is None or todo.size:
        v = out if todo is None else out.take(todo)
        for k in range(0, len(v), 1 << 13):  # few enough to stay in the cache
            part = v[k : k + (1 << 13)]
            left, right = part >> h, part & mask
            for t in rounds:
                left ^= t.take(right)
                left, right = right, left
            left <<= h
            np.bitwise_or(left, right, out=part)
        if todo is None:
            todo = np.flatnonzero(out >= n)
        else:
            out[todo] = v
            todo = todo[v >= n]
    return out


# --- permutations


def permutation_p(values: DataFrame, edges: DataFrame, observed: DataFrame, reps: int = 3000, seed: int = 0) -> DataFrame:
    """(feature, c, p) for ``observed`` (feature, c): the share of permutations of a feature's values (id, feature, value) over
    all ids that reach c, (count + 1) / (reps + 1).

    Repetition r (from 0) gives the n-th id, in order, the value of the ``places(n, ids, seed + r)``-th.  Features that are
    constant, hold nulls or lack ids have p 1.
    """
    ids, n = numbered(values.select("id").distinct(), ["id"])
    ids = saved(ids)
    full = values.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    names = sorted(r["feature"] for r in full.where((F.col("n") == n) & (F.col("a") < F.col("b"))).select("feature").collect())
    if not names or n < 2:
        return observed.select("feature", "c", F.lit(1.0).alias("p"))
    spark = values.sparkSession
    ranked = stats.average_rank(values.where(F.col("feature").isin(names)), ["feature"], "value").join(ids, "id")
    ranked = saved(ranked.select("feature", "place", F.col("rank").cast("double").alias("rank")))
    a, b = (ids.select(F.col("id").alias(s), F.col("place").alias("p" + s)) for s in "ij")
    ends = saved(edges.join(a, "i").join(b, "j").select("pi", "pj", F.col("w").cast("double").alias("w")))
    size = ends.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    cores = spark.sparkContext.defaultParallelism
    chunks = max(1, -(-size["n"] // EDGES))
    splits = min(reps, max(1, -(-cores // chunks)))  # few edges: each task takes a part of the repetitions
    # a node's edges are together, unless they are many
    heavy = ends.groupBy("pi").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select("pi", F.lit(True).alias("heavy"))
    part = F.when(F.col("heavy"), F.xxhash64("pi", "pj")).otherwise(F.xxhash64("pi"))
    dealt = ends.join(F.broadcast(heavy), "pi", "left").select("pi", "pj", "w", F.pmod(part, F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split")).repartition(chunks * splits, "split", "chunk")
    block = min(n, SENT)
    together = max(1, SENT // block)
    found = None
    for f in range(0, len(names), together):
        some = names[f : f + together]
        for low in range(0, n, block):
            one = _vectors(ranked, some, n, low, block)
            for high in range(low, n, block):
                other = one if high == low else _vectors(ranked, some, n, high, block)
                sums = _sums_of(dealt, some, n, reps, splits, seed, (low, one), (high, other))
                found = sums if found is None else found.unionByName(sums)
    nums = found.select("feature", "first", F.posexplode("sums").alias("k", "num")).groupBy("feature", (F.col("first") + F.col("k")).alias("rep")).agg(F.sum("num").alias("num"))
    spread = ranked.groupBy("feature").agg(F.var_samp("rank").alias("v"))
    c = 1 - F.col("num") / (2 * size["w"] * F.col("v")) if size["w"] else F.lit(None).cast("double")
    # to twelve places, so that the order of sums does not decide
    reached = nums.join(spread, "feature").join(observed, "feature").groupBy("feature").agg(F.sum((F.round(c - F.col("c"), 12) >= 0).cast("long")).alias("n"))
    return observed.join(reached, "feature", "left").select("feature", "c", ((F.coalesce("n", F.lit(reps)) + 1) / (reps + 1)).alias("p"))


def _vectors(ranked: DataFrame, names: list[str], n: int, low: int, block: int) -> np.ndarray:
    """Ranks of features (columns) at places low..low+block, at most :data:`SENT` numbers: twice their distance from the mean rank."""
    out = np.zeros((min(block, n - low), len(names)), np.int32 if n < 1 << 30 else np.int64)
    for k, f in enumerate(names):
        rows = ranked.where((F.col("feature") == f) & F.col("place").between(low, low + block - 1))
        rows = rows.select((F.col("place") - low).alias("at"), (2 * F.col("rank") - (n + 1)).cast("int" if n < 1 << 30 else "long").alias("x")).toArrow()
        out[np.asarray(rows.column(0)), k] = np.asarray(rows.column(1))
    return out


class _Shared:
    """Edges of a task, by lists of neighbours and weights that nodes share, for sums of w (x_i - x_j)^2."""

    def __init__(self, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        put = np.lexsort((w, j, i))
        i, j, w = i[put], j[put], w[put]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        size = np.diff(np.append(first, len(i)))
        both = np.stack([j, w.view(np.int64)], axis=1).tobytes()
        of: dict[bytes, int] = {}
        own = np.array([of.setdefault(both[16 * a : 16 * (a + m)], len(of)) for a, m in zip(first.tolist(), size.tolist())])
        nodes = np.argsort(own, kind="stable")
        self.cuts = np.flatnonzero(np.diff(own[nodes], prepend=-1))
        self.count = np.diff(np.append(self.cuts, len(nodes))).astype(float)
        one = nodes[self.cuts]  # a node of each list
        length = size[one]
        self.starts = np.cumsum(length) - length
        at = np.repeat(first[one] - self.starts, length) + np.arange(length.sum())
        self.w = w[at][:, None]
        self.weight = np.add.reduceat(self.w[:, 0], self.starts)
        # the nodes of the lists, then those that are neighbours only
        ends, where = np.unique(j[at], return_inverse=True)
        self.nodes = np.concatenate([i[first[nodes]], ends])
        self.inner, self.where = len(nodes), where

    def sums(self, x: np.ndarray) -> np.ndarray:
        """By feature, for values ``x`` of :attr:`nodes` (rows)."""
        own, far = x[: self.inner], x[self.inner :].take(self.where, axis=0)
        s, q = np.add.reduceat(own, self.cuts, axis=0), np.add.reduceat(own * own, self.cuts, axis=0)
        far_w = far * self.w
        t, u = np.add.reduceat(far_w, self.starts, axis=0), np.add.reduceat(far_w * far, self.starts, axis=0)
        return self.weight @ q + self.count @ u - 2 * (s * t).sum(0)


def _sums_of(dealt: DataFrame, names: list[str], n: int, reps: int, splits: int, seed: int, one, other) -> DataFrame:
    """(feature, first, sums): w (x - y)^2 summed over a task's edges with one end in each block, by repetition from ``first``."""
    (low, x), (high, y) = one, other
    sent = dealt.sparkSession.sparkContext.broadcast((x, None if high == low else y))
    size, step = x.shape[0], -(-reps // splits)
    whole, across = size >= n, y.shape[0]

    def task(batches):
        x, y = sent.value
        totals: dict[int, np.ndarray] = {}

        def add(held):
            i, j, w, split = (np.concatenate(c) for c in zip(*held))
            for s in np.unique(split).tolist():
                mine = np.flatnonzero(split == s)
                total = totals.setdefault(s, np.zeros((max(0, min(step, reps - s * step)), len(names))))
                first = seed + s * step
                if whole:
                    shared = _Shared(i[mine], j[mine], w[mine])
                    for r in range(len(total)):
                        total[r] += shared.sums(x.take(places_of_one(shared.nodes, n, first + r), axis=0).astype(float)) / 4
                    continue
                nodes, at = np.unique(np.concatenate([i[mine], j[mine]]), return_inverse=True)
                a, b = at[: len(mine)], at[len(mine) :]
                for r in range(len(total)):
                    p = places_of_one(nodes, n, first + r)
                    for u, v in ((p[a], p[b]),) if y is None else ((p[a], p[b]), (p[b], p[a])):
                        here = np.flatnonzero((u >= low) & (u < low + size) & (v >= high) & (v < high + across))
                        d = x.take(u[here] - low, axis=0).astype(float) - (x if y is None else y).take(v[here] - high, axis=0)
                        total[r] += w[mine[here]] @ (d * d) / 4

        held, there = [], 0
        for b in batches:
            held.append([np.asarray(b.column(k)) for k in range(4)])
            there += b.num_rows
            if there >= EDGES:
                add(held)
                held, there = [], 0
        if there:
            add(held)
        made = [(names[f], s * step, t[:, f].tolist()) for s, t in totals.items() for f in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * 3, (pa.string(), pa.int64(), pa.list_(pa.float64())))], ["feature", "first", "sums"])

    return dealt.select("pi", "pj", "w", "split").mapInArrow(task, "feature string, first long, sums array<double>")


# --- random signatures


def drawn(groups: list[tuple[int, int, float]], size: int, genes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, gene, sign) of ``size`` random signatures for each group (grp, k, balance); signature g * size + r is the r-th of the g-th.

    ``balance`` x k genes are positive, of a part of a gene by chance; genes are distinct.
    """
    sig, gene, sign = [], [], []
    for g, (_, k, balance) in enumerate(groups):
        k = min(k, genes)
        number = np.arange(size, dtype=np.int64) + g * size
        key = number + seed * (1 << 20)
        up = balance * k
        chance = _mixed(number, np.int64(seed * 64 + 63)) / 4294967296.0
        positive = np.floor(up) + (chance < up - np.floor(up))
        at = np.arange(k, dtype=np.int64)
        gene.append(places(np.broadcast_to(at, (size, k)), genes, key[:, None]).reshape(-1))
        sig.append(np.repeat(number, k))
        sign.append(np.where(at[None, :] < positive[:, None], 1.0, -1.0).reshape(-1))
    none = np.zeros(0, np.int64)
    return (np.concatenate(sig), np.concatenate(gene), np.concatenate(sign)) if groups else (none, none, none.astype(float))


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks of a vector."""
    order = np.argsort(x)
    y = x[order]
    new = (y[1:] != y[:-1]) & ~(np.isnan(y[1:]) & np.isnan(y[:-1]))
    cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(x)]])
    out = np.empty(len(x))
    out[order] = np.repeat((cuts[:-1] + cuts[1:] + 1) / 2, np.diff(cuts))
    return out


def _as_bytes(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers as one string of bytes for each part between ``cuts``, which passes through Spark without a look at each number."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def _from_bytes(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of bytes, and the cuts between its rows."""
    column = pa.concat_arrays([column.cast(pa.binary())])
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    size = np.dtype(kind).itemsize
    found = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)
    return found, (ends - ends[0]) // size


def random_autocorrelation(entries: DataFrame, cells: DataFrame, genes: DataFrame, edges: DataFrame, groups: list[tuple[int, int, float]], size: int, seed: int = 0) -> DataFrame:
    """(grp, bg): autocorrelation of the scores of ``size`` random signatures a group (grp, k, balance).

    A cell's score is (sum of w v + sum of w ro + co sum of w) cs / sum of |w| for ``entries`` (cell, gene, v), ``genes``
    (gene, ro) and ``cells`` (cell, co, cs), as :func:`signascope.operators.score.scaled` returns them; ``edges`` (i, j, w)
    join cells.  Genes are numbered by name, and their offsets go to every task, as do the groups.
    """
    spark = entries.sparkSession
    own, n = numbered(cells.select("cell", "co", "cs"), ["cell"])
    own = saved(own)
    names, total = numbered(genes.select("gene", "ro"), ["gene"])
    names = saved(names)
    offsets = np.zeros(total)
    rows = names.select("place", "ro").toArrow()
    offsets[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    listed = entries.join(names.select("gene", F.col("place").cast("int").alias("g")), "gene").groupBy("cell").agg(F.collect_list(F.struct("g", "v")).alias("e"))
    wide = own.join(listed, "cell", "left").select("place", F.col("co").cast("double"), F.col("cs").cast("double"), F.col("e.g").alias("g"), F.col("e.v").cast("array<double>").alias("v"))
    a, b = (own.select(F.col("cell").alias(s), F.col("place").cast("int").alias("p" + s)) for s in "ij")
    ends = edges.join(a, "i").join(b, "j").select("pi", "pj", F.col("w").cast("double").alias("w")).sortWithinPartitions("pi", "pj")
    many = len(groups) * size
    if not many or not n:
        return spark.createDataFrame([], "grp int, bg double")
    step = int(max(1, min(HELD // n, -(-many // (2 * spark.sparkContext.defaultParallelism)))))
    blocks = -(-many // step)

    def packed(batches):
        """Edges, :data:`LISTED` a row."""
        for b in batches:
            cuts = pa.array(np.append(np.arange(0, b.num_rows, LISTED), b.num_rows), pa.int32())
            rows = len(cuts) - 1
            if rows:
                i, j, w = (_as_bytes(np.asarray(b.column(k)), np.asarray(cuts)) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.float64()), i, j, w], ["place", "co", "cs", "g", "h", "v"])

    def bytes_of(batches):
        """Cells, with their genes and values as bytes."""
        for b in batches:
            cuts = np.append(0, np.cumsum(b.column("g").value_lengths().fill_null(0).to_numpy()))
            g, v = (_as_bytes(np.asarray(b.column(c).flatten()), cuts) for c in "gv")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("place", "co", "cs")), g, pa.nulls(b.num_rows, pa.binary()), v], ["place", "co", "cs", "g", "h", "v"])

    def measured(batches):
        """Scores of a block of signatures for all cells, their ranks once all cells are there, then sums over the edges."""
        block, held, top, weight, there, early = None, None, None, 0.0, 0, []

        def scored(b):
            (gene, cuts), (value, _) = _from_bytes(b.column("g"), np.int32), _from_bytes(b.column("v"), np.float64)
            cell = np.repeat(np.arange(b.num_rows), np.diff(cuts))
            # of the entries only those of the block's genes are sorted
            mine = np.flatnonzero(used[gene])
            mine = mine[np.argsort(gene[mine], kind="stable")]
            gene, value, cell = gene[mine], value[mine], cell[mine]
            raw = np.zeros((len(held), b.num_rows))
            if len(gene):
                once = np.flatnonzero((np.diff(gene, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
                gene, cell, value = gene[once], cell[once], np.add.reduceat(value, once)
                cuts = np.flatnonzero(np.diff(gene, prepend=-1, append=-1))
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    at, v = cell[lo:hi], value[lo:hi]
                    for c, s in genes_of[int(gene[lo])]:
                        raw[c, at] += s * v
            co, cs = np.asarray(b.column("co")), np.asarray(b.column("cs"))
            for c in range(len(held)):
                raw[c] = (raw[c] + sums[1][c] + co * sums[0][c]) * cs / sums[2][c]
            held[:, np.asarray(b.column("place"))] = raw

        def added(b):
            i, j, w = (_from_bytes(b.column(k), kind)[0] for k, kind in (("g", np.int32), ("h", np.int32), ("v", np.float64)))
            for c in range(len(held)):
                d = held[c, i] - held[c, j]
                top[c] += (d * d) @ w
            return w.sum()

        for b in batches:
            if block is None:
                block = b.column("block")[0].as_py()
                sig, gene, sign = drawn(groups, size, total, seed)
                mine = np.flatnonzero((sig >= block * step) & (sig < (block + 1) * step))
                sig, gene, sign = sig[mine] - block * step, gene[mine], sign[mine]
                width = min(step, many - block * step)
                sums = np.bincount(sig, sign, width), np.bincount(sig, sign * offsets[gene], width), np.maximum(np.bincount(sig, np.abs(sign), width), 1e-300)
                genes_of: dict[int, list] = {}
                for g, c, s in zip(gene.tolist(), sig.tolist(), sign.tolist()):
                    genes_of.setdefault(g, []).append((c, s))
                used = np.zeros(total, bool)
                used[list(genes_of)] = True
                held, top = np.zeros((width, n)), np.zeros(width)
            cell = b.column("place").is_valid()
            found, rest = b.filter(cell), b.filter(pc.invert(cell))
            if rest.num_rows:
                early.append(rest)
            if there < n:
                scored(found)
                there += found.num_rows
                if there == n:
                    for c in range(len(held)):
                        held[c] = ranks(held[c])
            if there == n:
                while early:
                    weight += added(early.pop())
        spread = [held[c].var(ddof=1) if n > 1 else 0.0 for c in range(len(held))] if block is not None else []
        bg = [float(1 - top[c] / (2 * weight * v)) if weight and v > 0 else 0.0 for c, v in enumerate(spread)]
        grp = [groups[(block * step + c) // size][0] for c in range(len(bg))]
        yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(bg, pa.float64())], ["grp", "bg"])

    shape = "place long, co double, cs double, g binary, h binary, v binary"
    both = saved(wide.mapInArrow(bytes_of, shape)).unionByName(saved(ends.mapInArrow(packed, shape))).coalesce(1)
    every = both.hint("shuffle_replicate_nl").crossJoin(spark.range(0, blocks, 1, blocks).select(F.col("id").cast("int").alias("block")))
    return every.mapInArrow(measured, "grp int, bg double")
