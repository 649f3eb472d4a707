"""Vector codes by product quantisation in whole numbers; nearest entries are looked up in a GNAT over each codebook.

Components become ``floor(256 x)``, a vector is cut into ``parts`` equal parts, and each part is coded by the nearest of
its codebook's entries.  Everything after the floor is whole-number arithmetic, so codes do not depend on the order or
place of additions.

A GNAT (geometric near-neighbour access tree) holds a codebook: some entries are split points, every other entry lies
with its nearest split point, and for each pair (split point, child) the tree knows the least and greatest distance from
the split point to what the child holds.  A query's distances to the split points rule out whole children.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signascope.llm.common import materialise

#: Components are held within this, so that squared distances of vectors of up to 64 components fit 64 bits (an ``x`` of 524 288).
LIMIT = 1 << 27
#: Children of a tree node, and entries from which a node is a leaf.
FANOUT, LEAF = 8, 8


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number squared distances of the rows of ``a`` to those of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


class Gnat:
    """Nearest entry by whole-number squared distance, ties to the lower index, the same as a look at every entry.

    Roots are rounded down in lower and up in upper bounds by one more place than a double's error (their bounds are
    scaled by 1e-12), and a child goes only if its bound is strictly over the best distance so far; entries that are left
    are compared by their whole-number distance and index.
    """

    def __init__(self, entries: np.ndarray, at: np.ndarray | None = None):
        self.entries, self.at = entries, np.arange(len(entries)) if at is None else at
        self.splits: np.ndarray | None = None
        if len(self.at) <= LEAF:
            return
        own = entries[self.at]
        picked = [0]
        far = _squared(own, own[:1])[:, 0]
        while len(picked) < FANOUT and far.max() > 0:  # each split point far from those before
            picked.append(int(far.argmax()))
            far = np.minimum(far, _squared(own, own[picked[-1:]])[:, 0])
        if len(picked) < 2:
            return
        to = _squared(own, own[picked])
        home = to.argmin(axis=1)
        home[picked] = -1
        self.splits = self.at[picked]
        groups = [np.flatnonzero(home == j) for j in range(len(picked))]
        groups = [g for g in groups if len(g)]
        self.children = [Gnat(entries, self.at[g]) for g in groups]
        root = np.sqrt(to.astype(float))
        self.low = np.array([[root[g, i].min() for g in groups] for i in range(len(picked))]) * (1 - 1e-12)
        self.high = np.array([[root[g, i].max() for g in groups] for i in range(len(picked))]) * (1 + 1e-12)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each of ``rows``."""
        best = np.full(len(rows), np.iinfo(np.int64).max)
        index = np.full(len(rows), len(self.entries), np.int64)
        self._search(rows, np.arange(len(rows)), best, index)
        return index, best

    def _meet(self, rows, asked, at, best, index) -> np.ndarray:
        d = _squared(rows[asked], self.entries[at])
        low = d.min(axis=1)
        i = np.where(d == low[:, None], at[None, :], len(self.entries)).min(axis=1)
        closer = (low < best[asked]) | (low == best[asked]) & (i < index[asked])
        best[asked[closer]], index[asked[closer]] = low[closer], i[closer]
        return d

    def _search(self, rows, asked, best, index) -> None:
        if self.splits is None:
            if len(self.at):
                self._meet(rows, asked, self.at, best, index)
            return
        d = np.sqrt(self._meet(rows, asked, self.splits, best, index).astype(float))
        low, high = d * (1 - 1e-12), d * (1 + 1e-12)
        bounds = [np.maximum(low - self.high[:, j], self.low[:, j] - high).max(axis=1) for j in range(len(self.children))]
        for bound, child in zip(bounds, self.children):
            left = bound <= np.sqrt(best[asked].astype(float)) * (1 + 1e-12)
            if left.any():
                child._search(rows, asked[left], best, index)


def _whole(column, n: int):
    """The batch's vectors as whole numbers, one row each."""
    flat = np.asarray(column.flatten(), dtype=float).reshape(len(column), n)
    return np.clip(np.floor(flat * 256.0), -LIMIT, LIMIT).astype(np.int64)


def _sums(books: list[np.ndarray], n: int):
    """A task's count and component sums for each part and entry: ``parts`` x ``entries`` rows at most."""

    def task(batches):
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros_like(b) for b in books]
        trees = [Gnat(b) for b in books]
        for b in batches:
            rows = _whole(b.column(0), n)
            for p, cut in enumerate(np.split(rows, len(books), axis=1)):
                at, _ = trees[p].nearest(cut)
                np.add.at(count[p], at, 1)
                np.add.at(total[p], at, cut)
        used = [(p, e) for p, c in enumerate(count) for e in np.flatnonzero(c).tolist()]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([e for _, e in used], pa.int32()),
            "n": pa.array([int(count[p][e]) for p, e in used], pa.int64()), "total": pa.array([total[p][e].tolist() for p, e in used], pa.list_(pa.int64())),
        })

    return task


def _coded(books: list[np.ndarray], n: int):
    def task(batches):
        trees = [Gnat(b) for b in books]
        for b in batches:
            rows = _whole(b.column(0), n)
            found = [t.nearest(cut) for t, cut in zip(trees, np.split(rows, len(books), axis=1))]
            at = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes().hex() for r in at], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return task


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor empty and holds no null, NaN or infinity."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """A codebook for each part, from rows that :func:`usable` keeps.

    The first books are the parts of the ``entries`` smallest ids (rows with equal ids by their vectors, null ids last);
    each round gives every entry the floored mean of the parts nearest to it, where there are any.  Each task sends one
    row per part and entry that it met; the driver sees one row per part and entry, whatever the table's size.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    n = len(first[0][0]) if first else 0
    if not n or n % parts:
        return []
    start = np.clip(np.floor(np.array([r[0] for r in first if len(r[0]) == n], float) * 256.0), -LIMIT, LIMIT).astype(np.int64)
    books = [np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)]
    like = vectors.where(F.size("embedding") == n).select("embedding")
    for _ in range(rounds):
        task = like.mapInArrow(_sums(books, n), "part int, entry int, n bigint, total array<bigint>")
        each = task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(n // parts)])
        books = [b.copy() for b in books]
        for part, entry, count, *total in each.collect():
            books[part][entry] = [t // count for t in total]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of rows that :func:`usable` keeps; vectors of another length than the books' have null codes."""
    n = sum(b.shape[1] for b in books)
    kinds = [T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("label", vectors.schema["label"].dataType)]
    schema = T.StructType([*kinds, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    others = vectors.where(F.size("embedding") != n).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not books:
        return others
    return vectors.where(F.size("embedding") == n).select("embedding", "vec_id", "label").mapInArrow(_coded(books, n), schema).unionByName(others)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row with a usable vector (vec_id, embedding, label).

    ``code`` is one byte a part, in hex; ``error`` the squared distances to the entries, summed; ``label_error`` the sum
    over rows of an equal label, null labels together.  Repeated rows are rows like others.  Vectors of another length
    than that of the smallest id, or all if ``parts`` does not divide that, have null codes and errors.  Components of
    over :data:`LIMIT` / 256 count as that.  No rows for an empty table.
    """
    kept = usable(vectors.select("vec_id", "embedding", "label"))
    books = train(kept, parts, entries, rounds)
    coded = materialise(encode(kept, books), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    named = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return named.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
