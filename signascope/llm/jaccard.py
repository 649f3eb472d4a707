"""Jaccard self-join on five-word shingles with Bayesian pruning of candidates.

1. Every text becomes a set of shingle hashes, known by the hash of the set; equal sets are one vertex.
2. MinHash bands put vertices into buckets; a pair at the threshold meets in some bucket with probability
   1 - (1 - t^rows)^bands (1 - 3e-6 at the defaults).
3. Buckets with the same members are one group.  A large bucket is dealt out as pairs of blocks, so no task holds
   more than two blocks.  In a group a pair is looked at only if it is there that it meets first.
4. MinHash values are compared a few at a time; a pair is dropped when the posterior probability (uniform prior)
   that its similarity reaches the threshold falls under ``tolerance``.  The rest is verified on the sets.
5. A group returns link counts and a spanning forest of its links, not the links.
"""

from __future__ import annotations

import re
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.llm.common import components, materialise, slices

WORDS, BANDS, ROWS, HASHES, STEP = 5, 24, 4, 128, 16
BLOCK = 400
_A = (np.random.default_rng(20).integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: whitespace beyond what ``_GAP`` knows as bytes
_RARE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BYTES = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[_GAP] = 0
_P = np.uint64(0xA0761D6478BD642F)
_FACTORS = np.cumprod(np.full(4096, _P, np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each lower-case word, words being what whitespace leaves: sums over the UTF-8 bytes, no string a word."""
    low = (text or "").lower()
    if _RARE_SPACE.search(low):
        low = _RARE_SPACE.sub(" ", low)
    data = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    gap = _GAP[data]
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1])) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    # the place of each byte in its word picks its factor; the bytes before the first word count as none
    data, starts = data[starts[0] :], starts - starts[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    longest = int(place.max()) + 1
    factor = _FACTORS if longest <= len(_FACTORS) else np.cumprod(np.full(longest, _P, np.uint64))
    h = np.add.reduceat(_BYTES[data] * factor[place], starts)
    h = (h ^ (h >> np.uint64(32))) * _C[1]
    return h ^ (h >> np.uint64(29))


def shingle_hashes(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    """A hash for each run of ``k`` word hashes; fewer words are one shingle, none are none."""
    n = len(h) - k + 1
    if n < 1:
        h, n = np.concatenate([h, np.zeros(k - len(h), np.uint64)]), min(1, len(h))
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * _C[j % len(_C)]
        out ^= out >> np.uint64(31)
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of the lower-case words of a text; null and empty texts have none."""
    return np.unique(shingle_hashes(word_hashes(text)))


def set_id(shingles: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values of 32 bits."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[k : k + 2048, None] * _A).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """By number of values compared (``STEP``, 2 ``STEP``, ...): fewer matches than this drop a pair.

    With a uniform prior the posterior of m matches of n is Beta(m+1, n-m+1), and its tail above t is the
    chance of at most m successes of n+1 at t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(sig[k * ROWS : (k + 1) * ROWS].tobytes(), k) - 2**63 for k in range(BANDS)]


def _sketches(batches):
    """A text's set id and band keys beside its ids; a text's shingles are let go before the next."""
    for b in slices(batches):
        sets, keys = [], []
        for text in b.column("text"):
            x = shingle_set(text.as_py())
            sets.append(set_id(x))
            keys.append(band_keys(sketch(x)) if len(x) else None)
        yield pa.record_batch([*(b.column(c) for c in ("doc_id", "k", "h")), pa.array(sets, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "k", "h", "s", "keys"])


def _payloads(batches):
    for b in slices(batches):
        sigs, sets = [], []
        for text in b.column("text"):
            x = shingle_set(text.as_py())
            sigs.append(sketch(x).tobytes())
            sets.append(x.tobytes())
        yield pa.record_batch([b.column("s"), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["s", "sig", "sh"])


def _set_ids(batches):
    for texts in batches:
        yield texts.map(lambda t: set_id(shingle_set(t)))


def links_within(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, bands: int, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i in left, j in right) that meet first in one of the group's bands (a bit mask).

    Rows are taken a slice at a time, so memory is bounded by slice x block.
    """
    num, den = round(threshold * 10_000), 10_000
    sizes, out_i, out_j = np.array([len(x) for x in sets], np.int64), [], []
    same_side = left is right
    keys = sigs[:, : BANDS * ROWS].reshape(len(sigs), BANDS, ROWS)
    for k in range(0, len(left), 64):
        rows = left[k : k + 64]
        first = np.full((len(rows), len(right)), -1, np.int8)
        for band in range(BANDS):
            hit = (keys[rows, band][:, None, :] == keys[right, band][None, :, :]).all(2)
            first[hit & (first < 0)] = band
        mine = np.array([bands >> b & 1 for b in range(BANDS)] + [0], bool)[first]
        i, j = np.nonzero(mine)
        if same_side:
            keep = rows[i] < right[j]
            i, j = i[keep], j[keep]
        i, j = rows[i], right[j]
        matches = np.zeros(len(i), np.int64)
        for step, need in enumerate(least):
            at = slice(step * STEP, (step + 1) * STEP)
            matches += (sigs[i, at] == sigs[j, at]).sum(1)
            keep = matches >= need
            i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            continue
        # what is left is verified on the sets
        both = _common(sets, i, j)
        ok = both * den >= num * (sizes[i] + sizes[j] - both)
        out_i.append(i[ok])
        out_j.append(j[ok])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(i) < 2000:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    ids, pos = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    df = np.bincount(pos)
    out = np.zeros(len(i), np.int64)
    for cols in np.array_split(np.flatnonzero(df > 1), max(1, (df > 1).sum() // 4096)):
        slot = np.full(len(ids), -1)
        slot[cols] = np.arange(len(cols))
        on = slot[pos] >= 0
        x = np.zeros((len(used), max(1, len(cols))), np.float32)
        x[owner[on], slot[pos[on]]] = 1
        ua, ra = np.unique(a, return_inverse=True)
        out += (x[ua] @ x.T)[ra, b].astype(np.int64)
    return out


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n vertices under the links (union by smaller root)."""
    root = np.arange(n)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _group_result(group: dict, threshold: float, least: list[int]):
    order = np.argsort(np.array(group["s"]))
    names = [group["s"][k] for k in order]
    sigs = np.stack([np.frombuffer(group["sig"][k], np.uint32) for k in order])
    sets = [np.frombuffer(group["sh"][k], np.uint64) for k in order]
    copies, side = np.array([group["n"][k] for k in order], np.int64), np.array([group["side"][k] for k in order])
    if (side == 2).any():
        i, j = links_within(sigs, sets, np.flatnonzero(side == 1), np.flatnonzero(side == 2), group["bands"], threshold, least)
    else:
        every = np.arange(len(names))
        i, j = links_within(sigs, sets, every, every, group["bands"], threshold, least)
    n = len(names)
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    roots = forest(i, j, n)
    for k in np.flatnonzero(links > 0):
        yield names[k], names[roots[k]], int(links[k])


def _verify(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(batches):
        group: dict | None = None
        out: list[tuple] = []
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("g", "bands", "side", "s", "n", "sig", "sh")}
            for k in range(batch.num_rows):
                if group is None or group["g"] != cols["g"][k]:
                    if group:
                        out += _group_result(group, threshold, least)
                    group = {"g": cols["g"][k], "bands": cols["bands"][k], "side": [], "s": [], "n": [], "sig": [], "sh": []}
                for c in ("side", "s", "n", "sig", "sh"):
                    group[c].append(cols[c][k])
            if len(out) > 5000:
                yield _links(out)
                out = []
        if group:
            out += _group_result(group, threshold, least)
        if out:
            yield _links(out)

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    a, b, n = zip(*rows)
    return pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["a", "b", "links"])


def _groups(buckets: DataFrame) -> DataFrame:
    """(g, bands, side, s): what is compared together, from (band, key, s) rows."""
    size = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    member = buckets.join(size, ["band", "key"])
    bit = F.call_function("shiftleft", F.lit(1), F.col("band"))
    small = member.where(F.col("m") <= BLOCK).groupBy("band", "key").agg(F.sort_array(F.collect_list("s")).alias("who"))
    small = small.groupBy("who").agg(F.bit_or(bit).alias("bands")).select(F.concat(F.lit("s"), F.md5(F.concat_ws(",", "who").cast("binary"))).alias("g"), "bands", F.lit(0).alias("side"), F.explode("who").alias("s"))
    large = member.where(F.col("m") > BLOCK).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    large = large.select(F.concat_ws(":", F.lit("b"), "band", "key", low, high).alias("g"), bit.alias("bands"), side.alias("side"), "s")
    return small.unionByName(large)


def classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), n_links (other documents linked directly), ``s`` (set id).

    Documents link when the Jaccard similarity of their shingle sets is at least ``threshold``; copies link with
    each other and with all that their text links with.  Null and texts without words link with nothing and are
    their own class.  Rows count as documents even if their doc_id repeats or is null (a class of null ids
    only has class_id null).  An empty table gives no rows.
    """
    # (k, h) finds a text again, whatever its id
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64("text").alias("h"), F.col("text"))
    keyed = materialise(rows.mapInArrow(_sketches, "doc_id long, k long, h long, s string, keys array<long>"), "jaccard")
    texts = keyed.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("first"), F.min(F.struct("k", "h")).alias("at"), F.count(F.lit(1)).alias("n"), F.any_value("keys").alias("keys"))
    texts = materialise(texts, "jaccard")
    groups = materialise(_groups(texts.select("s", F.posexplode("keys").alias("band", "key"))), "jaccard")
    wanted = groups.select("s").distinct().join(texts.select("s", "at.k", "at.h"), "s")
    payload = rows.join(wanted, ["k", "h"]).select("s", "text").mapInArrow(_payloads, "s string, sig binary, sh binary").groupBy("s").agg(F.any_value("sig").alias("sig"), F.any_value("sh").alias("sh"))
    full = groups.join(payload, "s").join(texts.select("s", "n"), "s")
    found = full.repartition("g").sortWithinPartitions("g").mapInArrow(_verify(threshold, tolerance), "a string, b string, links long")
    found = materialise(found, "jaccard")
    root = components(found.select("a", "b"), "jaccard")
    links = found.groupBy(F.col("a").alias("s")).agg(F.sum("links").alias("links"))
    info = texts.select("s", "first", "n").join(links, "s", "left").join(root.withColumnRenamed("v", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    info = materialise(info, "jaccard")
    least = info.groupBy("root").agg(F.min("first").alias("class_id"))
    info = info.join(least, "root").select("s", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    own = keyed.where("s is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "s")
    return keyed.select("doc_id", "s").where("s is not null").join(info, "s").select("doc_id", "class_id", "n_links", "s").unionByName(own)


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each class; texts without words stay, repeated rows stay once.

    Where a class has only null ids, one of its rows stays for each of its texts.
    """
    found = materialise(classes(docs, threshold), "jaccard")
    keep = found.where("doc_id = class_id").select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = docs.join(keep.select("doc_id"), "doc_id", "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    if not found.where("doc_id is null").isEmpty():
        orphans = found.where("class_id is null and s is not null").select("s").distinct()
        with_set = docs.where("doc_id is null").withColumn("_set_id", F.pandas_udf(_set_ids, "string", F.PandasUDFType.SCALAR_ITER)("text"))
        rest = with_set.join(orphans, with_set["_set_id"] == orphans["s"], "left_semi").dropDuplicates(["_set_id"])
        kept = kept.unionByName(rest.drop("_set_id")).unionByName(with_set.where("_set_id is null").drop("_set_id"))
    return kept.select(*docs.columns)
