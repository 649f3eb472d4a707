"""Near-duplicate embeddings by NN-descent.

1. Equal vectors of a label are one node.  Nodes start with lists of ``K`` neighbours from random-hyperplane buckets,
   the large ones dealt out by salt.
2. Neighbours of neighbours: around each node, its neighbours and those that list it are compared with each
   other, and each keeps its best ``K``; again until few lists change.
3. Edges at the threshold join nodes into components.  A list that is full of such edges can hide a link only where the
   lists of both ends are full.  Such nodes get second lists, of neighbours outside their component, by the same
   descent; what they find merges components, until no second list has an edge at the threshold.
4. Components are compared exactly, a pair of blocks at a time, and only counts leave a task.  So link counts are
   exact within components.
5. The audit compares bounded samples of all nodes, of those with links and of those with full lists with all rows,
   after each attempt; while recall is under ``recall``, more buckets are drawn and the descent runs again.  After the
   last attempt all vectors of a label are compared exactly, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.llm.common import components, materialise

K, TABLES, BUCKET, BLOCK, AUDIT = 10, 10, 192, 512, 64
NBRS = "array<struct<far: double, id: long, ok: boolean>>"


def _matrix(batch, name: str) -> np.ndarray:
    col = batch.column(name)
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of unit rows, and which reach the threshold.

    Products of blocks may differ in the last bit from block to block; pairs this near the threshold are summed alone, so that
    every step decides alike on a pair.
    """
    sim = x @ y.T
    ok = sim >= threshold
    i, j = np.nonzero(np.abs(sim - threshold) < 1e-9)
    ok[i, j] = (x[i] * y[j]).sum(1) >= threshold
    return sim, ok


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with vec_id and node key; nodes id, space, copies, v): one node for each distinct usable vector of a label."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    space = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    rows = rows.withColumn("usable", F.coalesce(usable & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("usable"), F.md5(F.concat_ws(":", space, F.concat_ws(",", F.transform("embedding", lambda x: (x + 0).cast("string")))).cast("binary"))))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(v, lambda x: x / length)
    some = rows.where("usable").groupBy("node").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value(space).alias("space"), F.any_value(unit).alias("v"))
    return rows.select("vec_id", "node"), some


def _codes(seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for pos, row in enumerate(zip(b.column("id").to_pylist(), b.column("space").to_pylist(), b.column("bits").to_pylist(), b.column("v"))):
                ids, space, bits, v = row
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((TABLES * 32, len(x)))
                signs = (planes[len(x)] @ x > 0).reshape(TABLES, 32)[:, :bits]
                keys = [f"{space}:{t}:" + "".join("01"[int(s)] for s in row) for t, row in enumerate(signs)]
                yield pa.record_batch([pa.array([ids] * TABLES, pa.int64()), pa.array(keys, pa.string())], names=["id", "g"])

    def packed(batches):
        held: list = []
        for b in run(batches):
            held.append(b)
            if len(held) == 500:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return packed


def _groups(batches, cols: tuple[str, ...]):
    """(g, columns) of each run of equal ``g`` in sorted batches."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("g").to_pylist()
        cuts = [0, *(k for k in range(1, len(g)) if g[k] != g[k - 1]), len(g)]
        for x, y in zip(cuts, cuts[1:]):
            if held and held[0][0] != g[x]:
                yield held[0][0], pa.Table.from_batches([h[1] for h in held]).combine_chunks().to_batches()[0]
                held = []
            held.append((g[x], b.slice(x, y - x)))
    if held:
        yield held[0][0], pa.Table.from_batches([h[1] for h in held]).combine_chunks().to_batches()[0]


def _compare(k: int, threshold: float):
    """Within each group, the ``k`` nearest of every member, outside its own ``root`` where members have one, and whether they link."""

    def run(batches):
        a, nbrs = [], []
        for _, group in _groups(batches, ("id", "v")):
            ids, x = np.asarray(group.column("id")), _matrix(group, "v")
            ids, first = np.unique(ids, return_index=True)
            x = x[first]
            if len(ids) < 2:
                continue
            sim, ok = _linked(x, x, threshold)
            np.fill_diagonal(sim, -2)
            if "root" in group.schema.names:
                root = np.asarray(group.column("root"))[first]
                sim[root[:, None] == root] = -2
            top = np.argsort(-sim, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
            for r in range(len(ids)):
                near = [{"far": round(1 - float(sim[r, c]), 12), "id": int(ids[c]), "ok": bool(ok[r, c])} for c in top[r] if sim[r, c] > -1.5]
                if near:
                    a.append(ids[r])
                    nbrs.append(near)
            if len(a) > 5000:
                yield _lists(a, nbrs)
                a, nbrs = [], []
        if a:
            yield _lists(a, nbrs)

    return run


def _lists(a, nbrs) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64()), ("ok", pa.bool_())]))
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(nbrs, kind)], names=["id", "nbrs"])


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of all lists of a node, merged in two steps so that a node in many lists is no hot key."""
    top = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("nbrs")))), 1, k).alias("nbrs")
    return lists.groupBy("id", F.pmod(F.xxhash64("nbrs"), F.lit(16)).alias("salt")).agg(top).groupBy("id").agg(top)


def _join_locally(groups: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Lists from comparing the members of each group (g, id); large groups are dealt out by salt."""
    size = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    salt = F.pmod(F.xxhash64("g", "id"), F.ceil(F.col("m") / BUCKET))
    dealt = groups.join(size, "g").select(F.concat_ws("/", "g", salt).alias("g"), "id")
    full = dealt.join(nodes.select("id", "v", *(c for c in nodes.columns if c == "root")), "id").repartition("g").sortWithinPartitions("g")
    return full.mapInArrow(_compare(k, threshold), f"id long, nbrs {NBRS}")


def descend(nodes: DataFrame, lists: DataFrame, k: int, threshold: float, rounds: int, settled: float, own: DataFrame | None = None) -> DataFrame:
    """Neighbours-of-neighbours joins until at most the share ``settled`` of the lists changes.

    ``own`` has further lists whose members are neighbours too, but are not kept.
    """
    for _ in range(rounds):
        edge = lists.select("id", F.explode("nbrs.id").alias("other"))
        edge = edge if own is None else edge.unionByName(own.select("id", F.explode("nbrs.id").alias("other")))
        around = edge.select(F.col("id").cast("string").alias("g"), F.col("other").alias("id")).unionByName(edge.select(F.col("other").cast("string").alias("g"), "id"))
        around = around.unionByName(lists.select(F.col("id").cast("string").alias("g"), "id")).distinct()
        found = _join_locally(around, nodes, k, threshold)
        new = materialise(_best(lists.select("id", "nbrs").unionByName(found), k), "descent")
        changed = new.join(lists.withColumnRenamed("nbrs", "old"), "id", "left").where(~F.col("nbrs").eqNullSafe(F.col("old"))).count()
        lists = new
        if changed <= settled * max(1, nodes.count()):
            break
    return lists


def _edges(lists: DataFrame) -> DataFrame:
    some = lists.select(F.col("id").alias("a"), F.explode("nbrs").alias("e")).where("e.ok")
    return some.select("a", F.col("e.id").alias("b"))


def full_lists(lists: DataFrame, k: int) -> DataFrame:
    """(id, nbrs) of the nodes whose list has ``k`` edges at the threshold, so that further ones may be hidden."""
    return lists.where((F.size("nbrs") >= k) & F.element_at("nbrs", -1)["ok"])


def _bits():
    return F.least(F.lit(32), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (BUCKET * 0.75))))).cast("int")


def _coded(nodes: DataFrame) -> DataFrame:
    sizes = nodes.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(sizes, "space").withColumn("bits", _bits()).select("id", "space", "bits", "v")


def merge(nodes: DataFrame, lists: DataFrame, edges: DataFrame, roots: DataFrame, k: int, threshold: float, rounds: int, settled: float, seed: int) -> DataFrame:
    """``roots`` after links between nodes with full lists in different components are followed, until none is found."""
    full = full_lists(lists, k)
    while True:
        member = full.select("id").join(nodes, "id").join(roots.withColumnRenamed("v", "id"), "id")
        several = member.groupBy("space").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("space")
        member = materialise(member.join(several, "space").select("id", "space", "v", "root"), "full")
        if member.isEmpty():
            return roots
        seed += 1
        buckets = materialise(_coded(member).mapInArrow(_codes(seed), "id long, g string"), "buckets")
        beyond = materialise(_best(_join_locally(buckets, member, k, threshold), k), "beyond")
        beyond = descend(member, beyond, k, threshold, rounds, settled, own=full.join(member.select("id"), "id", "left_semi"))
        found = materialise(_edges(beyond), "found")
        if found.isEmpty():
            return roots
        edges = edges.unionByName(found)
        roots = components(edges, "graph")


def _lowest(sim: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of the symmetric ``sim`` reaches."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(sim, low, np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return low
        low = new


def _join_blocks(threshold: float):
    """(a, b): of the links of a pair of blocks, as many as connect what they connect."""

    def run(batches):
        for _, group in _groups(batches, ("id", "side", "v")):
            ids, side, x = np.asarray(group.column("id")), np.asarray(group.column("side")), _matrix(group, "v")
            _, sim = _linked(x, x, threshold)
            if (side == 2).any():
                sim &= (side < 2)[:, None] != (side < 2)
            low = _lowest(sim, ids)
            yield pa.record_batch([pa.array(ids[low < ids], pa.int64()), pa.array(low[low < ids], pa.int64())], names=["a", "b"])

    return run


def _count_blocks(threshold: float):
    def run(batches):
        for _, group in _groups(batches, ("id", "side", "copies", "v")):
            ids, side, copies, x = (np.asarray(group.column(c)) if c != "v" else _matrix(group, c) for c in ("id", "side", "copies", "v"))
            left = side < 2
            right = ~left if (side == 2).any() else left
            _, sim = _linked(x[left], x[right], threshold)
            if right is left:
                np.fill_diagonal(sim, False)
                out_id, n = ids[left], sim @ copies[right]
            else:
                out_id, n = np.concatenate([ids[left], ids[right]]), np.concatenate([sim @ copies[right], copies[left] @ sim])
            yield pa.record_batch([pa.array(out_id, pa.int64()), pa.array(n, pa.int64())], names=["id", "links"])

    return run


def _block_pairs(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of blocks of each component: g, id, side, copies, v, sorted by g."""
    member = nodes.join(roots.withColumnRenamed("v", "id"), "id")
    size = member.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    member = member.join(size, "root").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    pairs = member.select(F.concat_ws(":", "root", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "id", side.alias("side"), "copies", "v")
    return pairs.repartition("g").sortWithinPartitions("g")


def count_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(id, links): linked vectors within each component, from blocks compared exactly."""
    counted = _block_pairs(nodes, roots).mapInArrow(_count_blocks(threshold), "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def exactly(nodes: DataFrame, threshold: float) -> DataFrame:
    """Roots from comparing all nodes of a space, a pair of blocks at a time."""
    whole = nodes.select(F.col("id").alias("v"), F.col("space").alias("root"))
    return components(_block_pairs(nodes, whole).mapInArrow(_join_blocks(threshold), "a long, b long"), "exact")


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, full: DataFrame | None = None, sample: int = AUDIT) -> float:
    """Share of the true links of samples that were counted, over all and as a mean of nodes, whichever is less; 1 where there are none.

    The samples are the ``sample`` smallest md5 of id among all nodes, among those with links and among ``full``.
    """
    linked = counted.where("links > 0").select("id")
    held = {}
    for ids in (nodes.select("id"), linked, *([] if full is None else [full.select("id")])):
        some = ids.orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(sample)
        held |= {r["id"]: (r["id"], r["space"], np.array(r["v"])) for r in nodes.join(F.broadcast(some), "id").select("id", "space", "v").collect()}
    held = list(held.values())

    def run(batches):
        for b in batches:
            ids, spaces, copies = b.column("id").to_pylist(), np.array(b.column("space").to_pylist()), np.asarray(b.column("copies"))
            out = []
            for q, space, v in held:
                at = np.flatnonzero(spaces == space)
                if len(at):
                    x = _matrix(b.take(pa.array(at)), "v")
                    hit = _linked(x, v[None, :], threshold)[1][:, 0] & (np.array(ids)[at] != q)
                    out.append((q, int(copies[at][hit].sum())))
            if out:
                q, n = zip(*out)
                yield pa.record_batch([pa.array(q, pa.int64()), pa.array(n, pa.int64())], names=["id", "true"])

    truth = nodes.select("id", "space", "copies", "v").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    f = F.coalesce("links", F.lit(0))
    both = truth.join(counted, "id", "left").where(F.col("true") > 0).agg(F.sum("true").alias("t"), F.sum(f).alias("f"), F.avg(f / F.col("true")).alias("m")).first()
    return min(both["f"] / both["t"], both["m"]) if both["t"] else 1.0


def link(vectors: DataFrame, threshold: float = 0.98, k: int = K, rounds: int = 3, settled: float = 0.02, recall: float = 0.999, tries: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors link when label and length are equal and their cosine is at least ``threshold``.  Null labels, and
    vectors that are null, empty, zero or hold null or non-finite components, link with nothing.  Equal
    vectors link with each other.  Rows without a vec_id link with nothing and have component_id null and kept
    false; a repeated vec_id counts as so many vectors.  An empty table gives no rows.
    """
    rows, nodes = nodes_of(vectors)
    rows, nodes = materialise(rows, "vectors"), materialise(nodes, "nodes")
    coded = _coded(nodes)
    lists = None
    for attempt in range(tries):
        buckets = coded.mapInArrow(_codes(attempt), "id long, g string")
        found = _join_locally(materialise(buckets, "buckets"), nodes, k, threshold)
        lists = materialise(_best(found if lists is None else found.unionByName(lists), k), "lists")
        lists = descend(nodes, lists, k, threshold, rounds, settled)
        edges = _edges(lists)
        roots = components(edges, "graph")
        roots = merge(nodes, lists, edges, roots, k, threshold, rounds, settled, tries + 1000 * attempt)
        counted = materialise(count_links(nodes, roots, threshold), "links")
        if audit(nodes, counted, threshold, full_lists(lists, k)) >= recall:
            break
    else:
        roots = exactly(nodes, threshold)
        counted = materialise(count_links(nodes, roots, threshold), "links")
    return _result(rows, nodes, roots, counted)


def _result(rows: DataFrame, nodes: DataFrame, roots: DataFrame, counted: DataFrame) -> DataFrame:
    info = nodes.select("node", "id", "copies").join(roots.withColumnRenamed("v", "id"), "id", "left").join(counted, "id", "left")
    info = info.select("node", F.coalesce("root", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = rows.join(info, "node", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
