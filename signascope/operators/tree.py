"""Trees as tables (node, parent): closure, clade sizes, distances, neighbours, clusters, parsimony of traits.

The closure (anc, node, hops) comes from joins that double the hops; everything else is a join with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signascope.operators.graph import saved


def closure(tree: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(anc, node, hops) for every node and each of its ancestors, itself at 0 hops.

    Each round joins the ancestors known so far (up to 2^r - 1 hops) with those at 2^r hops and is written, so a tree of depth
    d takes log2(d) rounds, whatever its number of rows.  Raises ValueError beyond ``max_depth``, as for a cycle.
    """
    known = tree.select(F.col("node").alias("anc"), "node", F.lit(0).alias("hops"))
    step = saved(tree.where("parent is not null").select(F.col("parent").alias("anc"), "node"))  # exactly 2^r hops
    width = 1
    while not step.isEmpty():
        if width > max_depth:
            raise ValueError(f"the tree is deeper than {max_depth}")
        far = known.select("anc", F.col("node").alias("mid"), "hops").join(step.select(F.col("anc").alias("mid"), "node"), "mid")
        known = saved(known.unionByName(far.select("anc", "node", (F.col("hops") + width).alias("hops"))))
        step = saved(step.select("anc", F.col("node").alias("mid")).join(step.select(F.col("anc").alias("mid"), "node"), "mid").select("anc", "node"))
        width *= 2
    return known


def tips(tree: DataFrame) -> DataFrame:
    return tree.select("node").join(tree.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")


def clade_sizes(tree: DataFrame, up: DataFrame) -> DataFrame:
    """(node, size): tips at or below each node."""
    return up.join(tips(tree), "node").groupBy(F.col("anc").alias("node")).agg(F.count(F.lit(1)).alias("size"))


def child_clades(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, n_children, least, most): children and their smallest and largest clade."""
    return tree.where("parent is not null").join(sizes, "node").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.min("size").alias("least"), F.max("size").alias("most"))


def ancestor_at_size(up: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """(node, anc): the nearest ancestor with at least ``size`` tips, the root where none has."""
    full = up.join(sizes.withColumnRenamed("node", "anc"), "anc")
    return full.groupBy("node").agg(F.coalesce(F.min_by("anc", F.when(F.col("size") >= size, F.col("hops"))), F.max_by("anc", "hops")).alias("anc"))


def mrca(up: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, anc, ha, hb): nearest common ancestor of each pair (a, b) and the hops to it."""
    ua = up.select(F.col("node").alias("a"), "anc", F.col("hops").alias("ha"))
    ub = up.select(F.col("node").alias("b"), "anc", F.col("hops").alias("hb"))
    every = pairs.join(ua, "a").join(ub, ["b", "anc"])
    return every.groupBy("a", "b").agg(F.min(F.struct("ha", "hb", "anc")).alias("m")).select("a", "b", "m.anc", "m.ha", "m.hb")


def path_distance(up: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, dist, trivial): edges between a and b, and the place of their common ancestor on a's way up, from 1."""
    return mrca(up, pairs).select("a", "b", (F.col("ha") + F.col("hb")).alias("dist"), (F.col("ha") + 1).alias("trivial"))


def lca_depth(up: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, depth): tips under the child of the common ancestor on a's side (of a itself if it is the ancestor)."""
    found = mrca(up, pairs).withColumn("h", F.greatest(F.col("ha") - 1, F.lit(0)))
    side = up.select(F.col("node").alias("a"), F.col("hops").alias("h"), F.col("anc").alias("node"))
    return found.join(side, ["a", "h"]).join(sizes, "node").select("a", "b", F.col("size").alias("depth"))


def tree_knn(up: DataFrame, tip: DataFrame, k: int) -> DataFrame:
    """(i, j, rank, dist): the ``k`` nearest tips by edges, ties by id.

    Seen from below, an ancestor's tips at the same hops are alike but for their ids, so only the ``k`` + 1 smallest of them
    (the tip itself may be one) can be neighbours.  Each tip meets these of its ancestors, up to the lowest one that
    holds more than ``k`` tips and as far up as a tip could still be nearer.
    """
    low = up.join(tip, "node")
    # ids by hops in two steps, so that a large clade is no single task's
    some = lambda d, by: d.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    dealt = low.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64))).groupBy("anc", "hops", "salt").agg(F.slice(F.sort_array(F.collect_set("node")), 1, k + 1).alias("ids"), F.count(F.lit(1)).alias("n"))
    size = dealt.groupBy("anc").agg(F.sum("n").alias("size"))
    near = some(dealt, ["anc", "hops"])
    # by ancestor: its tips by hops, at most k + 1 a hop
    listed = near.groupBy("anc").agg(F.sort_array(F.collect_list(F.struct(F.col("hops").alias("hj"), "ids"))).alias("by")).join(size, "anc")
    path = low.select(F.col("node").alias("i"), "anc", F.col("hops").alias("hi"))
    full = path.join(listed, "anc")
    deepest = F.element_at("by", -1)["hj"]
    bound = full.where(F.col("size") > k).groupBy("i").agg(F.min(F.struct("hi", deepest.alias("deep"))).alias("b")).select("i", (F.col("b.hi") + F.col("b.deep")).alias("bound"))
    pairs = full.join(bound, "i", "left").where("bound is null or hi <= bound").select("i", "hi", F.explode("by").alias("e"))
    pairs = pairs.select("i", (F.col("hi") + F.col("e.hj")).alias("dist"), F.explode("e.ids").alias("j")).where("i <> j").groupBy("i", "j").agg(F.min("dist").alias("dist"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("dist", "j"))), 1, k)
    return pairs.groupBy("i").agg(best.alias("b")).select("i", F.posexplode("b")).select("i", F.col("col.j").alias("j"), (F.col("pos") + 1).alias("rank"), F.col("col.dist").cast("double").alias("dist"))


def clade_neighbours(up: DataFrame, tip: DataFrame, sizes: DataFrame, size: int = 20, block: int = 2048) -> DataFrame:
    """(i, j, w): for each tip the other tips of its lowest clade with more than ``size`` tips, weight 1 (all others have 0).

    The result grows with the square of the clades.  A clade's tips are dealt into lists of about ``block``, and its rows are the
    work of as many tasks; a task holds one list at a time, and only the lists and a row for each tip and list are shuffled.
    A tip's neighbours of one list follow each other, so repeated lists compress well where the result is written.
    """
    path = saved(up.join(tip, "node"))
    own = saved(ancestor_at_size(path, sizes, size + 1).select(F.col("node").alias("i"), "anc"))
    used = saved(own.select("anc").distinct().join(sizes.withColumnRenamed("node", "anc"), "anc").select("anc", F.ceil(F.col("size") / block).cast("int").alias("lists")))
    parts = max(tip.sparkSession.sparkContext.defaultParallelism, used.agg(F.coalesce(F.sum("lists"), F.lit(1))).first()[0])
    listed = path.join(used, "anc").groupBy("anc", F.pmod(F.xxhash64("node"), F.col("lists")).cast("int").alias("list")).agg(F.collect_list("node").alias("js"))
    dealt = own.join(used, "anc").select("i", "anc", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"))
    met = dealt.repartition(parts, "anc", "list").join(listed.repartition(parts, "anc", "list").hint("merge"), ["anc", "list"])
    # the tip itself leaves its list before rows are made of it
    return met.select("i", F.explode(F.array_remove("js", F.col("i"))).alias("j"), F.lit(1.0).alias("w"))


def fitch_sets(tree: DataFrame, labels: DataFrame, up: DataFrame) -> DataFrame:
    """(node, labels, cost): plurality label set of each node (sorted) and, for inner nodes, children minus the largest count.

    Levels are worked off from the deepest; each is a join of sets with parents and a count.
    """
    height = up.groupBy("anc").agg(F.max("hops").alias("height")).withColumnRenamed("anc", "node")
    deepest = height.agg(F.max("height")).first()[0] or 0
    sets = labels.select("node", F.array("level").alias("labels"), F.lit(0).cast("long").alias("cost"))
    inner = tree.where("parent is not null").select("node", "parent")
    for h in range(1, deepest + 1):
        level = height.where(F.col("height") == h).select(F.col("node").alias("parent"))
        votes = sets.join(inner, "node").join(level, "parent").select("parent", "node", F.explode("labels").alias("l"))
        kids = inner.join(level, "parent").groupBy("parent").agg(F.count(F.lit(1)).alias("kids"))
        count = votes.groupBy("parent", "l").agg(F.count(F.lit(1)).alias("n")).join(kids, "parent")
        top = count.withColumn("top", F.max("n").over(Window.partitionBy("parent"))).where("n = top")
        new = top.groupBy(F.col("parent").alias("node")).agg(F.sort_array(F.collect_list("l")).alias("labels"), (F.max("kids") - F.max("top")).alias("cost"))
        sets = saved(sets.unionByName(new))
    return sets


def fitch_assignment(tree: DataFrame, sets: DataFrame, up: DataFrame) -> DataFrame:
    """(node, level): the parent's label where the set has it, else the smallest of the set, from the root down."""
    depth = up.groupBy("node").agg(F.max("hops").alias("depth"))
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    full = sets.join(tree.select("node", "parent"), "node").join(depth, "node")
    done = full.where("depth = 0").select("node", F.array_min("labels").alias("level"))
    for d in range(1, deepest + 1):
        own = full.where(F.col("depth") == d).join(done.select(F.col("node").alias("parent"), F.col("level").alias("above")), "parent")
        done = saved(done.unionByName(own.select("node", F.when(F.array_contains("labels", F.col("above")), F.col("above")).otherwise(F.array_min("labels")).alias("level"))))
    return done


def parsimony(tree: DataFrame, assigned: DataFrame) -> DataFrame:
    """(score): parents and children with different labels."""
    up = assigned.select(F.col("node").alias("parent"), F.col("level").alias("above"))
    return tree.where("parent is not null").join(assigned, "node").join(up, "parent").agg(F.sum((F.col("level") != F.col("above")).cast("long")).alias("score"))


def node_scores(sets: DataFrame, up: DataFrame) -> DataFrame:
    """(node, score): label changes in each inner node's subtree over its nodes less one."""
    full = up.join(sets.select("node", "cost"), "node").groupBy("anc").agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("n"))
    return full.where("n > 1").select(F.col("anc").alias("node"), (F.col("c") / (F.col("n") - 1)).alias("score"))


def plasticity(tree: DataFrame, scores: DataFrame, up: DataFrame) -> DataFrame:
    """(node, plasticity): mean score of a tip's ancestors."""
    above = up.where("hops > 0").join(tips(tree), "node")
    return above.join(scores.withColumnRenamed("node", "anc"), "anc").groupBy("node").agg(F.avg("score").alias("plasticity"))


def ultrametric(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, edge_len): tips of the parent less tips of the node."""
    above = sizes.select(F.col("node").alias("parent"), F.col("size").alias("above"))
    return tree.where("parent is not null").join(sizes, "node").join(above, "parent").select("node", (F.col("above") - F.col("size")).cast("double").alias("edge_len"))


def clusters_by_size(tree: DataFrame, up: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """(node, cluster): each tip's highest ancestor with at most ``size`` tips."""
    low = up.join(tips(tree), "node").join(sizes.withColumnRenamed("node", "anc"), "anc").where(F.col("size") <= size)
    return low.groupBy("node").agg(F.max_by("anc", "hops").alias("cluster"))


def clusters_by_min_clade(tree: DataFrame, up: DataFrame, sizes: DataFrame, size: int = 30) -> DataFrame:
    """(node, cluster): clades are opened from the root while all of a node's child clades have at least ``size`` tips."""
    least = child_clades(tree, sizes).select(F.col("node").alias("anc"), "least")
    path = up.join(tips(tree), "node").join(least, "anc", "left").withColumn("open", F.coalesce(F.col("least") >= size, F.lit(False)))
    # the highest ancestor that stays shut
    return path.where("not open").groupBy("node").agg(F.max_by("anc", "hops").alias("cluster"))


def _spans(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """(low, size, high, nodes): how many nodes have ``size`` tips, ``low`` in their smallest child clade (0: no child) and
    ``high`` in the parent's clade (null: no parent).

    Written once; a search over sizes counts clusters in it and does not make them.
    """
    low = child_clades(tree, sizes).select("node", F.col("least").alias("low"))
    above = sizes.select(F.col("node").alias("parent"), F.col("size").alias("high"))
    full = tree.join(sizes, "node").join(low, "node", "left").join(above, "parent", "left")
    return saved(full.groupBy(F.coalesce("low", F.lit(0)).alias("low"), "size", "high").agg(F.count(F.lit(1)).alias("nodes")))


def _clusters(spans: DataFrame, chosen) -> int:
    return spans.where(chosen).agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]


def clusters_to_target(tree: DataFrame, up: DataFrame, sizes: DataFrame, target: int = 10) -> DataFrame:
    """``clusters_by_size`` at the largest size that gives at least ``target`` clusters (found by halving)."""
    low, high, spans = 1, int(sizes.agg(F.max("size")).first()[0] or 1), _spans(tree, sizes)
    while low < high:
        mid = (low + high + 1) // 2
        if _clusters(spans, (F.col("size") <= mid) & (F.col("high").isNull() | (F.col("high") > mid))) >= target:
            low = mid
        else:
            high = mid - 1
    return clusters_by_size(tree, up, sizes, low)


def clusters_at_depth(tree: DataFrame, up: DataFrame, sizes: DataFrame, target: int = 10) -> DataFrame:
    """(node, cluster): each tip's lowest ancestor with at least d tips, d found by halving between 0 and the number of tips.

    The search moves up where a cut gives at least ``target`` clusters and down where it gives fewer, and keeps the cut it
    tried last, which may be one with fewer (halves are rounded to even).
    """
    low, high, tip, cut = 0, int(sizes.agg(F.max("size")).first()[0] or 1), tips(tree), 0
    spans = _spans(tree, sizes)
    while low != high and (d := round((low + high) / 2)):
        cut = d
        # nodes that some tip's way up enters at d, and trees that are smaller
        enough = _clusters(spans, (F.col("low") < d) & (F.col("size") >= d) | F.col("high").isNull() & (F.col("size") < d)) >= target
        if d == (low if enough else high):
            break
        low, high = (d, high) if enough else (low, d)
    return ancestor_at_size(up.join(tip, "node"), sizes, cut).withColumnRenamed("anc", "cluster") if cut else tip.select("node", F.col("node").alias("cluster"))


def clusters_cladewise(tree: DataFrame, up: DataFrame, sizes: DataFrame, target: int = 10, by: str = "size") -> DataFrame:
    """(node, cluster): clades are opened from the root, the largest first, until there are at least ``target``.

    Largest by tips (``by="size"``) or by the largest child clade (``by="most"``); of equals the one nearer the root, then by
    name.  A clade is never larger than the one that holds it, so those opened are a prefix of all inner nodes in that order.
    """
    order = child_clades(tree, sizes).join(sizes, "node").join(up.groupBy("node").agg(F.max("hops").alias("depth")), "node")
    order = order.select("node", F.col(by).alias("key"), "depth", (F.col("n_children") - 1).alias("more"))
    # the key at which the target is reached, from one row a key; the rest is settled among nodes of that key
    totals = order.groupBy("key").agg(F.sum("more").alias("more")).withColumn("upto", F.sum("more").over(Window.orderBy(F.desc("key"))))
    cut = totals.where(F.col("upto") + 1 >= target).agg(F.max("key").alias("cut")).first()["cut"]
    if cut is None:
        opened = order.select("node")
    else:
        before = int(totals.where(F.col("key") > cut).agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]) + 1
        tied = order.where(F.col("key") == cut)
        # a node with several children adds one cluster or more, so as many of them are enough
        most = max(1, target) + tied.where("more < 1").count()
        edge = tied.orderBy("depth", "node").limit(most).withColumn("upto", F.sum("more").over(Window.orderBy("depth", "node")) - F.col("more"))
        opened = order.where(F.col("key") > cut).select("node").unionByName(edge.where(F.lit(before) + F.col("upto") < target).select("node"))
    path = up.join(tips(tree), "node").join(opened.select(F.col("node").alias("anc"), F.lit(True).alias("open")), "anc", "left")
    return path.where("open is null").groupBy("node").agg(F.max_by("anc", "hops").alias("cluster"))


def parsimony_rate(tree: DataFrame, assigned: DataFrame) -> DataFrame:
    """(rate): label changes over edges."""
    n = tree.agg((F.count(F.lit(1)) - 1).alias("edges"))
    return parsimony(tree, assigned).crossJoin(F.broadcast(n)).select((F.col("score") / F.col("edges")).alias("rate"))
