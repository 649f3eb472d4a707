"""Stages of the analysis against plain Python: trees, neighbours, permutations, pools, backgrounds, comparisons."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signascope.functions import stats
from signascope.operators import background, contrast, graph, latent, matrix, pools, principal, score, trajectory
from signascope.operators import tree as trees
from signascope.plans import analysis, bindings
from signascope.sources import files


def random_tree(n, seed):
    """(node, parent) rows of a tree with ``n`` nodes, and the parents by node."""
    rng = random.Random(seed)
    parent = {"n000": None} | {f"n{k:03d}": f"n{rng.randrange(max(0, k - 9), k):03d}" for k in range(1, n)}
    return list(parent.items()), parent


def up_of(parent, x):
    out = []
    while x is not None:
        out.append(x)
        x = parent[x]
    return out


def test_tree_closure_and_its_limit(spark):
    rows, parent = random_tree(80, 1)
    t = spark.createDataFrame(rows, "node string, parent string")
    got = {(r["anc"], r["node"]): r["hops"] for r in trees.closure(t).collect()}
    assert got == {(a, x): h for x in parent for h, a in enumerate(up_of(parent, x))}
    chain = spark.range(200).select(F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    assert trees.closure(chain).agg(F.max("hops"), F.count(F.lit(1))).first()[:] == (199, 200 * 201 // 2)
    with pytest.raises(ValueError):
        trees.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"), 50)
    assert trees.closure(t.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [2])
def test_tree_neighbours_and_clusters(spark, seed):
    rows, parent = random_tree(70, seed)
    t = spark.createDataFrame(rows, "node string, parent string")
    up = graph.saved(trees.closure(t))
    tips = sorted(set(parent) - set(parent.values()))
    below = {x: [t for t in tips if x in up_of(parent, t)] for x in parent}

    def far(a, b):
        ua, ub = up_of(parent, a), up_of(parent, b)
        return min(ua.index(x) + ub.index(x) for x in ua if x in ub)

    for k in (4, 100):
        got = {}
        for r in trees.tree_knn(up, trees.tips(t), k).orderBy("i", "rank").collect():
            got.setdefault(r["i"], []).append((r["dist"], r["j"]))
        assert got == {a: sorted((float(far(a, b)), b) for b in tips if b != a)[:k] for a in tips}
    sizes = trees.clade_sizes(t, up)
    near = {(r["i"], r["j"]) for r in trees.clade_neighbours(up, trees.tips(t), sizes, 5).collect()}
    own = {a: next((below[x] for x in up_of(parent, a) if len(below[x]) > 5), tips) for a in tips}
    assert near == {(a, b) for a in tips for b in own[a] if a != b}
    for by in ("size", "most"):
        for target in (1, 5, len(tips)):
            got = {r["node"]: r["cluster"] for r in trees.clusters_cladewise(t, up, sizes, target, by).collect()}
            kids = {x: [y for y in parent if parent[y] == x] for x in parent}
            key = {x: len(below[x]) if by == "size" else max((len(below[y]) for y in kids[x]), default=1) for x in parent}
            opened, frontier = set(), {"n000"}
            for x in sorted((x for x in parent if kids[x]), key=lambda x: (-key[x], len(up_of(parent, x)), x)):
                if len(frontier) >= target:
                    break
                frontier = frontier - {x} | set(kids[x])
                opened.add(x)
            assert set(got) == set(tips) and set(got.values()) == frontier, (by, target)
    cut = {r["node"]: r["cluster"] for r in trees.clusters_at_depth(t, up, sizes, 4).collect()}
    assert set(cut) == set(tips) and all(c in up_of(parent, x) for x, c in cut.items())
    fewest = {r["node"]: r["cluster"] for r in trees.clusters_to_target(t, up, sizes, 4).collect()}
    assert len(set(fewest.values())) >= 4


def test_permutations_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, 30).astype(float)
    values = spark.createDataFrame([(i, f, v) for i in range(30) for f, v in (("a", float(x[i])), ("flat", 1.0), ("gap", None if i == 3 else float(i)))], "id long, feature string, value double")
    edges = [(i, int(j), float(w)) for i in range(30) for j, w in zip(rng.choice([k for k in range(30) if k != i], 3, replace=False), rng.random(3))]
    e = spark.createDataFrame(edges, "i long, j long, w double")
    got = {r["feature"]: (r["c"], r["p"]) for r in graph.permutation_p(values, e, 40).collect()}
    assert got["flat"] == (0.0, 1.0) and got["gap"] == (0.0, 1.0)
    rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    c = lambda y: 1 - sum(w * (y[i] - y[j]) ** 2 for i, j, w in edges) / (2 * sum(w for *_, w in edges) * y.var(ddof=1))
    hits = 0
    for rep in range(40):
        y = rank[background.places(np.arange(30), 30, np.int64(rep))]
        hits += round(c(y) - c(rank), 12) >= 0
    assert got["a"][0] == pytest.approx(c(rank)) and got["a"][1] == pytest.approx((hits + 1) / 41)
    # ranks that do not fit one task's share go in blocks of places, each pair of blocks in a pass
    monkeypatch.setattr(background, "SENT", 13)
    monkeypatch.setattr(background, "EDGES", 20)
    again = {r["feature"]: (r["c"], r["p"]) for r in graph.permutation_p(values, e, 40).collect()}
    assert again == {f: (pytest.approx(c), pytest.approx(p)) for f, (c, p) in got.items()}


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_keyed_bijections(n):
    every = np.stack([background.places(np.arange(n), n, np.int64(k)) for k in range(300)])
    assert (np.sort(every, axis=1) == np.arange(n)).all()
    if n >= 64:  # places are even, and neighbours are not kept together
        assert abs(every[:, 0].mean() / (n - 1) - 0.5) < 0.06 and len({tuple(r) for r in every.tolist()}) == 300
        assert abs(np.corrcoef(every[:, 0], every[:, 1])[0, 1]) < 0.2


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_average_ranks_in_ranges(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, f, float(v)) for f, many in (("ties", 4), ("all", 10**6)) for i, v in enumerate(rng.integers(0, many, 300))]
    df = spark.createDataFrame(rows, "id long, f string, v double")
    x = {f: np.array([v for _, g, v in rows if g == f]) for f in ("ties", "all")}
    want = {(i, f): (x[f] < v).sum() + ((x[f] == v).sum() + 1) / 2 for i, f, v in rows}
    assert {(r["id"], r["f"]): r["rank"] for r in stats.average_rank(df, ["f"], "v", parts=parts).collect()} == want


@pytest.mark.parametrize("method", ["znorm_columns", "znorm_rows", "znorm_rows_then_columns", "rank_norm_columns", "none"])
def test_random_signatures_against_plain_scores(spark, monkeypatch, method):
    """Autocorrelation of random signatures as blocks against that of their score rows."""
    rng = np.random.default_rng(5)
    expr = spark.createDataFrame([(f"c{i:02d}", f"g{j:02d}", float(v)) for i in range(25) for j in range(18) if (v := rng.integers(0, 4))], "cell string, gene string, value double")
    edges = spark.createDataFrame([(f"c{i:02d}", f"c{j:02d}", float(w)) for i in range(25) for j, w in zip(rng.choice([k for k in range(25) if k != i], 3, replace=False), rng.random(3))], "i string, j string, w double")
    groups = [(1, 3, 1.0), (2, 6, 0.6)]
    monkeypatch.setattr(background, "HELD", 100)
    got = background.random_autocorrelation(*score.scaled(expr, method), edges, groups, 7, seed=2).collect()
    names = sorted(r["gene"] for r in expr.select("gene").distinct().collect())
    sig, gene, sign = background.drawn(groups, 7, len(names), seed=2)
    sigs = spark.createDataFrame([(f"s{s}", names[g], float(w)) for s, g, w in zip(sig, gene, sign)], "sig string, gene string, sign double")
    plain = {r["feature"]: r["c"] for r in graph.autocorrelation(analysis.as_values(score.scores(expr, sigs, method).withColumn("score", F.round("score", 9))), edges).collect()}
    for g in (1, 2):
        assert sorted(r["bg"] for r in got if r["grp"] == g) == pytest.approx(sorted(plain[f"s{k}"] for k in range(7 * (g - 1), 7 * g)))


def test_random_signatures_send_no_scores(spark, monkeypatch):
    """Signatures' scores, cells times signatures, are made where they are ranked; edges may come before the cells."""
    expr = spark.createDataFrame([(f"c{i:02d}", f"g{j}", float(i * j % 5)) for i in range(20) for j in range(6)], "cell string, gene string, value double")
    edges = spark.createDataFrame([(f"c{i:02d}", f"c{(i + k) % 20:02d}", 0.5) for i in range(20) for k in (1, 3)], "i string, j string, w double")
    plain = background.random_autocorrelation(*score.scaled(expr), edges, [(1, 3, 1.0)], 9)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    union = type(plain).unionByName
    monkeypatch.setattr(type(plain), "unionByName", lambda a, b: union(b, a))
    turned = background.random_autocorrelation(*score.scaled(expr), edges, [(1, 3, 1.0)], 9)
    assert sorted(r["bg"] for r in turned.collect()) == pytest.approx(sorted(r["bg"] for r in plain.collect()))


def test_louvain_merges_small_cliques(spark):
    """A ring of triangles: local moves alone stop at triangles, the larger graph joins some."""
    edges = [(3 * c + a, 3 * c + b, 1.0) for c in range(12) for a, b in ((0, 1), (1, 2), (0, 2))] + [(3 * c, (3 * c + 4) % 36, 1.0) for c in range(12)]
    e = spark.createDataFrame(edges, "i long, j long, w double")
    label = graph.saved(graph.louvain_levels(e))
    triangles = spark.createDataFrame([(i, i // 3) for i in range(36)], "id long, cluster long")
    assert graph.modularity(e, label).first()["q"] > graph.modularity(e, triangles).first()["q"]
    assert label.count() == 36 and label.groupBy("cluster").agg(F.min("id").alias("m")).where("m <> cluster").isEmpty()


def test_pools_of_about_the_wanted_size(spark):
    x = np.random.default_rng(6).normal(size=(120, 3))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    one = vec.select("id", F.lit("all").alias("cluster"))
    got = pools.split_clusters(vec, one, 10, rounds=4).collect()
    names = {r["cluster"] for r in got}
    assert len(got) == 120 and 0.85 * 12 <= len(names) <= 24
    inside = np.mean([x[[r["id"] for r in got if r["cluster"] == c]].var(0).sum() for c in names])
    assert inside < 0.5 * x.var(0).sum()
    same = vec.withColumn("vec", F.array(F.lit(1.0)))
    assert pools.split_clusters(same, one, 10, rounds=2).select("cluster").distinct().count() == 1


def test_signature_clusters(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(2, 12))
    x = {f"s{k:02d}": base[k % 2] + rng.normal(size=12) * 0.2 for k in range(24)} | {"z": rng.normal(size=12)}
    values = spark.createDataFrame([(i, f, float(v[i])) for f, v in x.items() for i in range(12)], "id long, feature string, value double")
    auto = spark.createDataFrame([(f, 0.5 if f != "z" else 0.1, 0.01) for f in x], "feature string, c double, fdr double")
    got = {r["feature"]: r["cluster"] for r in pools.signature_clusters(values, auto).collect()}
    assert got == {f"s{k:02d}": 1 + k % 2 for k in range(24)} | {"z": 3}
    few = {r["feature"]: r["cluster"] for r in pools.signature_clusters(values.where("feature in ('s00', 's01', 'z')"), auto).collect()}
    assert few == {"s00": 1, "s01": 1, "z": 2}
    factors = spark.createDataFrame([(1, "half", "a"), (2, "half", "b")], "id long, var string, level string")
    meta = {r["feature"]: r["cluster"] for r in pools.meta_clusters(factors, spark.createDataFrame([("half_a",), ("depth",)], "feature string"), True).collect()}
    assert meta == {"half": 2, "half_a": 2, "depth": 1}


def test_signature_background(spark):
    sigs = spark.createDataFrame([(f"s{n}_{k}", f"g{j}", 1.0 if j < n * share else -1.0) for n in (4, 40) for k in range(6) for share in (1.0, 0.5)[k % 2 : k % 2 + 1] for j in range(n)], "sig string, gene string, sign double")
    member, groups = analysis.size_groups(sigs)
    rows = {(r["k"], round(r["balance"], 3)): r["grp"] for r in groups.collect()}
    assert rows == {(4, 0.5): 1, (4, 1.0): 2, (40, 0.5): 3, (40, 1.0): 4}
    own = {r["sig"]: r["grp"] for r in member.collect()}
    assert own["s4_1"] == 1 and own["s4_0"] == 2 and own["s40_3"] == 3 and own["s40_2"] == 4
    sig, gene, sign = background.drawn([(1, 5, 0.7)], 200, 60)
    drawn = [(sorted(gene[sig == k]), (sign[sig == k] > 0).sum()) for k in range(200)]
    assert all(len(set(g)) == 5 and max(g) < 60 for g, _ in drawn) and {up for _, up in drawn} == {3, 4}
    assert 0.3 < np.mean([up == 4 for _, up in drawn]) < 0.7 and len({tuple(g) for g, _ in drawn}) > 195
    assert [len(x) for x in background.drawn([], 5, 9)] == [0, 0, 0]


def test_rank_sum_edges(spark):
    """No columns, an empty and a full cluster; three against two without ties."""
    values = spark.createDataFrame([(i, "f", v) for i, v in enumerate((1.0, 2.0, 3.0, 4.0, 5.0))], "id long, feature string, value double")
    level = lambda ids: spark.createDataFrame([(i, "v", "in" if i in ids else "out") for i in range(5)], "id long, var string, level string")
    got = {r["level"]: r for r in contrast.one_vs_rest(values, level({0, 1, 2})).collect()}
    assert got["in"]["auc"] == 0 and got["in"]["p"] == pytest.approx(0.14891467) and got["out"]["auc"] == 1
    full = contrast.one_vs_rest(values, level(set(range(5)))).first()
    assert full["auc"] == 0.5 and full["p"] == 1
    assert contrast.one_vs_rest(values.limit(0), level({0})).collect() == []


@pytest.mark.parametrize("k", [3, 40])
def test_trajectory_neighbours(spark, k):
    rng = random.Random(k)
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("b", "d", 3.0)], "a string, b string, length double")
    prog = spark.createDataFrame([(i, *rng.choice([("a", "b"), ("b", "c"), ("b", "d")]), rng.randrange(5) / 4) for i in range(36)], "cell long, a string, b string, position double")
    every = trajectory.distances(edges, prog, prog).withColumn("dist", F.round("dist", 9))
    expect = {(r["i"], r["rank"]): (r["j"], r["dist"]) for r in trajectory.nearest(every, k).collect()}
    assert {(r["i"], r["rank"]): (r["j"], r["dist"]) for r in trajectory.knn(edges, prog, k).collect()} == expect


def test_trajectory_neighbours_of_cells_at_their_own_places(spark):
    """A long edge of cells that are apart, some of them together: as many blocks as k gives, equal to all distances."""
    rng = random.Random(9)
    edges = spark.createDataFrame([("a", "b", 8.0), ("b", "c", 1.0)], "a string, b string, length double")
    prog = spark.createDataFrame([(i, *(("a", "b") if i % 9 else ("b", "c")), 0.5 if i % 4 == 0 else rng.random()) for i in range(70)], "cell long, a string, b string, position double")
    every = trajectory.distances(edges, prog, prog).withColumn("dist", F.round("dist", 9))
    for k in (1, 4, 9):
        expect = {(r["i"], r["rank"]): (r["j"], pytest.approx(r["dist"], abs=5e-9)) for r in trajectory.nearest(every, k).collect()}
        assert {(r["i"], r["rank"]): (r["j"], r["dist"]) for r in trajectory.knn(edges, prog, k).collect()} == expect


def test_sparse_columns_become_entries(spark):
    e = matrix.clip_bottom(spark.createDataFrame([(1, 0.5), (2, 3.0), (3, None)], "id long, value double"), 1)
    assert [r["value"] for r in e.orderBy("id").collect()] == [1.0, 3.0, None]


def test_permutation_components(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 8)) * 3
    x = base + rng.normal(size=(60, 8)) * 0.3 + 20
    expr = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(60) for j in range(8)], "cell long, gene string, value double")
    assert latent.permutation_components(expr, expr.select("gene").distinct(), 6, 5, least=1) == 2


def test_compressed_columns_and_feature_types(spark):
    entries = files.csc_entries(spark.createDataFrame([(0, [0, 2], [4.0, 1.0]), (1, [1], [7.0]), (2, [], [])], "j long, indices array<long>, data array<double>"))
    assert sorted(map(tuple, entries.collect())) == [(0, 0, 4.0), (1, 1, 7.0), (2, 0, 1.0)]
    expr = entries.select(F.col("j").alias("cell"), F.concat(F.lit("f"), "i").alias("gene"), "value")
    kinds = spark.createDataFrame([("f0", "Gene Expression"), ("f1", "Antibody Capture"), ("f2", "Gene Expression")], "gene string, feature_type string")
    genes, proteins = files.split_features(expr, kinds)
    assert genes.count() == 2 and [tuple(r) for r in proteins.collect()] == [(1, "f1", 7.0)]


def test_principal_tree_finds_a_fork(spark):
    """Points along three arms from one place: the tree's nodes lie on the arms, one node or two in the middle branch."""
    rng = np.random.default_rng(2)
    arms = np.array([[1.0, 0.0], [-0.5, 0.9], [-0.5, -0.9]])
    x = np.array([arms[k % 3] * 10 * rng.random() + rng.normal(0, 0.15, 2) for k in range(240)])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    tree = principal.fit(points, 16, sigma=0.5, gamma=2.0, tolerance=1e-4)
    assert all(a >= b - 1e-9 for a, b in zip(tree.scores, tree.scores[1:])) and len(tree.scores) > 2
    off = [min(np.linalg.norm(v - max(0.0, min(10.0, v @ a / (a @ a))) * a) for a in arms) for v in tree.nodes]
    assert max(off) < 0.6 and len(tree.edges) == 15
    degree = np.bincount(np.array(tree.edges).ravel(), minlength=16)
    assert (degree == 1).sum() == 3 and np.linalg.norm(tree.nodes[degree > 2], axis=1).max() < 2.5
    d2 = ((x[:, None] - tree.nodes[None]) ** 2).sum(2)
    assert tree.mse == pytest.approx(d2.min(1).mean()) == pytest.approx(principal.mean_squared_error(points, tree).first()["mse"])
    assert {r["id"]: r["node"] for r in principal.assigned(points, tree).collect()} == dict(enumerate(d2.argmin(1)))
    assert principal.fit(points.limit(0), 4).edges == []


def test_spanning_tree_against_kruskal():
    rng = np.random.default_rng(3)
    for m in (1, 2, 9, 30):
        x = rng.integers(0, 4, (m, 2)).astype(float) if m == 30 else rng.normal(size=(m, 3))
        ways, part, length = sorted((((x[a] - x[b]) ** 2).sum(), a, b) for a in range(m) for b in range(a)), list(range(m)), 0.0
        for d, a, b in ways:
            if part[a] != part[b]:
                part, length = [part[a] if p == part[b] else p for p in part], length + d
        found = principal.spanning_tree(x)
        assert len(found) == m - 1 and sum(((x[a] - x[b]) ** 2).sum() for a, b in found) == pytest.approx(length)


def test_local_correlation_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = np.where(rng.random((30, 4)) < 0.7, rng.normal(size=(30, 4)), 0.0)
    x[:, 3] = 0
    pairs = {(i, int(j)): float(rng.random()) for i in range(30) for j in rng.choice([k for k in range(30) if k != i], 3, replace=False)}
    values = spark.createDataFrame([(i, f"f{k}", float(x[i, k])) for i in range(30) for k in range(4) if x[i, k] or (i == 0 and k == 3)], "id long, feature string, value double")
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in pairs.items()], "i long, j long, w double")
    s = np.zeros((30, 30))
    for (i, j), w in pairs.items():
        s[i, j] += w / 2
        s[j, i] += w / 2
    sd = x.std(0)
    y = (x - x.mean(0)) / np.where(sd > 0, sd, np.inf)
    h = y.T @ s @ y
    got = {(r["a"], r["b"]): (r["lc"], r["z"]) for r in graph.local_correlation(values, edges).collect()}
    assert got == {(f"f{a}", f"f{b}"): (pytest.approx(h[a, b] / s.sum()), pytest.approx(h[a, b] / np.sqrt((s**2).sum()))) for a in range(4) for b in range(a + 1, 4)}
    assert graph.local_correlation(values.limit(0), edges).collect() == []


def test_clipping_a_sparse_matrix(spark):
    e = spark.createDataFrame([(1, "a", 0.5), (2, "b", 3.0), (2, "c", None)], "cell long, gene string, value double")
    got = {(r["cell"], r["gene"]): r["value"] for r in matrix.clip_bottom(e, 1, over=("cell", "gene")).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 1.0, (1, "c"): 1.0, (2, "a"): 1.0, (2, "b"): 3.0, (2, "c"): None}
    assert matrix.clip_bottom(e, -1, over=("cell", "gene")).count() == 3


def test_sums_do_not_depend_on_the_order_of_orders(spark, tmp_path):
    """0.1 to 0.3 and 1e16 add up to other doubles in another order; both tables must give the same totals, and keep every row."""
    rows = [(c * 10 + k, c, x) for c in range(40) for k, x in enumerate((1e16, 0.1, 1.0, -1e16, 0.3, 0.7, None))]
    spark.createDataFrame([(c, 1.0) for c in range(41)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = []
    for name, some in (("a", rows), ("b", rows[::-1])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(some, "o_orderkey long, o_custkey long, o_totalprice double").repartition(3).write.parquet(f"{d}/orders.parquet")
        spark.read.parquet(f"{tmp_path}/customer.parquet").write.parquet(f"{d}/customer.parquet")
        got.append({(r["id"], r["feature"]): r["value"] for r in bindings.numbers(spark, d).collect()})
    assert got[0] == got[1] and len(got[0]) == 123 and got[0][(40, "spent")] is None
    expect = 0.0
    for x in (1e16, 0.1, 1.0, -1e16, 0.3, 0.7):
        expect += x
    assert got[0][(7, "spent")] == expect and got[0][(7, "orders")] == 7


def test_rank_sum_keeps_rows_whose_values_differ_when_made_again(spark):
    fresh = F.udf(lambda _: random.random(), "double").asNondeterministic()
    values = spark.range(400).select("id", F.lit("x").alias("feature"), fresh("id").alias("value"))
    levels = spark.range(400).select("id", F.lit("v").alias("var"), (F.col("id") % 2).cast("string").alias("level"))
    got = {r["level"]: r["auc"] for r in contrast.one_vs_rest(values, levels).collect()}
    assert len(got) == 2 and got["0"] + got["1"] == pytest.approx(1.0)


def test_trajectory_distances_shuffle_no_pairs(spark):
    """Distances are one row a pair; a cell on two edges counts by the nearer place; neighbours of some cells are theirs among all."""
    rng = random.Random(5)
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("b", "d", 3.0)], "a string, b string, length double")
    rows = [(i, *rng.choice([("a", "b"), ("b", "c"), ("b", "d")]), rng.randrange(9) / 8) for i in range(40)]
    prog = spark.createDataFrame(rows, "cell long, a string, b string, position double")
    asked = prog.where("cell % 10 = 0")
    length, path = {("a", "b"): 2.0, ("b", "c"): 1.0, ("b", "d"): 3.0}, {"a": 2.0, "b": 0.0, "c": 1.0, "d": 3.0}

    def apart(x, y):
        if x[1:3] == y[1:3]:
            return abs(x[3] - y[3]) * length[x[1:3]]
        ends = lambda r: ((r[1], r[3] * length[r[1:3]]), (r[2], (1 - r[3]) * length[r[1:3]]))
        return min(p + q + (0.0 if m == n else path[m] + path[n]) for m, p in ends(x) for n, q in ends(y))

    got = trajectory.distances(edges, prog, asked)
    assert "Exchange hashpartitioning(i" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["i"], r["j"]): round(r["dist"], 9) for r in got.collect()} == {(x[0], y[0]): round(apart(x, y), 9) for x in rows for y in rows if x[0] % 10 == 0 and x[0] != y[0]}
    near = lambda *a: {(r["i"], r["rank"]): (r["j"], r["dist"]) for r in trajectory.knn(edges, prog, 4, *a).collect()}
    assert near(asked) == {key: x for key, x in near().items() if key[0] % 10 == 0}
    twice = prog.unionByName(spark.createDataFrame([(0, "b", "d", 0.125), (0, "b", "c", 0.125)], prog.schema))
    more = {(r["i"], r["j"]): r["dist"] for r in trajectory.distances(edges, twice, asked).collect()}
    places = [rows[0], (0, "b", "d", 0.125), (0, "b", "c", 0.125)]
    assert all(more[0, y[0]] == pytest.approx(min(apart(x, y) for x in places)) for y in rows[1:])
    best = sorted((round(min(apart(x, y) for x in places), 9), y[0]) for y in rows[1:])[:4]
    assert [(r["dist"], r["j"]) for r in trajectory.knn(edges, twice, 4, asked).where("i = 0").orderBy("rank").collect()] == best


def test_a_clades_pairs_are_the_work_of_many_tasks(spark):
    """One clade of 60 tips, and one of three inside it that is too small: lists of about eight, in as many tasks."""
    rows = [("root", None), ("b", "root"), *[(f"t{k:02}", "b" if k < 3 else "root") for k in range(60)]]
    t = spark.createDataFrame(rows, "node string, parent string")
    up = graph.saved(trees.closure(t))
    found = trees.clade_neighbours(up, trees.tips(t), trees.clade_sizes(t, up), 20, 8)
    rows = found.select("i", "j", F.spark_partition_id().alias("p")).collect()
    tips = [f"t{k:02}" for k in range(60)]
    assert sorted((r["i"], r["j"]) for r in rows) == [(a, b) for a in tips for b in tips if a != b]
    share = {p: sum(r["p"] == p for r in rows) for p in {r["p"] for r in rows}}
    assert len(share) > 2 and max(share.values()) < len(rows) / 2


@pytest.mark.parametrize("n", [2, 5, 1000, 70000])
def test_places_of_one_permutation(n):
    at = np.arange(0, n, max(1, n // 500))
    assert all((background.places(at, n, np.int64(k)) == background.places_of_one(at, n, k)).all() for k in (0, 1, 2999))


def test_permutations_in_one_pass_of_shared_neighbours(spark, monkeypatch):
    """Ranks of 20 000 nodes go to the tasks once; nodes with the same neighbours, and one with many edges, give plain sums."""
    asked = []
    monkeypatch.setattr(background, "_vectors", lambda *a, own=background._vectors: asked.append(a) or own(*a))
    monkeypatch.setattr(background, "HEAVY", 50)
    n, rng = 20_000, np.random.default_rng(1)
    edges = [(i, i % 7 * 3 + k, 0.5 + k / 4) for i in range(100, 200) for k in range(3)] + [(5, j, 1.0) for j in range(300, 400)] + [(i, i + 1, 0.3) for i in range(9000, 9050)]
    x = rng.integers(0, n // 2, n).astype(float)
    values = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x.tolist())], "id long, feature string, value double")
    got = graph.permutation_p(values, spark.createDataFrame(edges, "i long, j long, w double"), 30).first()
    order = np.sort(x)
    rank = (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2
    i, j, w = (np.array(c) for c in zip(*edges))
    c = lambda y: 1 - w @ (y[i] - y[j]) ** 2 / (2 * w.sum() * rank.var(ddof=1))
    hits = sum(round(c(rank[background.places(np.arange(n), n, np.int64(r))]) - c(rank), 12) >= 0 for r in range(30))
    assert got["c"] == pytest.approx(c(rank)) and got["p"] == pytest.approx((hits + 1) / 31) and len(asked) == 1
    i, j, w = i.astype(np.int64), j.astype(np.int64), w.astype(float)
    shared = background._Shared(i, j, w)
    assert len(shared.count) < 70  # 7 lists of 100 nodes, one of many edges, and 50 chained nodes
    y = np.stack([rank, x], axis=1)
    assert shared.sums(y[shared.nodes]) == pytest.approx(w @ (y[i] - y[j]) ** 2)


def test_differential_reads_cells_twice_and_sends_no_ranks(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 5, (60, 8)).astype(float)
    x[:, 7] = 0
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = [(c, f"g{g}", float(x[c, g])) for c in range(60) for g in range(8)]
    expr = spark.createDataFrame(rows, "cell long, gene string, value double").repartition(3).mapInPandas(counted, "cell long, gene string, value double")
    groups = spark.createDataFrame([(c, "A" if c % 3 else "B") for c in range(50)], "cell long, side string")
    got = {r["gene"]: r for r in contrast.differential(expr, groups, 3).collect()}
    assert seen.value <= 2 * len(rows)
    a, b = ([c for c in range(50) if bool(c % 3) == s] for s in (True, False))
    assert set(got) == {f"g{g}" for g in range(7)}
    for g in range(7):
        u = sum((x[i, g] > x[j, g]) + (x[i, g] == x[j, g]) / 2 for i in a for j in b)
        bias = 1 / (len(a) * len(b)) ** 0.5
        assert got[f"g{g}"]["auc"] == pytest.approx(u / len(a) / len(b))
        assert got[f"g{g}"]["log_fc"] == pytest.approx(np.log2((x[a, g].mean() + bias) / (x[b, g].mean() + bias)))


@pytest.mark.parametrize("seed", [3, 4])
def test_searches_over_sizes_count_clusters_without_making_them(spark, seed, monkeypatch):
    """A tree with chains, and a second one of three tips; the cuts are those of a search that makes all clusters."""
    rows, parent = random_tree(60, seed)
    more = [("x", None), ("x1", "x"), ("x2", "x1"), ("x3", "x1"), ("x4", "x")]
    parent = parent | dict(more)
    t = graph.saved(spark.createDataFrame(rows + more, "node string, parent string"))
    up = graph.saved(trees.closure(t))
    sizes = graph.saved(trees.clade_sizes(t, up))
    tips = sorted(set(parent) - set(parent.values()))
    size = {x: sum(x in up_of(parent, y) for y in tips) for x in parent}
    lowest = lambda d: {x: next((y for y in up_of(parent, x) if size[y] >= d), up_of(parent, x)[-1]) for x in tips}
    highest = lambda s: {x: [y for y in up_of(parent, x) if size[y] <= s][-1] for x in tips}
    made = []
    for name in ("ancestor_at_size", "clusters_by_size"):
        monkeypatch.setattr(trees, name, lambda *a, own=getattr(trees, name): made.append(a) or own(*a))
    for target in (1, 3, 8, len(tips)):
        low, high, want = 0, max(size.values()), {x: x for x in tips}
        while low != high and (d := round((low + high) / 2)):
            want = lowest(d)
            enough = len(set(want.values())) >= target
            if d == (low if enough else high):
                break
            low, high = (d, high) if enough else (low, d)
        assert {r["node"]: r["cluster"] for r in trees.clusters_at_depth(t, up, sizes, target).collect()} == want
        best = max((s for s in range(1, max(size.values()) + 1) if len(set(highest(s).values())) >= target), default=1)
        assert {r["node"]: r["cluster"] for r in trees.clusters_to_target(t, up, sizes, target).collect()} == highest(best)
    assert len(made) <= 8


def _jobs(spark, work) -> int:
    """Jobs that ``work`` starts."""
    name = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def _blobs(spark, n: int, parts: int):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 4)) + 4 * rng.normal(size=(parts, 4))[np.arange(n) % parts]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def test_pools_take_few_jobs(spark):
    vec = _blobs(spark, 200, 4)
    found = []
    n = _jobs(spark, lambda: found.extend(pools.micro_clusters(vec, 10, 8).collect()))
    assert sorted(r["cell"] for r in found) == list(range(200)) and len({r["pool"] for r in found}) >= 17
    assert n < 100


def test_communities_and_pools_are_the_same_in_driver_and_tasks(spark, monkeypatch):
    vec = _blobs(spark, 200, 4)
    edges = graph.saved(graph.louvain_weights(graph.knn(vec, 8)))
    own = {r["id"]: r["cluster"] for r in graph.louvain_levels(edges).collect()}
    coarse = spark.createDataFrame(list(own.items()), "id long, cluster long")
    fine = {tuple(r) for r in pools.split_clusters(vec, coarse, 10).collect()}
    monkeypatch.setattr(graph, "MOVED_HERE", 20)
    monkeypatch.setattr(pools, "WHOLE", 25)
    assert {r["id"]: r["cluster"] for r in graph.louvain_levels(edges).collect()} == own
    assert {tuple(r) for r in pools.split_clusters(vec, coarse, 10).collect()} == fine
    # names, not numbers; an edge to itself; no edges at all
    named = spark.createDataFrame([("b", "c", 1.0), ("c", "b", 1.0), ("x", "y", 1.0), ("x", "x", 1.0)], "i string, j string, w double")
    assert {tuple(r) for r in graph.louvain_levels(named).collect()} == {("b", "b"), ("c", "b"), ("x", "x"), ("y", "x")}
    assert graph.louvain_levels(named.limit(0)).collect() == []


def test_trajectory_distances_are_dealt_to_tasks(spark, monkeypatch):
    """All cells lie in one part; their pairs are the work of several tasks, and rounding agrees with decimals."""
    monkeypatch.setattr(trajectory, "PAIRS", 2_000)
    edges = spark.createDataFrame([("a", "b", 2.0)], "a string, b string, length double")
    prog = spark.range(0, 200, 1, 1).select(F.col("id").alias("cell"), F.lit("a").alias("a"), F.lit("b").alias("b"), (F.col("id") / 200).alias("position"))
    found = trajectory.distances(edges, prog, prog.where("cell % 2 = 0")).select("i", "j", "dist", F.spark_partition_id().alias("p")).collect()
    assert {(r["i"], r["j"]): round(r["dist"], 9) for r in found} == {(i, j): round(abs(i - j) / 100, 9) for i in range(0, 200, 2) for j in range(200) if i != j}
    assert len({r["p"] for r in found}) > 4


def test_random_signatures_read_bytes(spark):
    """What passes by each block of signatures holds no lists, whose numbers would be read one by one; parts of such columns are read whole."""
    expr = spark.createDataFrame([(f"c{i:02d}", f"g{j}", float(i * j % 5)) for i in range(20) for j in range(6)], "cell string, gene string, value double")
    edges = spark.createDataFrame([(f"c{i:02d}", f"c{(i + 1) % 20:02d}", 0.5) for i in range(20)], "i string, j string, w double")
    plan = background.random_autocorrelation(*score.scaled(expr), edges, [(1, 3, 1.0)], 9)._jdf.queryExecution().executedPlan().toString()
    assert "g:binary" in plan and "array<" not in plan
    column = background._as_bytes(np.arange(9.0), np.array([0, 4, 4, 9]))
    for part, want, cuts in ((column, range(9), [0, 4, 4, 9]), (column.slice(1), range(4, 9), [0, 0, 5]), (column.slice(1, 1), [], [0, 0]), (column.slice(0, 0), [], [0])):
        x, at = background._from_bytes(part, np.float64)
        assert x.tolist() == list(want) and at.tolist() == cuts


def test_a_tip_leaves_its_list_before_rows_are_made(spark):
    t = spark.createDataFrame([("root", None), *[(f"t{k}", "root") for k in range(30)]], "node string, parent string")
    up = graph.saved(trees.closure(t))
    found = trees.clade_neighbours(up, trees.tips(t), trees.clade_sizes(t, up), 20, 8)
    assert "array_remove" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["i"], r["j"], r["w"]) for r in found.collect()) == sorted((f"t{a}", f"t{b}", 1.0) for a in range(30) for b in range(30) if a != b)
