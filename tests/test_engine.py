"""Fixtures with known values, and rules that hold for any data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signascope.functions import stats
from signascope.operators import contrast, graph, latent, matrix, score, trajectory, tree
from signascope.sources import files
from signascope.streaming import ingest


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 7.2, 38.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.normal("x").alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("df,x", [(1, 3.841458820694124), (2, 5.991464547107979), (3, 7.814727903251179), (4, 9.487729036781154), (5, 11.070497693516351)])
def test_chi_square_five_percent_points(spark, df, x):
    p = spark.range(1).select(stats.chi2_tail(F.lit(x), F.lit(df)).alias("p")).first()["p"]
    assert p == pytest.approx(0.05, abs=1e-9)


def test_hypergeometric_tail(spark):
    for o, m, k, n in [(3, 10, 5, 50), (0, 7, 7, 20), (5, 5, 5, 6), (1, 30, 2, 40), (6, 5, 5, 30)]:
        exact = sum(math.comb(m, i) * math.comb(n - m, k - i) for i in range(o, min(m, k) + 1) if n - m >= k - i) / math.comb(n, k)
        got = spark.range(1).select(stats.hypergeometric_tail(*map(F.lit, (o, m, k, n))).alias("p")).first()["p"]
        assert got == pytest.approx(exact, abs=1e-10)


def test_average_rank_and_bh(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, 2.0)], "id int, v double").withColumn("f", F.lit("x"))
    assert {r["id"]: r["rank"] for r in stats.average_rank(df, ["f"], "v").collect()} == {2: 1.0, 4: 2.0, 1: 3.5, 3: 3.5}
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.04, 0.03, 0.5])], "i int, p double")
    assert {r["i"]: round(r["fdr"], 6) for r in stats.bh(p, "p", [], ["i"]).collect()} == {0: 0.04, 1: round(0.16 / 3, 6), 2: round(0.16 / 3, 6), 3: 0.5}


def test_geary_golden(spark):
    x = {"X": [1, 1, 1, 1, 2, 2, 2, 2], "X2": [1, 2] * 4}
    values = spark.createDataFrame([(i, f, float(v)) for f, vs in x.items() for i, v in enumerate(vs)], "id long, feature string, value double")
    dense = spark.createDataFrame([(i, j, 1.0 if (i < 4) == (j < 4) else 0.1) for i in range(8) for j in range(8) if i != j], "i long, j long, w double")
    half = spark.createDataFrame([(i, j, 1.0) for i in range(8) for j in range(8) if (i < 4) == (j < 4)], "i long, j long, w double")
    got = {r["feature"]: r["c"] for r in graph.geary(values, half).collect()}
    assert got["X"] == 0 and got["X2"] == pytest.approx(0.875)
    got = {r["feature"]: r["c"] for r in graph.geary(values, dense).collect()}
    num = {f: sum((1.0 if (i < 4) == (j < 4) else 0.1) * (v[i] - v[j]) ** 2 for i in range(8) for j in range(8) if i != j) for f, v in x.items()}
    w = 2 * 4 * 3 + 2 * 16 * 0.1
    for f, v in x.items():
        assert got[f] == pytest.approx(num[f] / (2 * w * np.var(v, ddof=1)))
    moved = values.withColumn("value", 3 * F.col("value") + 7)
    assert {r["feature"]: round(r["c"], 9) for r in graph.geary(moved, dense).collect()} == {k: round(v, 9) for k, v in got.items()}


def test_unweighted_scores_golden(spark):
    expr = spark.createDataFrame([(c, g, float(v)) for g, row in zip("ABC", [[1, 2], [2, 2], [5, 4]]) for c, v in zip(("s1", "s2"), row)], "cell string, gene string, value double")
    sigs = spark.createDataFrame([("sig1", "A", 1.0), ("sig1", "B", 1.0), ("sig2", "B", 1.0), ("sig2", "C", -1.0), ("sig2", "none", 1.0)], "sig string, gene string, sign double")
    got = {(r["cell"], r["sig"]): r["score"] for r in score.scores(expr, sigs, "none").collect()}
    assert got == {("s1", "sig1"): 1.5, ("s2", "sig1"): 2.0, ("s1", "sig2"): -1.5, ("s2", "sig2"): -1.0}


def test_rank_sum_edges(spark):
    v = spark.createDataFrame([(i, "f", x) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 5.0])], "id int, feature string, value double")
    lev = spark.createDataFrame([(i, "v", "a" if i < 3 else "b") for i in range(5)], "id int, var string, level string")
    got = {r["level"]: r for r in contrast.one_vs_rest(v, lev).collect()}
    assert got["a"]["auc"] == 0 and got["a"]["p"] == pytest.approx(0.14891467, abs=1e-8) and got["a"]["auc"] + got["b"]["auc"] == 1
    full = contrast.one_vs_rest(v, lev.withColumn("level", F.lit("all"))).first()
    assert (full["auc"], full["p"]) == (0.5, 1.0)
    assert contrast.one_vs_rest(v.limit(0), lev).collect() == []
    holed = v.withColumn("value", F.when(F.col("id") != 1, F.col("value")))
    assert {r["level"]: r["auc"] for r in contrast.one_vs_rest(holed, lev).collect()} == {"a": 0.0, "b": 1.0}


TREES = [
    ("(((1,2)7,3)8,((4,5)9,6)10)11;", dict(zip("123456", "AABCAC")), 3, {"7": 0, "8": 0.25, "9": 0.5, "10": 0.25, "11": 0.3}, {"1": 0.55 / 3, "2": 0.55 / 3, "3": 0.275, "4": 0.35, "5": 0.35, "6": 0.275}),
    ("(((1,2)11,3,(4,5)13)12,(6,(7,(8,9,10)14)15)16)17;", dict(zip(map(str, range(1, 11)), "AACDDBBCCB")), 5, {"11": 0, "12": 2 / 7, "13": 0, "14": 1 / 3, "15": 0.4, "16": 2 / 7, "17": 5 / 16}, {"7": 0.3327, "3": 0.2991, "8": 0.3329, "1": 0.1994}),
]


@pytest.mark.parametrize("newick,labels,total,scores,leaves", TREES)
def test_parsimony_golden(spark, newick, labels, total, scores, leaves):
    t = files.read_newick(spark, newick)
    up = graph.saved(tree.closure(t))
    names = {r["node"]: r["label"] for r in t.collect()}
    sets = tree.fitch_sets(t, t.where(F.col("label").isin(list(labels))).select("node", F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("label")].alias("level")), up)
    assert tree.parsimony(t, tree.fitch_assignment(t, sets, up)).first()["score"] == total
    nodes = tree.node_scores(sets, up)
    got = {names[r["node"]]: r["score"] for r in nodes.collect()}
    assert got == pytest.approx(scores)
    tips = {names[r["node"]]: r["plasticity"] for r in tree.plasticity(t, nodes, up).collect()}
    assert {k: tips[k] for k in leaves} == pytest.approx(leaves, abs=5e-5)


def test_newick_round_trip():
    for text in ("((a:1,b:2)c:0.5,d)e;", "(a,(b,(c,d)));", "x;"):
        assert files.to_newick(files.parse_newick(text)) == text


def test_filters_and_ids(spark):
    expr = spark.createDataFrame([("c1", "g1", 1.0), ("c3", "g2", 1.0)], "cell string, gene string, value double")
    assert matrix.apply_filter(expr, "Threshold", 3).collect() == []
    with pytest.raises(ValueError):
        matrix.apply_filter(expr, "other")
    m = spark.createDataFrame([(f"c{c}", f"g{g}", float(c)) for c in (1, 2, 3) for g in range(3)], "cell string, gene string, value double")
    ids = spark.createDataFrame([("g0", "GeneA"), ("g1", "GeneA"), ("g2", "GeneB")], "gene string, new_id string")
    got = {(r["gene"], r["cell"]): r["value"] for r in matrix.convert_gene_ids(m, ids).collect()}
    assert got == {(n, f"c{c}"): c * k for n, k in (("GeneA", 2.0), ("GeneB", 1.0)) for c in (1, 2, 3)}


def test_gene_set_files(spark, tmp_path):
    (tmp_path / "s.gmt").write_text("set_UP\td\tA\tB\nset_DN\td\tC\tA\nvals\td\tg1,.5\tG2,1.5\nshort\tx\nplain_SET\td\tQ\n")
    got = {(r["sig"], r["gene"]): r["sign"] for r in files.read_signatures(spark, str(tmp_path / "s.gmt")).collect()}
    assert got == {("set", "A"): -1.0, ("set", "B"): 1.0, ("set", "C"): -1.0, ("vals", "g1"): 0.5, ("vals", "G2"): 1.5, ("plain_SET", "Q"): 1.0}


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n%\n3 2 3\n1 1 4\n2 1 1\n3 2 7\n")
    (tmp_path / "g.tsv").write_text("e1\tAA\ne2\tAA\ne3\tBB\n")
    (tmp_path / "b.tsv").write_text("cell1\ncell2\n")
    got = {(r["cell"], r["gene"]): r["value"] for r in files.read_10x(spark, *(str(tmp_path / x) for x in ("m.mtx", "g.tsv", "b.tsv"))).collect()}
    assert got == {("cell1", "AA"): 5.0, ("cell2", "BB"): 7.0}


def test_scores_do_not_depend_on_scale_under_znorm(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", f"g{g}", rng.random() * 9) for c in range(12) for g in range(10) if rng.random() < 0.6]
    expr = spark.createDataFrame(rows, "cell string, gene string, value double")
    sigs = spark.createDataFrame([("s", f"g{g}", 1.0 if g % 2 else -1.0) for g in range(5)], "sig string, gene string, sign double")
    one = {r["cell"]: round(r["score"], 9) for r in score.scores(expr, sigs).collect()}
    two = {r["cell"]: round(r["score"], 9) for r in score.scores(expr.withColumn("value", F.col("value") * 5), sigs).collect()}
    assert one == two and len(one) == 12


def test_knn_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(120, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for block in (1000, 25):
        got = {(r["i"], r["rank"]): r["j"] for r in graph.knn(df, 4, block).collect()}
        assert got == {(i, r + 1): int(j) for i in range(120) for r, j in enumerate(np.argsort(d[i])[:4])}


def test_louvain_finds_cliques(spark):
    edges = [(a + 5 * c, b + 5 * c, 1.0) for c in range(3) for a in range(5) for b in range(a)] + [(0, 5, 0.1), (5, 10, 0.1)]
    e = spark.createDataFrame(edges, "i long, j long, w double")
    label = graph.louvain_levels(e)
    assert sorted(len([r for r in label.collect() if r["cluster"] == c]) for c in {r["cluster"] for r in label.collect()}) == [5, 5, 5]
    assert graph.modularity(e, label).first()["q"] > 0.6


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.maximum(rng.normal(size=(40, 6)), 0)
    expr = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(40) for j in range(6)], "cell long, gene string, value double")
    scores, share = latent.pca(expr, expr.select("gene").distinct(), 2)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.zeros((40, 2))
    for r in scores.collect():
        got[r["cell"], r["comp"] - 1] = r["coord"]
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2])) and np.allclose(share, (s**2 / (s**2).sum())[:2])


def test_trajectory_distances(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "a string, b string, length double")
    prog = spark.createDataFrame([(1, "a", "b", 0.25), (2, "a", "b", 0.75), (3, "c", "b", 0.5)], "cell long, a string, b string, position double")
    p = trajectory.validated(edges, prog)
    got = {(r["i"], r["j"]): r["dist"] for r in trajectory.distances(edges, p, prog).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (1, 3): 2.0, (3, 1): 2.0, (2, 3): 1.0, (3, 2): 1.0}
    with pytest.raises(ValueError):
        trajectory.validated(edges, prog.union(spark.createDataFrame([(9, "a", "zz", 0.5)], prog.schema)))


def test_results_and_selections(spark, tmp_path):
    df = spark.createDataFrame([("one", "c1"), ("one", "c2"), ("two", "c3")], "name string, cell string")
    files.save_results({"sel": df}, str(tmp_path / "out"))
    assert files.load_results(spark, str(tmp_path / "out"))["sel"].count() == 3
    text = files.selections_json(df).first()["json"]
    (tmp_path / "s.json").write_text(text)
    assert files.read_selections(spark, str(tmp_path / "s.json")).count() == 3


def test_streaming_counts(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("value")).first()[0] == src.count()


def test_whole_analysis(spark):
    from signascope.plans import analysis, report

    rng = random.Random(5)
    rows = [(c, f"g{g}", float(rng.randrange(1, 9)) + (5 if (c < 20) == (g < 8) else 0)) for c in range(40) for g in range(16) if rng.random() < 0.8]
    data = analysis.Dataset(
        expr=spark.createDataFrame(rows, "cell long, gene string, value double"),
        sigs=spark.createDataFrame([(s, f"g{g}", 1.0 if g % 3 else -1.0) for s, gs in (("low", range(8)), ("high", range(8, 16))) for g in gs], "sig string, gene string, sign double"),
        numbers=spark.createDataFrame([(c, "depth", float(c % 7)) for c in range(40)], "id long, feature string, value double"),
        factors=spark.createDataFrame([(c, "half", "a" if c < 20 else "b") for c in range(40)], "id long, var string, level string"),
        params=analysis.Parameters(threshold=1, filter="threshold", components=3, permutations=5, null_size=4, neighbours=5),
    )
    done = analysis.analyze(data)
    assert report.signature_scores(done, "low").count() == 40
    auto = {r["feature"]: r for r in report.signature_autocorrelation(done).collect()}
    assert {"low", "high"} <= set(auto) and auto["low"]["c"] > 0.2
    assert set(report.differential(done, "half").columns) == {"feature", "a", "b"}
    assert report.differential_expression(done, report.cell_levels(done, "half").where("level = 'a'")).count() == 16
    assert report.search(report.gene_list(done), "G1,!g15", "gene").count() == 6
    assert report.selection_factors(done, report.cell_levels(done, "half")).first()["entropy"] == pytest.approx(1.0)
    assert report.histogram(data.numbers).agg(F.sum("n")).first()[0] == 40
    with pytest.raises(KeyError):
        report.signature_scores(data, "low")


def test_analysis_over_tree_modules_proteins_and_trajectory(spark):
    """Every stage over 24 cells, each result against the operator that makes it."""
    from signascope.operators import contrast, graph, score, trajectory
    from signascope.operators import tree as trees
    from signascope.plans import analysis

    rng, n = random.Random(6), 24
    cells = [f"c{k:02d}" for k in range(n)]
    rows = [(c, f"g{g}", float(rng.randrange(1, 9)) + (6 if (k < n / 2) == (g < 6) else 0)) for k, c in enumerate(cells) for g in range(12) if rng.random() < 0.9]
    tree = [(c, f"p{k // 3}") for k, c in enumerate(cells)] + [(f"p{k}", f"q{k // 4}") for k in range(n // 3)] + [("q0", "root"), ("q1", "root"), ("root", None)]
    milestones = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "a string, b string, length double")
    data = analysis.Dataset(
        expr=graph.saved(spark.createDataFrame(rows, "cell string, gene string, value double")),
        sigs=spark.createDataFrame([(s, f"g{g}", 1.0) for s, gs in (("low", range(6)), ("high", range(6, 12))) for g in gs], "sig string, gene string, sign double"),
        numbers=spark.createDataFrame([(c, "depth", float(k % 7)) for k, c in enumerate(cells)], "id string, feature string, value double"),
        factors=spark.createDataFrame([(c, "half", "a" if k < n / 2 else "b") for k, c in enumerate(cells)], "id string, var string, level string"),
        proteins=spark.createDataFrame([(c, "cd", float(k // 6)) for k, c in enumerate(cells)], "id string, feature string, value double"),
        modules=spark.createDataFrame([("m1", f"g{g}") for g in range(5)] + [("m2", f"g{g}") for g in range(6, 11)], "mod string, gene string"),
        tree=spark.createDataFrame(tree, "node string, parent string"),
        latent=spark.createDataFrame([(c, [float(k < n / 2) * 9 + rng.random(), rng.random()]) for k, c in enumerate(cells)], "id string, vec array<double>"),
        milestones=milestones, progressions=spark.createDataFrame([(c, *(("a", "b") if k < n / 2 else ("b", "c")), (k % 12) / 12) for k, c in enumerate(cells)], "cell string, a string, b string, position double"),
        params=analysis.Parameters(permutations=20, null_size=20, neighbours=4, cluster_neighbours=4, min_signature_genes=3),
    )
    done = analysis.analyze(data)
    got = {k: v for k, v in done.results.items()}
    rounded = lambda df, *cols: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())
    logs = matrix.log2p1(data.expr)
    assert rounded(got["scores"], "cell", "sig", "score") == rounded(score.scores(logs, data.sigs), "cell", "sig", "score")
    up = trees.closure(data.tree)
    edges = got["knn"]
    assert rounded(edges, "i", "j", "w") == rounded(graph.weights(trees.tree_knn(up, trees.tips(data.tree), 4)), "i", "j", "w")
    for name, near in (("", edges), ("trajectory_", got["trajectory_knn"])):
        auto = {r["feature"]: r["c"] for r in graph.autocorrelation(analysis.as_values(got["scores"]).unionByName(data.numbers), near).collect()}
        sigs, meta = ({r["feature"]: r for r in got[f"{name}{kind}_autocorrelation"].collect()} for kind in ("signature", "meta"))
        assert {f: r["c"] for f, r in sigs.items()} == {f: pytest.approx(auto[f]) for f in ("low", "high")}
        assert meta["depth"]["c"] == pytest.approx(auto["depth"]) and set(meta) == {"depth", "half", "half_plasticity"}
        assert all(0 < r["p"] <= r["fdr"] <= 1 for r in [*sigs.values(), *meta.values()])
        assert rounded(got[f"{name}protein_autocorrelation"], "feature", "c", "p") == rounded(analysis.protein_autocorrelation(data.proteins, near), "feature", "c", "p")
        assert {r["feature"] for r in got[f"{name}signature_clusters"].collect()} == {"low", "high", "depth", "half_plasticity"}
    assert rounded(got["trajectory_knn"], "i", "j", "dist") == rounded(trajectory.knn(milestones, data.progressions, 4), "i", "j", "dist")
    assert sigs["low"]["c"] > 0.3
    own = {r["feature"]: r["c"] for r in got["module_autocorrelation"].collect()}
    assert own == {r["feature"]: pytest.approx(r["c"]) for r in graph.autocorrelation(analysis.as_values(got["module_scores"]), edges).collect()}
    assert rounded(got["module_enrichment"], "sig", "mod", "p") == rounded(contrast.enrichment(contrast.directional_sets(data.sigs), data.modules, 12), "sig", "mod", "p")
    assert rounded(got["proteins_one_vs_rest"], "level", "auc") == rounded(contrast.one_vs_rest(data.proteins, data.factors, ties=True), "level", "auc")
    assert {r["cluster"] for r in got["clusters"].collect()} <= set(cells)


def test_pools_are_made_beyond_a_number_of_cells(spark):
    from signascope.plans import analysis

    expr = spark.createDataFrame([(f"c{k:02d}", f"g{g}", 1.0 + (k + g) % 3) for k in range(40) for g in range(3)], "cell string, gene string, value double")
    latent = spark.createDataFrame([(f"c{k:02d}", [float(k // 20) * 50, float(k % 20)]) for k in range(40)], "id string, vec array<double>")
    few = analysis.Dataset(expr, latent=latent, params=analysis.Parameters(pool_above=40))
    assert analysis.automatic_pools(few) is few
    own = analysis.automatic_pools(analysis.replace(few, params=analysis.Parameters(pool_above=39, cells_per_pool=5)))
    assert own.pools.count() == 40 and 4 <= own.pools.select("pool").distinct().count() <= 16
    with pytest.raises(ValueError, match="latent lack"):
        analysis.validated(analysis.replace(few, latent=latent.where("id <> 'c03'")))


def test_pca_in_several_passes(spark):
    """More genes than a block is wide, values that fall slowly: equal to numpy, and no pass holds all genes."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(150, 60)) * np.linspace(3, 0.5, 60) + rng.normal(size=(150, 1)) * 2, 3) * (rng.random((150, 60)) < 0.7)
    expr = spark.createDataFrame([(i, f"g{j:02d}", float(v)) for i in range(150) for j, v in enumerate(x[i]) if v], "cell long, gene string, value double")
    scores, share = latent.pca(expr, expr.select("gene").distinct(), 4, extra=4)
    y = x - x.mean(0)
    val, vec = np.linalg.eigh(y.T @ y)
    val, vec = val[::-1][:4], vec[:, ::-1][:, :4]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(4)])
    assert share == pytest.approx(val / (y**2).sum())
    got = np.zeros((150, 4))
    for r in scores.collect():
        got[r["cell"], r["comp"] - 1] = r["coord"]
    assert np.abs(got - y @ vec).max() < 1e-6
    with pytest.raises(ValueError):
        latent.pca(expr, expr.select("gene").distinct(), 4, extra=4, rounds=1)


def test_neighbours_among_many_copies(spark):
    """Of sixty copies the nearest have the smallest ids, and no vector is shuffled."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile(rng.normal(size=(1, 3)), (60, 1)), rng.normal(size=(40, 3))])[rng.permutation(100)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    for block in (1000, 30):
        near = graph.knn(df, 4, block)
        assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
        got = {(r["i"], r["rank"]): r["j"] for r in near.collect()}
        for i in range(100):
            d = ((x - x[i]) ** 2).sum(1)
            assert [got[i, r] for r in range(1, 5)] == sorted((j for j in range(100) if j != i), key=lambda j: (d[j], j))[:4]


def test_edges_meet_all_features_at_once(spark, monkeypatch):
    """Geary sums with null and absent values; no row is shuffled for an edge and a feature."""
    import re

    monkeypatch.setattr(graph, "TOGETHER", 2)
    rng = np.random.default_rng(9)
    rows = [(i, f, None if (i, f) == (3, "b") else float(rng.integers(0, 9))) for i in range(12) for f in "abc" if (i, f) != (5, "c")] + [(i, "flat", 1.0) for i in range(12)]
    at = {(i, f): v for i, f, v in rows}
    edges = [(i, (i + k) % 12, 0.5 / k) for i in range(12) for k in (1, 2, 5)]
    values, e = spark.createDataFrame(rows, "id long, feature string, value double"), spark.createDataFrame(edges, "i long, j long, w double")
    local = graph.geary_local(values, e)
    assert re.search(r"hashpartitioning\([^)]*feature", local._jdf.queryExecution().executedPlan().toString()) is None
    got, whole = {(r["feature"], r["i"]): r["c"] for r in local.collect()}, {r["feature"]: r["c"] for r in graph.geary(values, e).collect()}
    assert whole["flat"] is None and ("flat", 0) in got
    for f in "abc":
        v = [x for (_, g), x in at.items() if g == f and x is not None]
        n = sum(g == f for _, g in at)
        pairs = [(i, j, w) for i, j, w in edges if (i, f) in at and (j, f) in at]
        gap = lambda i, j: 0 if None in (at[i, f], at[j, f]) else (at[i, f] - at[j, f]) ** 2
        assert whole[f] == pytest.approx(sum(w * gap(i, j) for i, j, w in pairs) / (2 * sum(w for *_, w in pairs) * np.var(v, ddof=1)))
        for i in range(12):
            own = [(j, w) for a, j, w in pairs if a == i]
            assert (f, i) in got if own else (f, i) not in got
            if own:
                assert got[f, i] == pytest.approx(sum(w * gap(i, j) for j, w in own) / (np.var(v, ddof=1) * (n - 1)))


def test_scores_make_the_matrix_once(spark):
    """Scores of a dataset read the written matrix and not the order lines, which they would for each use."""
    from signascope.plans import more_queries

    for name in ("scores", "module_scores"):
        found = more_queries.data(spark, "/root/testdata/sf0.001", name).results[name]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "gene" in plan
