"""Queries over analysis stages, report questions, tree graphs and trajectories, each with the SQL that computes the same rows.

Registered with those of ``queries``; each calls the function that the analysis or the report calls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from signascope.operators import background, contrast, graph, latent, matrix, pools, principal, score, trajectory
from signascope.operators import tree as trees
from signascope.plans import analysis, report
from signascope.plans import bindings as b
from signascope.plans import queries as q
from signascope.plans.queries import BH, ENR, EXPR, FITCH, GENES, KNN, LOG, N, NUMBERS, PROG, TREE, TSIG, UPDOWN, ZC, query, r6, scored
from signascope.functions import stats

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SIG, GENE = "S_ECONOMY", "Brand#12|LARGE"


def data(spark, d, *names: str) -> analysis.Dataset:
    """The sample tables as a dataset, with the named results."""
    e = b.expr(spark, d)
    if {"scores", "gene_importance", "module_scores"} & set(names):
        e = graph.saved(e)  # scores read the matrix several times
    logs = matrix.log2p1(e)
    sigs = score.split_directions(b.signed_signatures(spark, d).join(e.select("gene").distinct(), "gene", "left_semi"))
    own = analysis.Dataset(e, sigs, b.numbers(spark, d), b.factor(spark, d), proteins=b.proteins(spark, d), modules=b.brand_modules(spark, d), tree=b.tree(spark, d))
    found = {}
    if {"scores", "gene_importance"} & set(names):
        found["scores"] = score.scores(logs, sigs)
        found["gene_importance"] = score.gene_importance(logs, sigs, found["scores"])
    if "module_scores" in names:
        found["module_scores"] = score.scores(logs, own.modules.select(F.col("mod").alias("sig"), "gene", F.lit(1.0).alias("sign")))
    if {"meta_one_vs_rest", "proteins_one_vs_rest"} & set(names):
        found |= analysis.comparisons(own, None, None, own.numbers, own.factors)
    if "module_enrichment" in names:
        found["module_enrichment"] = contrast.enrichment(contrast.directional_sets(b.signed_signatures(spark, d)), own.modules, b.genes(spark, d).count())
        found["module_assignment"] = contrast.best_module(found["module_enrichment"].withColumn("stat", F.round("stat", 9)))
    return analysis.replace(own, results=found)


# --- comparisons

LEVELS = q.LEV
_P = f"coalesce(least(1.0::DOUBLE, 2 * {stats.normal_sql('z')}), 1.0::DOUBLE)"


def ranked_against(values: str, ties: str) -> str:
    """Rank-sum of each level against the rest, from ``values`` (id, feature, value): pp (feature, var, level, auc, p)."""
    return f"""{LEVELS}, kv AS (SELECT id, feature, value FROM {values} WHERE value IS NOT NULL), rk AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rank FROM kv),
    tie AS (SELECT feature, sum(t * t * t - t)::DOUBLE AS ties, sum(t)::DOUBLE AS n FROM (SELECT feature, value, count(*)::DOUBLE AS t FROM kv GROUP BY 1, 2) GROUP BY 1), pa AS (SELECT feature, var, level, sum(rank) AS r1, count(*)::DOUBLE AS n1 FROM rk JOIN lev USING (id) GROUP BY ALL),
    st AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n - n1 AS n2, sqrt(n1 * (n - n1) / 12 * (n + 1 - {ties} / (n * (n - 1)))) AS sd FROM pa JOIN tie USING (feature)),
    zz AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN u / (n1 * n2) ELSE 0.5 END AS auc, CASE WHEN n1 > 0 AND n2 > 0 THEN CASE WHEN sd > 0 THEN (-abs(u - n1 * n2 / 2) + 0.5) / sd ELSE 0 END END AS z FROM st), pp AS (SELECT feature, var, level, auc, {_P} AS p FROM zz)"""


def adjusted(source: str, stat: str) -> str:
    return f"SELECT feature, var, level, round({stat}, 5) + 0.0 AS {stat}, round(p, 5) + 0.0 AS p, round({BH.format(by='PARTITION BY var, level')}, 5) + 0.0 AS fdr FROM (SELECT *, row_number() OVER (PARTITION BY var, level ORDER BY p, feature) AS rn, count(*) OVER (PARTITION BY var, level) AS cnt FROM {source})"


def r5(df):
    return df.select(*[(F.round(F.col(c), 5) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# scores are rounded before they are ranked: equal ones must tie alike in every engine
MODSIG = f"{GENES}, sigs AS (SELECT p_brand AS sig, gene, 1.0::DOUBLE AS sign FROM genes WHERE gene IN (SELECT gene FROM expr))"
MODVALS = f"{scored(ZC, MODSIG)}, mv AS (SELECT cell AS id, sig AS feature, round(score, 9) AS value FROM sc)"
SIGVALS = f"{scored(ZC, UPDOWN)}, mv AS (SELECT cell AS id, sig AS feature, round(score, 9) AS value FROM sc)"


def _rounded(scores):
    return scores.withColumn("score", F.round("score", 9))


@query(f"WITH {SIGVALS}, {ranked_against('mv', '0')} {adjusted('pp', 'auc')}")
def compare_signatures(spark, d):
    own = data(spark, d, "scores")
    return r5(analysis.comparisons(own, _rounded(own.results["scores"]), None, None, own.factors)["one_vs_rest"]).select("feature", "var", "level", "auc", "p", "fdr")


@query(f"WITH {MODVALS}, {ranked_against('mv', '0')} {adjusted('pp', 'auc')}")
def compare_modules(spark, d):
    own = data(spark, d, "module_scores")
    return r5(analysis.comparisons(own, None, _rounded(own.results["module_scores"]), None, own.factors)["modules_one_vs_rest"]).select("feature", "var", "level", "auc", "p", "fdr")


def _tail(x: str, df: str) -> str:
    """Chi-square tail for the even or odd ``df`` of the tables here."""
    even = f"list_sum(list_transform(range(0, ({df} // 2)::BIGINT), lambda i: exp(-{x} / 2 + i * ln(greatest({x}, 1e-300) / 2) - lgamma(i + 1))))"
    odd = f"2 * {stats.normal_sql(f'(-sqrt({x}))')} + coalesce(list_sum(list_transform(range(1, (({df} - 1) // 2 + 1)::BIGINT), lambda i: exp(-{x} / 2 + (i - 0.5) * ln(greatest({x}, 1e-300) / 2) - lgamma(i + 0.5)))), 0)"
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


FACTORS = f"""tb AS (SELECT f.var AS factor, f.level AS b, l.var, l.level, count(*)::DOUBLE AS o1 FROM lev f JOIN lev l USING (id) GROUP BY ALL), bt AS (SELECT f.var AS factor, f.level AS b, count(*)::DOUBLE AS tot FROM lev f GROUP BY ALL),
    lv AS (SELECT DISTINCT var, level FROM lev), fu AS (SELECT bt.factor, bt.b, lv.var, lv.level, tot, coalesce(o1, 0) AS o1 FROM bt CROSS JOIN lv LEFT JOIN tb ON tb.factor = bt.factor AND tb.b = bt.b AND tb.var = lv.var AND tb.level = lv.level),
    mg AS (SELECT factor, var, level, sum(o1) AS r1, sum(tot) AS n, count(*) AS k FROM fu GROUP BY ALL), ch AS (SELECT factor, var, level, any_value(k) AS k, any_value(n) AS n, sum(pow(o1 - tot * r1 / n, 2) / (tot * r1 / n) + pow(tot - o1 - tot * (n - r1) / n, 2) / (tot * (n - r1) / n)) AS chi2 FROM fu JOIN mg USING (factor, var, level) GROUP BY ALL),
    fp AS (SELECT factor AS feature, var, level, sqrt(chi2 / n) AS stat, least(1.0, greatest(0.0, {_tail('chi2', '(k - 1)')})) AS p FROM ch)"""


@query(f"WITH {NUMBERS}, {ranked_against('num', 'ties')}, {FACTORS}, al AS (SELECT feature, var, level, auc AS stat, p FROM pp UNION ALL SELECT * FROM fp) {adjusted('al', 'stat')}")
def compare_metadata(spark, d):
    own = data(spark, d, "meta_one_vs_rest")
    return r5(own.results["meta_one_vs_rest"]).select("feature", "var", "level", "stat", "p", "fdr")


PROTEINS = "pro AS (SELECT c.c_custkey AS id, p.p AS feature, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = p.p)::DOUBLE AS value FROM customer c, (SELECT DISTINCT o_orderpriority AS p FROM orders) p)"


@query(f"WITH {PROTEINS}, {ranked_against('pro', 'ties')} {adjusted('pp', 'auc')}")
def compare_proteins(spark, d):
    return r5(data(spark, d, "proteins_one_vs_rest").results["proteins_one_vs_rest"]).select("feature", "var", "level", "auc", "p", "fdr")


# --- the tree as the cells' graph

KT = 5
TREEKNN = f"""{TREE}, ds AS (SELECT x.node AS i, y.node AS j, min(x.hops + y.hops)::DOUBLE AS dist FROM up x JOIN up y ON x.anc = y.anc AND x.node <> y.node WHERE x.node IN (SELECT node FROM tip) AND y.node IN (SELECT node FROM tip) GROUP BY 1, 2), kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM ds) WHERE rank <= {KT}),
    raw AS (SELECT *, exp(-dist * dist / pow(CASE WHEN max(dist) OVER (PARTITION BY i) = 0 THEN 1 ELSE max(dist) OVER (PARTITION BY i) END, 2)) AS q FROM kn), wk AS (SELECT i, j, rank, dist, q / sum(q) OVER (PARTITION BY i) AS w FROM raw)"""


def _tree_edges(spark, d):
    t = b.tree(spark, d)
    own = analysis.Dataset(b.expr(spark, d), tree=t, params=analysis.Parameters(neighbours=KT))
    return analysis.neighbour_graph(own)


def _tips(values):
    return values.withColumn("id", F.concat(F.lit("c"), F.col("id")))


@query(f"WITH RECURSIVE {TREEKNN} SELECT i, j, rank, round(w, 6) AS w FROM wk")
def tree_knn_weights(spark, d):
    return r6(_tree_edges(spark, d).select("i", "j", F.col("rank").cast("long").alias("rank"), "w"))


def ranked_geary(values: str, edges: str = "wk") -> str:
    """1 - Geary's C of average ranks over ``edges``, from ``values`` (id, feature, value) of tips: g (feature, c)."""
    return f"""ok AS (SELECT feature FROM {values} GROUP BY 1 HAVING count(value) = count(*) AND min(value) < max(value)), rv AS (SELECT 'c' || id AS id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS value FROM {values} WHERE feature IN (SELECT feature FROM ok)),
    va AS (SELECT feature, var_samp(value) AS v FROM rv GROUP BY 1), gg AS (SELECT a.feature, sum(w * (a.value - c.value) * (a.value - c.value)) / (2 * sum(w)) AS num FROM {edges} JOIN rv a ON a.id = i JOIN rv c ON c.id = j AND c.feature = a.feature GROUP BY 1),
    g AS (SELECT feature, coalesce(1 - num / v, 0) AS c FROM (SELECT DISTINCT feature FROM {values}) LEFT JOIN gg USING (feature) LEFT JOIN va USING (feature))"""


@query(f"WITH RECURSIVE {TREEKNN}, {NUMBERS}, {ranked_geary('num')} SELECT feature, round(c, 6) + 0.0 AS c FROM g")
def tree_autocorrelation(spark, d):
    return r6(graph.autocorrelation(_tips(b.numbers(spark, d)), _tree_edges(spark, d)))


@query(f"WITH RECURSIVE {TREEKNN}, {PROTEINS}, {ranked_geary('pro')} SELECT feature, round(c, 6) + 0.0 AS c, 1.0::DOUBLE AS p, 1.0::DOUBLE AS fdr FROM g")
def protein_autocorrelation(spark, d):
    return r6(analysis.protein_autocorrelation(_tips(b.proteins(spark, d)), _tree_edges(spark, d)))


@query(f"WITH RECURSIVE {TREEKNN}, {MODVALS}, {ranked_geary('mv')} SELECT feature, round(c, 5) + 0.0 AS c FROM g")
def module_autocorrelation(spark, d):
    values = graph.saved(analysis.as_values(_rounded(data(spark, d, "module_scores").results["module_scores"])))
    return r5(graph.autocorrelation(_tips(values), _tree_edges(spark, d)))


@query(f"WITH RECURSIVE {TREE}, {{own}} SELECT o.node AS i, up.node AS j, 1.0::DOUBLE AS w FROM own o JOIN up ON up.anc = o.anc JOIN tip ON tip.node = up.node WHERE o.node <> up.node".replace("{own}", "own AS (SELECT node, anc FROM (SELECT up.node, anc, row_number() OVER (PARTITION BY up.node ORDER BY hops) AS rn FROM up JOIN tip USING (node) JOIN sz ON sz.node = anc WHERE size > 20) WHERE rn = 1)"))
def tree_lca_neighbours(spark, d):
    t, up = q._tree(spark, d)
    return trees.clade_neighbours(up, trees.tips(t), trees.clade_sizes(t, up), 20)


@query(f"WITH RECURSIVE {TREE} SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS cluster FROM customer")
def tree_clusters_cladewise(spark, d):
    """Root and regions are opened for ten clusters or more: all nations."""
    t, up = q._tree(spark, d)
    return trees.clusters_cladewise(t, up, trees.clade_sizes(t, up), 22)


@query(f"WITH RECURSIVE {TREE}, nk AS (SELECT node, size, rank() OVER (ORDER BY size DESC) AS rn FROM sz WHERE node LIKE 'r%' AND node <> 'root') SELECT up.node, any_value(up.anc) AS cluster FROM up JOIN tip USING (node) WHERE (up.anc LIKE 'n%' AND (SELECT t.parent FROM tree t WHERE t.node = up.anc) IN (SELECT node FROM nk WHERE rn = 1)) OR (up.anc LIKE 'r%' AND up.anc <> 'root' AND up.anc NOT IN (SELECT node FROM nk WHERE rn = 1)) GROUP BY 1")
def tree_clusters_cladewise_few(spark, d):
    """Six clusters or more: the root and its largest region are opened."""
    t, up = q._tree(spark, d)
    return trees.clusters_cladewise(t, up, trees.clade_sizes(t, up), 6)


_OPENED = """cc AS (SELECT t.parent AS node, count(*) AS n, max(size) AS most FROM tree t JOIN sz USING (node) WHERE t.parent IS NOT NULL GROUP BY 1), dp AS (SELECT node, max(hops) AS depth FROM up GROUP BY 1),
    od AS (SELECT node, 1 + coalesce(sum(n - 1) OVER (ORDER BY most DESC, depth, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cc JOIN dp USING (node)), op AS (SELECT node FROM od WHERE before < (SELECT round(sqrt(count(*))) FROM tip))"""


@query(f"WITH RECURSIVE {TREE}, {_OPENED} SELECT up.node, arg_max(up.anc, hops) AS cluster FROM up JOIN tip USING (node) WHERE up.anc NOT IN (SELECT node FROM op) GROUP BY 1")
def tree_clusters_most(spark, d):
    """Clades are opened by their largest child clade until there are as many as the root of the number of tips."""
    t, up = q._tree(spark, d)
    return trees.clusters_cladewise(t, up, trees.clade_sizes(t, up), round(trees.tips(t).count() ** 0.5), "most")


SEARCH = f"""{TREE}, sk AS (SELECT d, count(DISTINCT anc) AS k FROM (SELECT d, up.node, arg_min(up.anc, hops) AS anc FROM up JOIN tip USING (node) JOIN sz ON sz.node = up.anc, (SELECT DISTINCT size AS d FROM sz) WHERE size >= d GROUP BY 1, 2) GROUP BY 1), kl AS (SELECT list({{'d': d, 'k': k}} ORDER BY d) AS l FROM sk),
    se AS (SELECT 0 AS n, 0::BIGINT AS low, (SELECT max(size) FROM sz)::BIGINT AS high, 0::BIGINT AS d, false AS stop UNION ALL SELECT n + 1, CASE WHEN e THEN m ELSE low END, CASE WHEN e THEN high ELSE m END, m, m = CASE WHEN e THEN low ELSE high END
      FROM (SELECT n, low, high, m, list_filter(l, lambda x: x.d >= m)[1].k >= 10 AS e FROM (SELECT n, low, high, round_even((low + high) / 2.0, 0)::BIGINT AS m FROM se WHERE NOT stop AND low <> high), kl WHERE m > 0)), cut AS (SELECT arg_max(d, n) AS d FROM se)"""


@query(f"WITH RECURSIVE {SEARCH} SELECT up.node, arg_min(up.anc, hops) AS cluster FROM up JOIN tip USING (node) JOIN sz ON sz.node = up.anc, cut WHERE size >= cut.d GROUP BY 1")
def tree_clusters_depth(spark, d):
    t, up = q._tree(spark, d)
    return trees.clusters_at_depth(t, graph.saved(up), trees.clade_sizes(t, up), 10)


@query(f"WITH RECURSIVE {FITCH} SELECT round(sum(cost) / ((SELECT count(*) FROM tree) - 1), 9) AS rate FROM sets")
def fitch_rate(spark, d):
    t, up, sets = q._sets(spark, d)
    return trees.parsimony_rate(t, trees.fitch_assignment(t, sets, up)).select(F.round("rate", 9).alias("rate"))


def _perm_sql(reps: int) -> str:
    """p-values over the same bijections of the tips' places: each round swaps halves, values outside walk on."""
    walk = "SELECT k, pos, v // m AS l0, v % m AS r0, m, n FROM ({src})"
    for r in range(background.ROUNDS):
        once = f"SELECT *, (r{r} * {background.MULTIPLIERS[0]} + k * 64 + {r}) & 4294967295 AS t FROM ({walk})"
        twice = f"SELECT *, (xor(t, t >> 15) * {background.MULTIPLIERS[1]}) & 4294967295 AS u FROM ({once})"
        walk = f"SELECT k, pos, r{r} AS l{r + 1}, xor(l{r}, xor(u, u >> 16) % m) AS r{r + 1}, m, n FROM ({twice})"
    step = f"SELECT k, pos, l{background.ROUNDS} * m + r{background.ROUNDS} AS v, m, n FROM ({walk})"
    first = f"SELECT range AS k, pos, pos AS v, m, n FROM range({reps}), nd, dm"
    return f"""nd AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT 'c' || id AS id FROM num)), ct AS (SELECT count(*) AS n FROM nd),
    dm AS (SELECT n, CAST(pow(2, greatest(1, ceil(ceil(log2(n)) / 2))) AS BIGINT) AS m FROM ct), wa AS ({step.format(src=first)} UNION ALL {step.format(src='SELECT k, pos, v, m, n FROM wa WHERE v >= n')}),
    ne AS MATERIALIZED (SELECT x.pos AS pi, y.pos AS pj, w FROM wk JOIN nd x ON x.id = i JOIN nd y ON y.id = j), rp AS MATERIALIZED (SELECT feature, pos, value FROM rv JOIN nd USING (id)),
    vl AS MATERIALIZED (SELECT k, wa.pos, feature, value FROM wa JOIN rp ON rp.pos = v WHERE v < n),
    sm AS (SELECT x.k, x.feature, sum(w * (x.value - y.value) * (x.value - y.value)) AS num FROM ne JOIN vl x ON x.pos = pi JOIN vl y ON y.pos = pj AND y.k = x.k AND y.feature = x.feature GROUP BY ALL),
    hi AS (SELECT feature, count(*) FILTER (round(1 - num / (2 * (SELECT sum(w) FROM ne) * v) - c, 12) >= 0) AS hits FROM sm JOIN va USING (feature) JOIN g USING (feature) GROUP BY feature)
    SELECT feature, round(c, 6) + 0.0 AS c, round((coalesce(hits, {reps}) + 1) / {reps + 1}, 6) AS p FROM g LEFT JOIN hi USING (feature)"""


@query()
def meta_perm_pvalue(spark, d):
    """All 3000 permutations; the SQL side needs too much disk for them, so it follows the first 100 below."""
    return r6(graph.permutation_p(_tips(b.numbers(spark, d)), graph.saved(_tree_edges(spark, d))))


@query(f"WITH RECURSIVE {TREEKNN}, {NUMBERS}, {ranked_geary('num')}, {_perm_sql(100)}")
def meta_perm_hundred(spark, d):
    """The first 100 permutations of the same sequence."""
    return r6(graph.permutation_p(_tips(b.numbers(spark, d)), graph.saved(_tree_edges(spark, d)), 100))


def _local(values: str) -> str:
    return f"""ee AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w / 2 AS w FROM wk UNION ALL SELECT j, i, w / 2 FROM wk) GROUP BY 1, 2), ix AS (SELECT DISTINCT i AS id FROM ee), fx AS (SELECT DISTINCT feature FROM {values}),
    dv AS (SELECT ix.id, fx.feature, coalesce(value, 0)::DOUBLE AS value FROM ix CROSS JOIN fx LEFT JOIN {values} v ON 'c' || v.id = ix.id AND v.feature = fx.feature),
    sv AS (SELECT id, feature, (value - avg(value) OVER f) / nullif(stddev_pop(value) OVER f, 0) AS y FROM dv WINDOW f AS (PARTITION BY feature)),
    lc AS (SELECT x.feature AS a, z.feature AS b, sum(w * x.y * z.y) AS h FROM ee JOIN sv x ON x.id = i JOIN sv z ON z.id = j AND x.feature < z.feature GROUP BY ALL)
    SELECT a, b, round(coalesce(h, 0) / (SELECT sum(w) FROM ee), 6) + 0.0 AS lc, round(coalesce(h, 0) / sqrt((SELECT sum(w * w) FROM ee)), 5) + 0.0 AS z FROM lc"""


def _shown(df):
    return df.select("a", "b", (F.round("lc", 6) + 0.0).alias("lc"), (F.round("z", 5) + 0.0).alias("z"))


@query(f"WITH RECURSIVE {TREEKNN}, {NUMBERS}, {PROTEINS}, mx AS (SELECT id, feature, value FROM num UNION ALL SELECT id, feature, value FROM pro), {_local('mx')}")
def local_correlation(spark, d):
    """Numbers and proteins against each other's neighbours in the tree."""
    values = b.numbers(spark, d).select("id", "feature", "value").unionByName(b.proteins(spark, d).select("id", "feature", "value"))
    return _shown(graph.local_correlation(_tips(values), graph.saved(_tree_edges(spark, d))))


@query(f"WITH RECURSIVE {TREEKNN}, {EXPR}, mg AS (SELECT DISTINCT p_brand || '|' || p_type AS gene FROM part WHERE p_brand = 'Brand#12'), mx AS (SELECT cell AS id, gene AS feature, log2(value + 1) AS value FROM expr WHERE gene IN (SELECT gene FROM mg)), {_local('mx')}")
def report_module_local_correlation(spark, d):
    """The genes of a module against each other's neighbours, over all cells."""
    own = data(spark, d)
    return _shown(report.module_local_correlation(analysis.replace(own, expr=own.expr.withColumn("cell", F.concat(F.lit("c"), F.col("cell"))), results={"knn": graph.saved(_tree_edges(spark, d))}), "Brand#12"))


# --- trajectories

KR = 5
TRAJALL = f"""{PROG}, {q.PATHS}, en AS (SELECT cell, a, b, position, length, a AS m, position * length AS off FROM pg JOIN ed USING (a, b) UNION ALL SELECT cell, a, b, position, length, b, (1 - position) * length FROM pg JOIN ed USING (a, b)),
    ds AS (SELECT x.cell AS i, y.cell AS j, round(min(CASE WHEN x.a = y.a AND x.b = y.b THEN abs(x.position - y.position) * y.length ELSE x.off + path + y.off END), 9) AS dist FROM en x JOIN pt ON pt.im = x.m JOIN en y ON y.m = pt.m AND y.cell <> x.cell GROUP BY 1, 2),
    kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM ds) WHERE rank <= {KR}),
    rw AS (SELECT *, exp(-dist * dist / pow(CASE WHEN max(dist) OVER (PARTITION BY i) = 0 THEN 1 ELSE max(dist) OVER (PARTITION BY i) END, 2)) AS q FROM kn), wg AS (SELECT i, j, rank, dist, q / sum(q) OVER (PARTITION BY i) AS w FROM rw)"""


def _trajectory_edges(spark, d):
    return analysis.trajectory_graph(b.milestones(spark), q._progress(spark, d), KR)


@query(f"WITH RECURSIVE {TRAJALL} SELECT i, j, rank, round(dist, 6) + 0.0 AS dist, round(w, 6) AS w FROM wg")
def traj_knn_weights(spark, d):
    return r6(_trajectory_edges(spark, d).select("i", "j", F.col("rank").cast("long").alias("rank"), "dist", "w"))


@query(f"WITH RECURSIVE {TRAJALL}, {NUMBERS}, {ranked_geary('num', 'wg')} SELECT feature, round(c, 6) + 0.0 AS c FROM g".replace("'c' || id AS id", "id"))
def traj_autocorrelation(spark, d):
    return r6(graph.autocorrelation(b.numbers(spark, d), _trajectory_edges(spark, d)))


SPOTS = [("m0", 0.0, 0.0), ("m1", 2.0, 0.0), ("m2", 2.0, 1.0), ("m3", 5.0, 0.0), ("m4", 5.0, 1.5)]
_SPOTS = "sp AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {x}::DOUBLE, {y}::DOUBLE)" for m, x, y in SPOTS) + ") t(m, x, y))"


@query(f"WITH {PROG}, {_SPOTS} SELECT cell, round(p.x + position * (s.x - p.x), 6) + 0.0 AS x, round(p.y + position * (s.y - p.y), 6) + 0.0 AS y FROM pg JOIN sp p ON p.m = a JOIN sp s ON s.m = b")
def traj_places(spark, d):
    return r6(trajectory.place_cells(q._progress(spark, d), spark.createDataFrame(SPOTS, "milestone string, x double, y double")))


_LINES = "ln AS (SELECT a || '-' || b AS edge, p.x AS xa, p.y AS ya, s.x AS xb, s.y AS yb FROM ed JOIN sp p ON p.m = a JOIN sp s ON s.m = b)"


@query(f"""WITH {q.EDGES}, {_SPOTS}, {_LINES}, pt AS (SELECT c_custkey AS id, (c_custkey * 37 % 601) / 100.0::DOUBLE AS x, (c_custkey * 53 % 199) / 100.0::DOUBLE AS y FROM customer),
    t AS (SELECT id, edge, x, y, xa, ya, xb, yb, least(1.0, greatest(0.0, ((x - xa) * (xb - xa) + (y - ya) * (yb - ya)) / ((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)))) AS position FROM pt, ln),
    e AS (SELECT id, edge, position, sqrt(pow(x - xa - position * (xb - xa), 2) + pow(y - ya - position * (yb - ya), 2)) AS dist FROM t)
    SELECT id, round(min(dist), 6) AS dist FROM e GROUP BY 1""")
def tree_projection(spark, d):
    """Distance of points to the nearest edge; which of two equally near edges it is may differ in the last bit."""
    at = {m: (x, y) for m, x, y in SPOTS}
    lines = spark.createDataFrame([(f"{r['a']}-{r['b']}", *at[r["a"]], *at[r["b"]]) for r in b.milestones(spark).collect()], "edge string, xa double, ya double, xb double, yb double")
    points = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 601 / 100.0).alias("x"), (F.col("c_custkey") * 53 % 199 / 100.0).alias("y"))
    return r6(trajectory.project(points, lines).select("id", "dist"))


@query()
def principal_tree(spark, d):
    """Nodes of a principal tree of 20 nodes through the vectors that each vector is nearest to."""
    points = b.latent(spark, d)
    return r6(principal.assigned(points, principal.fit(points, 20, gamma=10.0, rounds=10)))


START = "st AS (SELECT vec_id AS node, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM embeddings ORDER BY vec_id LIMIT 8)"


@query(f"""WITH {START}, nd AS (SELECT row_number() OVER (ORDER BY node) - 1 AS node, c FROM st), pt AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
    ds AS (SELECT id, {{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'node': node}} AS e FROM pt, nd) SELECT id, min(e).node AS node, round(min(e).d, 6) AS d2 FROM ds GROUP BY id""")
def principal_assignment(spark, d):
    """Nearest of given nodes: the eight first vectors."""
    points = b.latent(spark, d)
    first = [r["vec"] for r in points.orderBy("id").limit(8).collect()]
    return r6(principal.assigned(points, principal.PrincipalTree(np.array(first, float), [], 0.0, [])))


# --- matrix and input stages


@query(f"WITH {EXPR} SELECT c.cell, g.gene, greatest(coalesce(value, 0), 30.0) AS value FROM (SELECT DISTINCT cell FROM expr) c CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN expr e ON e.cell = c.cell AND e.gene = g.gene")
def clip_bottom(spark, d):
    return matrix.clip_bottom(b.expr(spark, d), 30.0, over=("cell", "gene"))


@query(f"WITH {EXPR} SELECT cell, gene, round(exp(value / 50) - 1, 6) AS value FROM expr")
def undo_log1p(spark, d):
    return r6(matrix.undo_log1p(b.expr(spark, d).withColumn("value", F.col("value") / 50)))


@query(f"WITH {EXPR}, {N} SELECT gene FROM expr, n WHERE value > 0 GROUP BY gene HAVING count(*) >= round(0.2 * any_value(nc))")
def projection_genes(spark, d):
    return matrix.projection_genes(b.expr(spark, d), None, "threshold", 0.2)


@query("SELECT c_custkey AS id, unnest(['c_nationkey', 'c_acctbal', 'c_mktsegment']) AS name, unnest([c_nationkey::DOUBLE, c_acctbal, NULL]) AS value, unnest([NULL, NULL, c_mktsegment]) AS level FROM customer")
def meta_kinds(spark, d):
    num, fac = analysis.metadata(b.table(spark, d, "customer"), "c_custkey")
    return num.select("id", F.col("feature").alias("name"), "value", F.lit(None).cast("string").alias("level")).unionByName(fac.select("id", F.col("var").alias("name"), F.lit(None).cast("double").alias("value"), "level"))


@query(f"WITH {NUMBERS} SELECT pool AS id, feature, round(avg(value), 6) AS value FROM num GROUP BY 1, 2")
def pooled_cells(spark, d):
    own = analysis.pooled(analysis.replace(data(spark, d), pools=b.pools(spark, d)))
    return r6(own.numbers)


@query(f"WITH {EXPR}, {N}, {GENES}, nw AS (SELECT 'B_' || p_brand AS sig, gene, 1.0::DOUBLE AS sign FROM genes), det AS (SELECT gene FROM expr, n WHERE value > 0 GROUP BY gene HAVING count(*) >= 0.01 * any_value(nc)), k AS (SELECT * FROM nw WHERE gene IN (SELECT gene FROM det)), {UPDOWN.replace(GENES + ', ', '')} SELECT sig, gene, sign FROM sigs UNION ALL SELECT sig, gene, sign FROM k WHERE sig IN (SELECT sig FROM k GROUP BY 1 HAVING count(*) >= 5)")
def added_signatures(spark, d):
    new = b.brand_modules(spark, d).select(F.concat(F.lit("B_"), "mod").alias("sig"), "gene", F.lit(1.0).alias("sign"))
    return report.add_signatures(data(spark, d), new)


@query()
def null_groups(spark, d):
    """Clusters of the signatures' sizes and balances for random backgrounds, by k-means."""
    return analysis.size_groups(data(spark, d).sigs)[0]


@query()
def signature_pvalues(spark, d):
    """Autocorrelation of signatures over the tree against 3000 random signatures a group."""
    own = data(spark, d, "scores")
    ids = lambda s: s.withColumn("cell", F.concat(F.lit("c"), F.col("cell")))
    logs = graph.saved(ids(q.log_expr(spark, d)))
    return r6(analysis.signature_autocorrelation(own, own.sigs, logs, ids(own.results["scores"]), graph.saved(_tree_edges(spark, d))))


@query()
def micro_pools(spark, d):
    """(pool, cell): communities of the vectors split to about ten each."""
    return pools.micro_clusters(b.latent(spark, d), 10)


# --- modules


@query(f"WITH {ENR.replace('SELECT p_type AS sig, gene FROM genes', 'SELECT p_type AS sig, gene FROM genes WHERE CAST(right(p_brand, 1) AS INT) % 2 = 0')}, own AS (SELECT sig, mod, row_number() OVER (PARTITION BY sig ORDER BY round(stat, 9) DESC, mod) = 1 AS assigned FROM en) SELECT 'S_' || sig || '_UP' AS sig, mod, round(stat, 6) + 0.0 AS stat, round(p, 6) AS p, assigned FROM en JOIN own USING (sig, mod)")
def report_module_enrichment(spark, d):
    return r6(report.module_enrichment(data(spark, d, "module_enrichment")))


@query(f"WITH {GENES}, g AS (SELECT 'S_' || p_type AS sig, gene, CAST(right(p_brand, 1) AS INT) % 2 = 0 AS even FROM genes) SELECT sig || CASE WHEN even THEN '_UP' ELSE '_DOWN' END AS sig, gene FROM g")
def directional_sets(spark, d):
    return contrast.directional_sets(b.signed_signatures(spark, d), skip_down=False)


FAMILY = ENR.replace("SELECT p_type AS sig, gene FROM genes", "SELECT left(p_brand, 7) AS sig, gene FROM genes")


@query(f"WITH {FAMILY} SELECT sig || '_OVERLAP_' || mod AS sig, gene, 1.0::DOUBLE AS sign FROM en JOIN s1 USING (sig) JOIN s2 USING (mod, gene) WHERE p < 0.05")
def overlap_sigs(spark, d):
    family = b.genes(spark, d).select(F.substring("p_brand", 1, 7).alias("sig"), "gene", F.lit(1.0).alias("sign"))
    modules = b.brand_modules(spark, d)
    return contrast.overlap_signatures(contrast.enrichment(family, modules, b.genes(spark, d).count()), family, modules)


@query("SELECT p_brand AS feature, row_number() OVER (ORDER BY p_brand)::INT AS cluster FROM (SELECT DISTINCT p_brand FROM part)")
def report_module_groups(spark, d):
    return report.module_groups(data(spark, d))


@query("SELECT DISTINCT p_brand || '|' || p_type AS gene FROM part WHERE p_brand = 'Brand#12'")
def report_module_genes(spark, d):
    return report.module_genes(data(spark, d), "Brand#12")


@query(f"WITH {scored(ZC, MODSIG)} SELECT cell, round(score, 6) + 0.0 AS score FROM sc WHERE sig = 'Brand#12'")
def report_module_scores(spark, d):
    return r6(report.module_values(data(spark, d, "module_scores"), "Brand#12"))


# --- report questions


@query(f"WITH {scored(ZC, UPDOWN)} SELECT cell, round(score, 6) + 0.0 AS score FROM sc WHERE sig = '{SIG}_UP'")
def report_signature_scores(spark, d):
    return r6(report.signature_scores(data(spark, d, "scores"), f"{SIG}_UP"))


@query(f"WITH {scored(ZC, UPDOWN)} SELECT sig, gene, any_value(sign) AS sign, round(round_even(covar_samp(score, z) * any_value(sign), 4), 3) + 0.0 AS importance FROM sc JOIN sigs USING (sig) JOIN z USING (cell, gene) WHERE sig = '{SIG}' GROUP BY sig, gene")
def report_signature_info(spark, d):
    parsed = F.from_json("genes", "map<string, struct<sign: double, importance: double>>")
    return report.signature_info(data(spark, d, "gene_importance"), SIG).select("sig", F.explode(parsed).alias("gene", "x")).select("sig", "gene", "x.sign", (F.round("x.importance", 3) + 0.0).alias("importance"))


_LEVELS = ", ".join(f"any_value(round(stat, 5) + 0.0) FILTER (level = '{x}') AS \"{x}\"" for x in SEGMENTS)


@query(f"WITH {SIGVALS}, {ranked_against('mv', '0')} SELECT feature, {_LEVELS.replace('stat', 'auc')} FROM pp WHERE var = 'segment' GROUP BY 1")
def report_differential(spark, d):
    own = data(spark, d, "scores")
    found = analysis.comparisons(own, _rounded(own.results["scores"]), None, None, own.factors)
    return r5(report.differential(analysis.replace(own, results=found), "segment"))


@query(f"WITH {NUMBERS}, {ranked_against('num', 'ties')}, {FACTORS}, al AS (SELECT feature, var, level, auc AS stat FROM pp UNION ALL SELECT feature, var, level, stat FROM fp) SELECT feature, {_LEVELS} FROM al WHERE var = 'segment' GROUP BY 1")
def report_meta_differential(spark, d):
    return r5(report.differential(data(spark, d, "meta_one_vs_rest"), "segment", "meta"))


@query(f"WITH {PROTEINS}, {ranked_against('pro', 'ties')} SELECT feature, {_LEVELS.replace('stat', 'auc')} FROM pp WHERE var = 'segment' GROUP BY 1")
def report_protein_differential(spark, d):
    return r5(report.differential(data(spark, d, "proteins_one_vs_rest"), "segment", "proteins"))


@query(f"WITH {MODVALS}, {ranked_against('mv', '0')} SELECT feature, {_LEVELS.replace('stat', 'auc')} FROM pp WHERE var = 'segment' GROUP BY 1")
def report_module_differential(spark, d):
    own = data(spark, d, "module_scores")
    found = analysis.comparisons(own, None, _rounded(own.results["module_scores"]), None, own.factors)
    return r5(report.differential(analysis.replace(own, results=found), "segment", "modules"))


def _coordinates(spark, d):
    """(id, comp, coord): balance and number of orders as two components."""
    n = b.numbers(spark, d).where("feature in ('balance', 'orders')")
    return n.select("id", F.when(F.col("feature") == "balance", 1).otherwise(2).alias("comp"), F.col("value").alias("coord"))


def _correlated(values: str, where: str) -> str:
    side = "cx AS (SELECT id, CASE feature WHEN 'balance' THEN 1 ELSE 2 END AS comp, value AS coord FROM num WHERE feature IN ('balance', 'orders'))"
    one = lambda k: f'round(coalesce(corr(value, coord) FILTER (comp = {k}), 0), 5) + 0.0 AS "{k}"'
    return f"{side} SELECT feature, {one(1)}, {one(2)} FROM {values} JOIN cx USING (id) {where} GROUP BY 1"


@query(f"WITH {SIGVALS}, {NUMBERS}, {_correlated('mv', '')}")
def report_correlations(spark, d):
    own = data(spark, d, "scores")
    found = {"component_correlation": latent.correlations(analysis.as_values(own.results["scores"]), _coordinates(spark, d))}
    return r5(report.correlations(analysis.replace(own, results=found)))


@query(f"WITH {PROTEINS}, {NUMBERS}, {_correlated('pro', '')}")
def report_protein_correlations(spark, d):
    own = data(spark, d)
    return r5(report.correlations(analysis.replace(own, results={"protein_component_correlation": latent.correlations(own.proteins, _coordinates(spark, d))}), "proteins"))


@query(f"WITH {EXPR} SELECT c.cell, round(log2(coalesce(e.value, 0) + 1), 6) AS value FROM (SELECT DISTINCT cell FROM expr) c LEFT JOIN expr e ON e.cell = c.cell AND e.gene = '{GENE}'")
def report_gene_values(spark, d):
    return r6(report.gene_values(data(spark, d), GENE))


@query(f"WITH {EXPR} SELECT DISTINCT gene FROM expr")
def report_gene_list(spark, d):
    return report.gene_list(data(spark, d))


@query(f"WITH {LEVELS} SELECT var, string_agg(DISTINCT level, ',' ORDER BY level) AS levels FROM lev GROUP BY 1")
def report_levels(spark, d):
    return report.levels(data(spark, d)).select("var", F.array_join("levels", ",").alias("levels"))


@query("SELECT c_custkey AS cell, c_mktsegment AS level FROM customer")
def report_cell_levels(spark, d):
    return report.cell_levels(data(spark, d), "segment")


@query("SELECT c_custkey AS cell, c_acctbal AS value FROM customer")
def report_meta_values(spark, d):
    return report.meta_values(data(spark, d), "balance")


@query(f"WITH {PROTEINS} SELECT id AS cell, value FROM pro WHERE feature = '1-URGENT'")
def report_protein_values(spark, d):
    return report.protein_values(data(spark, d), "1-URGENT")


@query("SELECT DISTINCT o_orderpriority AS feature, 1::INT AS cluster FROM orders")
def report_protein_groups(spark, d):
    return report.protein_groups(data(spark, d))


@query("SELECT unnest(['balance', 'orders', 'spent', 'segment', 'nation']) AS feature, 1::INT AS cluster")
def report_meta_groups(spark, d):
    own = data(spark, d)
    found = {"meta_clusters": pools.meta_clusters(own.factors, own.numbers.select("feature").distinct())}
    return report.meta_groups(analysis.replace(own, results=found))


@query(f"WITH {NUMBERS}, {LEVELS} SELECT feature, round(value, 4) AS number, NULL AS level FROM num WHERE id = 7 UNION ALL SELECT var, NULL, level FROM lev WHERE id = 7")
def report_cell(spark, d):
    number = F.col("feature").isin("balance", "orders", "spent")
    return report.cell_metadata(data(spark, d), 7).select("feature", F.round(F.when(number, F.col("value")).cast("double"), 4).alias("number"), F.when(~number, F.col("value")).alias("level"))


@query("WITH s AS (SELECT 'segment' AS var, c_mktsegment AS level, count(*) AS n FROM customer WHERE c_nationkey = 3 GROUP BY 2 UNION ALL SELECT 'nation', '3', count(*) FROM customer WHERE c_nationkey = 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY var) AS share FROM s) SELECT var, level, round(100 * share, 6) AS percent, round(-sum(share * log2(share)) OVER (PARTITION BY var), 6) + 0.0 AS entropy FROM p")
def report_selection_factors(spark, d):
    return r6(report.selection_factors(data(spark, d), b.pools(spark, d).where("pool = 3")))


@query(f"WITH {EXPR} SELECT DISTINCT gene FROM expr WHERE (lower(gene) LIKE '%large%' OR lower(gene) LIKE '%brand#2%') AND lower(gene) NOT LIKE '%promo%'")
def report_search(spark, d):
    return report.search(report.gene_list(data(spark, d)), "large, Brand#2, !PROMO", "gene")


@query(f"WITH {NUMBERS}, kv AS (SELECT feature, value FROM num WHERE feature IN ('balance', 'orders')), e AS (SELECT feature, min(value) AS lo, (max(value) - min(value)) / 40 AS w FROM kv GROUP BY 1) SELECT feature, least(floor((value - lo) / w), 39)::BIGINT AS bin, count(*) AS n FROM kv JOIN e USING (feature) GROUP BY 1, 2")
def report_histogram(spark, d):
    return report.histogram(b.numbers(spark, d).where("feature in ('balance', 'orders')")).withColumn("bin", F.col("bin").cast("long"))
