"""Queries over the sample schema, each with the SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signascope.functions import stats
from signascope.operators import contrast, graph, latent, matrix, score, trajectory
from signascope.operators import tree as trees
from signascope.plans import analysis, report
from signascope.plans import bindings as b
from signascope.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros."""
    return df.select(*[(F.round(F.col(c), 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def ids(df: DataFrame, name: str = "cell") -> DataFrame:
    return df.withColumnRenamed("id", name)


def log_expr(spark, d):
    return matrix.log2p1(b.expr(spark, d))


EXPR = "expr AS (SELECT o_custkey AS cell, p_brand || '|' || p_type AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
N = "n AS (SELECT count(DISTINCT cell) AS nc, count(DISTINCT gene) AS ng FROM expr)"
LOG = f"{EXPR}, {N}, lx AS (SELECT cell, gene, log2(value + 1) AS x FROM expr)"
GST = "gs AS (SELECT gene, count(*) FILTER (x > 0) AS n_detected, sum(x) / any_value(nc) AS mean, (sum(x * x) - sum(x) * sum(x) / any_value(nc)) / (any_value(nc) - 1) AS var FROM lx, n GROUP BY gene)"
CST = "cs AS (SELECT cell, count(*) FILTER (x > 0) AS n_detected, sum(x) / any_value(ng) AS mean, (sum(x * x) - sum(x) * sum(x) / any_value(ng)) / (any_value(ng) - 1) AS var FROM lx, n GROUP BY cell)"
GENES = "genes AS (SELECT DISTINCT p_brand || '|' || p_type AS gene, p_brand, p_type FROM part)"
TSIG = f"{GENES}, sigs AS (SELECT p_type AS sig, gene, 1.0::DOUBLE AS sign FROM genes WHERE gene IN (SELECT gene FROM expr))"
SSIG = f"{GENES}, sigs AS (SELECT 'S_' || p_type AS sig, gene, CASE WHEN CAST(right(p_brand, 1) AS INT) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM genes WHERE gene IN (SELECT gene FROM expr))"
#: every normalised entry, zeros too
DENSE = "cells AS (SELECT DISTINCT cell FROM expr), gns AS (SELECT DISTINCT gene FROM expr), dense AS (SELECT c.cell, g.gene, coalesce(lx.x, 0) AS x FROM cells c CROSS JOIN gns g LEFT JOIN lx ON lx.cell = c.cell AND lx.gene = g.gene)"
ZC = f"{LOG}, {DENSE}, z AS (SELECT cell, gene, x, (x - avg(x) OVER c) / CASE WHEN var_samp(x) OVER c <= 1e-300 THEN 1 ELSE sqrt(var_samp(x) OVER c) END AS z FROM dense WINDOW c AS (PARTITION BY cell))"
ZR = f"{LOG}, {DENSE}, z AS (SELECT cell, gene, x, (x - avg(x) OVER g) / CASE WHEN var_samp(x) OVER g <= 1e-300 THEN 1 ELSE sqrt(var_samp(x) OVER g) END AS z FROM dense WINDOW g AS (PARTITION BY gene))"
ZRC = ZR.replace(", z AS", ", z1 AS") + ", z AS (SELECT cell, gene, x, (z - avg(z) OVER c) / CASE WHEN var_samp(z) OVER c <= 1e-300 THEN 1 ELSE sqrt(var_samp(z) OVER c) END AS z FROM z1 WINDOW c AS (PARTITION BY cell))"
ZN = f"{LOG}, {DENSE}, z AS (SELECT cell, gene, x, x AS z FROM dense)"
ZK = f"{LOG}, {DENSE}, z AS (SELECT cell, gene, x, CAST(rank() OVER (PARTITION BY cell ORDER BY x) AS DOUBLE) AS z FROM dense)"


def scored(z: str, sig: str) -> str:
    return f"{z}, {sig}, sc AS (SELECT cell, sig, sum(sign * z) / sum(abs(sign)) AS score FROM z JOIN sigs USING (gene) GROUP BY cell, sig)"


# --- matrix


@query(f"WITH {EXPR} SELECT cell, gene, value FROM expr")
def expr_long(spark, d):
    return b.expr(spark, d)


@query(f"WITH {LOG}, {GST} SELECT gene, n_detected, round(mean, 6) AS mean, round(var, 6) AS var FROM gs")
def gene_stats(spark, d):
    return r6(matrix.gene_stats(log_expr(spark, d)).select("gene", "n_detected", "mean", "var"))


@query(f"WITH {LOG}, {CST} SELECT cell, n_detected, round(mean, 6) AS mean, round(var, 6) AS var FROM cs")
def cell_stats(spark, d):
    return r6(matrix.cell_stats(log_expr(spark, d)).select("cell", "n_detected", "mean", "var"))


@query(f"WITH {EXPR}, {N} SELECT gene FROM expr, n WHERE value > 0 GROUP BY gene HAVING count(*) >= round(0.2 * any_value(nc))")
def filter_threshold(spark, d):
    e = b.expr(spark, d)
    return matrix.apply_filter(e, "threshold", round(0.2 * e.select("cell").distinct().count()))


@query(f"WITH {LOG}, {GST} SELECT gene FROM gs WHERE var > 1e-12")
def filter_novar(spark, d):
    return matrix.apply_filter(log_expr(spark, d), "novar")


FANO = f"""{LOG}, {GST}, f AS (SELECT gene, mean, var / mean AS fano, row_number() OVER (ORDER BY mean, gene) AS rn, count(*) OVER () AS n FROM gs WHERE mean > 0),
    bn AS (SELECT *, CASE WHEN n < 30 THEN 0 ELSE least((rn - 1) // (n // 30), 29) END AS bin FROM f), md AS (SELECT bin, median(fano) AS med FROM bn GROUP BY bin),
    mad AS (SELECT bin, any_value(med) AS med, median(abs(fano - med)) AS mad FROM bn JOIN md USING (bin) GROUP BY bin)"""


@query(f"WITH {FANO} SELECT gene FROM bn JOIN mad USING (bin) WHERE fano > med + 1 * mad")
def filter_fano(spark, d):
    return matrix.filter_fano(log_expr(spark, d), num_mad=1)


def _norm(method):
    def run(spark, d):
        return r6(matrix.normalised(log_expr(spark, d), method).select("cell", "gene", "z", "z0"))

    return run


for _name, _method, _z in (("norm_znorm_cols", "znorm_columns", ZC), ("norm_znorm_rows", "znorm_rows", ZR), ("norm_rows_then_cols", "znorm_rows_then_columns", ZRC)):
    QUERIES[_name] = _norm(_method)
# an absent entry's value is that of a stored zero, which the dense form shows by shifting x to 0
_Z0 = {
    "norm_znorm_cols": "z - x / CASE WHEN var_samp(x) OVER (PARTITION BY cell) <= 1e-300 THEN 1 ELSE sqrt(var_samp(x) OVER (PARTITION BY cell)) END",
    "norm_znorm_rows": "z - x / CASE WHEN var_samp(x) OVER (PARTITION BY gene) <= 1e-300 THEN 1 ELSE sqrt(var_samp(x) OVER (PARTITION BY gene)) END",
}
ORACLES["norm_znorm_cols"] = f"WITH {ZC}, o AS (SELECT *, {_Z0['norm_znorm_cols']} AS z0 FROM z) SELECT cell, gene, round(z, 6) + 0.0 AS z, round(z0, 6) + 0.0 AS z0 FROM o WHERE x > 0"
ORACLES["norm_znorm_rows"] = f"WITH {ZR}, o AS (SELECT *, {_Z0['norm_znorm_rows']} AS z0 FROM z) SELECT cell, gene, round(z, 6) + 0.0 AS z, round(z0, 6) + 0.0 AS z0 FROM o WHERE x > 0"
ORACLES["norm_rows_then_cols"] = f"""WITH {ZRC}, o AS (SELECT z.*, sqrt(var_samp(x) OVER (PARTITION BY gene)) AS sg, sqrt(var_samp(z1.z) OVER (PARTITION BY cell)) AS sc FROM z JOIN z1 USING (cell, gene, x))
    SELECT cell, gene, round(z, 6) + 0.0 AS z, round(z - x / sg / sc, 6) + 0.0 AS z0 FROM o WHERE x > 0"""


@query(f"WITH {ZK} SELECT cell, gene, z, 1.0::DOUBLE AS z0 FROM z WHERE x > 0")
def norm_rank_cols(spark, d):
    return matrix.column_ranks(log_expr(spark, d)).select("cell", "gene", "z", "z0")


@query(f"WITH {EXPR} SELECT cell, split_part(gene, '|', 1) AS gene, sum(value) AS value FROM expr GROUP BY 1, 2")
def convert_gene_ids(spark, d):
    return matrix.convert_gene_ids(b.expr(spark, d), b.genes(spark, d).select("gene", F.col("p_brand").alias("new_id")))


@query(f"WITH {EXPR}, {N}, p AS (SELECT c_nationkey AS pool, c_custkey AS cell FROM customer), s AS (SELECT pool, count(*) AS n FROM p GROUP BY pool) SELECT pool, gene, round(sum(value) / any_value(s.n), 6) AS value FROM expr JOIN p USING (cell) JOIN s USING (pool) GROUP BY pool, gene")
def pool_matrix(spark, d):
    return r6(matrix.pool_matrix(b.expr(spark, d), b.pools(spark, d)))


NUMBERS = "num AS (SELECT c_custkey AS id, c_nationkey AS pool, unnest(['balance', 'orders', 'spent']) AS feature, unnest([c_acctbal, coalesce(k, 0), t]) AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS k, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


@query(f"WITH {NUMBERS} SELECT pool, feature AS var, round(avg(value), 6) AS value FROM num GROUP BY 1, 2")
def pool_meta_num(spark, d):
    return r6(matrix.pool_numbers(b.numbers(spark, d).select(F.col("id").alias("cell"), F.col("feature").alias("var"), "value"), b.pools(spark, d)))


SEG = "sh AS (SELECT c_nationkey AS pool, 'segment' AS var, c_mktsegment AS level, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS share FROM customer GROUP BY 1, 3)"


@query(f"WITH {SEG}, t AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY share DESC, level) AS rn FROM sh) SELECT pool, var, CASE WHEN share >= 0.5 THEN level ELSE '~' END AS level FROM t WHERE rn = 1")
def pool_meta_factor(spark, d):
    return matrix.pool_factors(b.factor(spark, d).where("var = 'segment'").withColumnRenamed("id", "cell"), b.pools(spark, d))


@query(f"WITH {SEG} SELECT pool, var, level, round(share, 6) AS share FROM sh")
def pool_meta_shares(spark, d):
    return r6(matrix.pool_shares(b.factor(spark, d).where("var = 'segment'").withColumnRenamed("id", "cell"), b.pools(spark, d)))


# --- signatures


@query(f"""WITH {EXPR}, {N}, {TSIG}, det AS (SELECT gene FROM expr, n WHERE value > 0 GROUP BY gene HAVING count(*) >= 0.2 * any_value(nc)), k AS (SELECT * FROM sigs WHERE gene IN (SELECT gene FROM det))
    SELECT sig, gene, sign FROM k WHERE sig IN (SELECT sig FROM k GROUP BY sig HAVING count(DISTINCT gene) >= 5)""")
def sig_process(spark, d):
    return score.process_signatures(b.type_signatures(spark, d), b.expr(spark, d), 5, 0.2)


def _scores(method, sigs):
    def run(spark, d):
        return r6(score.scores(log_expr(spark, d), sigs(spark, d), method))

    return run


for _name, _method, _sigs, _z, _s in (
    ("sig_scores_none", "none", b.type_signatures, ZN, TSIG), ("sig_scores_znorm", "znorm_columns", b.type_signatures, ZC, TSIG), ("sig_scores_rows", "znorm_rows", b.type_signatures, ZR, TSIG),
    ("sig_scores_rows_cols", "znorm_rows_then_columns", b.type_signatures, ZRC, TSIG), ("sig_scores_rank", "rank_norm_columns", b.type_signatures, ZK, TSIG), ("sig_scores_signed", "znorm_columns", b.signed_signatures, ZC, SSIG),
):
    QUERIES[_name] = _scores(_method, _sigs)
    ORACLES[_name] = f"WITH {scored(_z, _s)} SELECT cell, sig, round(score, 6) + 0.0 AS score FROM sc"

UPDOWN = SSIG.replace("sigs AS", "base AS") + ", sigs AS (SELECT * FROM base UNION ALL SELECT sig || CASE WHEN sign > 0 THEN '_UP' ELSE '_DOWN' END, gene, sign FROM base WHERE sig IN (SELECT sig FROM base GROUP BY sig HAVING min(sign) = -1 AND max(sign) = 1))"


@query(f"WITH {scored(ZC, UPDOWN)} SELECT cell, sig, round(score, 6) + 0.0 AS score FROM sc")
def sig_scores_up_down(spark, d):
    e = log_expr(spark, d)
    known = b.signed_signatures(spark, d).join(e.select("gene").distinct(), "gene", "left_semi")
    return r6(score.scores(e, score.split_directions(known)))


def _importance(method):
    def run(spark, d):
        e, s = log_expr(spark, d), b.signed_signatures(spark, d)
        return r6(score.gene_importance(e, s, score.scores(e, s, method), method))

    return run


for _name, _method, _z in (("gene_importance", "znorm_columns", ZC), ("gene_importance_rows", "znorm_rows", ZR), ("gene_importance_rows_cols", "znorm_rows_then_columns", ZRC)):
    QUERIES[_name] = _importance(_method)
    ORACLES[_name] = f"WITH {scored(_z, SSIG)} SELECT sig, gene, round(covar_samp(score, z) * any_value(sign), 6) + 0.0 AS importance FROM sc JOIN sigs USING (sig) JOIN z USING (cell, gene) GROUP BY sig, gene"


# --- graph

K = 8
KNN = f"""e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), pr AS (SELECT x.id AS i, y.id AS j, list_distance(x.v, y.v) AS dist FROM e x JOIN e y ON x.id <> y.id),
    kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM pr) WHERE rank <= {K}),
    raw AS (SELECT *, exp(-dist * dist / pow(CASE WHEN max(dist) OVER (PARTITION BY i) = 0 THEN 1 ELSE max(dist) OVER (PARTITION BY i) END, 2)) AS q FROM kn), wk AS (SELECT i, j, rank, dist, q / sum(q) OVER (PARTITION BY i) AS w FROM raw)"""
VALS = "vals AS (SELECT vec_id AS id, 'd' || k AS feature, embedding[k + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS k))"
RANKED = VALS.replace("vals AS", "v0 AS") + ", vals AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS value FROM v0)"
GEARY = "g AS (SELECT a.feature, sum(w * (a.value - c.value) * (a.value - c.value)) / (2 * sum(w)) AS num FROM wk JOIN vals a ON a.id = i JOIN vals c ON c.id = j AND c.feature = a.feature GROUP BY 1), va AS (SELECT feature, var_samp(value) AS v FROM vals GROUP BY 1)"


def _edges(spark, d):
    return graph.weights(graph.knn(b.latent(spark, d), K))


@query(f"WITH {KNN} SELECT i, j, rank, round(dist, 6) AS dist FROM kn")
def knn(spark, d):
    return r6(graph.knn(b.latent(spark, d), K).select("i", "j", F.col("rank").cast("long").alias("rank"), "dist"))


@query(f"WITH {KNN} SELECT i, j, round(w, 6) AS w FROM wk")
def knn_weights(spark, d):
    return r6(_edges(spark, d).select("i", "j", "w"))


@query(f"WITH {KNN}, {VALS}, {GEARY} SELECT feature, round(num / v, 6) AS c FROM g JOIN va USING (feature)")
def geary(spark, d):
    return r6(graph.geary(b.latent_values(spark, d), _edges(spark, d)))


@query(f"WITH {KNN}, {VALS}, va AS (SELECT feature, var_samp(value) * (count(*) - 1) AS ss FROM vals GROUP BY 1) SELECT a.feature, i, round(sum(w * (a.value - c.value) * (a.value - c.value)) / any_value(ss), 6) AS c FROM wk JOIN vals a ON a.id = i JOIN vals c ON c.id = j AND c.feature = a.feature JOIN va ON va.feature = a.feature GROUP BY 1, 2")
def geary_local(spark, d):
    return r6(graph.geary_local(b.latent_values(spark, d), _edges(spark, d)))


@query(f"WITH {KNN}, {RANKED}, {GEARY} SELECT feature, round(1 - num / v, 6) AS c FROM g JOIN va USING (feature)")
def autocorrelation_ranked(spark, d):
    return r6(graph.autocorrelation(b.latent_values(spark, d), _edges(spark, d)))


@query(f"""WITH {KNN}, tb AS (SELECT x.label AS a, y.label AS b, sum(w) AS o FROM wk JOIN embeddings x ON x.vec_id = i JOIN embeddings y ON y.vec_id = j GROUP BY 1, 2), rs AS (SELECT a, sum(o) AS r FROM tb GROUP BY 1), cl AS (SELECT b, sum(o) AS c FROM tb GROUP BY 1),
    t AS (SELECT sum(o) AS n FROM tb), ex AS (SELECT r * c / n AS e, coalesce(o, 0) AS o FROM rs CROSS JOIN cl CROSS JOIN t LEFT JOIN tb USING (a, b))
    SELECT 'label' AS var, round(sum((o - e) * (o - e) / e), 4) AS chi2, round(sqrt(sum((o - e) * (o - e) / e) / (SELECT n FROM t) / (least((SELECT count(*) FROM rs), (SELECT count(*) FROM cl)) - 1)), 6) AS v FROM ex""")
def factor_autocorr(spark, d):
    return graph.factor_association(b.latent_labels(spark, d), _edges(spark, d)).select("var", F.round("chi2", 4).alias("chi2"), F.round("v", 6).alias("v"))


@query()
def louvain(spark, d):
    return graph.louvain_levels(graph.louvain_weights(graph.knn(b.latent(spark, d), K)))


# --- contrasts

LEV = "lev AS (SELECT c_custkey AS id, 'segment' AS var, c_mktsegment AS level FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer)"
BH = "least(1.0::DOUBLE, min(p * cnt / rn) OVER ({by} ORDER BY rn DESC ROWS UNBOUNDED PRECEDING))"
WIL = f"""{NUMBERS}, {LEV}, kn AS (SELECT * FROM num WHERE value IS NOT NULL), rk AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rank FROM kn),
    tie AS (SELECT feature, sum(t * t * t - t)::DOUBLE AS ties, sum(t)::DOUBLE AS n FROM (SELECT feature, value, count(*) AS t FROM kn GROUP BY 1, 2) GROUP BY 1), pa AS (SELECT feature, var, level, sum(rank) AS r1, count(*)::DOUBLE AS n1 FROM rk JOIN lev USING (id) GROUP BY ALL),
    st AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n - n1 AS n2, sqrt(n1 * (n - n1) / 12 * (n + 1 - TIES / (n * (n - 1)))) AS sd FROM pa JOIN tie USING (feature)),
    zz AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN u / (n1 * n2) ELSE 0.5 END AS auc, CASE WHEN n1 > 0 AND n2 > 0 THEN CASE WHEN sd > 0 THEN (-abs(u - n1 * n2 / 2) + 0.5) / sd ELSE 0 END END AS z FROM st),
    pp AS (SELECT feature, var, level, auc, coalesce(least(1.0::DOUBLE, 2 * {stats.normal_sql('z')}), 1.0::DOUBLE) AS p FROM zz), od AS (SELECT *, row_number() OVER (PARTITION BY var, level ORDER BY p, feature) AS rn, count(*) OVER (PARTITION BY var, level) AS cnt FROM pp)"""


@query(f"WITH {WIL.replace('TIES', 'ties')} SELECT feature, var, level, round(auc, 6) AS auc, round(p, 6) AS p, round({BH.format(by='PARTITION BY var, level')}, 6) AS fdr FROM od")
def wilcox_one_vs_rest(spark, d):
    return r6(contrast.one_vs_rest(b.numbers(spark, d), b.factor(spark, d), ties=True).select("feature", "var", "level", "auc", "p", "fdr"))


@query(f"WITH {WIL.replace('TIES', '0')} SELECT feature, var, level, round(auc, 6) AS auc, round(p, 6) AS p, round({BH.format(by='PARTITION BY var, level')}, 6) AS fdr FROM od")
def wilcox_without_ties(spark, d):
    return r6(contrast.one_vs_rest(b.numbers(spark, d), b.factor(spark, d)).select("feature", "var", "level", "auc", "p", "fdr"))


DE = f"""{EXPR}, {{grp}}, sz AS (SELECT (count(*) FILTER (side = 'A'))::DOUBLE AS na, (count(*) FILTER (side = 'B'))::DOUBLE AS nb FROM grp), gns AS (SELECT gene FROM expr WHERE value > 0 GROUP BY gene HAVING count(*) >= 20),
    dn AS (SELECT g.gene, grp.cell, side, coalesce(value, 0) AS value FROM gns g CROSS JOIN grp LEFT JOIN expr ON expr.gene = g.gene AND expr.cell = grp.cell),
    rk AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE AS rank FROM dn),
    ti AS (SELECT gene, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT gene, value, count(*)::DOUBLE AS t FROM dn GROUP BY 1, 2) GROUP BY 1),
    ag AS (SELECT gene, sum(rank) FILTER (side = 'A') AS r1, sum(value) FILTER (side = 'A') AS sa, sum(value) FILTER (side = 'B') AS sb FROM rk GROUP BY 1 HAVING max(value) > 0),
    st AS (SELECT ag.*, na, nb, na + nb AS n, r1 - na * (na + 1) / 2 AS u, sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS sd FROM ag JOIN ti USING (gene), sz),
    zz AS (SELECT *, u / (na * nb) AS auc, CASE WHEN sd > 0 THEN (-abs(u - na * nb / 2) + 0.5) / sd ELSE 0 END AS z, log2((sa / na + 1 / sqrt(na * nb)) / (sb / nb + 1 / sqrt(na * nb))) AS log_fc FROM st),
    pp AS (SELECT gene, log_fc, auc, coalesce(least(1.0::DOUBLE, 2 * {stats.normal_sql('z')}), 1.0::DOUBLE) AS p FROM zz), od AS (SELECT *, row_number() OVER (ORDER BY p, gene) AS rn, count(*) OVER () AS cnt FROM pp)
    SELECT gene, round(log_fc, 6) + 0.0 AS log_fc, round(auc, 6) AS auc, round(p, 6) AS p, round({BH.format(by='')}, 6) AS fdr FROM od"""
_CELLS = "cl AS (SELECT DISTINCT o_custkey AS cell FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _by_segment(spark, d, level):
    return b.factor(spark, d).where((F.col("var") == "segment") & (F.col("level") == level)).select(F.col("id").alias("cell"))


@query("WITH " + DE.format(grp="grp AS (SELECT c_custkey AS cell, CASE WHEN c_mktsegment = 'BUILDING' THEN 'A' ELSE 'B' END AS side FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT cell FROM expr))"))
def de_wilcox(spark, d):
    e = graph.saved(b.expr(spark, d))  # cells, groups and genes read the matrix
    cells = e.select("cell").distinct()
    return r6(contrast.differential(e, contrast.groups_of(cells, _by_segment(spark, d, "BUILDING"), _by_segment(spark, d, "MACHINERY")), 20))


@query("WITH " + DE.format(grp="grp AS (SELECT c_custkey AS cell, CASE WHEN c_mktsegment = 'BUILDING' THEN 'A' ELSE 'B' END AS side FROM customer WHERE c_custkey IN (SELECT cell FROM expr))"))
def de_meta_remainder(spark, d):
    e = graph.saved(b.expr(spark, d))  # cells, groups and genes read the matrix
    return r6(contrast.differential(e, contrast.groups_of(e.select("cell").distinct(), _by_segment(spark, d, "BUILDING")), 20))


@query("""WITH x AS (SELECT s.level, c.c_nationkey AS b, count(*) FILTER (c.c_mktsegment = s.level)::DOUBLE AS o1, count(*) FILTER (c.c_mktsegment <> s.level)::DOUBLE AS o0 FROM customer c, (SELECT DISTINCT c_mktsegment AS level FROM customer) s GROUP BY 1, 2),
    t AS (SELECT level, sum(o1) AS r1, sum(o0) AS r0, sum(o1 + o0) AS n, count(*) AS k FROM x GROUP BY 1),
    q AS (SELECT level, any_value(k) AS k, any_value(n) AS n, sum(pow(o1 - (o1 + o0) * r1 / n, 2) / ((o1 + o0) * r1 / n) + pow(o0 - (o1 + o0) * r0 / n, 2) / ((o1 + o0) * r0 / n)) AS chi2 FROM x JOIN t USING (level) GROUP BY 1)
    SELECT 'nation' AS factor, 'segment' AS var, level, round(chi2, 6) AS chi2, round(sqrt(chi2 / n), 6) AS v, CAST(k - 1 AS INT) AS df, round(list_sum(list_transform(range(0, ((k - 1) // 2)::BIGINT), lambda i: exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1)))), 6) AS p FROM q""")
def chisq_one_vs_rest(spark, d):
    f = b.factor(spark, d)
    return r6(contrast.chi2_one_vs_rest(f.where("var = 'nation'"), f.where("var = 'segment'")))


@query(f"WITH {WIL.replace('TIES', 'ties')} SELECT feature, var, level, round(p, 6) AS p, round({BH.format(by='')}, 6) AS fdr FROM (SELECT *, row_number() OVER (ORDER BY p, feature, var, level) AS rn, count(*) OVER () AS cnt FROM pp)")
def bh_fdr(spark, d):
    tested = contrast.one_vs_rest(b.numbers(spark, d), b.factor(spark, d), ties=True).drop("fdr")
    return r6(stats.bh(tested, "p", [], ["feature", "var", "level"]).select("feature", "var", "level", "p", "fdr"))


# --- modules

ENR = f"""{GENES}, ng AS (SELECT count(DISTINCT gene)::DOUBLE AS n FROM genes), s1 AS (SELECT p_type AS sig, gene FROM genes), s2 AS (SELECT p_brand AS mod, gene FROM genes), na AS (SELECT sig, count(*) AS na FROM s1 GROUP BY 1), nb AS (SELECT mod, count(*) AS nb FROM s2 GROUP BY 1),
    ov AS (SELECT sig, mod, greatest(na, nb)::DOUBLE AS m, least(na, nb)::DOUBLE AS k, n, (SELECT count(*) FROM s1 JOIN s2 USING (gene) WHERE s1.sig = na.sig AND s2.mod = nb.mod) AS o FROM na, nb, ng),
    en AS (SELECT sig, mod, o AS overlap, CASE WHEN o > 0 THEN ln(o / (k * m / n)) ELSE 0 END AS stat,
      coalesce(list_sum(list_transform(list_filter(range(o, k::BIGINT + 1), lambda i: i >= m + k - n), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n - m + 1) - lgamma(k - i + 1) - lgamma(n - m - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)))), 0) AS p FROM ov)"""


def _enriched(spark, d):
    return contrast.enrichment(b.type_signatures(spark, d), b.brand_modules(spark, d), b.genes(spark, d).count())


@query(f"WITH {ENR} SELECT sig, mod, overlap, round(stat, 6) + 0.0 AS stat, round(p, 6) AS p FROM en")
def enrichment(spark, d):
    return r6(_enriched(spark, d))


@query(f"WITH {ENR} SELECT sig, mod FROM (SELECT sig, mod, row_number() OVER (PARTITION BY sig ORDER BY round(stat, 9) DESC, mod) AS rn FROM en) WHERE rn = 1")
def sig_module_assign(spark, d):
    return contrast.best_module(_enriched(spark, d).withColumn("stat", F.round("stat", 9)))


# --- trees

TREE = """tree AS (SELECT 'root' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
    up AS (SELECT node AS anc, node, 0 AS hops FROM tree UNION ALL SELECT t.parent, up.node, up.hops + 1 FROM up JOIN tree t ON t.node = up.anc WHERE t.parent IS NOT NULL),
    tip AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)), sz AS (SELECT anc AS node, count(*) AS size FROM up JOIN tip USING (node) GROUP BY 1)"""


def _tree(spark, d):
    t = b.tree(spark, d)
    return t, trees.closure(t)


@query(f"WITH RECURSIVE {TREE} SELECT anc, node, hops FROM up")
def tree_closure(spark, d):
    return _tree(spark, d)[1]


@query(f"WITH RECURSIVE {TREE} SELECT node, size FROM sz")
def tree_clade_sizes(spark, d):
    t, up = _tree(spark, d)
    return trees.clade_sizes(t, up)


@query(f"WITH RECURSIVE {TREE} SELECT parent AS node, count(*) AS n_children, min(size) AS least, max(size) AS most FROM tree JOIN sz USING (node) WHERE parent IS NOT NULL GROUP BY 1")
def tree_child_clades(spark, d):
    t, up = _tree(spark, d)
    return trees.child_clades(t, trees.clade_sizes(t, up))


@query(f"WITH RECURSIVE {TREE} SELECT node, size::DOUBLE AS edge_len FROM (SELECT tree.node, p.size - sz.size AS size FROM tree JOIN sz USING (node) JOIN sz p ON p.node = tree.parent)")
def tree_ultrametric(spark, d):
    t, up = _tree(spark, d)
    return trees.ultrametric(t, trees.clade_sizes(t, up))


@query(f"WITH RECURSIVE {TREE}, q AS (SELECT node, anc, row_number() OVER (PARTITION BY node ORDER BY hops) AS rn FROM up JOIN sz ON sz.node = up.anc WHERE size >= 20) SELECT u.node, coalesce(q.anc, 'root') AS anc FROM (SELECT DISTINCT node FROM up) u LEFT JOIN (SELECT node, anc FROM (SELECT up.node, anc, row_number() OVER (PARTITION BY up.node ORDER BY hops) AS rn FROM up JOIN sz ON sz.node = up.anc WHERE size >= 20) WHERE rn = 1) q USING (node)".replace(", q AS (SELECT node, anc, row_number() OVER (PARTITION BY node ORDER BY hops) AS rn FROM up JOIN sz ON sz.node = up.anc WHERE size >= 20)", ""))
def tree_min_size_clade(spark, d):
    t, up = _tree(spark, d)
    return trees.ancestor_at_size(up, trees.clade_sizes(t, up), 20)


PAIRS = "pairs AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey * 7 % (SELECT count(*) FROM customer) + 1) AS b FROM customer)"


def _pairs(spark, d):
    c = b.table(spark, d, "customer")
    n = c.count()
    return c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("a"), F.concat(F.lit("c"), F.col("c_custkey") * 7 % n + 1).alias("b"))


MRCA = f"{TREE}, {PAIRS}, mr AS (SELECT a, b, ha, hb, anc FROM (SELECT a, b, x.hops AS ha, y.hops AS hb, x.anc, row_number() OVER (PARTITION BY a, b ORDER BY x.hops) AS rn FROM pairs JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.anc = x.anc) WHERE rn = 1)"


@query(f"WITH RECURSIVE {MRCA} SELECT a, b, ha + hb AS dist, ha + 1 AS trivial FROM mr")
def tree_distances(spark, d):
    return trees.path_distance(_tree(spark, d)[1], _pairs(spark, d))


@query(f"WITH RECURSIVE {MRCA} SELECT a, b, size AS depth FROM mr JOIN up ON up.node = a AND up.hops = greatest(ha - 1, 0) JOIN sz ON sz.node = up.anc")
def tree_lca_depth(spark, d):
    t, up = _tree(spark, d)
    return trees.lca_depth(up, trees.clade_sizes(t, up), _pairs(spark, d))


@query(f"WITH RECURSIVE {TREE}, ds AS (SELECT x.node AS i, y.node AS j, min(x.hops + y.hops) AS dist FROM up x JOIN up y ON x.anc = y.anc AND x.node <> y.node WHERE x.node IN (SELECT node FROM tip) AND y.node IN (SELECT node FROM tip) GROUP BY 1, 2) SELECT i, j, rank, dist::DOUBLE AS dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM ds) WHERE rank <= 5")
def tree_knn(spark, d):
    t, up = _tree(spark, d)
    return trees.tree_knn(up, trees.tips(t), 5).select("i", "j", F.col("rank").cast("long").alias("rank"), "dist")


@query(f"WITH RECURSIVE {TREE} SELECT node, anc AS cluster FROM (SELECT up.node, anc, row_number() OVER (PARTITION BY up.node ORDER BY hops DESC) AS rn FROM up JOIN tip USING (node) JOIN sz ON sz.node = anc WHERE size <= 100) WHERE rn = 1")
def tree_clusters(spark, d):
    t, up = _tree(spark, d)
    return trees.clusters_by_size(t, up, trees.clade_sizes(t, up), 100)


@query(f"WITH RECURSIVE {TREE}, ch AS (SELECT parent AS anc, min(size) AS least FROM tree JOIN sz USING (node) GROUP BY 1) SELECT node, anc AS cluster FROM (SELECT up.node, up.anc, row_number() OVER (PARTITION BY up.node ORDER BY hops DESC) AS rn FROM up JOIN tip USING (node) LEFT JOIN ch USING (anc) WHERE coalesce(least, 0) < 10) WHERE rn = 1")
def tree_clusters_min_clade(spark, d):
    t, up = _tree(spark, d)
    return trees.clusters_by_min_clade(t, up, trees.clade_sizes(t, up), 10)


# three levels: nations vote by customers, regions by nations, the root by regions
_VOTE = "{n} AS (SELECT node, list_sort(list(l)) AS labels, any_value(kids) - any_value(c) AS cost FROM (SELECT node, l, c, kids, max(c) OVER (PARTITION BY node) AS top FROM (SELECT t.parent AS node, l, count(*) AS c, any_value(k.kids) AS kids FROM (SELECT node, unnest(labels) AS l FROM {src}) s JOIN tree t USING (node) JOIN (SELECT parent, count(*) AS kids FROM tree GROUP BY 1) k ON k.parent = t.parent GROUP BY 1, 2)) WHERE c = top GROUP BY node)"
FITCH = f"{TREE}, f0 AS (SELECT 'c' || c_custkey AS node, [c_mktsegment] AS labels, 0 AS cost FROM customer), {_VOTE.format(n='f1', src='f0')}, {_VOTE.format(n='f2', src='f1')}, {_VOTE.format(n='f3', src='f2')}, sets AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3), nsc AS (SELECT anc AS node, sum(cost) / (count(*) - 1) AS score FROM up JOIN sets USING (node) GROUP BY 1 HAVING count(*) > 1)"


def _sets(spark, d):
    t, up = _tree(spark, d)
    up = graph.saved(up)  # read once for each level
    return t, up, trees.fitch_sets(t, b.tip_levels(spark, d), up)


@query(f"WITH RECURSIVE {FITCH} SELECT node, array_to_string(labels, ',') AS labels, cost::BIGINT AS cost FROM sets")
def fitch_sets(spark, d):
    return _sets(spark, d)[2].select("node", F.array_join("labels", ",").alias("labels"), "cost")


@query(f"WITH RECURSIVE {FITCH} SELECT node, round(score, 6) AS score FROM nsc")
def fitch_node_scores(spark, d):
    _, up, sets = _sets(spark, d)
    return r6(trees.node_scores(sets, up))


@query(f"WITH RECURSIVE {FITCH} SELECT up.node, round(avg(score), 6) AS plasticity FROM up JOIN tip USING (node) JOIN nsc ON nsc.node = up.anc WHERE hops > 0 GROUP BY 1")
def plasticity(spark, d):
    t, up, sets = _sets(spark, d)
    return r6(trees.plasticity(t, trees.node_scores(sets, up), up))


@query(f"WITH RECURSIVE {FITCH} SELECT sum(cost)::BIGINT AS score FROM sets")
def fitch_parsimony(spark, d):
    t, up, sets = _sets(spark, d)
    return trees.parsimony(t, trees.fitch_assignment(t, sets, up))


# --- trajectories

EDGES = "ed AS (SELECT * FROM (VALUES ('m0', 'm1', 2.0::DOUBLE), ('m1', 'm2', 1.0), ('m1', 'm3', 3.0), ('m3', 'm4', 1.5)) t(a, b, length))"
PROG = f"""{EDGES}, raw AS (SELECT c_custkey AS cell, ['m0', 'm1', 'm1', 'm3', 'm2'][c_custkey % 5 + 1] AS a, ['m1', 'm2', 'm3', 'm4', 'm1'][c_custkey % 5 + 1] AS b, abs(round(c_acctbal, 0))::BIGINT % 100 / 100.0::DOUBLE AS position FROM customer),
    pg AS (SELECT cell, CASE WHEN a = 'm2' THEN 'm1' ELSE a END AS a, CASE WHEN a = 'm2' THEN 'm2' ELSE b END AS b, CASE WHEN a = 'm2' THEN 1 - position ELSE position END AS position FROM raw)"""


def _progress(spark, d):
    return trajectory.validated(b.milestones(spark), b.progressions(spark, d))


@query(f"WITH {PROG} SELECT cell, a || '->' || b AS edge, 'Position: ' || a || '->' || b AS var, round(position, 6) AS position FROM pg")
def traj_meta(spark, d):
    return r6(trajectory.metadata(_progress(spark, d)))


PATHS = "bo AS (SELECT a, b, length FROM ed UNION ALL SELECT b, a, length FROM ed), wk(a, b, len, hop) AS (SELECT DISTINCT a, a, 0.0::DOUBLE, 0 FROM bo UNION ALL SELECT wk.a, bo.b, wk.len + bo.length, hop + 1 FROM wk JOIN bo ON bo.a = wk.b WHERE hop < 4), pt AS (SELECT a AS im, b AS m, min(len) AS path FROM wk GROUP BY 1, 2)"
TRAJ = f"""{PROG}, {PATHS}, en AS (SELECT cell, a, b, position, length, a AS m, position * length AS off FROM pg JOIN ed USING (a, b) UNION ALL SELECT cell, a, b, position, length, b, (1 - position) * length FROM pg JOIN ed USING (a, b)),
    ds AS (SELECT x.cell AS i, y.cell AS j, min(CASE WHEN x.a = y.a AND x.b = y.b THEN abs(x.position - y.position) * y.length ELSE x.off + path + y.off END) AS dist FROM en x JOIN pt ON pt.im = x.m JOIN en y ON y.m = pt.m AND y.cell <> x.cell WHERE x.cell % 50 = 0 GROUP BY 1, 2)"""


def _asked(spark, d):
    return b.table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("cell"))


@query(f"WITH RECURSIVE {TRAJ} SELECT i, j, round(dist, 6) AS dist FROM ds")
def traj_distances(spark, d):
    found = trajectory.distances(b.milestones(spark), _progress(spark, d), _asked(spark, d))
    # F.round goes through decimals, which takes longer than all else for a pair
    return found.select("i", "j", (F.floor(F.col("dist") * 1e6 + 0.5) / 1e6).alias("dist"))


@query(f"WITH RECURSIVE {TRAJ} SELECT i, j, rank, dist FROM (SELECT i, j, round(dist, 6) AS dist, row_number() OVER (PARTITION BY i ORDER BY round(dist, 6), j) AS rank FROM ds) WHERE rank <= 5")
def traj_knn(spark, d):
    return r6(trajectory.knn(b.milestones(spark), _progress(spark, d), 5, _asked(spark, d)).withColumn("rank", F.col("rank").cast("long")))


# --- latent space


@query("WITH v AS (SELECT vec_id AS id, k, embedding[k]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k)) SELECT 'd' || (w.k - 1) AS feature, CAST(v.k AS INT) AS comp, round(coalesce(corr(w.x, v.x), 0), 6) + 0.0 AS r FROM v JOIN v w USING (id) GROUP BY v.k, w.k")
def lc_pearson(spark, d):
    lat = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding")).select("id", (F.col("pos") + 1).alias("comp"), F.col("col").cast("double").alias("coord"))
    return r6(latent.correlations(b.latent_values(spark, d), lat))


@query()
def pca_scores(spark, d):
    e = log_expr(spark, d)
    return r6(latent.pca(e, matrix.filter_fano(e, 0.5), 10)[0])


@query()
def layout_mds(spark, d):
    return latent.layout(b.latent(spark, d), "mds", 400)


@query()
def layout_tsne30(spark, d):
    return latent.layout(b.latent(spark, d), "tsne30", 300)


@query()
def layout_ica(spark, d):
    return latent.layout(b.latent(spark, d), "ica", 400)


@query()
def layout_rbf(spark, d):
    return latent.layout(b.latent(spark, d), "rbf", 400)


# --- what a report asks for


@query(f"WITH {LOG}, m AS (SELECT gene, c_mktsegment AS level, sum(x) AS s FROM lx JOIN customer ON c_custkey = cell GROUP BY 1, 2), z AS (SELECT c_mktsegment AS level, count(*) AS n FROM customer WHERE c_custkey IN (SELECT cell FROM expr) GROUP BY 1), a AS (SELECT gene, level, s / n AS mean FROM m JOIN z USING (level)) SELECT gene, level, round(mean, 6) AS mean, round((mean - avg(mean) OVER g) / stddev_samp(mean) OVER g, 6) + 0.0 AS z FROM a WINDOW g AS (PARTITION BY gene)")
def sig_expression_heatmap(spark, d):
    own = analysis.Dataset(b.expr(spark, d), b.genes(spark, d).select(F.lit("all").alias("sig"), "gene", F.lit(1.0).alias("sign")), factors=b.factor(spark, d))
    return r6(report.signature_expression(own, "all", "segment"))


@query(f"WITH {NUMBERS} SELECT feature, round(min(value), 6) AS least, round(median(value), 6) AS mid, round(max(value), 6) AS most FROM num WHERE pool = 3 GROUP BY 1")
def cells_meta_summary(spark, d):
    return r6(report.selection_numbers(analysis.Dataset(b.expr(spark, d), numbers=b.numbers(spark, d)), b.pools(spark, d).where("pool = 3")))


@query("WITH s AS (SELECT c_nationkey AS pool, c_mktsegment, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS p FROM customer GROUP BY 1, 2) SELECT pool, 'segment' AS var, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM s GROUP BY 1")
def cells_entropy(spark, d):
    s = matrix.pool_shares(b.factor(spark, d).where("var = 'segment'").withColumnRenamed("id", "cell"), b.pools(spark, d))
    return r6(s.groupBy("pool", "var").agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id AS cell, event_type AS gene, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2, 3")
def event_counts(spark, d):
    return ingest.windowed_counts(b.table(spark, d, "events"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature scores with column z-normalisation: the engine's core query."""
    return QUERIES["sig_scores_znorm"](spark, sf_dir)
