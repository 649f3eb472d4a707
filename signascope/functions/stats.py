"""Statistical functions as Spark columns: normal, chi-square and hypergeometric tails, ranks, Benjamini-Hochberg.

Functions that end in ``_sql`` return an expression in SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signascope.functions.tables import saved

# Coefficients of the double precision rational approximation of the normal distribution (Hart 1968, West 2005).
NORMAL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients: Sequence[float], x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def normal_sql(x: str) -> str:
    """P(Z <= x) of the standard normal distribution."""
    a = f"abs({x})"
    near = f"exp(-({x}) * ({x}) / 2) * {_horner(NORMAL_TOP, a)} / {_horner(NORMAL_BOTTOM, a)}"
    far = f"exp(-({x}) * ({x}) / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65e0))))) / 2.506628274631e0"
    low = f"(CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN ({x}) > 0 THEN 1 - {low} ELSE {low} END)"


def normal(x: str) -> Column:
    """P(Z <= x); ``x`` is a column's name or an SQL expression."""
    return F.expr(normal_sql(x))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X >= x) of chi-square with a whole number ``df`` of degrees of freedom; null where df < 1."""
    half = F.greatest(x, F.lit(0.0)) / 2
    even = df % 2 == 0
    start = F.when(even, F.exp(-half)).otherwise(F.exp(-half) * F.sqrt(half) * 1.1283791670955126)
    steps = F.when(even, (df / 2).cast("int") - 1).otherwise(((df - 1) / 2).cast("int") - 1)
    shift = F.when(even, F.lit(0.0)).otherwise(F.lit(0.5))
    first = F.struct(start.alias("t"), start.alias("s"))

    def grow(acc, i):
        t = acc["t"] * half / (i + shift)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    series = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), first, grow)["s"]
    root = F.sqrt(F.greatest(x, F.lit(0.0)))
    tail = 2 * _normal_column(-root)
    return F.when(df < 1, None).when(even, series).when(df == 1, tail).otherwise(tail + series)


def _normal_column(x: Column) -> Column:
    name = "_normal_argument"
    return F.transform(F.array(x), lambda v: _normal_of(v))[0].alias(name)


def _normal_of(x: Column) -> Column:
    a = F.abs(x)

    def poly(cs):
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * a + c
        return out

    near = F.exp(-x * x / 2) * poly(NORMAL_TOP) / poly(NORMAL_BOTTOM)
    far = F.exp(-x * x / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    low = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - low).otherwise(low)


def _log_factorial(n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), n.cast("int")), F.lit(0.0), lambda a, i: a + F.log(i)))


def hypergeometric_tail(o: Column, m: Column, k: Column, n: Column) -> Column:
    """P(overlap >= o) when k of n are drawn and m of n are marked; the first term by logarithms, the rest by ratios."""
    top, low = F.least(m, k).cast("int"), F.greatest(o, m + k - n, F.lit(0)).cast("int")
    lf = _log_factorial
    start = F.exp(lf(m) - lf(low) - lf(m - low) + lf(n - m) - lf(k - low) - lf(n - m - k + low) - lf(n) + lf(k) + lf(n - k))
    first = F.struct(start.alias("t"), start.alias("s"))

    def grow(acc, i):
        t = acc["t"] * (m - i + 1) * (k - i + 1) / (i * (n - m - k + i))
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    more = F.aggregate(F.when(low < top, F.sequence(low + 1, top)).otherwise(F.array().cast("array<int>")), first, grow)["s"]
    return F.when(o > top, 0.0).otherwise(F.least(F.lit(1.0), more))


def running_sum(counts: DataFrame, by: Sequence[str], value: str, weight: str, name: str, parts: int = 64) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of a ``by`` group up to and with this one in the order of ``value``, which no two of them share.

    A group is cut into ``parts`` ranges of about equal numbers of values; each range is added up by itself, from what the ranges before it
    hold, so a group of any number of values is the work of many tasks.  Where the cuts fall does not change a sum.
    """
    # written, because a second computation could cut elsewhere
    cuts = saved(counts.groupBy(*by).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("_cuts")))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    ranged = counts.join(cuts, list(by)).withColumn("_part", part).drop("_cuts")
    sizes = ranged.groupBy(*by, "_part").agg(F.sum(weight).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(*by, "_part", F.coalesce(ahead, F.lit(0)).alias("_before"))
    upto = F.sum(weight).over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_upto", upto).join(before, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_upto")).drop("_part", "_upto", "_before")


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str = "rank", parts: int = 64) -> DataFrame:
    """Adds ``name``: the rank of ``value`` within ``by``, ties sharing the mean of their places.

    Ranks come from counts of distinct values, so ties (however many) never meet in one task row by row, and from sums over
    ranges of these (:func:`running_sum`), so neither do the values of one group.
    """
    # the counts' shuffle is made once and read by all that sums need
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    ranks = running_sum(counts, by, value, "_ties", "_all", parts).select(*by, value, (F.col("_all") - (F.col("_ties") - 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def bh(df: DataFrame, p: str = "p", by: Sequence[str] = (), tie: Sequence[str] = (), name: str = "fdr") -> DataFrame:
    """Adds the Benjamini-Hochberg adjusted p-value within ``by``: the running minimum of p n / rank, at most 1."""
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy(p, *tie))
    raw = F.col(p) * F.count(p).over(group) / place
    df = df.withColumns({"_raw": raw, "_place": place})
    down = group.orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw", "_place")
