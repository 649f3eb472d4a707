"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A token budget flows down the tree domain > language > source.  At each level the children of a node share its
budget in proportion to their weights; a child whose whole subtree has too few tokens (at ``max_epochs`` passes)
keeps what it has and its shortage goes to its siblings, so it reaches the ancestors' siblings only when all
siblings are full.  A leaf then takes whole epochs and the token-prefix of one more epoch in seeded order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signascope.llm.common import materialise

#: Whole-number weights of languages; others, and null, weigh 1.
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
DOMAIN_WEIGHTS = {"d0": 1, "d1": 2, "d2": 3, "d3": 4}
N_TOKENS = r"[^ \t\n\r]+"
LEVELS = ("domain", "lang", "source")
HEX = 2


def weight_of(col: Column, weights: dict[str, int]) -> Column:
    """The weight of a value as a whole number; 1 where none is given."""
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(col == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def domain_of(source: Column) -> Column:
    """A source's domain: its number modulo 4 (``d0`` to ``d3``); sources without a number are ``d0``."""
    digits = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.when(F.coalesce(digits, F.lit("")) == "", F.lit(0)).otherwise(digits.cast("long")) % 4).cast("string"))


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Water-filling: adds ``got`` to nodes (w, cap, budget), siblings being the rows that agree on ``parent``.

    Every child gets min(cap, floor(level * w)) for the one level at which the parent's budget is used up.
    """
    rank = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), *LEVELS[: len(parent) + 1])
    group = Window.partitionBy(*parent)
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({"_c": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_w": F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    nodes = nodes.withColumn("_full", F.col("_c") + F.floor(F.col("cap") * F.col("_w") / F.col("w")) <= F.col("budget"))
    #: the first child that is not full sets the level of all after it
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("cap") / F.col("w"), (F.col("budget") - F.col("_c")) / F.col("_w")))).over(group)["col2"]
    got = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(level * F.col("w"))))
    return nodes.withColumn("got", F.when(F.col("_full"), F.col("cap")).otherwise(got).cast("long")).drop("_c", "_w", "_full")


def leaf_budgets(leaves: DataFrame, budget_pct: int, max_epochs: int) -> DataFrame:
    """Adds ``got`` (tokens to take) to leaves (domain, lang, source, tokens, w_domain, w_lang, w_source)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * budget_pct / 100).cast("long").alias("budget"))
    nodes = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("w")).join(total)
    given = share(nodes, []).select("domain", F.col("got").alias("budget"))
    nodes = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("w")).join(given, "domain")
    given = share(nodes, ["domain"]).select("domain", "lang", F.col("got").alias("budget"))
    nodes = leaves.select("domain", "lang", "source", "tokens", "cap", F.col("w_source").alias("w")).join(given, ["domain", "lang"])
    return share(nodes, ["domain", "lang"]).select(*LEVELS, "tokens", "got")


def mix(docs: DataFrame, budget_pct: int = 60, max_epochs: int = 2, seed: str = "mix", domain_weights: dict | None = None, lang_weights: dict | None = None, source_weights: dict | None = None, refinements: int = 2) -> DataFrame:
    """Rows of ``docs`` that the mixture takes, with ``n_tokens`` and ``copies`` (epochs that hold the row).

    Tokens are runs of characters other than blank, tab and line ends; null text has none.  Null lang or
    source is the leaf "".  The order of an epoch is md5(seed:epoch:doc_id:text digest), then doc_id, so ties
    are rows that do not differ.  A row without tokens is taken where its place in the order is.  The last
    document that would pass a leaf's budget is left out, so a leaf stays under it by less than a document.
    Columns of ``docs`` named ``n_tokens`` or ``copies`` give way to the mixture's.  An empty table, or no tokens at all, gives no budget: only rows without tokens at the front are taken.
    """
    domain_weights = DOMAIN_WEIGHTS if domain_weights is None else domain_weights
    lang_weights = LANG_WEIGHTS if lang_weights is None else lang_weights
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        domain_of(F.coalesce(docs["source"], F.lit(""))).alias("domain"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["source"], F.lit("")).alias("source"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)).alias("id"), F.coalesce(F.regexp_count(docs["text"], F.lit(N_TOKENS)), F.lit(0)).cast("long").alias("n_tokens"),
        F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("digest"),
    )
    slim = materialise(rows.drop("row"), "mix")  # texts are read twice in all: here, and where rows are taken
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaves.withColumns({"w_domain": weight_of(F.col("domain"), domain_weights), "w_lang": weight_of(F.col("lang"), lang_weights), "w_source": weight_of(F.col("source"), source_weights or {})})
    plan = leaf_budgets(leaves, budget_pct, max_epochs)
    plan = plan.select(*LEVELS, F.when(F.col("tokens") > 0, F.floor(F.col("got") / F.col("tokens"))).otherwise(0).cast("long").alias("whole"), F.when(F.col("tokens") > 0, F.col("got") % F.col("tokens")).otherwise(0).alias("rest"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.col("id").cast("string"), F.col("digest")).cast("binary"))
    plan = _small(materialise(plan, "mix"))
    keyed = [x.join(plan, list(LEVELS)).withColumn("key", key).drop("digest") for x in (rows, slim)]
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("n_tokens", "copies")]
    return _take(*keyed, refinements).select(*own, "n_tokens", "copies")


def _small(leaves: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of a row for each leaf, sent to every task where it is known to be small; so hot leaves deal out no rows."""
    return F.broadcast(leaves) if leaves.count() <= most else leaves


def _take(rows: DataFrame, counted: DataFrame, refinements: int) -> DataFrame:
    """The prefix of each leaf in key order that holds ``rest`` tokens; ``counted``: the rows without their data.

    Hot leaves never meet in one task: token counts by leading hex digits of the key find the digits at which
    the budget runs out, twice over, and only rows under those digits are ordered one by one.
    """
    leaf, cuts = [*LEVELS], []
    counted = counted.select(*leaf, "key", "n_tokens", "rest")
    for step in range(refinements):
        digits = [F.substring("key", 1, HEX * step), F.substring("key", HEX * step + 1, HEX)]
        inner = counted if not cuts else counted.join(cuts[-1], leaf).where(digits[0] == F.col("edge")).select(*leaf, "key", "n_tokens", F.col("left").alias("rest"))
        slots = inner.groupBy(*leaf, digits[0].alias("edge"), digits[1].alias("slot")).agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
        upto = F.sum("t").over(Window.partitionBy(*leaf).orderBy("slot"))
        over = slots.withColumn("upto", upto).where("upto > rest")
        first = over.groupBy(*leaf).agg(F.min(F.struct("slot", "edge", (F.col("rest") - F.col("upto") + F.col("t")).alias("left"))).alias("m"))
        cuts.append(_small(materialise(first.select(*leaf, F.concat("m.edge", "m.slot").alias("edge"), F.col("m.left").alias("left")), "mix")))
    # a leaf without a cut at a level takes all that the level before left open
    for k, c in enumerate(cuts):
        rows = rows.join(c.select(*leaf, F.col("edge").alias(f"edge{k}"), F.col("left").alias(f"left{k}")), leaf, "left")
    last = len(cuts) - 1
    state = F.lit(1)  # 1: in, 0: out, null: ordered one by one
    for k in reversed(range(len(cuts))):
        own = F.substring("key", 1, HEX * (k + 1))
        inside = state if k < last else F.lit(None).cast("int")
        state = F.when(F.col(f"edge{k}").isNull() | (own < F.col(f"edge{k}")), 1).when(own > F.col(f"edge{k}"), 0).otherwise(inside)
    rows = rows.withColumn("state", state)
    sure = rows.where("state is not null").withColumn("copies", F.col("whole") + F.col("state"))
    order = Window.partitionBy(*leaf).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("state is null").withColumn("copies", F.col("whole") + (F.sum("n_tokens").over(order) <= F.col(f"left{last}")).cast("long"))
    cols = ["row", "n_tokens", "copies"]
    return reduce(DataFrame.unionByName, [sure.select(*cols), edge.select(*cols)]).where("copies > 0")
