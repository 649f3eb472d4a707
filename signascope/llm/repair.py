"""Repair of conversations by generalised LR parsing of their roles, with weighted delete, rerole and insert actions.

A conversation's role initials have to form ``(s?(ua)+)?``: nothing, or pairs of user and assistant after at most one
system turn.  A graph-structured stack holds every way to read the rows so far; where the tops of two stacks are equal,
what may follow them is equal too, and the one of least (cost, audit) goes on.

The rows reach the parser as one character each, so a conversation of any length is a string as long as its audit.
Repeated rows are counted where they are read, and rows equal in conversation, turn, role and text travel as one row.
The texts are shuffled once, to be hashed or returned in order, and stream through a task one at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signascope.llm.common import materialise

#: Costs of the edits, and of a truncated row that stays.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Turns of a conversation that are put in order together.
BLOCK = 4096

# The LR(0) automaton of C -> (nothing) | B | s B,  B -> P | B P,  P -> u a.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (5, "u"): 2, (2, "a"): 6}
REDUCE = {4: ("B", 1), 6: ("P", 2), 7: ("B", 2)}
GOTO = {(0, "P"): 4, (1, "P"): 4, (3, "P"): 7, (5, "P"): 7, (0, "B"): 3, (1, "B"): 5}
ACCEPT = (0, 3, 5)


@functools.cache
def shift(stack: tuple, terminal: str):
    """The stack (state, stack below) after ``terminal`` and all reductions, or None."""
    state = SHIFT.get((stack[0], terminal))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        symbol, length = REDUCE[stack[0]]
        for _ in range(length):
            stack = stack[1]
        stack = (GOTO[stack[0], symbol], stack)
    return stack


def _better(tops: dict, stack: tuple, cost: int, audit: str) -> bool:
    old = tops.get(stack[0])
    if old is None or (cost, audit) < old[:2]:
        tops[stack[0]] = (cost, audit, stack)
        return True
    return False


def _inserted(tops: dict) -> dict:
    """``tops`` and what inserted rows make of them."""
    todo = list(tops.values())
    while todo:
        cost, audit, stack = todo.pop()
        if tops[stack[0]][:2] != (cost, audit):
            continue
        for terminal in "ua":
            after = shift(stack, terminal)
            if after and _better(tops, after, cost + COST["I"], audit + "I"):
                todo.append(tops[after[0]])
    return tops


@functools.lru_cache(maxsize=1 << 14)
def parse(rows: str) -> tuple[int, str]:
    """Least cost and its ASCII-least audit.

    A row is one character: ``-`` has to go, ``s``, ``u`` and ``a`` are sound rows of these initials and ``x`` one of
    another, ``S``, ``U``, ``A`` and ``X`` truncated ones.
    """
    tops = {0: (0, "", (0, None))}
    for row in rows:
        kind, extra = row.lower(), TRUNCATED * row.isupper()
        after: dict = {}
        for cost, audit, stack in _inserted(tops).values():
            _better(after, stack, cost + COST["D"], audit + "D")
            if kind == "-":
                continue
            if kind in ROLES and (kept := shift(stack, kind)):
                _better(after, kept, cost + COST["K"] + extra, audit + "K")
            for terminal in "ua":
                if terminal != kind and (moved := shift(stack, terminal)):
                    _better(after, moved, cost + COST["R"] + extra, audit + "R")
        tops = after
    return min(x[:2] for k, x in _inserted(tops).items() if k in ACCEPT)


def roles_of(rows: str, audit: str) -> list[tuple[str, int | None]]:
    """(role initial, row) of each row after the edits of ``audit``; inserted ones have no row, kept ones no new role."""
    out, stack, k = [], (0, None), 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        at = None if edit == "I" else k
        k += edit != "I"
        kind = rows[at].lower() if edit == "K" else next(t for t in "ua" if shift(stack, t) and (edit == "I" or t != rows[at].lower()))
        stack = shift(stack, kind)
        out.append(("" if edit == "K" else kind, at))
    return out


def _nonnull(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``n``: how often each row is there after damage (0: dropped).

    Damage goes by ``crc32(conv_id:turn) % 20``, nulls in any column count as one space: 0 drops the row, 1 empties its
    text, 2 takes ``[.!?]`` out of it, 3 repeats the row, 4 makes it the user's.
    """
    kind = F.crc32(F.concat_ws(":", _nonnull("conv_id"), _nonnull("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_nonnull("text"), "[.!?]", "")).otherwise(_nonnull("text"))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(_nonnull("role")).alias("role"), text.alias("text"), n.cast("long").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``key`` tells conversations apart, a null id too; ``digest`` stands for role and text."""
    key = F.concat(F.when(F.col("conv_id").isNull(), "0").otherwise("1"), _nonnull("conv_id"))
    return rows.withColumns({"key": key, "digest": F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text").cast("binary"))})


def _order(rows: DataFrame):
    """Turns, nulls first; what has one turn by role and text digest."""
    turn = F.struct(F.col("turn").isNotNull(), "turn", "role", "digest")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK) + 1, F.lit(-(1 << 62)))
    return rows.withColumns({"at": turn, "block": block})


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (as :func:`damaged` returns them): its rows' characters, faults and edits.

    key, conv_id, codes (a character a row in order, as :func:`parse` takes them), gaps, blank, duplicate, truncated,
    illegal, cost, audit.
    """
    space = "[^\\x20\\x09-\\x0D]"
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    fault = F.when(~F.col("text").rlike(space), "b").when(~last.isin(".", "!", "?"), "t").otherwise("")
    light = _order(_keyed(rows)).select("key", "conv_id", "block", "at", "turn", "role", "digest", "n", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    same = light.groupBy("key", "block", "at").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("role").alias("role"), F.first("digest").alias("digest"), F.sum("n").alias("n"), F.first("fault").alias("fault"), F.first("initial").alias("initial"))
    # a role and text is seen first at its least place
    first = same.where("n > 0").groupBy("key", "digest").agg(F.min("at").alias("first_at"))
    seen = same.join(first, ["key", "digest"], "left")
    sound = F.when(F.col("initial").isin(*ROLES), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault") == "t", F.upper(sound)).otherwise(sound)
    head = F.when(F.col("fault") == "b", "b").when(F.col("at") == F.col("first_at"), code).otherwise("d")
    again = F.when(F.col("fault") == "b", "b").otherwise("d")
    marked = seen.select(
        "key", "conv_id", "block", "at", "turn", "n",
        F.when(F.col("n") > 0, F.concat(head, F.repeat(again, (F.col("n") - 1).cast("int")))).otherwise("").alias("marks"),
        F.when(F.col("n") > 0, F.repeat(sound, F.col("n").cast("int"))).otherwise("").alias("initials"),
    )
    there = F.when(F.col("n") > 0, F.col("turn"))
    blocks = marked.groupBy("key", "block").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("at", "marks", "initials"))).alias("rows"),
        F.min(there).alias("low"), F.max(there).alias("high"), F.size(F.collect_set(there)).alias("turns"),
    )
    blocks = blocks.select("key", "conv_id", "block", *[F.concat_ws("", f"rows.{c}").alias(c) for c in ("marks", "initials")], "low", "high", "turns")
    whole = blocks.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("block", "marks", "initials"))).alias("rows"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
    )
    whole = whole.select("key", "conv_id", "gaps", *[F.concat_ws("", f"rows.{c}").alias(c) for c in ("marks", "initials")])

    @F.pandas_udf("codes string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")
    def repaired(marks: pd.Series, initials: pd.Series) -> pd.DataFrame:
        out = []
        for m, i in zip(marks, initials):
            codes = m.replace("b", "-").replace("d", "-")
            cost, audit = parse(codes)
            legal = sum(map({"su", "ua", "au"}.__contains__, map("".join, zip(i, i[1:]))))
            out.append((codes, m.count("b"), m.count("d"), sum(map(m.count, "SUAX")), max(0, len(i) - 1) - legal, cost, audit))
        return pd.DataFrame(out, columns=["codes", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return whole.withColumn("r", repaired("marks", "initials")).select("key", "conv_id", "gaps", "r.*")


def _streams(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's plan and then its rows in order, in one task and next to each other."""
    rows = _order(_keyed(rows.where("n > 0"))).select("key", "conv_id", F.lit(1).alias("part"), "at", "role", "text", F.lit("").alias("audit"), "n")
    head = plan.select("key", "conv_id", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["at"].dataType).alias("at"), F.lit("").alias("role"), F.col("codes").alias("text"), "audit", F.lit(1).cast("long").alias("n"))
    both = head.unionByName(rows).repartition("key").sortWithinPartitions("key", "part", "at")
    return both.select("key", "conv_id", "part", "role", "text", "audit", "n")


def _lines(batches):
    """(key, conv_id, what) in order: what is None for a new conversation, then (position, edit, role, text) of its repaired rows."""
    edits, row, place, key, conv = [], 0, 0, None, None

    def due(text=None, role=None):
        """What the edits up to the next row of the table make, and that row."""
        nonlocal place
        while edits and (text is not None or edits[-1][1] is None):
            initial, at = edits[-1]
            if at is not None and at > row:
                return
            edits.pop()
            if at is None:
                yield place, "I", ROLES[initial], ""
            else:
                yield place, "R" if initial else "K", ROLES[initial] if initial else role, text
            place += 1
            if at is not None:
                return

    for b in batches:
        for k, c, part, role, text, audit, n in zip(*[b.column(i).to_pylist() for i in range(7)]):
            if not part:
                for x in due():
                    yield key, conv, x
                key, conv, edits, row, place = k, c, roles_of(text, audit)[::-1], 0, 0
                yield key, conv, None
                continue
            for _ in range(n):
                for x in due(text, role):
                    yield key, conv, x
                row += 1
    for x in due():
        yield key, conv, x


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, repaired_sha256): of a conversation's repaired ``role:text`` lines.  A text is hashed as it goes by."""

    def task(batches):
        made, own, key = [], None, None
        for k, _, line in _lines(batches):
            if line is None:
                if own:
                    made.append((key, own.hexdigest()))
                own, key = hashlib.sha256(), k
            else:
                own.update(f"{chr(10) if line[0] else ''}{line[2]}:{line[3]}".encode())
            if len(made) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*made)], ["key", "repaired_sha256"])
                made = []
        if own:
            made.append((key, own.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*made)], ["key", "repaired_sha256"])

    return _streams(rows, plan).mapInArrow(task, "key string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """The rows after repair: conv_id, position (from 0), edit (K, R or I), role, text.  Nothing for conversations without rows."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def task(batches):
        lines = ((c, *x) for _, c, x in _lines(batches) if x)
        while some := list(itertools.islice(lines, 256)):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in some], to_arrow_schema(schema))

    return _streams(rows, plans(rows)).mapInArrow(task, schema)


def report(conversations: DataFrame) -> DataFrame:
    """Damage, faults, cheapest repair and its digest for every conv_id of ``conversations`` (conv_id, turn, role, text).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  Null conv_ids are one
    conversation.  Rows of one turn stand in the order of role and text digest; rows equal in all four columns are next
    to each other and all but the first are duplicates.  A conversation without rows after damage has zeros, an empty audit and the
    digest of an empty string; an empty table gives no rows.  Other columns are not read.
    """
    rows = damaged(conversations)
    plan = materialise(plans(rows), "repair")
    return plan.join(digests(rows, plan), "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
