"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if some string of ``LENGTH`` bytes that covers it starts anywhere else too, in the same or another text.

* Buckets.  Every window of ``LENGTH`` bytes has an anchor: the smallest hash among its ``GRAM``-byte strings (the
  first of equals).  Equal windows have equal anchors at equal places, so only suffixes whose anchor's string occurs
  again can repeat, and only within the anchor's bucket.  All others are never sorted or shuffled; no repeat is lost.
* Blocks.  Buckets are dealt out, and a task sorts a block of them at a time.  Places that are multiples of ``COVER``
  from the anchor are the cover sample.  Sample suffixes get ranks by prefix doubling; any other suffix is
  compared by the bytes up to its next sample place, that sample's rank, and the bytes after the ranked stretch.
  So ties of any length cost a look-up, and memory is bounded by the block.
* A bucket of more than ``BUCKET`` rows is refined before it is sorted, as is usual for large suffix buckets: equal
  contexts become one row with their places, and the rest is dealt by the cover sample that the windows of a piece share,
  ``COVER`` windows to a piece, then half as many while a piece's bucket is still too large.  A bucket in which all rows are
  equal, or a piece of one window, needs no sorting.  So no task holds more than a block, and a row becomes about ten.
* Equal texts are one text; where there are two, everything that a window covers goes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.llm.common import materialise, slices

LENGTH, GRAM, COVER, BUCKET, BLOCK = 400, 144, 32, 1000, 4000
REACH = LENGTH - GRAM + 1  # places at which an anchor can stand in a window
WIDTH = REACH - 1 + LENGTH
PIECE = 1 << 21
SENT = 64 << 20  # bytes that may go to every task
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place, by doubling."""
    h, width, parts, at = (data.astype(np.uint64) + np.uint64(1)) * _M1, 1, [], 0
    while True:
        if GRAM & width:
            parts.append((h, at))
            at += width
        if width * 2 > GRAM:
            break
        x = h[: len(h) - width] * _M2
        x ^= x >> np.uint64(29)
        x += h[width:]
        x *= _M1
        x ^= x >> np.uint64(32)
        h, width = x, width * 2
    n = len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for h, at in parts:
        out = (out ^ h[at : at + n]) * _M1
        out ^= out >> np.uint64(31)
    return out


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Best of each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x = best(x[: len(x) - span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash by place, smallest hash by window, places of anchors); a window spans no two owners (its minimum is 0)."""
    n = len(data) - LENGTH + 1
    h = _gram_hashes(data)
    low = _sliding(h, REACH, np.minimum)
    low[owner[:n] != owner[LENGTH - 1 :]] = 0
    padded = np.zeros(n + 2 * (REACH - 1), np.uint64)
    padded[REACH - 1 : REACH - 1 + n] = low
    high = _sliding(padded, REACH, np.maximum)
    return h, low, np.flatnonzero(high >= h)


def _pieces(column: pa.Array):
    """(bytes, owner by byte, [(row, first byte in text, place in bytes)]) of about ``PIECE`` bytes each.

    A long text is cut so that every window lies in exactly one piece.
    """
    col = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    held, size = [], 0

    def built():
        lens = np.array([y - x for _, x, y, _ in held])
        place = np.cumsum(lens) - lens
        return np.concatenate([data[x:y] for _, x, y, _ in held]), np.repeat(np.arange(len(held)), lens), [(r, f, p) for (r, _, _, f), p in zip(held, place.tolist())]

    for row in range(len(col)):
        x, y = int(ends[row]), int(ends[row + 1])
        for a in range(x, max(x + 1, y - LENGTH + 1), PIECE):
            b = min(y, a + PIECE + LENGTH - 1)
            if b - a < LENGTH:
                continue
            held.append((row, a, b, a - x))
            size += b - a
            if size >= PIECE:
                yield built()
                held, size = [], 0
    if held:
        yield built()


def _anchor_rows(batches):
    """(id, h, key, pos): the places in a text of each anchor's string."""
    for b in batches:
        for data, owner, items in _pieces(b.column("text")):
            h, _, at = anchors(data, owner)
            if not len(at):
                continue
            row, first, place = (np.array(x, np.int64) for x in zip(*items))
            who, key = owner[at], h[at].view(np.int64)
            pos = at - place[who] + first[who]
            order = np.lexsort((pos, key, who))
            who, key, pos = who[order], key[order], pos[order]
            cut = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (key[1:] != key[:-1])))
            rows = pa.array(row[who[cut]])
            yield pa.record_batch(
                [b.column("id").take(rows), b.column("h").take(rows), pa.array(key[cut]), pa.ListArray.from_arrays(pa.array(np.append(cut, len(pos)).astype(np.int32)), pa.array(pos))],
                names=["id", "h", "key", "pos"],
            )


def _context_rows(batches):
    """For each wanted anchor the windows it owns: (key, large, id, h, starts, at, n, ctx).

    In a text, equal windows of anchors with large buckets are one row with all their starts.
    """
    for b in batches:
        wants = [(np.array(p), np.array(x)) for p, x in zip(b.column("pos").to_pylist(), b.column("large").to_pylist())]
        for data, owner, items in _pieces(b.column("text")):
            h, low, _ = anchors(data, owner)
            out = []
            for row, first, place in items:
                pos, hot = wants[row]
                at = pos - first + place
                ok = (pos >= first) & (at < len(h))
                at, hot = at[ok], hot[ok]
                inside = owner[at] == owner[place] if len(at) else np.zeros(0, bool)
                at, hot = at[inside], hot[inside]
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hot = at[order], hot[order]
                last: dict[int, int] = {}
                before = np.full(len(at), -1)
                for n, (i, k) in enumerate(zip(at.tolist(), h[at].tolist())):
                    before[n] = last.get(k, -1)
                    last[k] = i
                starts = at[:, None] - (REACH - 1) + np.arange(REACH)
                good = (starts >= place) & (starts < len(low)) & (starts > before[:, None])
                good &= low[np.clip(starts, 0, len(low) - 1)] == h[at][:, None]
                same: dict[bytes, list[int]] = {}
                for n in np.flatnonzero(good.any(1)):
                    o, m = int(good[n].argmax()), int(good[n].sum())
                    s = int(starts[n, o])
                    ctx = data[s : s + m - 1 + LENGTH].tobytes()
                    if hot[n] and ctx in same:
                        same[ctx].append(s - place + first)
                        continue
                    own = [s - place + first]
                    if hot[n]:
                        same[ctx] = own
                    out.append((int(h[at[n]].view(np.int64)), bool(hot[n]), row, own, o, m, ctx))
            if out:
                key, hot, row, start, o, m, ctx = zip(*out)
                take = pa.array(row)
                yield pa.record_batch(
                    [pa.array(key, pa.int64()), pa.array(hot), b.column("id").take(take), b.column("h").take(take), pa.array(start, pa.list_(pa.int64())), pa.array(o, pa.int32()), pa.array(m, pa.int32()), pa.array(ctx, pa.binary())],
                    names=["key", "large", "id", "h", "starts", "at", "n", "ctx"],
                )


def _rank(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].reshape(x.shape).astype(np.uint64)


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _rank(x << np.uint64(32) | y)


def _sorted_lcp(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes, and how many bytes each shares with the one before it."""
    width = -(-block.shape[1] // 8) * 8
    full = np.zeros((len(block), width), np.uint8)
    full[:, : block.shape[1]] = block
    order = np.lexsort(full.view(">u8").astype(np.uint64).T[::-1])
    differ = block[order[1:]] != block[order[:-1]]
    return order, np.where(differ.any(1), differ.argmax(1), block.shape[1])


def _class(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Number of each row's class under equality of ``least`` bytes."""
    out = np.zeros(len(order), np.uint64)
    out[order[1:]] = np.cumsum(lcp < least)
    return out


def repeated(text: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which windows of anchored rows occur in another row: text is rows x ``WIDTH``, a row's own windows start at ``at``.

    The windows at each distance from the anchor are sorted by (ranked stretch, bytes before, bytes after).
    """
    hit = np.zeros((len(text), REACH), bool)
    words = np.ascontiguousarray(text[:, : WIDTH // 32 * 32]).view(">u8").astype(np.uint64)
    name = _rank(words)
    levels, size = {}, 8
    while size < COVER:  # within a sample block
        name = _paired(name[:, 0::2], name[:, 1::2])
        size *= 2
    levels[size] = name
    while size < 256:  # sample places only: their distance is COVER
        step = size // COVER
        name = _paired(name[:, :-step], name[:, step:])
        size *= 2
        levels[size] = name
    for s in range(0, REACH + COVER - 1, COVER):
        k = s // COVER
        some = np.flatnonzero((at <= s) & (at + n > s - COVER + 1))
        if len(some) < 2 or s + LENGTH - COVER + 1 > WIDTH:
            continue
        rest = _paired(levels[64][some, k + 256 // COVER], levels[32][some, k + 320 // COVER])
        mid = _paired(levels[256][some, k], rest)
        before = _sorted_lcp(text[some, s - COVER : s][:, ::-1]) if s else None
        after = _sorted_lcp(text[some, s + 352 : s + LENGTH])
        for d in range(min(COVER - 1, s) + 1):
            o = s - d
            own = np.flatnonzero((at[some] <= o) & (o < (at + n)[some]))
            if len(own) < 2:
                continue
            key = mid[own] << np.uint64(42) | _class(*after, LENGTH - 352 - d)[own]
            if d:
                key |= _class(*before, d)[own] << np.uint64(21)
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            hit[some[own[order[1:][same]]], o] = True
            hit[some[own[order[:-1][same]]], o] = True
    return hit


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def _sorted_blocks(batches):
    """Blocks of whole buckets from rows sorted by key; at most ``BLOCK`` rows and one bucket more."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("key", "id", "h", "start", "at", "n", "ctx"))):
            if held and held[-1][:4] == row[:4]:
                continue  # a repeated row of the same document
            if len(held) >= BLOCK and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sort_buckets(batches):
    for block in _sorted_blocks(batches):
        text = np.zeros((len(block), WIDTH), np.uint8)
        for r, (_, _, _, _, at, _, ctx) in enumerate(block):
            text[r, at : at + len(ctx)] = np.frombuffer(ctx, np.uint8)
        at, n = np.array([x[4] for x in block]), np.array([x[5] for x in block])
        hit = repeated(text, at, n)
        out = [(x[1], x[2], x[3] + a - x[4], x[3] + b - 1 - x[4] + LENGTH) for r, x in enumerate(block) if hit[r].any() for a, b in _runs(hit[r])]
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["id", "h", "a", "b"])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches):
    """What is left of each text: all of it without ``ranges``, nothing where it is ``gone``."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
    for b in slices(batches):
        rows = []
        for text, gone, ranges in zip(*(b.column(c).to_pylist() for c in ("text", "gone", "ranges"))):
            data = text.encode("utf-8", "surrogatepass")
            spans = [(0, len(data))] if gone else merged([(r["a"], r["b"]) for r in ranges or []])
            kept, at = hashlib.sha256(), 0
            for x, y in spans:
                kept.update(data[at:x])
                at = y
            kept.update(data[at:])
            rows.append((len(data), sum(y - x for x, y in spans), len(spans), kept.hexdigest(), [{"a": x, "b": y} for x, y in spans]))
        yield pa.record_batch([b.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _few(ids: DataFrame) -> bool:
    """Whether rows of a few numbers are within ``SENT`` bytes, at 80 bytes a row, and so may go to every task."""
    return ids.count() * 80 <= SENT


def _with_copies(slim: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows of ``slim`` whose text occurs again; no task gets all rows of one text with over ``BUCKET`` copies."""
    often = copies.where(F.col("n") > BUCKET)
    if not _few(often):
        return slim.join(copies, "m")
    alike = slim.join(F.broadcast(often), "m")
    rest = slim.join(F.broadcast(often.select("m")), "m", "left_anti")
    return alike.unionByName(rest.join(copies.where(F.col("n") <= BUCKET), "m"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges a, b that go) of every row of ``docs``.

    Null text is empty.  Texts under ``LENGTH`` bytes stay whole.  Rows with equal texts count as so many texts, whatever their
    ids, so repeated rows remove each other.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), text.alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    slim = materialise(base.where(F.octet_length("text") >= LENGTH).select("id", "h", F.md5(F.col("text").cast("binary")).alias("m")), "slim")
    copies = slim.groupBy("m").agg(F.min(F.struct("id", "h")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = materialise(_with_copies(slim, materialise(copies, "texts")).select("id", "h", ((F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h"))).alias("first")).distinct(), "copies")
    again = gone.where("not first").select("id", "h")
    found = materialise(base.select("id", "h", "text").mapInArrow(_anchor_rows, "id long, h long, key long, pos array<long>"), "anchors")
    found = found.join(F.broadcast(again) if _few(again) else again, ["id", "h"], "left_anti")
    count = materialise(found.groupBy("key").agg(F.sum(F.size("pos")).alias("c")).where("c > 1"), "anchors")
    # where keys with large buckets are few, no task gets all rows of one
    large = count.where(F.col("c") > BUCKET).select("key", F.lit(True).alias("large"))
    flagged = found.join(F.broadcast(large) if _few(large) else large, "key", "left")
    small = flagged.where("large is null").drop("large").join(count.where(F.col("c") <= BUCKET).select("key"), "key").withColumn("large", F.lit(False))
    places = F.transform("pos", lambda p: F.struct(p.alias("pos"), F.col("large").alias("large")))
    wanted = flagged.where("large").unionByName(small).groupBy("id", "h").agg(F.flatten(F.collect_list(places)).alias("w"))
    wanted = materialise(wanted.select("id", "h", F.col("w.pos").alias("pos"), F.col("w.large").alias("large")), "wanted")
    texts, ids = base.select("id", "h", "text"), wanted.select("id", "h")
    texts = (texts.join(F.broadcast(ids), ["id", "h"], "left_semi") if _few(ids) else texts).join(wanted, ["id", "h"])
    context = texts.mapInArrow(_context_rows, "key long, large boolean, id long, h long, starts array<long>, at int, n int, ctx binary")
    any_large = not wanted.where(F.exists("large", lambda x: x)).isEmpty()
    if any_large:  # read twice
        context = materialise(context, "contexts")
    cold = context.where("not large").select("key", "id", "h", F.element_at("starts", 1).alias("start"), "at", "n", "ctx").repartition("key").sortWithinPartitions("key", "id", "h", "start")
    ranges = cold.mapInArrow(_sort_buckets, "id long, h long, a long, b long").select("id", "h", F.array(F.struct("a", "b")).alias("r"))
    if any_large:
        ranges = ranges.unionByName(_refined(context.where("large")))
    ranges = ranges.join(F.broadcast(gone) if _few(gone) else gone, ["id", "h"], "left_anti").groupBy("id", "h").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    nothing = F.lit(None).cast("array<struct<a: bigint, b: bigint>>")
    marks = ranges.select("id", "h", F.lit(False).alias("gone"), "ranges").unionByName(gone.select("id", "h", F.lit(True).alias("gone"), nothing.alias("ranges")))
    return _result(base, materialise(marks, "marks"))


def _refined(context: DataFrame) -> DataFrame:
    """(id, h, r) with ranges of windows in large buckets that occur again.

    A context is one row whatever its places; one with several places goes whole.  A repeated row's contexts count once.
    """
    named = context.withColumn("c", F.md5("ctx"))
    once = materialise(named.select("c", "id", "h", "starts").distinct(), "places")
    places = once.groupBy("c").agg(F.sum(F.size("starts")).alias("m"))
    # equal contexts have one anchor, at one place
    same = materialise(named.groupBy("c").agg(*(F.any_value(x).alias(x) for x in ("key", "at", "n", "ctx"))).join(places, "c"), "same")
    hits = [same.where("m > 1").select("c", F.lit(0).cast("long").alias("a"), (F.col("n") - 1 + LENGTH).cast("long").alias("b"))]
    todo, width = same.select("c", "key", F.col("at").alias("first"), "at", "n", "ctx"), COVER
    while True:
        # the windows of a piece share the bytes from its last window's start to its first window's end
        piece = F.explode(F.sequence(F.floor(F.col("at") / width).cast("int"), F.floor((F.col("at") + F.col("n") - 1) / width).cast("int")))
        cut = todo.withColumn("p", piece).withColumn("lo", F.greatest("at", F.col("p") * width)).withColumn("hi", F.least(F.col("at") + F.col("n"), (F.col("p") + 1) * width))
        shared = F.substring("ctx", F.col("p") * width + width - F.col("at"), F.lit(LENGTH + 1 - width))
        x = F.substring("ctx", F.col("lo") - F.col("at") + 1, F.col("hi") - F.col("lo") - 1 + LENGTH)
        g = F.md5(F.concat(F.concat_ws(":", F.col("key").cast("string"), F.col("p").cast("string"), F.lit("")).cast("binary"), shared))
        cut = materialise(cut.select("c", "key", "first", "lo", (F.col("hi") - F.col("lo")).alias("k"), x.alias("x"), g.alias("g")), "pieces")
        whole = F.md5(F.concat(F.concat(F.col("lo").cast("string"), F.lit(":")).cast("binary"), F.col("x")))
        size = cut.groupBy("g").agg(F.count(F.lit(1)).alias("m"), (F.min(whole) == F.max(whole)).alias("equal")).where("m > 1")
        member = materialise(cut.join(size, "g").withColumn("start", (F.col("lo") - F.col("first")).cast("long")), "pieces")
        done = F.col("equal") | F.lit(width == 1)
        hits.append(member.where(done).select("c", F.col("start").alias("a"), (F.col("start") + F.col("k") - 1 + LENGTH).alias("b")))
        ready = member.where(~done & (F.col("m") <= BUCKET)).select(F.col("g").alias("key"), F.col("c").alias("id"), F.lit(0).alias("h"), "start", F.col("lo").alias("at"), F.col("k").alias("n"), F.col("x").alias("ctx"))
        ready = ready.repartition("key").sortWithinPartitions("key", "id", "start")
        hits.append(ready.mapInArrow(_sort_buckets, "id string, h long, a long, b long").select(F.col("id").alias("c"), "a", "b"))
        more = member.where(~done & (F.col("m") > BUCKET))
        if more.isEmpty():
            break
        todo, width = more.select("c", "key", "first", F.col("lo").alias("at"), F.col("k").alias("n"), F.col("x").alias("ctx")), width // 2
    found = reduce(DataFrame.unionByName, hits).groupBy("c").agg(F.collect_set(F.struct("a", "b")).alias("x"))
    moved = F.transform("starts", lambda s: F.transform("x", lambda x: F.struct((s + x["a"]).alias("a"), (s + x["b"]).alias("b"))))
    return once.join(found, "c").select("id", "h", F.flatten(moved).alias("r"))


def _result(base: DataFrame, marks: DataFrame) -> DataFrame:
    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: bigint, b: bigint>>"
    ids = marks.select("id", "h")
    if not _few(ids):
        return base.join(marks, ["id", "h"], "left").select("doc_id", "text", "gone", "ranges").mapInArrow(_cut, schema)
    # only texts that lose something meet their marks
    cut = base.join(F.broadcast(ids), ["id", "h"], "left_semi").join(marks, ["id", "h"]).select("doc_id", "text", "gone", "ranges").mapInArrow(_cut, schema)
    size, zero, none = F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.array().cast("array<struct<a: bigint, b: bigint>>")
    whole = base.join(F.broadcast(ids), ["id", "h"], "left_anti").select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), none.alias("spans"))
    return cut.unionByName(whole)
