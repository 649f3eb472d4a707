"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

An item leaks into a document when some stretch of the document is within floor(``rate`` * words) word edits of the item
(words: runs of word characters, lower case).

* An item of over ``PIECE`` words is cut into near-equal pieces; edits of at most ``rate`` of the item leave a piece with at
  most ``rate`` of its own words edited, so looking for pieces with their share of edits drops no match.
* Where to look: a piece of n words with at most k edits keeps an untouched run of ceil((n-k)/(k+1)) words.  Runs
  of that length (three at most) that a piece and the document share give the starts of piece-sized windows; this
  drops no match.
* The CGK embedding reads a window by a random walk: at step j it writes the current word and moves on or stays, by
  a random bit of (j, word).  After an edit two walks fall into step again, so few edits become few differing places.
* Each repetition has a walk and samples ``BITS`` places of it; windows that agree with a piece there are candidates, and
  nothing else is.  Pieces are short, so that k edits leave a repetition a chance that does not fall with the item's
  length; ``REPETITIONS`` of them reach the target recall, which the tests measure by item length and kind of edit.
* A candidate counts only if the edit distance of the whole item to its best stretch, computed in full, is small enough.

The items are taken in blocks of at most ``block`` so that what each task holds is bounded; a block is one pass.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.llm.common import slices

RATE, BITS, REPETITIONS, SHIFTS, PIECE = 0.2, 2, 48, (0, -1, 1), 12
TOGETHER = 4000  # texts whose windows are embedded together
_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
#: one salt for each step of the walk, from the seeded generator
_J = np.random.default_rng(5).integers(1, 2**63, 4096, dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each word of its lower case, which some characters lengthen."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _WORD.finditer(low)]
    source = [k for k, c in enumerate(text) for _ in range(len(c.lower()))]
    return [(source[a], source[b - 1] + 1) for a, b in (m.span() for m in _WORD.finditer(low))]


def allowed(n: int, rate: float = RATE) -> int:
    return int(n * rate + 1e-9)


def run_length(n: int, rate: float = RATE) -> int:
    k = allowed(n, rate)
    return min(3, -(-(n - k) // (k + 1)))


def best_stretch(item: np.ndarray, seq: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``seq`` nearest to ``item``; of equals the one that ends first, then is shortest."""
    scores = [len(item), *_edits(item, seq, False)]
    edits = min(scores)
    end = scores.index(edits)
    back = [len(item), *_edits(item[::-1], seq[:end][::-1], True)]
    return edits, end - back.index(edits), end


def _edits(item: np.ndarray, seq: np.ndarray, anchored: bool) -> list[int]:
    """Edits of ``item`` against what ends at each word of ``seq`` and starts anywhere, or at its start if ``anchored``.

    Myers' bit-parallel columns, a bit for each word of the item.
    """
    where: dict[int, int] = defaultdict(int)
    for j, w in enumerate(item.tolist()):
        where[w] |= 1 << j
    n = len(item)
    full, top, first, score, out = (1 << n) - 1, 1 << (n - 1), int(anchored), n, []
    up, down = full, 0
    for w in seq.tolist():
        eq = where.get(w, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(h | up)), up & h
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) | first, left << 1
        up, down = (left | ~(v | right)) & full, right & v & full
        out.append(score)
    return out


class Items:
    """A block of items, ready to look for in documents."""

    def __init__(self, rows: list[tuple[int, str | None]], rate: float = RATE, seed: int = 11):
        split = [(i, w) for i, t in rows if (w := words_of(t))]
        self.rate, self.ids = rate, [i for i, _ in split]
        self.vocab = {w: k for k, w in enumerate(sorted({x for _, ws in split for x in ws}), 1)}
        self.seqs = [np.array([self.vocab[x] for x in ws], np.int64) for _, ws in split]
        self.base = len(self.vocab) + 1
        self.bags = [Counter(s.tolist()) for s in self.seqs]
        #: (item, place of its first word in the item, its words) of each piece
        self.pieces = [(k, int(p[0]), s[p]) for k, s in enumerate(self.seqs) for p in np.array_split(np.arange(len(s)), -(-len(s) // PIECE))]
        posts: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for _, _, s in self.pieces:
            g = run_length(len(s), rate)
            for q, code in enumerate(self.codes(s, g).tolist()):
                posts[g][code].add((len(s), q))
        self.posts = {g: {c: sorted(v) for c, v in p.items()} for g, p in posts.items()}
        self.grams = {g: np.array(sorted(p), np.int64) for g, p in self.posts.items()}
        rng = np.random.default_rng(seed)
        self.walks = rng.integers(1, 2**63, REPETITIONS, dtype=np.uint64)
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for k, (_, _, s) in enumerate(self.pieces):
            self.by_length[len(s)].append(k)
        self.places = {n: np.sort(rng.integers(0, max(1, 2 * n), (REPETITIONS, BITS)), axis=1) for n in self.by_length}
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for n, members in self.by_length.items():
            tables = [defaultdict(list) for _ in range(REPETITIONS)]
            keys = self.keys(np.stack([self.pieces[k][2] for k in members]), n)
            for r in range(REPETITIONS):
                for k, key in zip(members, keys[r].tolist()):
                    tables[r][key].append(k)
            self.tables[n] = tables

    def codes(self, s: np.ndarray, g: int) -> np.ndarray:
        """A number for each run of ``g`` known words, -1 where one is not known."""
        n = len(s) - g + 1
        if n < 1:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(g):
            out = out * self.base + s[j : j + n]
            known &= s[j : j + n] > 0
        return np.where(known, out, -1)

    def keys(self, windows: np.ndarray, n: int) -> np.ndarray:
        """LSH key of each window (rows of ``n`` word numbers) in each repetition."""
        padded = np.hstack([windows, np.full((len(windows), 1), -1)]).astype(np.int64)
        out = np.zeros((REPETITIONS, len(windows)), np.uint64)
        times = np.stack([(self.places[n] == j).sum(1) for j in range(int(self.places[n].max()) + 1)])
        rows = np.arange(len(windows))
        at = np.zeros(out.shape, np.int64)
        for j, sampled in enumerate(times):
            w = padded[rows, at].astype(np.uint64)
            for t in range(1, int(sampled.max()) + 1):
                r = np.flatnonzero(sampled >= t)
                out[r] = (out[r] ^ (w[r] + np.uint64(2))) * _P
            h = (w ^ self.walks[:, None]) * _P + _J[j % len(_J)]
            h = (h ^ (h >> np.uint64(32))) * _P
            at = np.minimum(at + (h >> np.uint64(63)).astype(np.int64), n)
        return out

    def shared(self, k: int, s: np.ndarray) -> int:
        """Words that item ``k`` and ``s`` have in common, with their numbers."""
        bag = self.bags[k]
        return sum(min(c, bag[w]) for w, c in Counter(s.tolist()).items() if w in bag)

    def starts(self, s: np.ndarray) -> dict[int, set[int]]:
        """Window starts worth a look, by window length."""
        found: dict[int, set[int]] = defaultdict(set)
        for g, grams in self.grams.items():
            codes = self.codes(s, g)
            hits = np.flatnonzero(codes >= 0)
            at = np.minimum(np.searchsorted(grams, codes[hits]), len(grams) - 1)
            for p in hits[grams[at] == codes[hits]].tolist():
                for n, q in self.posts[g][int(codes[p])]:
                    found[n].add(p - q)
        return found

    def verified(self, k: int, firsts: set[int], s: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best stretch of ``s`` for item ``k`` around the starts ``firsts``, if it is near enough."""
        n = len(self.seqs[k])
        reach = allowed(n, self.rate)
        places: list[list[int]] = []
        for a in sorted(firsts):
            lo, hi = max(0, a - reach - 1), min(len(s), a + n + reach + 1)
            if lo < hi and hi - lo >= n - reach and self.shared(k, s[lo:hi]) >= n - reach:  # each edit costs one shared word at most
                if places and lo <= places[-1][1]:
                    places[-1][1] = max(hi, places[-1][1])
                else:
                    places.append([lo, hi])
        got = ((e, lo + x, lo + y) for lo, hi in places for e, x, y in [best_stretch(self.seqs[k], s[lo:hi])] if e <= reach and y > x)
        return min(got, default=None)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, start, end, edits), code point offsets: the best stretch for each item that leaks.

        Windows of all texts are embedded together, which is what makes the walks cheap.
        """
        get, seqs = self.vocab.get, []
        candidates: dict[tuple[int, int], set[int]] = defaultdict(set)
        looks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d, text in enumerate(texts):
            s = np.array([get(w, 0) for w in words_of(text)], np.int64)
            seqs.append(s)
            for n, firsts in self.starts(s).items():
                shifts = SHIFTS if allowed(n, self.rate) else (0,)
                looks[n] += [(d, a) for a in sorted({a + x for a in firsts for x in shifts}) if -n < a < len(s)]
        for n, at in looks.items():
            for c in range(0, len(at), 500):
                some = at[c : c + 500]
                windows = np.zeros((len(some), n), np.int64)
                for row, (d, a) in zip(windows, some):
                    part = seqs[d][max(0, a) : a + n]
                    row[max(0, -a) : max(0, -a) + len(part)] = part
                for table, keys in zip(self.tables[n], self.keys(windows, n).tolist()):
                    for (d, a), key in zip(some, keys):
                        if key in table:
                            for piece in table[key]:
                                k, begin, _ = self.pieces[piece]
                                candidates[d, k].add(a - begin)
        best = {dk: got for dk, firsts in candidates.items() if (got := self.verified(dk[1], firsts, seqs[dk[0]]))}
        out: list[list] = [[] for _ in texts]
        spans: dict[int, list] = {}
        for (d, k), (edits, x, y) in sorted(best.items()):
            if d not in spans:
                spans[d] = word_spans(texts[d])
            out[d].append((self.ids[k], spans[d][x][0], spans[d][y - 1][1], edits))
        return [sorted(x, key=lambda m: (m[0] is None, m)) for x in out]


def blocks(items: DataFrame, block: int, id_col: str = "item_id") -> list[list[tuple[int, str | None]]]:
    """The items in lists of about ``block``, dealt by a hash of their text."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col("text")).where("text is not null")
    parts = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("text"), F.lit(parts))
    return [sorted(((r["i"], r["text"]) for r in rows.where(own == k).collect()), key=lambda x: (x[0] is None, x)) for k in range(parts)]


def find(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = 20_000) -> DataFrame:
    """doc_id, item_id, start, end, edits: for each document and item that leaks into it, the best stretch.

    Offsets are code points of the text.  Null and empty texts match nothing; items without words never match; repeated rows repeat.
    """
    rows, parts = docs.select(F.col("doc_id"), F.col("text")), []
    kind = rows.schema["doc_id"].dataType.simpleString()
    for some in blocks(items, block):

        def scan(batches, some=some):
            held = Items(some, rate)
            for b in slices(batches, TOGETHER):
                got = [(row, *m) for row, found in enumerate(held.matches_of(b.column("text").to_pylist())) for m in found]
                row, *cols = zip(*got) if got else [()] * 5
                yield pa.record_batch([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "item_id", "start", "end", "edits"])

        parts.append(rows.mapInArrow(scan, f"doc_id {kind}, item_id long, start long, end long, edits long"))
    return reduce(DataFrame.unionByName, parts)


def leaks_column(items: list[tuple[int, str | None]], text, rate: float = RATE):
    """Column: whether any of the items leaks into a text (null: false)."""

    def leaked(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Items(items, rate)
        for texts in it:
            texts = list(texts)
            yield pd.Series([bool(m) for k in range(0, len(texts), TOGETHER) for m in held.matches_of(texts[k : k + TOGETHER])], dtype=bool)

    return F.pandas_udf(leaked, "boolean")(text)


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = 20_000) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    for some in blocks(items, block):
        docs = docs.where(~leaks_column(some, docs["text"], rate))
    return docs
