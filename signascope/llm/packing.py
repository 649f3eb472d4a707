"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition, so nothing is shuffled: it tokenises a text, gives every whole
``capacity`` ids of it a sequence of their own and keeps the tail.  Tails are packed ``group`` at a time:

* tails are cut into pieces of at most ``piece`` ids;
* what is over the ids that a whole number of windows takes (less ``SPARE`` a window, for uneven ones) fills sequences
  of power-of-two lengths to the brim, which are not padded;
* the other pieces become windows of near-equal sums: a partial partition of one piece in one window each, the two with
  the largest spread merged again and again, the fullest window of one with the emptiest of the other;
* if a window holds more than ``capacity``, there is one more window and the differencing starts anew.

A task holds one group of tails and its word caches, whatever the partition's size.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signascope.llm.common import slices

#: Ids left free in a window on average; 0.2 % of 2048.
SPARE = 4
#: Entries at which a word cache starts anew.  Only speed depends on it.
CACHED = 1 << 19
#: Stripped from the end of words before these are looked up; none of them is part of a letter run in the vocabulary's split
#: or ends a special token.
MARKS = ".,;:!?%#$*&@~=+-_/\"()[]{}"
#: Python splits words at these, the vocabulary does not: texts that hold one are encoded as they are.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: How byte-level vocabularies write a byte that is no visible sign of Latin-1: by the signs from 256 on, in order.
BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Ids of words, and of whole texts by way of their words, as 32-bit numbers in bytes.

    The vocabulary drops white space and no token, normalisation or special token reaches across it, so the ids of a
    text are those of its words one after the other.  Marks at a word's end are a run of their own when a letter or
    digit stands before them.  A word is encoded when it is first looked up.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.old: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            core = word.rstrip(MARKS)
            letters = core.isalpha() and (core.isascii() or max(core) < "ɐ" and "İ" not in core)
            if core and not letters and core != word and not (core[-1] < "ɐ" and core[-1].lower()[-1].isalnum()):
                core = word
            ids = self._core(core.lower() if letters else core, letters)
            if len(core) < len(word):
                ids += self._core(word[len(core) :], False)
        self[word] = ids
        return ids

    def _core(self, core: str, letters: bool) -> bytes:
        ids = self.cores.get(core)
        if ids is None:
            if len(self.cores) > 2 * CACHED:
                self.cores.clear()
            if letters:  # one run of letters in normal form: the model alone
                found = [x.id for x in self.model.tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(BYTES))]
            else:
                found = self.tokenizer.encode(core, add_special_tokens=False).ids
            ids = self.cores[core] = array("I", found).tobytes()
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.__getitem__
        for text in texts:
            if len(self) > CACHED:
                self.old = self.copy()
                self.clear()
            words = [] if SEPARATORS.search(text) else text.split()
            out.append(b"".join(map(get, words)) if words else array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
        return out


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """``windows`` lists of positions of ``sizes`` with near-equal sums, by largest differencing (needs one size at least)."""
    joined: list[tuple[int, int]] = []
    n = len(sizes)
    # a partial partition: its spread, a number for ties, the sums of windows that hold something, falling, and their contents
    heap = [(-s, k, np.array([s]), np.array([k])) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        free = windows - len(a)
        sums, held = np.concatenate([a, b[:free]]), np.concatenate([x, y[:free]])
        if len(b) > free:  # the rest of b, falling, onto the windows of a from its emptiest
            over = len(b) - free
            at = slice(len(a) - over, len(a))
            sums[at] += b[free:][::-1]
            pairs = list(zip(held[at].tolist(), y[free:][::-1].tolist()))
            held[at] = np.arange(len(joined) + n, len(joined) + n + over)
            joined += pairs
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        low = int(sums[-1]) if len(sums) == windows else 0
        heapq.heappush(heap, (low - int(sums[0]), tie, sums, held))
    out = []
    for root in heap[0][3].tolist():
        todo, inside = [root], []
        while todo:
            k = todo.pop()
            if k < n:
                inside.append(k)
            else:
                todo.extend(joined[k - n])
        out.append(inside)
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; one more window whenever one holds more."""
    if not sizes:
        return []
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, count)
        if max(sum(sizes[k] for k in w) for w in found) <= capacity:
            return found
        count += 1


def _packed(tails: list[tuple], capacity: int, piece: int):
    """Sequences, as lists of (owner, from, to) over ids, of ``tails`` (owner, ids as bytes, start)."""
    total = sum(len(t[1]) // 4 for t in tails)
    whole = total // max(1, capacity - SPARE)
    surplus = total - whole * (capacity - SPARE)
    brim = [1 << k for k in range(surplus.bit_length() - 1, -1, -1) if surplus >> k & 1]
    owner, at = len(tails) - 1, 0
    for size in brim:
        seq, room = [], size
        while room:
            left = len(tails[owner][1]) // 4 - at
            if not left:
                owner, at = owner - 1, 0
                continue
            take = min(left, room)
            seq.append((owner, at, at + take))
            room, at = room - take, at + take
        yield seq
    pieces = []
    for k in range(owner + 1):
        n, begin = len(tails[k][1]) // 4, at if k == owner else 0
        pieces += [(k, p, min(p + piece, n)) for p in range(begin, n, piece)]
    for window in windows_of([q - p for _, p, q in pieces], capacity):
        yield [pieces[k] for k in sorted(window)]


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, piece: int = 512, group: int = 1000, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text, then ``end_id``; a null or empty text has ``end_id`` alone.  Every id
    lies in one piece.  Repeated rows and null ids are documents like others.  No rows for an empty table; other columns
    are not read.  ``with_ids`` adds the pieces' ids.  Sequence ids are unique and follow the partitions of ``docs``:
    write the result where one assignment has to last.

    ``capacity`` is a power of two.  Documents are whole up to ``piece`` ids at the end and ``capacity`` before it;
    smaller pieces pad less.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    stop = np.array([end_id], "<u4").tobytes()

    def task(batches):
        words = Words(path)
        sequence = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        tails: list[tuple] = []
        arrow = None

        def placed(seq):
            nonlocal sequence
            offset = 0
            for doc_id, ids, start, tokens in seq:
                row = (doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset)
                out.append(row + (np.frombuffer(ids, "<u4").tolist(),) * with_ids)
                offset += len(ids) // 4
            sequence += 1

        def settle():
            for seq in _packed(tails, capacity, piece):
                placed([(tails[k][0], tails[k][1][4 * p : 4 * q], tails[k][2] + p, tails[k][3]) for k, p, q in seq])
            tails.clear()

        def batch():
            types = [arrow, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.name for f in fields])
            out.clear()
            return made

        for b in slices(batches, 64):
            arrow = b.schema.field(0).type
            for doc_id, ids in zip(b.column(0).to_pylist(), words.ids([t or "" for t in b.column(1).to_pylist()])):
                ids += stop
                tokens = len(ids) // 4
                cut = tokens - tokens % capacity
                for p in range(0, cut, capacity):
                    placed([(doc_id, ids[4 * p : 4 * (p + capacity)], p, tokens)])
                if cut < tokens:
                    tails.append((doc_id, ids[4 * cut :], cut, tokens))
                if len(tails) >= group:
                    settle()
            if out:
                yield batch()
        settle()
        if out:
            yield batch()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(task, T.StructType(fields))
