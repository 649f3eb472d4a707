"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

* Rows of the machine are stretches of sentences: from a word's start (every ``STRIDE`` characters inside longer words) the
  ``WIDTH`` places at which a subsequence may start, spaces included, within the sentence.  Whitespace runs are one space; a
  sentence ends at a line end and at ``.!?`` before whitespace.  Signs between two letters and digits go (``g.r-o*b`` is
  ``grob``), and single letters in a row with spaces between them (three at least) are one word.  Characters count as ``CLASSES`` classes (letters a to z
  without case, space, digits, symbols, other letters by code).
* The kernel counts the subsequences of ``ORDER`` characters that two stretches share, each weighted by ``DECAY`` to the number
  of skipped characters (within ``SPAN`` places), so an insult with gaps, inserted letters or a split in two still shares most.
  The toxic rows that the machine learns from, and as many clean ones, are also shown with one or two letters put into them, so
  gapped subsequences get weights.
* Training (multiple-instance SVM) alternates between picking the worst stretch of each toxic document's sentences and fitting
  a squared-hinge SVM on Nystroem features over landmark stretches; the worst stretches of clean documents pile up as
  negatives.  It starts from the log-odds of subsequences in the sentences of both classes.
* The machine is linear in the landmarks' subsequences, so it folds into one weight a subsequence.  A sentence is as toxic as
  its worst stretch, a document as its worst sentence.

Labels are learned from at most ``max_docs`` documents of each class of at most ``max_chars`` characters, the ones with the
smallest md5 of their id.  Everything is scored, whole texts, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.llm.common import held_out, materialise

ORDER, SPAN, DECAY = 4, 6, 0.6
WIDTH, STRIDE = 8, 4
CLASSES = 40
THRESHOLD = 0.7
COST, FOLDS = 1.0, 4
BLOCK_CHARS = 1 << 16
#: (offsets after the first character, weight) of each pattern of places.
PATTERNS = [(o, DECAY ** (o[-1] - ORDER + 1)) for o in combinations(range(1, SPAN), ORDER - 1)]
_BREAK, _SPACE, _DIGIT, _SYMBOL, _OTHER = 0, 1, 28, 29, 30
_LETTERS = [*range(2, 28), *range(30, CLASSES)]


def _classes() -> np.ndarray:
    """Class of each character of the basic plane; line ends are breaks."""
    out = np.full(1 << 16, _SYMBOL, np.uint8)
    for code in range(len(out) - 1):
        c = chr(code).lower()[0]
        if "a" <= c <= "z":
            out[code] = 2 + ord(c) - ord("a")
        elif c.isspace():
            out[code] = _SPACE
        elif c.isdigit():
            out[code] = _DIGIT
        elif c.isalpha() and code < 0x250:
            out[code] = _OTHER + ord(c) % (CLASSES - _OTHER)
        elif c.isalpha():  # other scripts have the classes of all letters
            out[code] = _LETTERS[ord(c) % len(_LETTERS)]
    out[ord("\n")] = _BREAK
    return out


_CLASS = _classes()
_ENDS = np.zeros(1 << 16, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all texts in a row, where each text starts).

    Each sentence starts with a space and ends with ``SPAN`` breaks, so no subsequence leaves it.
    """
    joined = "\n".join(texts) + "\n"
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    cls = _CLASS[codes]
    gap = cls <= _SPACE
    end = _ENDS[codes]
    end[:-1] &= gap[1:]
    cls[end] = _BREAK
    # breaks become SPAN breaks and a space; a space after a space or break goes
    reps = np.ones(len(cls), np.int64)
    sign = cls == _SYMBOL
    if sign.any():  # runs of signs between letters or digits go
        edge = np.flatnonzero(np.diff(np.concatenate([[False], sign, [False]]).astype(np.int8)))
        first, after = edge[::2], edge[1::2]
        inner = (first > 0) & (cls[first - 1] > _SPACE) & (after < len(cls)) & (cls[np.minimum(after, len(cls) - 1)] > _SPACE)
        for a, b in zip(first[inner].tolist(), after[inner].tolist()):
            reps[a:b] = 0
    word = cls > _SPACE
    single = word.copy()
    single[1:] &= ~word[:-1]
    single[:-1] &= ~word[1:]
    # spaces with a single letter on both sides, next to another such
    joint = np.zeros(len(cls), bool)
    joint[1:-1] = (cls[1:-1] == _SPACE) & single[:-2] & single[2:]
    joint &= np.concatenate([joint[2:], [False] * min(2, len(joint))])[: len(joint)] | np.concatenate([[False] * min(2, len(joint)), joint[:-2]])[: len(joint)]
    reps[joint] = 0
    reps[cls == _BREAK] = SPAN + 1
    reps[1:][(cls[1:] == _SPACE) & (cls[:-1] <= _SPACE)] = 0
    reps[:1][cls[:1] == _SPACE] = 0
    at = np.cumsum(reps)
    out = np.repeat(cls, reps)
    out[at[cls == _BREAK] - 1] = _SPACE
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(lens) - lens
    starts = np.where(first > 0, at[first - 1], 0)
    head = np.array([_SPACE], np.uint8)  # for the first sentence of all; the rest have theirs from the break before
    return np.concatenate([head, out]), np.where(starts > 0, starts, 0)


def stretches(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, place after the last) of each stretch: where its subsequences may start."""
    word = cls > _SPACE
    begins = np.flatnonzero((cls == _SPACE) & np.append(word[1:], False))
    stop = np.append(np.flatnonzero(~word), len(cls))
    length = stop[np.searchsorted(stop, begins, side="right")] - begins
    more = np.maximum(0, -(-length // STRIDE) - 1)  # further stretches of longer words
    at = np.repeat(begins, more + 1)
    at += STRIDE * (np.arange(len(at)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
    breaks = np.append(np.flatnonzero(cls == _BREAK), len(cls))
    return at, np.minimum(at + WIDTH, breaks[np.searchsorted(breaks, at)])


def features(cls: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(number of the subsequence from each place, weight) by pattern; what touches a break has no valid number."""
    n = len(cls) - SPAN
    by = [cls.astype(np.int32) * CLASSES ** (ORDER - 1 - k) for k in range(ORDER)]
    sums: dict[tuple, np.ndarray] = {(): by[0][:n]}
    for o, w in PATTERNS:
        for k in range(1, ORDER):
            if o[:k] not in sums:
                sums[o[:k]] = sums[o[: k - 1]] + by[k][o[k - 1] : o[k - 1] + n]
        yield sums.pop(o), w


def squares(cls: np.ndarray) -> np.ndarray:
    """Summed squared weights of the subsequences from each place."""
    n = len(cls) - SPAN
    on = (cls > _BREAK).astype(np.float32)
    out = np.zeros(n, np.float32)
    for last in sorted({o[-1] for o, _ in PATTERNS}):
        out += sum(w * w for o, w in PATTERNS if o[-1] == last) * on[last : last + n]
    return out * on[:n]


def subsequences(cls: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, weight) of every subsequence of stretches; each stretch's weights have length 1."""
    lens = np.maximum(end - at, 0)
    row = np.repeat(np.arange(len(at)), lens)
    place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + at[row]
    cls = np.concatenate([cls, np.zeros(SPAN, np.uint8)])
    norm = np.maximum(np.sqrt(np.bincount(row, squares(cls)[place], len(at))), 1e-9)
    out = []
    for (o, _), (number, w) in zip(PATTERNS, features(cls)):
        ok = (cls[place] > 0) & (cls[place + o[-1]] > 0)
        out.append((row[ok], number[place[ok]], w / norm[row[ok]]))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Model:
    """Weight of each known subsequence, bias, and the cut and slope that turn a margin into a score."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    cut: float = 1.0
    slope: float = 5.0


class Scorer:
    """Margins of texts; holds one weight for each possible subsequence (10 MB)."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros(CLASSES**ORDER, np.float32)
        self.table[model.numbers] = model.weights

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(margin by stretch, its text, its first place, its end, classes)."""
        cls, starts = encode(texts)
        at, end = stretches(cls)
        sums = np.zeros(len(cls) + 1)
        norm = np.zeros(len(cls) + 1)
        part = np.zeros(len(cls), np.float32)
        for lo in range(0, len(cls), BLOCK_CHARS):  # a block stays in the processor's cache
            own = np.append(cls[lo : lo + BLOCK_CHARS + SPAN], np.zeros(max(0, lo + BLOCK_CHARS + SPAN - len(cls)), np.uint8))
            acc = part[lo : lo + BLOCK_CHARS]
            for number, w in features(own):
                acc += np.float32(w) * self.table.take(number[: len(acc)], mode="clip")
            norm[lo + 1 : lo + 1 + len(acc)] = squares(own)[: len(acc)]
        np.cumsum(part, dtype=np.float64, out=sums[1:])
        np.cumsum(norm, out=norm)
        length = norm[end] - norm[at]
        m = np.where(length > 1e-6, (sums[end] - sums[at]) / np.sqrt(np.maximum(length, 1e-6)), 0.0) + self.model.bias
        return m, np.searchsorted(starts, at, side="right") - 1, at, end, cls

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The worst stretch's margin of each text; one without words has the bias."""
        out = np.full(len(texts), self.model.bias)
        for group in _slices([t or "" for t in texts]):
            m, text, *_ = self.margins([texts[k] or "" for k in group])
            np.maximum.at(found := np.full(len(group), -np.inf), text, m)
            out[group] = np.where(np.isfinite(found), found, self.model.bias)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.log(THRESHOLD / (1 - THRESHOLD)) + self.model.slope * (self.worst(texts) - self.model.cut)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[list[int]]:
    """Numbers of texts in groups of about ``most`` characters."""
    held, size = [], 0
    for k, t in enumerate(texts):
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(t)
    if held:
        yield held


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton steps with halving of a linear SVM with squared hinge loss; the last column of x is the bias."""
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1])

    def loss(w):
        return w @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    now = loss(w)
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * cost[on, None]
        step, size = np.linalg.solve(eye + a.T @ x[on], a.T @ y[on]) - w, 1.0
        while (new := loss(w + size * step)) > now and size > 1e-4:
            size /= 2
        if now - new <= 1e-9 * now:
            break
        w, now = w + size * step, new
    return w


class _Landmarks:
    """Stretches by their subsequences, against those of a set of landmark stretches (each a row of classes)."""

    def __init__(self, rows: list[bytes]):
        row, number, w = subsequences(*_laid(rows))
        self.numbers, at = np.unique(number, return_inverse=True)
        self.dense = np.zeros((len(self.numbers), len(rows)), np.float32)
        np.add.at(self.dense, (at, row), w.astype(np.float32))

    def kernel(self, rows: list[bytes]) -> np.ndarray:
        out, n = np.zeros((len(rows), self.dense.shape[1])), len(self.numbers)
        for k in range(0, len(rows), 64):
            row, number, w = subsequences(*_laid(rows[k : k + 64]))
            at = np.minimum(np.searchsorted(self.numbers, number), n - 1)
            some = np.flatnonzero(self.numbers[at] == number)
            some = some[np.argsort(row[some], kind="stable")]
            first = np.flatnonzero(np.diff(row[some], prepend=-1))
            if len(some):
                out[k + row[some[first]]] = np.add.reduceat(self.dense[at[some]] * w[some, None].astype(np.float32), first)
        return out


def _laid(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (with their tails of up to ``SPAN`` - 1 classes) one after the other: classes, starts, ends."""
    lens = np.array([len(r) for r in rows])
    at = np.cumsum(lens + SPAN) - lens - SPAN
    cls = np.frombuffer(bytes(SPAN).join(rows) + bytes(SPAN), np.uint8)
    return cls, at, at + np.minimum(lens, WIDTH)


def _cut_out(cls: np.ndarray, at: np.ndarray, end: np.ndarray) -> list[bytes]:
    """A stretch with the classes after it that its subsequences may reach."""
    data, out = cls.tobytes(), []
    for a, e in zip(at.tolist(), end.tolist()):
        piece = data[a : e + SPAN - 1] if e - a == WIDTH else data[a:e]
        out.append(piece.split(b"\0")[0])
    return out


def _first_guess(docs: list[tuple[int, str]]) -> Model:
    """Log-odds of each subsequence between the sentences of toxic and clean documents."""
    count, total = np.zeros((2, CLASSES**ORDER), np.float32), np.zeros(2)
    for y in (0, 1):
        texts = [t for k, t in docs if k == y]
        for group in _slices(texts):
            cls, _ = encode([texts[k] for k in group])
            cls = np.append(cls, np.zeros(SPAN, np.uint8))
            for (o, w), (number, _) in zip(PATTERNS, features(cls)):
                ok = (cls[: len(number)] > 0) & (cls[o[-1] : o[-1] + len(number)] > 0)
                count[y] += np.bincount(number[ok], minlength=CLASSES**ORDER).astype(np.float32) * np.float32(w)
        total[y] = max(count[y].sum(), 1)
    rate = total[1] / total[0]
    odds = np.log((count[1] + 1) / (count[0] * rate + 1))
    known = np.flatnonzero(odds)
    return Model(known, odds[known].astype(np.float32))


def machine(docs: list[tuple[int, str]], seed: int = 7, landmarks: int = 512, rounds: int = 4, per_doc: int = 3, most: int = 6000) -> Model:
    """Nystroem SVM on the worst stretches of toxic documents against stretches of clean ones, at most ``most`` of these a round."""
    if len({y for y, _ in docs}) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32))
    rng, model = np.random.default_rng(seed), _first_guess(docs)
    negatives: dict[bytes, int] = {}
    for step in range(rounds):
        scorer, positives, hard = Scorer(model), {}, {}
        for group in _slices([t for _, t in docs]):
            own = [docs[k] for k in group]
            m, text, at, end, cls = scorer.margins([t for _, t in own])
            label = np.array([y for y, _ in own])[text]
            order = np.lexsort((at, -m, text))
            rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            worst = order[(label[order] == 1) & (rank == 0)]
            for row in _cut_out(cls, at[worst], end[worst]):
                positives[row] = positives.get(row, 0) + 1
            near = order[(label[order] == 0) & (rank < per_doc) & ((m[order] > -1) | (step == 0))]
            for row, far in zip(_cut_out(cls, at[near], end[near]), m[near].tolist()):
                n, _ = hard.get(row, (0, 0.0))
                hard[row] = (n + 1, far)
            if step == 0 and (label == 0).any():  # and some by chance
                some = rng.choice(np.flatnonzero(label == 0), len(own))
                hard.update((row, (1, np.inf)) for row in _cut_out(cls, at[some], end[some]) if row not in hard)
        for row in sorted(hard, key=lambda r: (-hard[r][1], r))[:most]:
            negatives[row] = max(negatives.get(row, 0), hard[row][0])
        bad, good = sorted(positives), sorted(negatives)
        marks = sorted({*_some(bad, landmarks // 2, rng), *_some(good, landmarks // 2, rng)})
        space = _Landmarks(marks)
        val, vec = np.linalg.eigh((space.dense.T @ space.dense).astype(np.float64))
        root = vec[:, val > 1e-6] / np.sqrt(val[val > 1e-6])
        rows = bad + good
        clean = _some(good, len(bad), rng)
        more = [_with_letters(r, rng) for r in bad + clean]
        x = np.hstack([space.kernel(rows + more) @ root, np.ones((len(rows) + len(more), 1))])
        y = np.r_[np.ones(len(bad)), -np.ones(len(good)), np.ones(len(bad)), -np.ones(len(clean))]
        cost = np.r_[np.sqrt([positives[r] for r in bad]), np.sqrt([negatives[r] for r in good])]
        w = _squared_hinge(x, y, COST * np.r_[cost, np.sqrt([positives[r] for r in bad]) / 2, np.sqrt([negatives[r] for r in clean]) / 2])
        model = Model(space.numbers, (space.dense @ (root @ w[:-1])).astype(np.float32), float(w[-1]))
    return model


def _with_letters(row: bytes, rng) -> bytes:
    """The stretch with one or two letters put between two of its letters."""
    out = bytearray(row)
    inner = [k for k in range(1, len(row)) if row[k - 1] > _SPACE and row[k] > _SPACE]
    for k in sorted(rng.permutation(inner)[: int(rng.integers(1, 3))].tolist(), reverse=True) if inner else ():
        out.insert(k, _LETTERS[int(rng.integers(len(_LETTERS)))])
    return bytes(out)


def _some(rows: list[bytes], n: int, rng) -> list[bytes]:
    return [rows[k] for k in sorted(rng.permutation(len(rows))[:n])]


def mean_of(both: list[Model]) -> Model:
    table = np.zeros(CLASSES**ORDER, np.float32)
    for made in both:
        table[made.numbers] += made.weights / len(both)
    known = np.flatnonzero(table)
    return Model(known, table[known], sum(made.bias for made in both) / len(both))


def with_cut(model: Model, margin: np.ndarray, label: np.ndarray) -> Model:
    """``model`` with the cut that errs least (a clean document counts twice).

    Of equally good cuts it is a fifth of the way up from the clean side: what is disguised lies between the two classes.
    """
    if len(set(label.tolist())) < 2:
        return model
    edges = np.unique(margin)
    cuts = np.r_[edges[0] - 1, (edges[1:] + edges[:-1]) / 2, edges[-1] + 1]
    up, down = np.sort(margin[label == 1]), np.sort(margin[label == 0])
    wrong = np.searchsorted(up, cuts) / len(up) + 2 * (len(down) - np.searchsorted(down, cuts)) / len(down)
    best = np.flatnonzero(wrong == wrong.min())
    low, high = (edges[max(0, best[0] - 1)], edges[min(len(edges) - 1, best[-1])])
    return replace(model, cut=float(0.8 * low + 0.2 * high), slope=float(4 / max(0.2, up.mean() - down.mean())))


def _fit_part(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["y", "doc_id", "text"])
    made = machine(list(zip(rows["y"].tolist(), rows["text"])))
    return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "numbers": [made.numbers.tolist()], "weights": [made.weights.tolist()], "bias": [made.bias]})


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 2000, max_chars: int = 1 << 20) -> Model:
    """Fit on at most ``max_docs`` labelled documents of each class, none of them held out; with one class only, everything scores below the threshold.

    ``FOLDS`` machines learn all but one fold each, in a task each; the model is their mean.  The cut between the classes comes
    from the margins that each machine gives the fold that it has not seen.  Rows with a null id, label or text are not learned
    from; a document with several labels counts as its largest.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null")
    ids = ids.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("o", F.md5(F.col("doc_id").cast("string").cast("binary")))
    some = [(r["doc_id"], y, k % FOLDS) for y in (0, 1) for k, r in enumerate(ids.where(F.col("y") == y).orderBy("o", "doc_id").limit(max_docs).collect())]
    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32))
    if not some:
        return none
    chosen = docs.sparkSession.createDataFrame(some, "doc_id long, y int, fold int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.char_length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")
    rows = materialise(rows, "labelled")
    there = {(r["fold"], r["y"]) for r in rows.select("fold", "y").distinct().collect()}
    if {y for _, y in there} != {0, 1}:
        return none
    # where a class is in one fold only, one machine learns all
    whole = any(len({fold for fold, y in there if y == label}) < 2 for label in (0, 1))
    parts = F.array(F.lit(0)) if whole else F.array(*(F.lit(k) for k in range(FOLDS)))
    dealt = rows.withColumn("part", F.explode(parts)).where(F.lit(whole) | (F.col("part") != F.col("fold")))
    made = dealt.groupBy("part").applyInPandas(_fit_part, "part int, numbers array<long>, weights array<float>, bias double").collect()
    machines = {r["part"]: Model(np.array(r["numbers"], np.int64), np.array(r["weights"], np.float32), r["bias"]) for r in made}

    def unseen(batches):
        scorers: dict[int, Scorer] = {}
        for b in batches:
            for fold, part in b.groupby("fold"):
                k = 0 if whole else int(fold)
                if k not in scorers:
                    scorers[k] = Scorer(machines[k])
                yield pd.DataFrame({"y": part["y"], "margin": scorers[k].worst(list(part["text"]))})

    seen = rows.select("fold", "y", "text").mapInPandas(unseen, "y int, margin double").collect()
    return with_cut(mean_of(list(machines.values())), np.array([r["margin"] for r in seen]), np.array([r["y"] for r in seen]))


def score_column(model: Model, text):
    """Column: the toxicity of a text, 0 to 1 (null and empty texts too)."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series(scorer.scores(list(texts)), dtype="float64")

    return F.pandas_udf(scored, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; repeated rows repeat, an empty table stays empty."""
    model = train(docs, labels, max_docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_docs: int = 2000) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    return docs.where(score_column(train(docs, labels, max_docs), docs["text"]) < THRESHOLD)
