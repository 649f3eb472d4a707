"""Document quality by Bradley-Terry ranking.

A preference pair says that one document beats another; the chance of that is the logistic of the difference of
their scores, and a score is linear in features of the text.  The weights minimise the logistic loss on feature
differences; a document is good when its score reaches the quantile of training scores that matches the share of
good documents.  Features are read from whole texts; labels, lang, source and ids are no part of them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.llm.common import held_out

_MARKS = re.compile(r"[^\w\s.,;:'\"()?-]")
_TAIL = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_LONG = 30
NAMES = (
    "words", "upper", "marks", "tails", "same_word", "distinct", "word_length", "short", "long", "digits",
    "same_line", "line_length", "lone_marks", "top_word", "worst_upper", "worst_marks", "worst_same", "commas",
)


def features(text: str | None) -> list[float]:
    """Shares and logs that describe the whole text; null and empty texts have all zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    seen, chars = Counter(words), len(text)
    letters = sum(map(len, words))
    kinds = [(w, c, w.isupper() and len(w) > 1, bool(_MARKS.search(w)), w.isalnum()) for w, c in seen.items()]
    upper = sum(c for _, c, u, _, _ in kinds if u)
    marked = sum(c for _, c, _, m, _ in kinds if m)
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    # the worst stretch of words decides for texts that are only partly junk
    caps, odd = {w for w, _, u, _, _ in kinds if u}, {w for w, _, _, m, _ in kinds if m}
    step = 40
    worst_u = worst_m = worst_s = 0.0
    if upper or marked or same:
        for k in range(0, n, step):
            part = words[k : k + step]
            if len(part) < step // 2 and k:
                break
            worst_u = max(worst_u, sum(w in caps for w in part) / len(part))
            worst_m = max(worst_m, sum(w in odd for w in part) / len(part))
            worst_s = max(worst_s, 1 - len(set(part)) / len(part))
    return [
        np.log1p(n), upper / n, marked / n, len(_TAIL.findall(text)) / n, same / n, len(seen) / n, letters / n / 10,
        sum(c for w, c, *_ in kinds if len(w) <= 3) / n, sum(c for w, c, *_ in kinds if len(w) > _LONG) / n,
        sum(c for w, c, *_ in kinds if w[0].isdigit()) / n, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(chars / max(1, len(lines))) / 5, sum(c for w, c, _, _, a in kinds if not a and len(w) == 1) / n,
        max(seen.values()) / n, worst_u, worst_m, worst_s, text.count(",") / n,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their roots, so that a little of a fault weighs too."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    spread: float

    def scores(self, texts) -> np.ndarray:
        x = expand(np.array([features(t) for t in texts], float).reshape(-1, len(NAMES)))
        z = (((x - self.mean) / self.scale) @ self.weights - self.cut) / self.spread
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(diff: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the logistic loss of winner-minus-loser feature differences (Newton steps)."""
    w, n = np.zeros(diff.shape[1]), max(1, len(diff))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = ridge * w - diff.T @ (1 - p) / n
        hess = ridge * np.eye(len(w)) + (diff * (p * (1 - p))[:, None]).T @ diff / n
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 20_000, seed: int = 3) -> Model:
    """Learn from labelled features; with one class only, the score is 0.5 for all."""
    x = expand(x.reshape(-1, len(NAMES)))
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(2 * len(NAMES)), np.ones(2 * len(NAMES)))
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(z.shape[1]), mean, scale, 0.0, 1.0)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = bradley_terry(diff)
    s = z @ w
    # the quantile of good documents' share, then the middle of the gap around it
    ordered, k = np.sort(s), len(bad)
    cut = (ordered[k - 1] + ordered[min(k, len(ordered) - 1)]) / 2
    # between neighbours the quantile is loose: take the place nearby that errs least
    up, down = np.sort(s[good]), np.sort(s[bad])
    near = np.unique(np.quantile(s, np.clip(k / len(s) + np.linspace(-0.05, 0.05, 201), 0, 1)))
    wrong = np.searchsorted(up, near, "left") + len(down) - np.searchsorted(down, near, "left")
    if len(near):
        cut = float(near[np.flatnonzero(wrong == wrong.min())].mean())
    return Model(w, mean, scale, float(cut), float(max(0.05, s.std() / 4)))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8000) -> Model:
    """Fit on at most ``max_docs`` labelled documents, those with the smallest md5 of their id, none held out.

    Rows with a null id or label are not learned from; a document with several labels counts as its largest.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null")
    ids = ids.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    some = ids.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_docs).collect()
    if not some:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in some], "doc_id long, y int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def measured(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [features(t) for t in b["text"]]})

    got = sorted((r["doc_id"], r["y"], r["x"]) for r in rows.mapInPandas(measured, "doc_id long, y int, x array<double>").collect())
    return fit(np.array([x for *_, x in got]), np.array([y for _, y, _ in got]))


def score_column(model: Model, text):
    """Column: the quality of a text, 0 to 1 (null and empty texts too)."""

    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts), dtype="float64")

    return F.pandas_udf(scored, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; repeated rows repeat, an empty table stays empty."""
    model = train(docs, labels, max_docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
