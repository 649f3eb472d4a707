"""Personal data in texts: plain patterns, and the same patterns behind disguises.

A text is rewritten by two small transducers - characters (homoglyphs, full-width forms, zero-width marks), then
words (spelled digits, at/dot disguises).  Each keeps where every piece came from, so what the patterns find in
the rewritten text is mapped back to code points of the source.  Plain finds always stay; the rewriting only adds.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁһԛԝ", "ABESIJKMHOPCTYXaeijopcyxsdhqw")) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp")) | {"ı": "i", "ɡ": "g", "ɑ": "a", "․": ".", "。": ".", "﹒": ".", "﹫": "@"}
# Marks that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
# Digit words of four languages.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_AT_WORDS, _DOT_WORDS = "at|arroba|chez", "dot|punto|punkt|point"
_CHARS = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + INVISIBLE + "！-～]")
_NUMBER = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: three or more digit words in a row, other digits, dots and a leading plus allowed between
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\x20-]+)?{_NUMBER}(?:(?:[\x20-]+|[\x20]+(?:{_DOT_WORDS})[\x20]+|\.)(?:{_NUMBER}|[0-9]{{1,4}})(?!\w))+(?!\w)", re.I)
_MAYBE_SPELLED = re.compile(rf"(?<!\w){_NUMBER}[\x20.-]+{_NUMBER}(?!\w)|(?<!\w){_NUMBER}[\x20]+(?:{_DOT_WORDS})\x20", re.I)
_DOT = rf"(?:\x20*[\[({{<]\x20*(?:{_DOT_WORDS}|\.)\x20*[\])}}>]\x20*|\x20+(?:{_DOT_WORDS})\x20+|\.)"
#: the same from right to left
_TOD = rf"(?:\x20*[\])}}>]\x20*(?:{'|'.join(w[::-1] for w in _DOT_WORDS.split('|'))}|\.)\x20*[\[({{<]\x20*|\x20+(?:{'|'.join(w[::-1] for w in _DOT_WORDS.split('|'))})\x20+|\.)"
#: where an at sign or its disguise may be; spaces around it are looked at later
_AT = re.compile(rf"@|\x20(?:{_AT_WORDS})\x20|[\[({{<]\x20*(?:{_AT_WORDS}|@)\x20*[\])}}>]", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", re.I)
_LOCAL_BACK = re.compile(rf"[A-Za-z0-9_%+-]++(?:{_TOD}[A-Za-z0-9_%+-]++)*+", re.I)
_DOT_PART = re.compile(_DOT, re.I)
_SAID_DOT = re.compile(rf"[\x20(\[{{<](?:{_DOT_WORDS})[\x20)\]}}>]", re.I)
_TOKEN = re.compile(rf"plus(?=[\x20-])|(?:{_DOT_WORDS})|\.|{_NUMBER}|[0-9]+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their @ signs, so no text costs more than its length."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plain identifiers: leftmost, not overlapping within a kind; failing matches are dropped."""
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


class Rewritten:
    """A text with pieces replaced, and the way back to the source's offsets."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.out, self.src, at, n = [], [], [], 0, 0
        self.touched: list[tuple[int, int]] = []
        for a, b, new in edits:
            parts += [text[at:a], new]
            n += a - at
            self.touched.append((a, b))
            self.out += [n, n + len(new)]
            self.src += [(a, b), (b, b)]
            n, at = n + len(new), b
        self.text = "".join(parts) + text[at:]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source offsets of [start, end): replaced pieces count whole."""
        return self._at(start, 0), self._at(end - 1, 1)

    def _at(self, pos: int, side: int) -> int:
        k = bisect_right(self.out, pos) - 1
        if k < 0:
            return pos + side
        (a, b), first = self.src[k], self.out[k]
        return (a, b)[side] if a != b else a + pos - first + side


def _char_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    out = []
    for m in _CHARS.finditer(text):
        c = m[0]
        out.append((m.start(), m.end(), HOMOGLYPHS.get(c) or ("" if c in INVISIBLE else chr(ord(c) - 0xFEE0))))
    return out


def _disguised(text: str) -> list[tuple[int, int, str]]:
    """(start, end, plain form) of addresses with a disguised at sign or dot, read both ways from the at signs.

    A plain "at" before a plain host ("look at example.com") is no address unless the part before it holds more than letters
    or the host is a mail host by name.
    """
    out, floor, back = [], 0, None
    for m in _AT.finditer(text):
        begin, end = m.start(), m.end()
        while end < len(text) and text[end] == " ":
            end += 1
        host = _HOST.match(text, end)
        if not host:
            continue
        while begin > floor and text[begin - 1] == " ":
            begin -= 1
        back = back if back is not None else text[::-1]
        local = _LOCAL_BACK.match(back, len(text) - begin, len(text) - floor)
        if not local:
            continue
        start, plain_host = len(text) - local.end(), _DOT_PART.sub(".", host[0])
        new = f"{_DOT_PART.sub('.', text[start:begin])}@{plain_host}"
        if text[start : host.end()] == new:
            continue
        if m[0].strip().lower() in _AT_WORDS.split("|") and not _SAID_DOT.search(host[0]) and text[start:begin].isalpha() and "mail" not in plain_host.lower().rsplit(".", 1)[0]:
            continue
        out.append((start, host.end(), new))
        floor = host.end()
    return out


def _word_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _MAYBE_SPELLED.search(text):
        for m in _SPELLED.finditer(text):
            new = ""
            for t in _TOKEN.finditer(m[0]):
                word = t[0].lower()
                new += "+" if word == "plus" else word if word.isdigit() else str(DIGIT_WORDS[word]) if word in DIGIT_WORDS else "."
            if sum(c.isdigit() for c in new) >= 4:
                out.append((m.start(), m.end(), new))
    ends = [b for _, b, _ in out]  # what is spelled does not overlap, so its ends rise
    for start, end, new in _disguised(text):
        k = bisect_right(ends, start)
        if k == len(ends) or out[k][0] >= end:
            out.append((start, end, new))
    return sorted(out)


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(plain spans, added spans), each (start, end, kind) by start, then kind as listed."""
    base, added = base_spans(text), set()
    chars = Rewritten(text, _char_edits(text))
    words = Rewritten(chars.text, _word_edits(chars.text))
    if chars.touched or words.touched:
        for a, b, kind in base_spans(words.text):
            a, b = chars.back(*words.back(a, b))
            if not any(k == kind and x <= a and b <= y for x, y, k in base):
                added.add((a, b, kind))
    key = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base, key=key), sorted(added, key=key)


def redacted(text: str) -> str:
    """The text with each find replaced by its kind in brackets; overlapping finds are replaced as one, by the first kind."""
    base, added = spans(text)
    out, at = [], 0
    for a, b, kind in sorted(base + added, key=lambda s: (s[0], -s[1])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


_FOUND = "base string, all string, n_email long, n_ip long, n_card long, n_phone long"


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, added = spans(text or "")
        every = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if added else base
        rows.append((_joined(base), _joined(every), *(sum(s[2] == k for s in every) for k in KINDS)))
    return pd.DataFrame(rows, columns=["base", "all", "n_email", "n_ip", "n_card", "n_phone"])


def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(redacted, na_action="ignore")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of all finds by kind, ``base`` and ``spans`` as kind:start:end lists.

    Null and empty texts have none.  Ids may be null or repeat; other columns are not looked at.
    """
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = out.withColumn("_found", F.pandas_udf(_scan, _FOUND)("_text"))
    return out.select(id_col, *(F.col(f"_found.n_{k}").alias(f"n_{k}") for k in KINDS), F.col("_found.base").alias("base"), F.col("_found.all").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with finds in ``text_col`` masked; null stays null."""
    return docs.withColumn(text_col, F.pandas_udf(_redact, "string")(F.col(text_col)))


def digest(found: DataFrame) -> DataFrame:
    """``find``'s result with the plain spans as their SHA-256."""
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
