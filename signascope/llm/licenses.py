"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates are runs of lower-case words; a template has the shingles of five words that it holds (one shingle of
all its words if it has fewer).  A document carries a template when in some window of the template's size at least
``containment`` of the template's shingles occur.

* Windows start wherever as many shingles as a template needs lie in a window of its size; a window with fewer cannot
  contain enough of it, so nothing is lost.
* A window's MinHash values are taken over its shingles, ``BANDS`` bands of ``ROWS``; a window that contains 0.8 of a
  template has a Jaccard similarity of 2/3 or more with it, and meets it in a band with probability
  1 - (1 - (2/3)^ROWS)^BANDS, over 0.9999999 at these settings.
* What a band retrieves is verified on the shingles themselves.

Templates are taken in blocks of at most ``block``, a pass each.

The built-in templates are one-line notices and the standard texts and headers in ``license_texts``.  Many standard texts
hold most of another one, so where two of them overlap by half of the shorter, the one with more shingles found stays.
"""

from __future__ import annotations

import pkgutil
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signascope.llm.common import slices
from signascope.llm.decontam import blocks, word_spans

WORDS, BANDS, ROWS, CONTAINMENT = 5, 28, 2, 0.8
_WORD = re.compile(r"\w+")

# Notices that grant or refuse rights, by the usual short name of their license.
NOTICES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "all-rights-reserved": "All rights reserved.",
}

#: Standard texts and headers, by the short name of their license and what it is where a license has several.
TEXTS = (
    "agpl-3.0", "agpl-3.0-or-later", "apache-2.0", "apache-2.0-header", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-or-later",
    "isc", "lgpl-2.1", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-or-later", "mit", "mit-permission", "mpl-2.0", "mpl-2.0-header",
)


def standard_text(name: str) -> str:
    return pkgutil.get_data("signascope.llm", f"license_texts/{name}.txt").decode()


def _mixed(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = (x.astype(np.uint64)[..., None] + np.uint64(1)) * salt
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


class Templates:
    """A block of templates, ready to look for."""

    def __init__(self, rows: list[tuple[int, str | None]], containment: float = CONTAINMENT, seed: int = 17, rivals: frozenset[int] = frozenset()):
        split = [(i, w) for i, t in rows if (w := _WORD.findall((t or "").lower()))]
        self.ids, self.containment = [i for i, _ in split], containment
        self.rivals = {t for t, i in enumerate(self.ids) if i in rivals}
        self.vocab = {w: k for k, w in enumerate(sorted({x for _, ws in split for x in ws}), 1)}
        self.k = [min(WORDS, len(ws)) for _, ws in split]
        self.numbers: dict[tuple, int] = {}
        self.shingles, sizes = [], defaultdict(lambda: defaultdict(set))
        for t, (_, ws) in enumerate(split):
            s, k = np.array([self.vocab[w] for w in ws]), self.k[t]
            own = [self.numbers.setdefault(tuple(s[j : j + k].tolist()), len(self.numbers)) for j in range(len(s) - k + 1)]
            self.shingles.append(own)
            for c in own:
                sizes[k][c].add(len(own))
        self.sizes = {k: {c: sorted(v) for c, v in p.items()} for k, p in sizes.items()}
        self.salts = np.random.default_rng(seed).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        self.bands: dict[tuple[int, int], list[dict[bytes, list[int]]]] = defaultdict(lambda: [defaultdict(list) for _ in range(BANDS)])
        for t, own in enumerate(self.shingles):
            for band, key in zip(self.bands[self.k[t], len(own)], self.keys(np.array(own)[None, :])[0]):
                band[key].append(t)

    def keys(self, windows: np.ndarray) -> list[list[bytes]]:
        """Band keys of windows of shingle numbers (rows)."""
        return self.bands_of(_mixed(windows, self.salts).min(1))

    @staticmethod
    def bands_of(low: np.ndarray) -> list[list[bytes]]:
        return [[r[b * ROWS : (b + 1) * ROWS].tobytes() for b in range(BANDS)] for r in low]

    def met(self, k: int, n: int, starts: np.ndarray, codes: dict[int, int], end: int) -> dict[int, list[int]]:
        """Starts of the windows of ``n`` shingles that meet a template in a band, by template; shingles end before ``end``."""
        out: dict[int, list[int]] = defaultdict(list)
        c = 0
        while c < len(starts):
            some = starts[c : c + 2000]
            some = some[some < some[0] + 4000]
            c += len(some)
            lo = int(some[0])
            places = range(lo, min(int(some[-1]) + n, end))
            low = _mixed(np.array([codes.get(p, 10**6 + p) for p in places]), self.salts)
            low = np.vstack([low, np.full((int(some[-1]) + n - lo - len(places), low.shape[1]), np.iinfo(np.uint64).max)])
            width = 1
            while 2 * width <= n:
                low, width = np.minimum(low[:-width], low[width:]), 2 * width
            at = some - lo
            for a, row in zip(some.tolist(), self.bands_of(np.minimum(low[at], low[at + n - width]))):
                for t in {t for band, key in zip(self.bands[k, n], row) for t in band.get(key, ())}:
                    out[t].append(a)
        return out

    def shares(self, t: int, starts: list[int], codes: dict[int, int]):
        """(start, containment) of the windows of template ``t`` at ascending ``starts``."""
        own, n = Counter(self.shingles[t]), len(self.shingles[t])
        bag: Counter = Counter()
        common, lo, hi = 0, starts[0], starts[0]
        for a in starts:
            if a >= hi:
                bag, common, lo, hi = Counter(), 0, a, a
            for p in range(lo, a):
                if (c := codes.get(p)) in own:
                    bag[c] -= 1
                    common -= bag[c] < own[c]
            for p in range(hi, a + n):
                if (c := codes.get(p)) in own:
                    common += bag[c] < own[c]
                    bag[c] += 1
            lo, hi = a, a + n
            yield a, common / n

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(template, start, end, containment) with code point offsets: every stretch that carries a template, best first at each place."""
        low = (text or "").lower()
        words = _WORD.findall(low)
        get = self.vocab.get
        s = np.array([get(w, 0) for w in words], np.int64)
        if not s.any():
            return []
        found: list[tuple[int, float, int, int]] = []
        for k, sizes in self.sizes.items():
            if len(s) < k:
                continue
            known = s > 0
            full = reduce(np.logical_and, [known[j : len(s) - k + 1 + j] for j in range(k)])
            codes = {p: c for p in np.flatnonzero(full).tolist() if (c := self.numbers.get(tuple(s[p : p + k].tolist()))) is not None}
            places = defaultdict(list)
            for p, c in codes.items():
                for n in sizes[c]:
                    places[n].append(p)
            end = len(s) - k + 1
            for n, at in sorted(places.items()):
                need = max(1, int(np.ceil(self.containment * n - 1e-9)))
                if len(at) < need:
                    continue
                upto = np.zeros(end + 1, np.int64)
                upto[np.array(at) + 1] = 1
                upto = np.cumsum(upto)
                starts = np.flatnonzero(upto[np.minimum(np.arange(end) + n, end)] - upto[:end] >= need)
                for t, some in self.met(k, n, starts, codes, end).items():
                    found += [(t, share, a, min(a + n, end) + k - 1) for a, share in self.shares(t, some, codes) if share >= self.containment - 1e-9]
        best: list[tuple[int, float, int, int]] = []
        for t, share, a, b in sorted(set(found), key=lambda f: (f[0], -f[1], f[2])):
            if not any(t == u and a < y and x < b for u, _, x, y in best):
                best.append((t, share, a, b))
        if not best:
            return []
        if self.rivals:
            kept: list[tuple[int, float, int, int]] = []
            for t, share, a, b in sorted((x for x in best if x[0] in self.rivals), key=lambda x: (-round(x[1] * len(self.shingles[x[0]])), -x[1], x[0])):
                if not any(2 * (min(b, y) - max(a, x)) > min(b - a, y - x) for _, _, x, y in kept):
                    kept.append((t, share, a, b))
            best = [x for x in best if x[0] not in self.rivals] + kept
        spans = word_spans(text)
        return sorted((self.ids[t], spans[a][0], spans[b - 1][1], share) for t, share, a, b in best)


def notices(spark) -> DataFrame:
    """The built-in templates: license_id, name, text, the standard texts from ``len(NOTICES)`` on."""
    texts = [(x.removesuffix("-header").removesuffix("-permission"), standard_text(x)) for x in TEXTS]
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate([*NOTICES.items(), *texts])], "license_id long, name string, text string")


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, block: int = 20_000) -> DataFrame:
    """doc_id, license, start, end, containment: each stretch of each document that carries a template.

    Of overlapping stretches of one template the fullest stays, then the first.  Offsets are code points of the
    text.  Null and empty texts carry nothing, templates without words are never found,
    repeated rows repeat.  Without ``templates`` the built-in ones are looked for.
    """
    rivals = frozenset(range(len(NOTICES), len(NOTICES) + len(TEXTS))) if templates is None else frozenset()
    templates = notices(docs.sparkSession) if templates is None else templates
    rows, parts = docs.select("doc_id", "text"), []
    kind = rows.schema["doc_id"].dataType.simpleString()
    for some in blocks(templates, block, "license_id"):

        def run(batches, some=some):
            held = Templates(some, containment, rivals=rivals)
            for b in slices(batches):
                got = [(row, *m) for row, t in enumerate(b.column("text").to_pylist()) for m in held.matches(t)]
                row, *cols, share = zip(*got) if got else [()] * 5
                yield pa.record_batch(
                    [b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in cols), pa.array(share, pa.float64())],
                    names=["doc_id", "license_id", "start", "end", "containment"],
                )

        parts.append(rows.mapInArrow(run, f"doc_id {kind}, license_id long, start long, end long, containment double"))
    out = reduce(DataFrame.unionByName, parts)
    return out.join(templates.select("license_id", "name"), "license_id").select("doc_id", F.col("name").alias("license"), "start", "end", "containment") if "name" in templates.columns else out
