"""Packing, conversation repair and vector codes against plain Python and on edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signascope.llm import codes, packing, repair

DOCS = "doc_id long, text string, lang string, length string, sequence_id int"


# op11
def packed(spark, texts, ids=None, **options):
    rows = [(k if ids is None else ids[k], t, "en", "own", 3) for k, t in enumerate(texts)]
    return packing.pack(spark.createDataFrame(rows, DOCS).coalesce(2), with_ids=True, **options).collect()


def whole_ids(text):
    return [*packing._tokenizer(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1]


def prose(rng, n):
    return " ".join(rng.choice(("The cat,", "sat on", "Éa été", "x.", "a's mat", "1999", "ßüß!")) for _ in range(n))


def test_packing_keeps_every_id_once(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 400)) for _ in range(60)] + [None, "", prose(rng, 6000), "x" * 9000, "same", "same", "a\x1cb <|endoftext|>İ. 文字"]
    rows = packed(spark, texts, capacity=512, piece=64, group=20)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k, text in enumerate(texts):
        ids, at = whole_ids(text), 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids"]) == (at, len(ids), own) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
        padding += 0 if at & (at - 1) == 0 else 512 - at
    assert padding < 0.05 * sum(r["length"] for r in rows)


def test_packing_edges(spark):
    assert packed(spark, []) == []
    rows = packed(spark, [None, "", "same text", "same text"], ids=[None, None, 7, 7])
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows if r["start"] == 0)[:2] == [(0, 1), (0, 1)]
    assert sum(r["length"] for r in rows) == 2 + 2 * len(whole_ids("same text"))


def test_words_give_the_ids_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 60)
    words, rng = packing.Words(packing.default_tokenizer()), random.Random(5)
    signs = [*"abzABZ '.,;:!?\"-0123\n\t\x1c\x85 éÉßΣσςİı中🙂²¼ﬁÅ", "é", "<|endoftext|>", "'LL", "İ.", "the", "And,"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        assert [*np.frombuffer(words.ids([text])[0], "<u4").tolist(), 1] == whole_ids(text), text


def test_words_ending_in_any_mark_give_the_ids_of_the_whole_text():
    words, rng = packing.Words(packing.default_tokenizer()), random.Random(6)
    assert set("%#$*&@~=+-_/") <= set(packing.MARKS)  # noisy words share their core
    signs = [*packing.MARKS, *"aBé1'>|<ȺʼnßΣ中", "\u0338", "\u0301", " ", " ", "<|endoftext|>", "'s", "Word", "été"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        assert [*np.frombuffer(words.ids([text])[0], "<u4").tolist(), 1] == whole_ids(text), text


def test_known_words_are_looked_up_and_not_walked():
    class Known(dict):
        def __iter__(self):
            raise AssertionError("every older word is visited for a few new ones")

    words = packing.Words(packing.default_tokenizer())
    words.old = Known({"older": b"1234"})
    assert words.ids(["older older"]) == [b"12341234"]


def test_differencing_is_near_equal_and_rises():
    rng = random.Random(8)
    for _ in range(100):
        sizes, count = [rng.randrange(1, 200) for _ in range(rng.randrange(1, 60))], rng.randrange(1, 12)
        found = packing.difference(sizes, count)
        assert sorted(k for w in found for k in w) == list(range(len(sizes))) and len(found) <= count
        sums = [sum(sizes[k] for k in w) for w in found] + [0] * (count - len(found))
        assert max(sums) - min(sums) <= max(sizes)
    assert packing.difference([8, 7, 6, 5, 4], 2) and sorted(sum([8, 7, 6, 5, 4][k] for k in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    # five pieces of 60 do not fit three windows of 100
    assert [len(w) for w in packing.windows_of([60] * 5, 100)] == [1] * 5


# op12
def brute(rows):
    """Every way to keep, rerole or delete the rows with up to two inserts at each place."""
    best = None
    for edits in itertools.product(*[[("D", "")] + ([] if r == "-" else [("K", r.lower())] + [("R", t) for t in "ua" if t != r.lower()]) for r in rows]):
        for put in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            initials = put[0] + "".join(e[1] + p for e, p in zip(edits, put[1:]))
            body = initials[1:] if initials.startswith("s") else initials
            if initials and (body == "" or len(body) % 2 or body != "ua" * (len(body) // 2)):
                continue
            audit = "I" * len(put[0]) + "".join(e[0] + "I" * len(p) for e, p in zip(edits, put[1:]))
            cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[x] for x in audit) + sum(5 for r, e in zip(rows, edits) if r.isupper() and e[0] != "D")
            best = min(best or (cost, audit), (cost, audit))
    return best


def test_parse_matches_brute_force():
    cases = ["", *map("".join, itertools.chain.from_iterable(itertools.product("suax-SUAX", repeat=n) for n in (1, 2)))]
    rng = random.Random(2)
    cases += ["".join(rng.choice("ssuuaax-SUA") for _ in range(rng.choice((3, 3, 4)))) for _ in range(70)]
    for rows in cases:
        assert repair.parse(rows) == brute(rows), rows
    assert repair.parse("suauaua") == (0, "KKKKKKK")


def plain_report(rows):
    """The report of rows (conv_id, turn, role, text), by conversation, in plain Python."""
    out, space = {c: [] for c, *_ in rows}, "\x20\x09\x0a\x0b\x0c\x0d"
    one = lambda x: " " if x is None else str(x)
    for c, t, r, x in rows:
        k = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        r, x = "user" if k == 4 else one(r), "" if k == 1 else one(x)
        if k == 2:
            x = x.translate({ord(z): None for z in ".!?"})
        out[c] += [(t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    made = {}
    for c, own in out.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(f"{len(z[1])}:{z[1]}:{z[2]}".encode()).hexdigest()))
        turns, seen, faults, rowcodes = [z[0] for z in own if z[0] is not None], set(), "", ""
        for t, r, x in own:
            fault = "b" if not x.strip(space) else "d" if (r, x) in seen else "t" if x.strip(space)[-1] not in ".!?" else "."
            seen.add((r, x))
            kind = r[:1] if r[:1] and r[:1] in "sua" else "x"
            faults, rowcodes = faults + fault, rowcodes + ("-" if fault in "bd" else kind.upper() if fault == "t" else kind)
        cost, audit = repair.parse(rowcodes)
        lines, k = [], 0
        for edit in audit:
            if edit == "D":
                k += 1
                continue
            system = bool(lines) and lines[0][2]
            given = "user" if (len(lines) - system) % 2 == 0 else "assistant"
            t, r, x = (None, given, "") if edit == "I" else own[k]
            lines.append((r if edit == "K" else given, x, edit == "K" and r[:1] == "s"))
            k += edit != "I"
        illegal = sum((a[1][:1] or "?") + (b[1][:1] or "?") not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x, _ in lines).encode()).hexdigest()
        made[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest, lines)
    return made


def conversations(seed=4):
    rng = random.Random(seed)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (5000, 1, "", "x."), (5001, None, "user", "one."), (5001, None, "user", "one."), (5001, 2, "assistant", "two.")]
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool"))
            rows.append((c, t * rng.choice((1, 1, 9000)), role, rng.choice(("Yes.", "no", " \t", "", "why?  ", "ß" * 40 + "!", None))))
    return rows


@pytest.mark.parametrize("block", [4096, 2])
def test_repair_matches_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("own"), "cost": F.lit(1), "n": F.lit(9)})
    want = plain_report(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(table).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    lines = {}
    for r in sorted(repair.repaired(repair.damaged(table)).collect(), key=lambda r: r["position"]):
        assert r["position"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append((r["role"], r["text"]))
    assert lines == {c: [(r, x) for r, x, _ in w[-1]] for c, w in want.items() if w[-1]}


def test_repair_edges(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert repair.report(spark.createDataFrame([], kind)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair.report(spark.createDataFrame([(gone, 0, "user", "Hi.")], kind)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    # one row five thousand times is one row and its copies
    kept = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    (r,) = repair.report(spark.createDataFrame([(kept, 0, "user", "Hi.")] * 5000, kind)).collect()
    assert (r["duplicate"], r["cost"], r["audit"]) == (4999, 2 * 5000, "D" * 5000)


# op13
def test_tree_finds_what_a_full_look_finds():
    rng = np.random.default_rng(1)
    for spread, n, dims in ((3, 64, 4), (40, 64, 4), (10**6, 64, 2), (1 << 27, 64, 4), (1, 40, 1), (5, 3, 4)):
        entries, rows = (rng.integers(-spread, spread + 1, (k, dims)) for k in (n, 500))
        rows[:20] = entries[rng.integers(0, n, 20)]
        full = ((rows[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(-1)
        at, d = codes.Gnat(entries).nearest(rows)
        assert d.tolist() == full.min(1).tolist() and at.tolist() == full.argmin(1).tolist()


def test_tree_rules_children_out(monkeypatch):
    entries = np.stack([np.arange(64) * 1000, np.zeros(64, np.int64)], axis=1)
    seen = []
    meet = codes.Gnat._meet
    monkeypatch.setattr(codes.Gnat, "_meet", lambda self, rows, asked, at, *a: seen.append(len(asked) * len(at)) or meet(self, rows, asked, at, *a))
    codes.Gnat(entries).nearest(entries + 3)
    assert sum(seen) < 0.5 * 64 * 64


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(np.int64), c) for i, v, c in rows]
    cut = np.stack([np.split(v, parts) for _, v, _ in rows])
    first = sorted(range(len(rows)), key=lambda k: rows[k][0])[:entries]
    books = cut[first].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        far = ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
        at = far.argmin(-1)
        for p, e in itertools.product(range(parts), range(len(first))) if step < rounds else ():
            if (at[:, p] == e).any():
                books[p, e] = cut[at[:, p] == e, p].sum(0) // (at[:, p] == e).sum()
    error = far.min(-1).sum(-1)
    total = {}
    for (_, _, c), e in zip(rows, error.tolist()):
        total[c] = total.get(c, 0) + e
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return {i: ("".join(f"{x:02x}" for x in a), e, total[c], sha) for (i, _, c), a, e in zip(rows, at.tolist(), error.tolist())}


VECTORS = "vec_id long, embedding array<float>, label int, error string"


@pytest.mark.parametrize("n", [5, 200])
def test_codes_match_plain_numpy(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k), np.round(rng.normal(0, 0.2, 32), 2).astype(np.float32).tolist(), int(rng.integers(0, 3)) if k % 7 else None) for k in rng.permutation(n)]
    rows[1] = (rows[1][0], rows[0][1], rows[1][2])
    odd = [(900, None, 1, ""), (901, [None] + [0.5] * 31, 1, ""), (902, [float("nan")] * 32, 1, ""), (903, [float("inf")] * 32, 1, ""), (904, [], 1, "")]
    table = spark.createDataFrame([(*r, "own") for r in rows] + odd, VECTORS).repartition(3)
    got = {r["vec_id"]: tuple(r)[1:] for r in codes.compress(table).collect()}
    assert got == plain_codes(rows)


def test_codes_edges(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(1, [0.5] * 16, None, ""), (1, [0.5] * 16, None, ""), (None, [0.5] * 16, 4, ""), (3, [1e30] * 16, 4, ""), (4, [0.5] * 3, 4, "")]
    got = codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 5 and [r["code"] for r in got if r["vec_id"] == 4] == [None]
    assert {r["error"] for r in got if r["vec_id"] != 4} == {0}
