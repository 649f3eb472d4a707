"""The queries of this subpackage, by name, and their SQL where SQL can say what they compute."""

from __future__ import annotations

from signascope.llm import codes, decontam, jaccard, licenses, mixing, neardup, packing, pii, quality, repair, suffix, toxicity, warc
from signascope.llm.common import read


def op3_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_tokens", "copies")


def op5_licenses(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_suffix(spark, sf_dir):
    return suffix.repeats(read(spark, sf_dir, "documents")).drop("spans")


def op2_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_toxicity(spark, sf_dir):
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_pii(spark, sf_dir):
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op4_jaccard(spark, sf_dir):
    return jaccard.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_decontam(spark, sf_dir):
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_neardup(spark, sf_dir):
    return neardup.link(read(spark, sf_dir, "embeddings"))


def op11_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op12_repair(spark, sf_dir):
    return repair.report(read(spark, sf_dir, "conversations"))


def op13_codes(spark, sf_dir):
    return codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {"op1_suffix": op1_suffix, "op4_jaccard": op4_jaccard, "op2_quality": op2_quality, "op3_mixing": op3_mixing, "op5_licenses": op5_licenses, "op6_warc": op6_warc, "op7_toxicity": op7_toxicity, "op8_pii": op8_pii, "op9_decontam": op9_decontam, "op10_neardup": op10_neardup, "op11_packing": op11_packing, "op12_repair": op12_repair, "op13_codes": op13_codes}


def _case(col: str, weights: dict[str, int]) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _share_sql(src: str, parent: str, names: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    keep = f"{names}, tokens" if "source" in names else names
    return f"""(SELECT {keep}, CAST(CASE WHEN fits THEN cap WHEN level IS NULL THEN cap ELSE least(cap, floor(level * w)) END AS BIGINT) AS got
      FROM (SELECT *, min(CASE WHEN NOT fits THEN (cap / w, (budget - c) / wr) END) OVER ({by}) AS lv, lv[2] AS level FROM
        (SELECT *, c + floor((cap * wr) / w) <= budget AS fits FROM
          (SELECT *, CAST(coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c,
             CAST(sum(w) OVER ({by}) - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wr
           FROM ({src}) WINDOW r AS ({by} ORDER BY cap / w, {names})))))"""


def mixing_sql(docs: str, budget_pct: int = 60, max_epochs: int = 2, seed: str = "mix") -> str:
    """CTEs up to ``taken`` (all columns of ``docs`` with n_tokens and copies)."""
    dom = "'d' || CAST(CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 0 ELSE CAST(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS BIGINT) % 4 END AS VARCHAR)"
    one = _share_sql("SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, max(wd) AS w, max(b) AS budget FROM leaf, total GROUP BY domain", "", "domain")
    two = _share_sql("SELECT domain, lang_, CAST(sum(cap) AS BIGINT) AS cap, max(wl) AS w, max(got) AS budget FROM leaf JOIN lv1 USING (domain) GROUP BY domain, lang_", "domain", "domain, lang_")
    three = _share_sql("SELECT domain, lang_, source_, tokens, cap, 1 AS w, got AS budget FROM leaf JOIN lv2 USING (domain, lang_)", "domain, lang_", "domain, lang_, source_")
    return f"""tok AS (SELECT *, {dom} AS domain, coalesce(lang, '') AS lang_, coalesce(source, '') AS source_, coalesce(doc_id, -1) AS id_,
        CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS digest FROM {docs}),
      leaf AS (SELECT *, tokens * {max_epochs} AS cap, {_case('domain', mixing.DOMAIN_WEIGHTS)} AS wd, {_case('lang_', mixing.LANG_WEIGHTS)} AS wl FROM
        (SELECT domain, lang_, source_, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM tok GROUP BY ALL)),
      total AS (SELECT CAST(floor(coalesce(sum(tokens), 0) * {budget_pct} / 100) AS BIGINT) AS b FROM leaf),
      lv1 AS {one}, lv2 AS {two}, lv3 AS {three},
      plan AS (SELECT domain, lang_, source_, CAST(CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END AS BIGINT) AS whole, CASE WHEN tokens > 0 THEN got % tokens ELSE 0 END AS rest FROM lv3),
      keyed AS (SELECT *, md5('{seed}:' || whole || ':' || id_ || ':' || digest) AS k FROM tok JOIN plan USING (domain, lang_, source_)),
      taken AS (SELECT *, whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang_, source_ ORDER BY k, id_ ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM keyed)"""


JACCARD_SQL = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM {docs}),
      sh AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4])) END) AS g FROM w),
      sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
      pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
      ln AS (SELECT a, b FROM pr JOIN sz p ON a = p.doc_id JOIN sz q ON b = q.doc_id WHERE c * 10 >= 8 * (p.n + q.n - c)),
      rc AS (SELECT doc_id AS a, doc_id AS b FROM {docs} UNION SELECT rc.a, ln.b FROM rc JOIN ln ON rc.b = ln.a),
      cl AS (SELECT doc_id, min(r.b) AS class_id, any_value(coalesce(k.n, 0)) AS n_links FROM {docs} JOIN rc r ON r.a = doc_id LEFT JOIN (SELECT a, count(*) AS n FROM ln GROUP BY a) k ON k.a = doc_id GROUP BY doc_id)"""

def _least(*choices: str) -> str:
    return f"list_min([{', '.join(choices)}])"


def _plus(state: str, cost: str, edit: str) -> str:
    """The pair (cost, audit) ``state`` after an edit."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"


def repair_sql() -> str:
    """States: e nothing read, s after a system row, u after a user's, a after a whole pair; each has its least (cost, audit).

    A row moves every state at once: rows inserted before it, then the row deleted, kept or given a role.
    """
    blank = "[^\\x20\\x09-\\x0D]"
    crc = """list_reduce([4294967295] || flatten(list_transform(string_split(key, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"""
    put_u = f"SELECT *, {_least('u', _plus('e', '5', 'I'), _plus('s', '5', 'I'), _plus('a', '5', 'I'))} AS u1 FROM "
    put_a = f"SELECT *, {_least('a', _plus('u1', '5', 'I'))} AS a1 FROM "

    def by(state: str, to: str) -> list[str]:
        keep = f"(CASE WHEN fault IN ('b', 'd') OR i <> '{to}' THEN 1000000 WHEN fault = 't' THEN 5 ELSE 0 END)"
        give = f"(CASE WHEN fault IN ('b', 'd') OR i = '{to}' THEN 1000000 WHEN fault = 't' THEN 6 ELSE 1 END)"
        return [_plus(state, keep, "K")] + [_plus(state, give, "R")] * (to != "s")

    return f"""WITH RECURSIVE
      c AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
      k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295) % 20 AS k FROM c),
      m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS p,
          row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM m),
      f AS (SELECT *, role[1] AS i, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY p) AS j, CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'b' WHEN seen > 1 THEN 'd'
          WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
      w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, {{'c': 0, 'a': ''}} AS e, {{'c': 1000000, 'a': ''}} AS s, {{'c': 1000000, 'a': ''}} AS u, {{'c': 1000000, 'a': ''}} AS a FROM conversations
        UNION ALL
        SELECT conv_id, p + 1, {_plus('e', '2', 'D')}, {_least(_plus('s', '2', 'D'), *by('e', 's'))}, {_least(_plus('u1', '2', 'D'), *by('e', 'u'), *by('s', 'u'), *by('a1', 'u'))}, {_least(_plus('a1', '2', 'D'), *by('u1', 'a'))}
        FROM ({put_a} ({put_u} (SELECT w.*, f.i, f.fault FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.p = w.p + 1)))),
      z AS (SELECT conv_id, {_least('e', 'a1')} AS best FROM ({put_a} ({put_u} w)) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1),
      t AS (SELECT conv_id, unnest(string_split(best.a, '')) AS x, generate_subscripts(string_split(best.a, ''), 1) AS pos FROM z WHERE best.a <> ''),
      r AS (SELECT *, CAST(sum(CASE WHEN x = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS p, row_number() OVER (PARTITION BY conv_id, x = 'D' ORDER BY pos) - 1 AS n FROM t),
      g AS (SELECT r.*, f.i, f.role AS own, f.text, max(CASE WHEN n = 0 AND x = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY r.conv_id) AS lead
        FROM r LEFT JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.p = f.p WHERE x <> 'D'),
      h AS (SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN own WHEN (n - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY n)) AS hash FROM g GROUP BY conv_id),
      y AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
          count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (j IS NOT NULL AND i || j NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
      SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(best.c AS BIGINT) AS cost, best.a AS audit, coalesce(hash, sha256('')) AS repaired_sha256
      FROM z LEFT JOIN y ON z.conv_id IS NOT DISTINCT FROM y.conv_id LEFT JOIN h ON z.conv_id IS NOT DISTINCT FROM h.conv_id"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    apart = "CAST(list_sum(list_transform(range(1, len(x.s) + 1), lambda i: (x.s[i] - b.s[i]) * (x.s[i] - b.s[i]))) AS BIGINT)"
    ctes = [
        f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"x AS (SELECT r, p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] AS s FROM v, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS (SELECT p, r - 1 AS e, s FROM x WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS (SELECT x.r, x.p, min({{'d': {apart}, 'e': b.e}}) AS m FROM x JOIN b{k} b ON x.p = b.p GROUP BY ALL)")
        if k < rounds:
            sums = f"SELECT p, e, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c FROM (SELECT a.p, a.m.e AS e, unnest(x.s) AS c, generate_subscripts(x.s, 1) AS i FROM a{k} a JOIN x ON a.r = x.r AND a.p = x.p) GROUP BY ALL"
            ctes.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(n.s, b.s) AS s FROM b{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS s FROM ({sums}) GROUP BY ALL) n ON b.p = n.p AND b.e = n.e)")
    ctes.append(f"c AS (SELECT r, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    return f"""WITH {', '.join(ctes)}
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(s) AS c, generate_subscripts(s, 1) AS i FROM b{rounds})) AS codebooks_sha256
      FROM v JOIN c USING (r)"""


ORACLES = {
    "op12_repair": repair_sql(),
    "op13_codes": codes_sql(),
    "op4_jaccard": f"WITH RECURSIVE {JACCARD_SQL.format(docs='documents')} SELECT doc_id, class_id, n_links FROM cl",
    "op3_mixing": f"WITH {mixing_sql('documents')} SELECT doc_id, lang, source, n_tokens, copies FROM taken WHERE copies > 0",
    "op6_warc": """
      WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
      f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
      SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN first_page IS NOT NULL AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first_page IS NOT NULL AND page_id <> first_page THEN first_page END AS refers_to
      FROM p LEFT JOIN f USING (payload_digest)""",
    "op10_neardup": """
      WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      n AS (SELECT *, sqrt(list_dot_product(v, v)) AS r FROM e),
      ln AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.r * y.r) >= 0.98),
      rc AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT rc.a, ln.b FROM rc JOIN ln ON rc.b = ln.a)
      SELECT vec_id, any_value(coalesce(k.n, 0)) AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
      FROM embeddings JOIN rc r ON r.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM ln GROUP BY a) k ON k.a = vec_id GROUP BY vec_id""",
}
