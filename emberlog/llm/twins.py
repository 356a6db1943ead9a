"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL = {
    "op6_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_fold('text')}, {_ALNUM_WORDS}), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all({_fold('text')}, {_ALNUM_WORDS}), []) AS w FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))
), grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)
), found AS (
  SELECT rid, item_id, i, n FROM grams JOIN wanted USING (n, gram)
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)""",
}

SQL["op3_url_filters"] = rf"""
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN {_fold("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), r(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), u AS (SELECT DISTINCT host, path FROM p), best AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path AND k = 1"""


def _places(pattern: str) -> str:
    """Start and end of each match, from the lengths of pieces and matches."""
    return f"""SELECT rid, unnest(range(1, len(m) + 1)) AS i, m, s FROM (
      SELECT rid, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS s FROM d)"""


def _secrets() -> str:
    from emberlog.llm import secrets as S

    quoted = lambda p: p.replace("'", "''")
    a = quoted(S.ASSIGN)
    parts = []
    for k, pattern in enumerate((a, S.ACCESS, S.HEX, S.TOKEN)):
        value = f"regexp_extract(v, '{a}', 2)" if k == 0 else "v"
        parts.append(f"""SELECT rid, {k} AS kind, start, start + length(v) AS stop, {value} AS value FROM (
          SELECT rid, m[i] AS v, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
          FROM ({_places(pattern)}))""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS repo FROM documents),
every AS ({' UNION ALL '.join(parts)}),
base AS (SELECT * FROM every WHERE kind < 3 AND (kind > 0 OR length(value) >= {S.MIN_VALUE})),
tokens AS (
  SELECT * FROM every e WHERE kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = e.rid AND b.start < e.stop AND e.start < b.stop)
), spans AS (SELECT * FROM base UNION ALL SELECT * FROM tokens),
owners AS (SELECT value, count(DISTINCT split_part(repo, '/', 1)) AS owners FROM spans JOIN d USING (rid) GROUP BY value),
judged AS (SELECT *, owners < {S.EXAMPLE_OWNERS} AS live, {S.KINDS}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS said FROM spans JOIN owners USING (value)),
per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_example
  FROM judged GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN per USING (rid)"""


SQL["op5_secrets"] = _secrets()


def _chat() -> str:
    from emberlog.llm import chat as C

    b = C.Budget()
    body = "replace(text, '\\', '\\\\')"
    role = "replace(role, '\\', '\\\\')"
    for control, inside in C.ESCAPES:
        body, role = f"replace({body}, '{control}', '{inside}')", f"replace({role}, '{control}', '{inside}')"
    cases = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in C.CASES)
    return f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {cases})
), written AS (
  SELECT *, '### ' || replace({role}, ': ', ':\\ ') || ': ' || {body} || '</turn>' || chr(10) AS fmt FROM every
), counted AS (
  SELECT *, len(regexp_extract_all(fmt, '{C.TOKEN}')) AS tokens, row_number() OVER conv AS no FROM written
  WINDOW conv AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), placed AS (
  SELECT *, max(CASE WHEN no = 1 AND role = '{b.system}' THEN tokens END) OVER (PARTITION BY conv_id) AS sys,
    sum(tokens) OVER (PARTITION BY conv_id ORDER BY no) - tokens AS before
  FROM counted
), sized AS (
  SELECT *, no = 1 AND sys IS NOT NULL AS is_system, before - coalesce(sys, 0) AS start,
    greatest({b.window - b.history} - coalesce(sys, 0), {b.least}) AS size
  FROM placed
), cells AS (
  SELECT *, start // size AS cell, (start + tokens - 1) // size AS last FROM sized WHERE NOT is_system
), fresh AS (
  SELECT *, CASE WHEN last > cell THEN 2 * last ELSE 2 * cell + 1 END AS win FROM cells
), windows AS (
  SELECT conv_id, win, min(start) AS begin, sum(length(fmt)) AS chars FROM fresh GROUP BY conv_id, win
), repeats AS (
  SELECT w.conv_id, w.win, sum(length(f.fmt)) AS chars FROM windows w JOIN fresh f
  ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.start < w.begin AND f.start >= w.begin - {b.history} GROUP BY 1, 2
), system AS (SELECT conv_id, length(fmt) AS chars FROM sized WHERE is_system),
sizes AS (
  SELECT s.conv_id, coalesce(n.n, 0) AS n, coalesce(n.chars, 0) + coalesce(y.chars, 0) * greatest(coalesce(n.n, 0), 1) AS chars
  FROM (SELECT DISTINCT conv_id FROM every) s
  LEFT JOIN (SELECT w.conv_id, count(*) AS n, sum(w.chars + coalesce(r.chars, 0)) AS chars FROM windows w
    LEFT JOIN repeats r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.win = r.win GROUP BY 1) n ON s.conv_id IS NOT DISTINCT FROM n.conv_id
  LEFT JOIN system y ON s.conv_id IS NOT DISTINCT FROM y.conv_id
), said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY no) FILTER (role = '{b.target}'), '') AS learned
  FROM counted GROUP BY conv_id
)
SELECT said.conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  chars::BIGINT AS formatted_chars, greatest(n, 1)::BIGINT AS n_windows
FROM said JOIN sizes ON said.conv_id IS NOT DISTINCT FROM sizes.conv_id"""


SQL["op1_chat"] = _chat()


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(
    f"substr('{_B32}', ((('0x' || substr(hex, {i + 1}, 10))::BIGINT >> {35 - 5 * k}) % 32 + 1)::INTEGER, 1)" for i in range(0, 40, 10) for k in range(8))

SQL["op10_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_ok
FROM p JOIN firsts USING (hex)"""

_NORM = "list_transform(embedding, lambda x: x::DOUBLE)"
SQL["op2_embeddings"] = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT vec_id, label, {_NORM} AS v FROM embeddings)
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT * FROM e WHERE norm > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id"""

_SPACED_WORDS = r"'[^\x20\x09-\x0D]+'"
SQL["op4_jaccard"] = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_fold('text')}, {_SPACED_WORDS}), []) AS w FROM documents
), s AS (
  SELECT DISTINCT rid, gram FROM (
    SELECT rid, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
      SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(4, len(w)) AS n FROM d WHERE len(w) > 0)))
), sizes AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY ALL),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM common JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b JOIN d x ON x.rid = a JOIN d y ON y.rid = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (rid) LEFT JOIN least ON least.a = doc_id"""


def _codes() -> str:
    from emberlog.llm import codes as K

    c = K.Code()
    ctes = [f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({c.scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT rid, (j - 1) // (len(v) // {c.parts}) AS part, (j - 1) % (len(v) // {c.parts}) AS pos, v[j] AS x
  FROM (SELECT rid, v, unnest(range(1, len(v) + 1)) AS j FROM kept)
), book0 AS (SELECT rid - 1 AS entry, part, pos, x AS y FROM parts WHERE rid <= {c.entries})"""]
    for r in range(c.rounds + 1):
        ctes.append(f"""far{r} AS (
  SELECT rid, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM parts JOIN book{r} USING (part, pos) GROUP BY rid, part, entry
), near{r} AS (
  SELECT rid, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) AS k FROM far{r}) WHERE k = 1
)""")
        if r < c.rounds:
            ctes.append(f"""mean{r} AS (
  SELECT entry, part, pos, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN near{r} USING (rid, part) GROUP BY entry, part, pos
), book{r + 1} AS (
  SELECT entry, part, pos, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM book{r} LEFT JOIN mean{r} USING (entry, part, pos)
)""")
    return ", ".join(ctes) + f""", coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{c.rounds} GROUP BY rid
), named AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{c.rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), named"""


SQL["op13_codes"] = _codes()


def _phrases() -> str:
    from emberlog.llm import phrases as P

    r = P.Rule()
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p WHERE len(w) >= {k})"
        for k in range(1, P.DEPTH + 1))
    return rf"""
WITH d AS (
  SELECT coalesce(lang, '{P.UNKNOWN}') AS lang, unnest(string_split_regex({_fold("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM ({grams}) GROUP BY lang, k, phrase HAVING count(*) >= {r.least}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS mid FROM c),
sides AS (
  SELECT cuts.*, x.a AS l, y.a AS r, ({r.unit}::HUGEINT * cuts.a) // (x.a + y.a) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.k = mid AND x.phrase = array_to_string(cuts.w[1:mid], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - mid AND y.phrase = array_to_string(cuts.w[mid + 1:], ' ')
), worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, mid) AS o FROM sides) WHERE o = 1),
around AS (
  SELECT lang, s AS k, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c)) GROUP BY 1, 2, 3
), kept AS (
  SELECT worst.* FROM worst LEFT JOIN around ON around.lang = worst.lang AND around.k = worst.k AND around.phrase = worst.phrase
  WHERE longer IS NULL OR 100 * longer < {r.cover} * worst.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {r.top}"""


SQL["op12_phrases"] = _phrases()

# The given pages mark their article and have headings and paragraphs in it; references are &amp; (also cut short) and &quot;.
SQL["op11_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT row_number() OVER () AS rid, page_id, url, string_split_regex(body, '</?(p|h1)>') AS parts FROM a),
c AS (SELECT rid, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM b),
d AS (
  SELECT rid, i, trim(regexp_replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '[\s\x0B\xA0]+', ' ', 'g')) AS line FROM c
), e AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS text FROM d WHERE line <> '' GROUP BY rid)
SELECT page_id, url, coalesce(text, '') AS text, coalesce(length(text), 0)::BIGINT AS n_chars FROM b LEFT JOIN e USING (rid)"""
