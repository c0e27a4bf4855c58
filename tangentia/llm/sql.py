"""DuckDB SQL that states what the queries return, where SQL can state it."""

from tangentia.llm import codes as _c
from tangentia.llm import mixing as _m
from tangentia.llm import quality as _q

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def lowered(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w
), t AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (
  SELECT doc_id, doc_id AS other FROM n
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN c ON c.doc_id = n.doc_id
"""

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{_TOKEN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{_TOKEN}') AS w FROM benchmark),
i AS (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda s: array_to_string(w[s:s+9], ' '))) AS k,
         least(len(w), 10) AS n
  FROM b WHERE len(w) > 0
), p AS (
  SELECT doc_id, n, s, array_to_string(w[s:s+n-1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
), h AS (SELECT DISTINCT p.doc_id, p.s, p.n, i.item_id FROM p JOIN i ON i.k = p.k AND i.n = p.n),
q AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY 1),
c AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(q.n_hit, 0)::BIGINT AS n_hit,
       coalesce(c.n_items, 0)::BIGINT AS n_items, sha256(coalesce(c.items, '')) AS items_sha256,
       coalesce(q.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares of one length."""
    m = f"(({p})[k] + ({q})[k]) / 2"
    half = [f"(CASE WHEN ({x})[k] > 0 THEN ({x})[k] * log2(({x})[k] / ({m})) ELSE 0 END)" for x in (p, q)]
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda k: ({half[0]} + {half[1]}) / 2)), 0))"


def quality() -> str:
    kinds = ("a-z", "A-Z", "0-9", None, r".,;:!?''\"()\-", "#*$%&|<>")
    counts = [
        r"length(regexp_replace(c, '[\x00-\x7F]+', '', 'g'))" if k is None else f"length(regexp_replace(c, '[^{k}]+', '', 'g'))" for k in kinds
    ]
    return rf"""
WITH d AS (
  SELECT doc_id, lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS c
  FROM documents
), g AS (
  SELECT doc_id, i, k FROM (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
  ), LATERAL (SELECT array_to_string(w[i:i+2], ' ') AS k)
), r AS (
  SELECT doc_id, count(DISTINCT x) AS n_repeat_words FROM (
    SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS x
    FROM g JOIN (SELECT doc_id, k FROM g GROUP BY 1, 2 HAVING count(*) > 1) m ON m.doc_id = g.doc_id AND m.k = g.k
  ) GROUP BY 1
), f0 AS (
  SELECT d.doc_id, d.lang, text, len(w) AS n, w, length(c) AS word_chars, [{", ".join(counts)}] AS own,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) AS lines,
         len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS own_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id
), f AS (SELECT *, list_append(own, (word_chars - list_sum(own))::BIGINT) AS classes FROM f0),
lc AS (
  SELECT lang, count(*) AS docs,
         {", ".join(f"quantile_disc(floor({_q.SHARE_STEPS} * (classes[{k}] / word_chars::DOUBLE)), 0.5) + 0.5 AS n{k}" for k in range(1, 8))}
  FROM f WHERE lang IS NOT NULL AND text IS NOT NULL AND word_chars > 0 GROUP BY lang
), lw AS (
  SELECT lang, v, count(*) AS n FROM (SELECT lang, unnest(w) AS v FROM f WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY 1, 2
), lt AS (
  SELECT lang, list(v ORDER BY k) AS v, list(n ORDER BY k) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, v) AS k FROM lw
    WHERE length(v) <= {_q.COMMON_LENGTH} AND regexp_matches(v, '{_q.COMMON_WORD}')
  ) WHERE k <= {_q.COMMON_WORDS} GROUP BY lang
), ls AS (SELECT lang, sum(n) AS words FROM lw GROUP BY lang),
q AS (
  SELECT lc.lang, list_transform([{", ".join(f"n{k}" for k in range(1, 8))}], lambda x: x::DOUBLE / ({" + ".join(f"n{k}" for k in range(1, 8))})) AS chars,
         coalesce(lt.v, []) AS v, list_transform(coalesce(lt.n, []), lambda x: x::DOUBLE / words) AS shares
  FROM lc JOIN ls USING (lang) LEFT JOIN lt USING (lang)
  WHERE docs >= {_q.LEAST_ROWS} QUALIFY row_number() OVER (ORDER BY docs DESC, lc.lang) <= {_q.MOST_REFERENCES}
), p AS (
  SELECT doc_id, list_transform(classes, lambda x: x::DOUBLE / word_chars) AS c, q.chars,
         list_append(shares, greatest(1.0 - coalesce(list_sum(shares), 0), 0)) AS s, n,
         list_transform(v, lambda x: len(list_filter(w, lambda y: y = x OR y = upper(x[1]) || x[2:] AND x[1] BETWEEN 'a' AND 'z'))) AS own
  FROM f, q WHERE n > 0 AND (f.lang IS NULL OR f.lang IN (SELECT lang FROM q))
), m AS (
  SELECT doc_id, c, chars, s, list_transform(list_append(own, n - coalesce(list_sum(own), 0)::BIGINT), lambda x: x::DOUBLE / n) AS o
  FROM p WHERE abs(c[4] - chars[4]) <= {_q.SCRIPT_GAP}
), j AS (
  SELECT doc_id, round(min({_js("c", "chars")}), 6) AS chars_js, round(min({_js("o", "s")}), 6) AS words_js FROM m GROUP BY doc_id
), e AS (
  SELECT f.*, chars_js, words_js, n < {_q.LEAST_BASE_WORDS} OR 100 * n_repeat_words > {_q.MOST_REPEAT_PERCENT} * n AS base_failed
  FROM f LEFT JOIN j ON j.doc_id = f.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, classes[6]::BIGINT AS n_symbols,
       (lines - own_lines)::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       chars_js, words_js, base_failed,
       NOT base_failed AND NOT (word_chars >= {_q.LEAST_CHARS} AND coalesce(chars_js, 0) > {_q.BOTH_CHARS_JS}
         AND (chars_js > {_q.MOST_CHARS_JS} OR (n >= {_q.LEAST_WORDS} AND words_js > {_q.BOTH_WORDS_JS}))) AS kept
FROM e
"""


def _escaped_length(column: str, chars: str) -> str:
    return f"length(regexp_replace({column}, '([{chars}])', '+\\1', 'g'))"


CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + {_escaped_length("role", "#<:" + chr(92) * 2)} + {_escaped_length("text", "#<" + chr(92) * 2)})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
       CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept > page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON k.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         (('0x' || substr(md5('{_m.SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         coalesce(greatest(round(length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))
           / greatest(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 1)::DOUBLE, 6), 0.05), 0.05) AS q,
         md5(coalesce(text, '')) AS tie
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size,
         [{", ".join(map(str, _m.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_m.WEIGHTS)}] AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, {_m.CAP} * source_size AS most, row_number() OVER r AS k, {_m.CAP} * source_size / w::DOUBLE AS r,
         coalesce(sum({_m.CAP} * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
         coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone_w
  FROM s WINDOW r AS (ORDER BY {_m.CAP} * source_size / w::DOUBLE, source NULLS LAST)
), l AS (
  SELECT arg_min(share, k) AS level FROM (
    SELECT k, r, ((SELECT sum(source_size) FROM s) - gone)::DOUBLE / ((SELECT sum(w) FROM s) - gone_w) AS share FROM o
  ) WHERE share <= r
), t AS (
  SELECT source, source_size::BIGINT AS source_size, least(most::DOUBLE, level * w) AS target FROM o, l
), e AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t
), x AS (
  SELECT d.*, e.* EXCLUDE (source), round(target - epochs * source_size)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(least(size, budget - before), 0))::BIGINT AS taken
FROM x
"""


def _integers(scale: int) -> str:
    """Rows of ``embeddings`` that take part, with their integers ``v``."""
    return f"""(
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""


def _score(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])::BIGINT"


TOP = f"""
WITH r AS {_integers(1024)}, s AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_score("q.v", "c.v")} AS score
  FROM r q JOIN r c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

NEGATIVES = f"""
WITH r AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM {_integers(256)} WHERE label IS NOT NULL AND vec_id IS NOT NULL
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, {_score("a.v", "c.v")} AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) QUALIFY row_number() OVER w <= 10
"""


def codes() -> str:
    def assigned(k: int) -> str:
        return f"""a{k} AS (
  SELECT k, s, x, min(d) AS d, arg_min(e, d * {_c.ENTRIES} + e) AS e FROM (
    SELECT p.*, e, list_sum(list_transform(list_zip(p.x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{k} b ON b.s = p.s
  ) GROUP BY k, s, x
)"""

    def moved(k: int) -> str:
        return f"""m{k} AS (
  SELECT s, e, list(m ORDER BY j) AS y FROM (
    SELECT s, e, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM a{k}, range(1, (SELECT max(len(x)) FROM p) + 1) t(j) GROUP BY s, e, j
  ) GROUP BY s, e
), b{k + 1} AS (SELECT b.s, b.e, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m ON m.s = b.s AND m.e = b.e)"""

    rounds = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(_c.ROUNDS))
    return f"""
WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, * FROM {_integers(_c.SCALE)}),
p AS (
  SELECT k, s, v[s * len(v) // {_c.PARTS} + 1 : (s + 1) * len(v) // {_c.PARTS}] AS x FROM r, range({_c.PARTS}) t(s)
), b0 AS (SELECT s, k - 1 AS e, x AS y FROM p WHERE k <= {_c.ENTRIES}),
{rounds},
{assigned(_c.ROUNDS)},
c AS (
  SELECT k, string_agg(printf('%02x', e), '' ORDER BY s) AS code, sum(d)::BIGINT AS error FROM a{_c.ROUNDS} GROUP BY k
), h AS (
  SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY s, e)) AS codebooks_sha256 FROM b{_c.ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM r JOIN c USING (k), h
"""
