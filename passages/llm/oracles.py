"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from .chat import SQL as OP4
from .secrets import ACCESS, ASSIGN, ENCODINGS, HEX

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT a AS d, a AS r FROM e UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.r
), m AS (
  SELECT d, min(r) AS m FROM r GROUP BY d
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.d = w.doc_id
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL
), k AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[a : a + 12], ' ') AS p, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS a FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, a, n, array_to_string(w[a : a + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM w, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)
), h AS (
  SELECT d.doc_id, d.a, d.n, k.item FROM d JOIN k ON k.p = d.p AND k.n = d.n
), c AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS x FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The white space that lines are trimmed of, as in lines.py.
_TRIMMED = "' ' || " + " || ".join(f"chr({c})" for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# Pages with an article, as all of the tables have: its text without inline marks, with a space for each other mark.
OP1 = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '(?s)<!--.*?-->|<(script|style|nav|aside|form|footer)\b.*?</(script|style|nav|aside|form|footer)>', ' ', 'g') AS h FROM pages
), t AS (
  SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(b|i|em|strong|a|span)>', '', 'g'), '<[^>]+>', ' ', 'g') AS t FROM a
), d AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM t
), s AS (
  SELECT page_id, url, trim(regexp_replace(t, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS text FROM d
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM s
"""


_KIND_SQL = r"""SELECT doc_id, {k} AS k, f[i] AS v, {value} AS kept,
    CAST(list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, regexp_split_to_array(t, '{pattern}') AS g, {group} AS w FROM d))"""


def _kind(k: int, pattern: str, value: str = "true", group: str = "NULL") -> str:
    return _KIND_SQL.format(k=k, pattern=pattern.replace("'", "''"), value=value, group=group.format(pattern.replace("'", "''")))


def _tail_sql(z: str) -> str:
    """The same rational approximation of the normal distribution as in secrets.py."""
    t = f"(1.0 / (1.0 + 0.2316419 * least(abs({z}), 30.0)))"
    upper = f"(exp(-pow(least(abs({z}), 30.0), 2) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {z} < 0 THEN 1.0 - {upper} ELSE {upper} END)"


def _two_sided_sql(z: str) -> str:
    return f"least(1.0, 2.0 * {_tail_sql(f'abs({z})')})"


_FITS = "WHEN regexp_full_match(body, '%s') THEN {'e': '%s', 'a': '%s'}"
_FIT = "CASE " + " ".join(_FITS % (pattern, name, alphabet) for name, pattern, alphabet in ENCODINGS[:-1]) + " ELSE {'e': '%s', 'a': '%s'} END" % ENCODINGS[-1][::2]
_LN = "-ln(greatest({0}, 1e-300))"

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, k, s, s + length(v) AS e FROM (
  {_kind(0, ASSIGN, "length(w[i]) >= 6", "regexp_extract_all(t, '{}', 2)")} UNION ALL {_kind(1, ACCESS, "length(f[i]) >= 20")} UNION ALL {_kind(2, HEX, "length(f[i]) >= 24")}) WHERE kept
), tok AS (
  SELECT doc_id, s, s + length(v) AS e, translate(regexp_replace(v, '=+$', ''), '-_=', '+/+') AS body FROM ({_kind(3, '[A-Za-z0-9+/_=-]{16,}')}) WHERE NOT regexp_full_match(v, '[0-9]+')
), enc AS (
  SELECT *, fit.e AS encoding, fit.a AS alphabet, length(fit.a) AS m, length(body) AS n FROM (SELECT *, {_FIT} AS fit FROM tok)
), code AS (
  SELECT * EXCLUDE (fit), list_transform(string_split(body, ''), lambda c: instr(alphabet, c) - 1) AS c FROM enc
), meas AS (
  SELECT *, CAST(m AS DOUBLE) / n * list_sum(list_transform(list_distinct(c), lambda y: pow(len(list_filter(c, lambda z: z = y)), 2))) - n AS chi,
    list_sum(list_transform(range(1, n), lambda j: (c[j] - (m - 1) / 2) * (c[j + 1] - (m - 1) / 2))) / ((m * m - 1) / 12) / sqrt(n - 1) AS serial,
    CAST(len(list_filter(range(1, n), lambda j: (c[j] < m / 2) <> (c[j + 1] < m / 2))) AS DOUBLE) AS turns,
    length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'), '[0-9]+', '0', 'g'), '[^aA0]+', '-', 'g')) - 1 AS changes,
    CAST(m - 1 AS DOUBLE) AS free, CAST(n - 1 AS DOUBLE) AS places, n * greatest(m * 0.0667 - 1, 0.5) AS uneven
  FROM code WHERE n >= 8
), z AS (
  SELECT *, (pow(greatest(chi, 0.0) / free, CAST(1 AS DOUBLE) / 3) - (1.0 - 2.0 / (9.0 * free))) / sqrt(2.0 / (9.0 * free)) AS z1, greatest(abs(turns - places / 2) - 0.5, 0.0) / sqrt(places / 4) AS z2,
    (free + uneven - chi) / sqrt(2.0 * (free + 2.0 * uneven)) AS z3, (changes - places * 0.25 - 0.5) / sqrt(places * 0.25 * 0.75) AS z4 FROM meas
), q AS (
  SELECT *, {_LN.format(_two_sided_sql('z1'))} + {_LN.format(_two_sided_sql('z2'))} + {_LN.format(_two_sided_sql('serial'))} AS x, {_tail_sql('z3')} AS uniform, {_tail_sql('z4')} AS mixed FROM z
), j AS (
  SELECT *, {_LN.format('uniform')} + {_LN.format('mixed')} AS y, exp(-x) * (1.0 + x + x * x / 2) >= 0.001 AND encoding <> 'decimal' AS fair FROM q
), p AS (
  SELECT doc_id, s, e, n, CASE WHEN NOT fair THEN 1.0 WHEN encoding IN ('lower', 'upper') THEN uniform ELSE exp(-y) * (1.0 + y) END AS p FROM j
  UNION ALL SELECT doc_id, s, e, n, 1.0 FROM enc WHERE n < 8
), b AS (
  SELECT *, CAST(least(greatest(floor(log2(greatest(n, 1) / 16) * 2), 0), 7) AS INTEGER) AS band, CAST(least(floor(-2 * log2(greatest(p, 1e-300))), 63) AS INTEGER) AS bin FROM p
), h AS (
  SELECT band, bin, sum(count(*)) OVER (PARTITION BY band ORDER BY bin DESC) AS seen, sum(count(*)) OVER (PARTITION BY band) AS total FROM b GROUP BY band, bin
), lim AS (
  SELECT band, min(bin) AS least FROM h WHERE pow(2.0, -bin / 2) * total <= 0.01 * seen GROUP BY band
), found AS (
  SELECT doc_id, k, s, e FROM base UNION ALL
  SELECT doc_id, 3, s, e FROM b JOIN lim USING (band) WHERE bin >= least AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = b.doc_id AND base.s < b.e AND b.s < base.e)
), named AS (
  SELECT *, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e AS span FROM found
), g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3,
    string_agg(span, ',' ORDER BY s, k, e) FILTER (k < 3) AS bases, string_agg(span, ',' ORDER BY s, k, e) AS spans FROM named GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, coalesce(n3, 0) AS n_random, sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


# DuckDB has no crc32: one entry for each byte by the polynomial's rule, then a fold over the bytes.
OP5 = """
WITH poly AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) r(b)
), bytes AS (
  SELECT doc_id, coalesce('s' || source, '') AS stratum, encode(coalesce(text, '')) AS b FROM documents
), sized AS (
  SELECT doc_id, stratum, CAST(octet_length(b) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS text_crc32
  FROM bytes, poly
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CAST('0x' || substr(md5(concat_ws('|', 17, coalesce(CAST(doc_id AS VARCHAR), ''), text_crc32, size)), 1, 13) AS BIGINT), doc_id NULLS FIRST, text_crc32, size) AS rank,
    count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS total,
    (CAST('0x' || substr(md5('17|' || stratum), 1, 5) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 1048576 AS inside
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank - 1 + inside) / n, stratum, rank) - 1 AS p FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 24 // total AS INTEGER) AS shard, CAST(p - ((p * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


# A window is its lines' text itself; doc_id tells documents apart and orders them.
OP8 = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents WHERE text IS NOT NULL
), line AS (
  SELECT *, len(regexp_split_to_array(x, '[\s\x0B\p{{Z}}]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS i
  FROM (SELECT *, trim(raw, {_TRIMMED}) AS x FROM raw) WHERE x <> ''
), counted AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM line
), span AS (
  SELECT a.doc_id, a.i, min(b.i) AS e FROM counted a JOIN counted b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 19 WHERE b.upto - a.upto + a.words >= 20 GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i), b.i FROM counted a JOIN counted b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 19 WHERE b.upto - a.upto + a.words >= 20 GROUP BY b.doc_id, b.i
), win AS (
  SELECT s.doc_id, s.i, s.e, string_agg(c.x, chr(10) ORDER BY c.i) AS name FROM span s JOIN counted c ON c.doc_id = s.doc_id AND c.i BETWEEN s.i AND s.e GROUP BY s.doc_id, s.i, s.e
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) AS copy FROM win) WHERE copy > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM later
), kept AS (
  SELECT raw.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN raw.raw END, chr(10) ORDER BY raw.r) AS text, count(line.i) AS n_lines, count(gone.i) AS n_deleted
  FROM raw LEFT JOIN line ON line.doc_id = raw.doc_id AND line.r = raw.r LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = line.i GROUP BY raw.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
  CASE WHEN n_deleted > 0 THEN coalesce(kept.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


SQL = {"op1_html": OP1, "op3_secrets": OP3, "op4_chat": OP4, "op5_sharding": OP5, "op6_jaccard": OP6, "op7_decontaminate": OP7, "op8_lines": OP8, "op9_topk": OP9}
