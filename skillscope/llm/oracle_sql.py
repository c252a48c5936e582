"""DuckDB equivalents of the operator queries that SQL can express, written
from the operators' definitions."""

from __future__ import annotations

from .licences import TEMPLATES, THRESHOLD

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Every 50-word window with the smallest document it starts in; a word goes if a window that covers it starts in a
# smaller document.
OP5 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
hit AS (SELECT w.doc_id, w.p FROM windows w JOIN firsts f ON f.h = w.h WHERE f.least < w.doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS at
         FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM hit) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(g.at), 0) AS n_removed,
         CASE WHEN g.at IS NULL THEN d.w
              ELSE (SELECT coalesce(list(d.w[i] ORDER BY i), []) FROM (
                SELECT unnest(range(1, len(d.w) + 1)) AS i) WHERE NOT list_contains(g.at, i)) END AS k
  FROM docs d LEFT JOIN gone g ON g.doc_id = d.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept"""

# Dice coefficient of word bigram sets, of every line and of short documents of several lines.
OP9 = f"""
WITH templates AS (
  SELECT * FROM (VALUES {', '.join(f"({_text(name)}, {k}, {_text(t)})" for name, texts in TEMPLATES.items()
                                   for k, t in enumerate(texts))}) v(licence, template, body)),
tw AS (SELECT licence, template, list_filter(string_split(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'),
              ' '), lambda x: x <> '') AS w FROM templates),
tg AS (SELECT licence, template, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM tw),
longest AS (SELECT max(CAST(floor(len(g) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9) AS BIGINT)) AS n FROM tg),
lines AS (
  SELECT doc_id, i - 1 AS unit, list_filter(string_split(regexp_replace(lower(l[i]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
         lambda x: x <> '') AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
whole AS (
  SELECT doc_id, -1 AS unit, flatten(list(w ORDER BY unit)) AS w FROM lines GROUP BY doc_id
  HAVING count(*) > 1 AND sum(len(w)) <= (SELECT n + 1 FROM longest)),
units AS (
  SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g
  FROM (SELECT * FROM lines UNION ALL SELECT * FROM whole) WHERE len(w) > 1),
grams AS (SELECT doc_id, unit, len(g) AS n, unnest(g) AS b FROM units),
tgrams AS (SELECT licence, template, len(g) AS m, unnest(g) AS b FROM tg),
shared AS (
  SELECT x.doc_id, x.unit, t.licence, t.template, any_value(x.n) AS n, any_value(t.m) AS m, count(*) AS c
  FROM grams x JOIN tgrams t ON t.b = x.b GROUP BY x.doc_id, x.unit, t.licence, t.template)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, licence, CAST(template AS INTEGER) AS template,
       CAST(n AS INTEGER) AS n_bigrams, round(2 * c / (n + m), 6) AS dice
FROM shared WHERE 2 * c / (n + m) >= {THRESHOLD}"""

# Chunks end after the first of adjacent lines whose rolling hash (with the line before) is even; repeats of chunks
# with two lines and a word go.
OP10 = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h,
                  list_transform(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS w FROM docs),
cuts AS (SELECT doc_id, l, [i FOR i IN range(1, len(l) + 1) IF i = 1 OR i = len(l)
                            OR (w[i] AND (h[greatest(i - 1, 1)] * 31 + h[i]) % 13 <> 0)] AS e FROM hashed),
chunks AS (SELECT doc_id, l, e[j] AS a, e[j + 1] AS b FROM (SELECT *, unnest(range(1, len(e))) AS j FROM cuts)),
texts AS (SELECT doc_id, a, b, array_to_string(l[a:b], chr(10)) AS t FROM chunks),
ranked AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY t ORDER BY doc_id, a) AS seen FROM texts
           WHERE regexp_matches(t, '[^\x20\x09-\x0D][^\n]*\n(?s:.*)[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE seen > 1),
parts AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM docs),
judged AS (SELECT p.doc_id, p.x, p.i, g.i IS NOT NULL AS gone FROM parts p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(p.x, chr(10) ORDER BY p.i)
         FILTER (WHERE NOT p.gone), '') END AS text,
       count(*) FILTER (WHERE p.gone) AS n_removed_lines
FROM documents d LEFT JOIN judged p ON p.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""

# Quote levels by counting markers, links of quoted units (passages, and lines of longer ones) to the first message
# that has them unquoted, threads by recursion.
OP3 = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, i, len(regexp_replace(regexp_extract(l[i], '^[ 	]*(>[ 	]*)+'), '[ 	]', '', 'g')) AS level,
         regexp_replace(l[i], '^[ 	]*(>[ 	]*)+', '') AS body
  FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations))),
runs AS (
  SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run
  FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i), -1) AS before,
               lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS after FROM lines)),
passages AS (SELECT conv_id, turn, level, run, string_agg(body, chr(10) ORDER BY i) AS p, count(*) AS n
             FROM runs GROUP BY conv_id, turn, level, run),
raw AS (SELECT conv_id, turn, level, p AS u FROM passages UNION ALL
        SELECT r.conv_id, r.turn, r.level, r.body FROM runs r JOIN passages s
          ON s.conv_id = r.conv_id AND s.turn = r.turn AND s.run = r.run WHERE s.n > 1),
units AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS u FROM raw),
origin AS (SELECT conv_id, u, min(turn) AS origin FROM units WHERE level = 0 AND u <> '' GROUP BY conv_id, u),
tally AS (
  SELECT q.conv_id, q.turn, q.level, o.origin, count(*) AS n
  FROM (SELECT DISTINCT * FROM units WHERE level > 0 AND u <> '') q
  JOIN origin o ON o.conv_id = q.conv_id AND o.u = q.u AND o.origin < q.turn GROUP BY ALL),
replies AS (
  SELECT conv_id, turn, arg_max(origin, (-level, n, origin)) AS reply_to, CAST(sum(n) AS BIGINT) AS n_linked
  FROM tally GROUP BY conv_id, turn),
chain AS (
  SELECT conv_id, turn, reply_to AS thread FROM replies
  UNION ALL
  SELECT c.conv_id, c.turn, r.reply_to FROM chain c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.thread),
roots AS (SELECT conv_id, turn, min(thread) AS thread FROM chain GROUP BY conv_id, turn),
own AS (
  SELECT conv_id, turn, string_agg(body, chr(10) ORDER BY i) AS t FROM runs
  WHERE level = 0 AND NOT (coalesce(after, 0) > 0
    AND regexp_matches(body, '(?i)(wrote|writes|said|schrieb|escribió|a écrit)[ 	]*:[ 	]*$'))
  GROUP BY conv_id, turn),
quoted AS (SELECT conv_id, turn, count(*) AS n FROM lines WHERE level > 0 GROUP BY conv_id, turn),
joined AS (
  SELECT m.conv_id, m.turn, m.role, trim(coalesce(o.t, ''), ' ') AS text, coalesce(q.n, 0) AS n_quoted_lines,
         coalesce(p.n_linked, 0) AS n_linked, p.reply_to, coalesce(r.thread, m.turn) AS thread
  FROM conversations m
  LEFT JOIN own o ON o.conv_id = m.conv_id AND o.turn = m.turn
  LEFT JOIN quoted q ON q.conv_id = m.conv_id AND q.turn = m.turn
  LEFT JOIN replies p ON p.conv_id = m.conv_id AND p.turn = m.turn
  LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn)
SELECT conv_id, turn, role, text, CAST(n_quoted_lines AS INTEGER) AS n_quoted_lines, n_linked, reply_to, thread,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role, text) - 1 AS BIGINT) AS position
FROM joined"""

# Payload digests in base32 from hex, and the largest id of equal payloads.
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, {5 * g + 1}, 5))::BIGINT >> {s}) & 31 AS BIGINT) + 1, 1)"
    for g in range(8) for s in (15, 10, 5, 0))

OP12 = f"""
WITH src AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex,
                    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to, true AS verified
FROM src"""

# Rounds of assignment to the nearest entry (squares from exact products of integers in doubles) and floored means.
_NEAREST = """
near{r} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.x) AS x,
         min(CAST(p.n + b.n - 2 * list_inner_product(p.x, b.x) AS BIGINT) * 256 + b.e) AS best
  FROM parts p JOIN book{r} b ON b.part = p.part GROUP BY p.vec_id, p.part)"""

_MOVE = """
sums{r} AS (
  SELECT part, best % 256 AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS m
  FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY part, best % 256, i),
means{r} AS (
  SELECT part, e, list(CAST((s - ((s % m) + m) % m) // m AS DOUBLE) ORDER BY i) AS x FROM sums{r} GROUP BY part, e),
book{next} AS MATERIALIZED (
  SELECT part, e, x, list_inner_product(x, x) AS n
  FROM (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m ON m.part = b.part AND m.e = b.e))"""

OP11 = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, x, list_inner_product(x, x) AS n
  FROM (SELECT vec_id, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM kept, range(4) r(part))),
book0 AS MATERIALIZED (
  SELECT * FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x, n FROM parts) WHERE e < 256),""" + ",".join(
    _NEAREST.format(r=r) + "," + _MOVE.format(r=r, next=r + 1) for r in range(4)) + "," + _NEAREST.format(r=4) + """,
codes AS (
  SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM near4 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS h
           FROM (SELECT part, e, unnest(x) AS c, unnest(range(0, len(x))) AS i FROM book4))
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT h FROM digest) AS codebooks_sha256
FROM codes c JOIN kept k ON k.vec_id = c.vec_id"""


# Equal word triples at one distance, joined into stretches; the smallest period of each stretch long enough.  The CRC
# of the id is taken digit by digit from a table made by its rule.
def _crc_table() -> list[int]:
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return table


_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: xor(list_extract({_crc_table()}::BIGINT[], 1 + (xor(c, x) & 255)), c >> 8)), 4294967295)"""

OP13 = f"""
WITH src AS (SELECT doc_id, {_WORDS} AS w0, {_CRC32} AS h FROM documents),
place AS (SELECT *, len(w0) AS n, (h // 10) % greatest(len(w0), 1) AS a FROM src),
step AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM place),
docs AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]
         FOR i IN range(0, n)] ELSE w0 END AS w FROM step),
pos AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM docs),
triples AS MATERIALIZED (
  SELECT doc_id, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS t,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM triples x JOIN triples y
    ON y.doc_id = x.doc_id AND y.t = x.t AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 3 - min(i) + q AS len FROM islands GROUP BY doc_id, q, isle),
runs AS MATERIALIZED (
  SELECT doc_id, s, len, min(q) AS q FROM stretches WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS k FROM runs) WHERE k = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
left_over AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS t
  FROM pos p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start,
       CAST(b.len AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
       CAST(1000 * b.len // b.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id
LEFT JOIN left_over k ON k.doc_id = d.doc_id"""


ORACLE_SQL = {"op3_quotation_linking": OP3, "op5_repeated_windows": OP5, "op9_licence_scan": OP9, "op10_line_chunks": OP10,
              "op11_vector_codes": OP11, "op12_warc": OP12, "op13_periodic_runs": OP13}
