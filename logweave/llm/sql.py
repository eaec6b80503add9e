"""DuckDB formulations of the queries that SQL can express."""

from __future__ import annotations

from logweave.llm import fim as I
from logweave.llm import host_rules as H
from logweave.llm import mixing as M
from logweave.llm import warc as A

WORD = r"[^\x20\x09-\x0D]+"
TEXT = "coalesce(text, '')"


def _hosts(table: str) -> str:
    """The host rules on ``table``: ``judged`` has a row for each document."""
    low, high = H.PRIOR_RANGE
    return f"""
tok AS (SELECT doc_id, source, {TEXT} AS t, regexp_extract_all({TEXT}, '{WORD}') AS w FROM {table}),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + {H.WINDOW - 1}], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {H.WINDOW - 2})) AS i FROM tok WHERE len(w) >= {H.WINDOW}) x),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) x WHERE c > 1),
cov AS (SELECT doc_id, CAST(sum(least({H.WINDOW}, coalesce(nxt - i, {H.WINDOW}))) AS BIGINT) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) x GROUP BY doc_id),
ln AS (SELECT doc_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '{WORD}')] AS l FROM tok),
m AS (SELECT tok.doc_id, tok.source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[ \\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words
      FROM tok JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {H.MIN_WORDS} OR 100 * n_repeat_words > {H.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR n_symbols > {H.MAX_SYMBOLS_PER_WORD} * n_words OR n_dup_lines > {H.MAX_DUP_LINE_RATE} * n_lines
             OR word_chars < {H.MIN_WORD_CHARS} * n_words OR word_chars > {H.MAX_WORD_CHARS} * n_words AS failed FROM b),
hst AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS k FROM f GROUP BY source),
tot AS (SELECT sum(n) AS n, sum(k) / sum(n) AS p, sum(n * n) AS q, sum(k * k / n) AS s, count(*) AS h FROM hst),
vr AS (SELECT *, (s - n * p * p - (h - 1) * p * (1 - p)) / nullif(n - q / n, 0) AS v FROM tot),
pr AS (SELECT p, CASE WHEN q >= n * n OR v <= 0 THEN {high!r}
                      ELSE greatest({low!r}, least({high!r}, p * (1 - p) / v - 1)) END AS w FROM vr),
rate AS (SELECT source, (k + p * w) / (n + w) AS rate FROM hst, pr),
judged AS (SELECT f.*, NOT failed AND rate <= {H.MAX_HOST_RATE!r} AS kept
           FROM f JOIN rate ON f.source IS NOT DISTINCT FROM rate.source)"""


HOST_RULES = f"""WITH {_hosts('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

_WEIGHT = " ".join(f"WHEN {i} THEN {w!r}" for i, w in enumerate(M.WEIGHTS))

MIXING = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all({TEXT}, '{WORD}')) AS BIGINT) AS size,
                      CAST('0x' || substr(md5('{M.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || {TEXT}), 1, {M.BITS // 4}) AS BIGINT) AS h
               FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, {M.MOST!r} * source_size AS cap,
                  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(M.WEIGHTS)} {_WEIGHT} END AS w FROM src),
lvl AS (SELECT *, ({M.SHARE!r} * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
        FROM ranked WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, round(least(cap, w * (SELECT max(lv) FROM lvl)), 6) AS target FROM lvl),
rest AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goal),
cum AS (SELECT s.doc_id, s.size, s.h, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS need,
               sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
               sum(s.size) OVER (PARTITION BY s.source, s.h) AS own, count(*) FILTER (WHERE s.size > 0) OVER (PARTITION BY s.source, s.h) AS copies,
               row_number() OVER (PARTITION BY s.source, s.h ORDER BY s.size DESC) AS k
        FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND need > 0 AND upto - own < need AND k <= floor((need - (upto - own)) * copies / own + 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM cum
"""

_HASH = f"sha256('{I.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))"
_DRAW = ", ".join(f"CAST('0x' || substr({_HASH}, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))

FILL_IN_MIDDLE = f"""
WITH cut AS (SELECT doc_id, {TEXT} AS t, regexp_extract_all({TEXT}, '{I.LINE}') AS l, {_DRAW} FROM documents),
ranked AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
                  CASE WHEN t = '' OR contains(t, '{I.PREFIX}') OR contains(t, '{I.SUFFIX}') OR contains(t, '{I.MIDDLE}') OR h3 % 100 >= {I.RATE}
                       THEN 'plain' WHEN h4 % 100 < {I.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m,
                 coalesce(array_to_string(l[b + 1:n], ''), '') AS s FROM ranked)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{I.SUFFIX}' || s || '{I.PREFIX}' || p || '{I.MIDDLE}' || m
                        ELSE '{I.PREFIX}' || p || '{I.SUFFIX}' || s || '{I.MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS k,
                  first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS f FROM pages),
s AS (SELECT *, CAST(strlen(t) AS BIGINT) AS payload_bytes, k > 1 AND strlen(t) >= {A.REVISIT_BYTES} AS again FROM p)
SELECT page_id, payload_bytes, sha256(t) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN f END AS refers_to
FROM s
"""

#: CRC-32 in SQL: a byte at a time, with the table's entry worked out bit by bit.
_BIT = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda s: ascii(s)::BIGINT)), lambda crc, byte: "
        "xor(crc // 256, list_reduce(list_prepend(xor(crc, byte) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, z: " + _BIT.format("b")
        + "))), 4294967295)")

PREFIX_TRIE = f"""
WITH own AS (SELECT conv_id AS c, list(coalesce(role, '') || chr(1) || {TEXT} ORDER BY turn NULLS FIRST) AS t FROM conversations
             WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT c, t, CAST({_CRC.format('CAST(c AS VARCHAR)')} % 4 AS BIGINT) AS h FROM own),
conv AS (SELECT a.c, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 20),
pre AS (SELECT c, t[1:d] AS p, d, len(t) = d AS ends FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM conv) x),
node AS (SELECT p, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS e FROM pre GROUP BY p, d),
val AS (SELECT p, d, c, n, e, (n - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(substr(p[d], strpos(p[d], chr(1)) + 1), '{WORD}')) END AS v FROM node),
kid AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
leaf AS (SELECT val.*, coalesce(k, 0) AS k FROM val LEFT JOIN kid USING (p)),
sub AS (SELECT p[1:a] AS p, sum(v) AS v, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS l FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM leaf) x GROUP BY 1)
SELECT leaf.c AS conv_id, CAST(leaf.d AS BIGINT) AS depth, up.c AS parent_conv_id, leaf.n AS n_convs, leaf.k AS n_children,
       CAST(sub.l AS BIGINT) AS n_leaves, CAST(sub.v AS BIGINT) AS saved_tokens, leaf.e AS ends_sha256
FROM leaf JOIN sub USING (p) LEFT JOIN node up ON up.p = leaf.p[1:leaf.d - 1] AND leaf.d > 0
"""
