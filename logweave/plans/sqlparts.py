"""Reusable DuckDB SQL fragments for the oracle formulations.

These restate the library's semantics independently in ANSI-ish SQL
(DuckDB dialect: RE2 regexes, ``'g'`` for global replace, 1-based lists).
"""

from __future__ import annotations

from logweave.functions.vocab import ANOMALY_RULE, significant_stems, stop_words

# Python whitespace set for RE2 (RE2's \s lacks \v).
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_ASCII_WORDCHAR = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def clean(x: str) -> str:
    e = f"regexp_replace({x}, {q(chr(92) + 'x1b' + chr(92) + '[[0-9;]*m')}, '', 'g')"
    e = f"regexp_replace({e}, {q(r'\[NR_\w+\]')}, '', 'g')"
    e = f"regexp_replace({e}, {q(r'\[MAC\]')}, '', 'g')"
    e = f"regexp_replace({e}, {q(r'(?i)CQI\s+0\b')}, 'CQI <CQI_INVALID>', 'g')"
    e = f"regexp_replace({e}, {q(r'(?i)MCS\s+\(\d+\)\s+0\b')}, 'MCS <MCS_INVALID>', 'g')"
    e = f"regexp_replace({e}, {q(r'(?i)MCS\s+0\b')}, 'MCS <MCS_INVALID>', 'g')"
    e = f"regexp_replace({e}, {q(WS + '+')}, ' ', 'g')"
    return strip(e)


def words(x: str) -> str:
    low = f"regexp_replace(lower({x}), {q(NON_ASCII_WORDCHAR)}, '0', 'g')"
    return f"regexp_extract_all({low}, {q(r'\b([a-z]+)\b')}, 1)"


def k(props: str = "props") -> str:
    return f"coalesce(CAST(json_extract_string({props}, '$.k') AS BIGINT), 0)"


EVENT_LOG = f"""
SELECT 'ue-' || CAST(user_id AS VARCHAR) AS log_id, ts, event_id,
  chr(27) || '[0m' || CASE event_type
    WHEN 'view' THEN '[NR_PHY]  UE ' || CAST(user_id AS VARCHAR) || ' CQI  ' || CAST({k()} % 16 AS VARCHAR)
         || ' MCS (' || CAST({k()} % 3 AS VARCHAR) || ') ' || CAST({k()} % 29 AS VARCHAR) || ' RSRP -' || CAST(80 + {k()} % 40 AS VARCHAR)
    WHEN 'click' THEN '[MAC]  UE ' || CAST(user_id AS VARCHAR) || ' DL packet SENT size=' || CAST(1000 + {k()} AS VARCHAR) || ' bytes'
    WHEN 'purchase' THEN '[NR_MAC]   UE ' || CAST(user_id AS VARCHAR) || ' HARQ ACK pid ' || CAST({k()} % 16 AS VARCHAR)
    WHEN 'error' THEN chr(27) || '[93m[NR_MAC]   UE ' || CAST(user_id AS VARCHAR) || ' HARQ NACK pid ' || CAST({k()} % 16 AS VARCHAR)
         || ' retx ' || CAST({k()} % 4 AS VARCHAR) || ' packet dropped'
    WHEN 'signup' THEN '[RRC]   UE ' || CAST(user_id AS VARCHAR) || ' RRC connection release requested, timer ' || CAST({k()} AS VARCHAR)
    ELSE 'UE ' || CAST(user_id AS VARCHAR) || ' ' || coalesce(event_type, 'event') END AS raw
FROM events
"""

EVENT_LINES = f"""
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY ts, event_id) - 1 AS BIGINT) AS line_no,
       raw, {clean('raw')} AS clean
FROM ({EVENT_LOG}) r
"""

DOC_LINES = """
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY doc_id, pos) - 1 AS BIGINT) AS line_no, raw
FROM (SELECT log_id, doc_id, unnest(arr) AS raw, unnest(generate_series(1, len(arr))) AS pos
      FROM (SELECT coalesce(source, 'unknown') AS log_id, doc_id,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS arr
            FROM documents) d) l
"""


def positional(lines_sql: str) -> str:
    """M1a over a lines relation with (log_id, line_no, clean)."""
    return f"""
WITH k0 AS (SELECT log_id, line_no, clean,
                   CASE WHEN clean = '' THEN []::VARCHAR[] ELSE string_split(clean, ' ') END AS toks
            FROM ({lines_sql}) s),
k2 AS (SELECT *, len(toks) AS n_tok,
              CASE WHEN len(toks) = 0 THEN '' WHEN regexp_matches(toks[1], '[0-9]') THEN '<*>' ELSE toks[1] END AS first_key
       FROM k0),
p AS (SELECT log_id, n_tok, first_key, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM k2),
pp AS (SELECT log_id, n_tok, first_key, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS t
       FROM p GROUP BY log_id, n_tok, first_key, pos),
tm AS (SELECT log_id, n_tok, first_key, string_agg(t, ' ' ORDER BY pos) AS template FROM pp GROUP BY log_id, n_tok, first_key),
st AS (SELECT log_id, n_tok, first_key, count(*) AS cnt, min(line_no) AS first_idx FROM k2 GROUP BY log_id, n_tok, first_key)
SELECT st.log_id, CAST(st.n_tok AS BIGINT) AS n_tok, st.first_key, coalesce(tm.template, '') AS template,
       CAST(cnt AS BIGINT) AS cnt, CAST(first_idx AS BIGINT) AS first_idx
FROM st LEFT JOIN tm USING (log_id, n_tok, first_key)
"""


def freq(lines_sql: str) -> str:
    """M2/M4-M6 over M1a: (log_id, template, cnt, first_idx, n_lines)."""
    return f"""
SELECT f.log_id, f.template, f.cnt, f.first_idx, n.n_lines FROM
 (SELECT log_id, template, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(min(first_idx) AS BIGINT) AS first_idx
  FROM ({positional(lines_sql)}) pt GROUP BY log_id, template) f
 JOIN (SELECT log_id, CAST(count(*) AS BIGINT) AS n_lines FROM ({lines_sql}) s GROUP BY log_id) n USING (log_id)
"""


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


def stop_values() -> str:
    return values([(w,) for w in stop_words()], ["word"])


ANOMALY_RE = ANOMALY_RULE
