"""String scalars for log lines and markdown text, all built-in Spark
expressions so they stay inside whole-stage codegen.

Regex dialect notes: Spark uses java.util.regex. Python's ``\\s`` and
``str.split()`` treat more characters as whitespace than Java's ``\\s``; the
``WS`` class below spells out Python's whitespace set so that collapsing and
trimming agree with the reference's ``' '.join(line.split())``.
"""


import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's cleaning rules) --------------
# ANSI colour escape, layer tags that are removed, zero-value markers.
ANSI_ESCAPE = r"\x1b\[[0-9;]*m"
NR_LAYER_TAG = r"\[NR_\w+\]"
MAC_TAG = r"\[MAC\]"
CQI_ZERO = r"(?i)CQI\s+0\b"
CQI_MARK = "CQI <CQI_INVALID>"
MCS_TABLE_ZERO = r"(?i)MCS\s+\(\d+\)\s+0\b"
MCS_ZERO = r"(?i)MCS\s+0\b"
MCS_MARK = "MCS <MCS_INVALID>"
PLACEHOLDER = r"<[^>]+>"
WORD = r"\b([a-z]+)\b"
# ---------------------------------------------------------------------------

# Python's str.isspace() set, as a Java regex character class.
WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same set as characters: trimming by it reads a text many times faster than a regex.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Non-ASCII letters/digits: word characters for Python's Unicode \b, but not
# for an ASCII regex engine. They are mapped to '0' before word extraction so
# that e.g. 'réaux' yields no word on every engine (as in Python).
NON_ASCII_WORDCHAR = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Python ``' '.join(s.split())``: runs of whitespace -> one space, trimmed."""
    return py_strip(F.regexp_replace(_c(c), rf"{WS}+", " "))


def clean_line(c) -> Column:
    """F8 = F2..F7 in order: ANSI codes, ``[NR_*]`` and ``[MAC]`` tags,
    zero CQI / MCS markers, whitespace collapse."""
    x = F.regexp_replace(_c(c), ANSI_ESCAPE, "")
    x = F.regexp_replace(x, NR_LAYER_TAG, "")
    x = F.regexp_replace(x, MAC_TAG, "")
    x = F.regexp_replace(x, CQI_ZERO, CQI_MARK)
    x = F.regexp_replace(x, MCS_TABLE_ZERO, MCS_MARK)
    x = F.regexp_replace(x, MCS_ZERO, MCS_MARK)
    return collapse_ws(x)


def is_blank(c) -> Column:
    """True when the line is empty after Python's strip()."""
    return py_strip(c) == F.lit("")


def strip_placeholders(c) -> Column:
    """drop ``<...>`` placeholders, then strip."""
    return py_strip(F.regexp_replace(_c(c), PLACEHOLDER, ""))


def words(c) -> Column:
    """``re.findall(r'\\b[a-z]+\\b', s.lower())`` as an array column."""
    low = F.regexp_replace(F.lower(_c(c)), NON_ASCII_WORDCHAR, "0")
    return F.regexp_extract_all(low, F.lit(WORD), 1)


def whitespace_tokens(c) -> Column:
    """Python ``s.split()`` (no empty tokens)."""
    # leading/trailing separators only produce empty tokens, which the filter
    # drops, so no separate strip pass over the text is needed
    return F.filter(F.split(_c(c), rf"{WS}+"), lambda t: t != F.lit(""))


def spaced_words(c) -> Column:
    """Python's ``' '.join(s.split())`` itself, by Arrow: the quickest way to
    words for whole corpora (split the result on a space)."""
    @F.pandas_udf("string")
    def _spaced(s: pd.Series) -> pd.Series:
        return s.map(lambda v: " ".join(v.split()) if isinstance(v, str) else v)

    return _spaced(_c(c))


def linear_to_db(c, digits: int = 2) -> Column:
    """``10*log10(x)`` rounded to ``digits``."""
    return F.round(F.lit(10.0) * F.log10(_c(c)), digits)


def fix_heading_line(line: Column) -> Column:
    """F11 for one line: a line that starts with ``##`` is stripped and its
    heading text (everything after the first space) decides the level by the
    depth of its dotted number: 6 parts ``######``, 5 ``#####``, 4 ``####``,
    3 ``###``; otherwise the stripped line is kept."""
    s = py_strip(line)
    pos = F.instr(s, " ")
    heading = F.when(pos > 0, F.substring(s, pos + 1, 1 << 30)).otherwise(F.lit(""))
    levelled = s
    for parts, hashes in ((3, "###"), (4, "####"), (5, "#####"), (6, "######")):
        pat = r"^\d+" + r"\.\d+" * (parts - 1)
        levelled = F.when(heading.rlike(pat), F.concat(F.lit(hashes + " "), heading)).otherwise(levelled)
    return F.when(line.startswith("##"), levelled).otherwise(line)


def fix_headings(c) -> Column:
    """F11 over a whole markdown text (split on newlines, fixed, re-joined)."""
    return F.array_join(F.transform(F.split(_c(c), "\n", -1), fix_heading_line), "\n")


# The five XML entities, in the order a safe unescape applies them (&amp; last).
XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape_xml(c) -> Column:
    """F10, SQL-expressible variant: the five XML entities only."""
    x = _c(c)
    for ent, ch in XML_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def unescape_html(c) -> Column:
    """F10, full HTML5 entity table (Python's ``html.unescape``), vectorised
    through an Arrow ``pandas_udf``; work is per row, no state."""
    @F.pandas_udf("string")
    def _unescape(s: pd.Series) -> pd.Series:
        return s.map(lambda v: html.unescape(v) if isinstance(v, str) else v)

    return _unescape(_c(c))
