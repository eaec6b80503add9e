"""Porter stemming (Porter 1980, with the widely used extension rules:
irregular-form table, short words kept, ``ies``/``ied`` on 4-letter words,
``y -> i`` only after a consonant, ``alli``/``fulli``/``logi`` in step 2).

The stemmer is a small per-word helper. Spark applies it once per *distinct*
word (see ``stem_table``) through an Arrow ``pandas_udf`` and joins the
result back, so the Python cost grows with the vocabulary, not the data.
"""


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOWELS = frozenset("aeiou")

# fixed values: irregular forms of the extended Porter stemmer (form -> stem)
IRREGULAR_FORMS = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    seq = "".join("c" if _cons(stem, i) else "v" for i in range(len(stem)))
    return seq.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) \
            and _cons(w, len(w) - 1) and w[-1] not in "wxy":
        return True
    return len(w) == 2 and not _cons(w, 0) and _cons(w, 1)


def _rules(word: str, rules) -> str:
    """Apply the first rule whose suffix matches; a failed condition stops."""
    for suffix, repl, cond in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)] if suffix else word
            if cond is None or cond(stem):
                return stem + repl
            return word
    return word


def _pos(stem: str) -> bool:
    return _m(stem) > 0


def _gt1(stem: str) -> bool:
    return _m(stem) > 1


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    return _rules(w, [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)])


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        stem = w[:-3]
        return stem + "ee" if _m(stem) > 0 else w
    base = None
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
            base = w[: -len(suffix)]
            break
    if base is None:
        return w
    for suffix, repl in (("at", "ate"), ("bl", "ble"), ("iz", "ize")):
        if base.endswith(suffix):
            return base[: -len(suffix)] + repl
    if _double_cons(base):
        return base[:-1] if base[-1] not in "lsz" else base
    if _m(base) == 1 and _cvc(base):
        return base + "e"
    return base


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        return w[:-1] + "i"
    return w


_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]


def _step2(w: str) -> str:
    if w.endswith("alli") and _pos(w[:-4]):
        return _step2(w[:-4] + "al")
    rules = [(s, r, _pos) for s, r in _STEP2]
    rules.append(("logi", "log", lambda stem: _pos(w[:-3])))
    return _rules(w, rules)


def _step3(w: str) -> str:
    return _rules(w, [(s, r, _pos) for s, r in (
        ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
        ("ical", "ic"), ("ful", ""), ("ness", ""))])


_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _step4(w: str) -> str:
    rules = []
    for s in _STEP4:
        if s == "ion":
            rules.append((s, "", lambda stem: _m(stem) > 1 and stem[-1:] in ("s", "t")))
        else:
            rules.append((s, "", _gt1))
    return _rules(w, rules)


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _m(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w


def porter_stem(word: str) -> str:
    """Stem one (lower-cased) word."""
    w = word.lower()
    if word in IRREGULAR_FORMS:
        return IRREGULAR_FORMS[w]
    if len(word) <= 2:
        return w
    for step in (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5):
        w = step(w)
    return w


def stem_column(c):
    """Arrow-batched stemming of a string column (one call per batch)."""
    @F.pandas_udf("string")
    def _stem(s: pd.Series) -> pd.Series:
        cache: dict[str, str] = {}

        def one(v):
            if v is None:
                return None
            r = cache.get(v)
            if r is None:
                r = cache[v] = porter_stem(v)
            return r

        return s.map(one)

    return _stem(F.col(c) if isinstance(c, str) else c)


def stem_table(words_df: DataFrame, col: str = "word") -> DataFrame:
    """Distinct words -> (word, stem). The distinct is a partial+final hash
    aggregate, so the Python UDF sees each word once per job."""
    return (words_df.select(col).where(F.col(col).isNotNull()).distinct()
            .select(F.col(col).alias("word"), stem_column(col).alias("stem")))
