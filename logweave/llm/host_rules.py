"""Quality rules by host (operator 9), with DataFrame functions only.

Every document is measured and tested against fixed rules. The failures are
summed by host, each host's failure rate is shrunk towards the corpus by a
beta prior that is fitted to the hosts' own rates (method of moments), and the
host's verdict is joined back to its documents. A document stays if it fails
no rule itself and its host's shrunk rate isn't above ``max_host_rate``.

Edge cases: a null text has no words (all measures 0) and fails; null hosts
form one host; an empty table gives an empty table; equal rows are measured
alike and all stay in the result; other columns, whatever their names, pass
through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import SPACES, cut_lineage, let, row_of, text_of, words

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_RATE = 0.3
MIN_WORD_CHARS, MAX_WORD_CHARS = 2.0, 12.0
MAX_HOST_RATE = 0.5
#: Prior weights (in documents) that the fitted prior is held within.
PRIOR_RANGE = (1.0, 1e6)


def repeated_words(tokens: Column) -> Column:
    """Number of words inside an eight-word window that occurs twice or
    more in the text. Windows are compared by a 64-bit hash; the work is
    n log n in the words of one text."""
    def covered(at: Column) -> Column:  # sorted starts of repeated windows
        gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def starts(pairs: Column) -> Column:  # pairs sorted by hash
        def twin(x: Column, i: Column, step: int) -> Column:
            return F.coalesce(F.get(pairs, i + step)["h"] == x["h"], F.lit(False))
        again = F.filter(pairs, lambda x, i: twin(x, i, -1) | twin(x, i, 1))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint"))
                .otherwise(let(let(pairs, starts), covered)))

    def wider(step: int):  # hashes of runs of 2 * step words from those of step
        return lambda hashes: F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    def windows(ids: Column) -> Column:
        runs = ids
        for step in (1, 2, 4):  # doubling is several times cheaper than hashing a slice at each word
            runs = let(runs, wider(step))
        return (F.when(F.size(ids) < WINDOW, F.array().cast("array<bigint>"))
                .otherwise(F.slice(runs, F.lit(1), F.size(ids) - (WINDOW - 1))))

    return let(let(F.transform(tokens, lambda w: F.xxhash64(w)), windows), count)


def measures(text: Column) -> dict[str, Column]:
    """The measures of one text (which isn't null)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), F.char_length(F.array_join(w, "")).cast("bigint").alias("chars"), repeated_words(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("d")))
    return {"of_words": of_words, "of_lines": of_lines, "n_symbols": (F.size(F.split(text, SYMBOLS)) - 1).cast("bigint")}


def measured(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(doc, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, failed)``; ``doc`` holds the columns
    ``carry`` (all, if None)."""
    kept = docs if carry is None else docs.select(*carry)
    m = measures(F.col("t"))
    raw = docs.select(row_of(kept), F.col(host).alias("host"), text_of(text).alias("t"))
    out = raw.select("doc", "host", *[c.alias(k) for k, c in m.items()]).select(
        "doc", "host", F.col("of_words.n").alias("n_words"), F.col("of_words.chars").alias("word_chars"), "n_symbols", F.col("of_lines.n").alias("n_lines"),
        F.col("of_lines.d").alias("n_dup_lines"), F.col("of_words.r").alias("n_repeat_words"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = ((F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
            | (F.col("n_dup_lines") > MAX_DUP_LINE_RATE * F.col("n_lines"))
            | (F.col("word_chars") < MIN_WORD_CHARS * F.col("n_words"))
            | (F.col("word_chars") > MAX_WORD_CHARS * F.col("n_words")))
    return out.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | more)


def host_rates(docs: DataFrame) -> DataFrame:
    """``(host, n, f, rate)``: documents, failures and shrunk failure rate of
    each host. One pre-aggregated shuffle by host; the prior comes from sums
    over the hosts.

    With p the overall rate, the variance between hosts beyond what chance
    gives is ``v = (sum n (f/n - p)^2 - (H - 1) p (1 - p)) / (N - sum n^2 / N)``;
    the prior weighs ``p (1 - p) / v - 1`` documents.
    """
    hosts = docs.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                     F.sum(F.col("failed").cast("double")).alias("f"))
    sums = cut_lineage(hosts)
    total = sums.agg(F.sum("n").alias("N"), F.sum("f").alias("K"), F.sum(F.col("n") * F.col("n")).alias("Q"),
                     F.sum(F.col("f") * F.col("f") / F.col("n")).alias("S"), F.count(F.lit(1)).alias("H"))
    p = F.col("K") / F.col("N")
    spread = (F.col("S") - F.col("N") * p * p - (F.col("H") - 1) * p * (1 - p)) / (F.col("N") - F.col("Q") / F.col("N"))
    low, high = PRIOR_RANGE
    weight = (F.when((F.col("Q") >= F.col("N") * F.col("N")) | (spread <= 0), F.lit(high))
              .otherwise(F.greatest(F.lit(low), F.least(F.lit(high), p * (1 - p) / spread - 1))))
    prior = total.select(p.alias("p"), weight.alias("w"))
    p1, w1 = prior.select("p").scalar(), prior.select("w").scalar()
    return sums.select("host", "n", "f", ((F.col("f") + p1 * w1) / (F.col("n") + w1)).alias("rate"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None,
           max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """:func:`measured`, with ``rate`` of the host and the verdict ``kept``.

    The measures are written once and read twice (by host, by document). The
    hosts' table is a written one too, so the planner knows its bytes: it
    broadcasts a small one and shuffles a large one, where adaptive execution
    splits a hot host."""
    table = cut_lineage(measured(docs, host, text, carry))
    hosts = cut_lineage(host_rates(table.select("host", "failed"))).select(F.col("host").alias("h"), "rate")
    return (table.join(hosts, table["host"].eqNullSafe(hosts["h"]), "left").drop("h")
            .withColumn("kept", ~F.col("failed") & (F.col("rate") <= max_host_rate)))


def drop_rejected(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents whose verdict is good, with the columns they came with.

    The measures are taken twice, once for the hosts and once for the
    documents: cheaper than a written copy of all texts between the two."""
    hosts = cut_lineage(host_rates(measured(docs, host, text, [host]).select("host", "failed"))).select(F.col("host").alias("h"), "rate")
    rows = measured(docs, host, text).where("not failed")
    return rows.join(hosts, rows["host"].eqNullSafe(hosts["h"])).where(F.col("rate") <= max_host_rate).select("doc.*")
