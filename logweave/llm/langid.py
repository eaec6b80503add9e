"""Language identification by Bayesian evidence fusion (operator 10).

The language of a web page follows from

* the likelihood of its main text under letter-trigram models of the
  languages, fitted on all labelled documents,
* the language that its markup declares: ``P(declared | language)``, counted
  over all pages, and
* the prior of its host, smoothed along the address: the suffix's share of
  languages is drawn towards that of all pages, the registered domain's towards
  the suffix's, the host's towards the domain's (``KAPPA`` pages each).

Counts over pages are sums of the text's posterior, by grouped aggregation; a
page's own share is taken out of its host's before it is judged.

A trigram model has ``BUCKETS`` numbers for each language, however many
documents there are; that table alone is sent to the tasks.

Edge cases: a page that is null or has no text gets no evidence from it; a
missing or unknown declaration gives no evidence; null, empty or odd addresses
form one host; documents with a null language aren't used; with no language at
all every page's language is null; an empty table gives an empty table; equal
pages are judged alike; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import cut_lineage, row_of, small_batches
from logweave.llm.htmltext import blocks, main_text
from logweave.llm.vec import mix

BUCKETS = 1 << 15
#: Pages that a level of the address weighs against its own.
KAPPA = 5.0
#: Pages that say before any is counted that a declaration is right, or names another language.
RIGHT, WRONG = 4.0, 0.5
#: A text weighs as much as so many independent trigrams at most.
EFFECTIVE = 40
NOT_LETTERS = re.compile(r"[\W\d_]+")
DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?\s*([a-zA-Z]{2,3})\b|<meta\b[^>]*content-language[^>]*content\s*=\s*["']?\s*([a-zA-Z]{2,3})\b""", re.I)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of texts, and the texts' bounds."""
    plain = [f" {NOT_LETTERS.sub(' ', t.lower()).strip()} " for t in texts]
    n = np.array([max(0, len(p) - 2) for p in plain], dtype=np.int64)
    code = np.frombuffer("".join(plain).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    found = mix((code[:-2] << np.uint64(42)) ^ (code[1:-1] << np.uint64(21)) ^ code[2:]) % np.uint64(BUCKETS)
    length = n + 2
    begin = np.cumsum(length) - length
    bounds = np.concatenate(([0], np.cumsum(n)))
    keep = np.repeat(begin - bounds[:-1], n) + np.arange(int(bounds[-1]))
    return found[keep].astype(np.int64), bounds


def fitted(docs: DataFrame, lang: str = "lang", text: str = "text", batch: int = 500) -> tuple[list[str], np.ndarray]:
    """``(languages, log probabilities by language and bucket)`` from all
    documents with a language; counts are summed in tasks, then by Spark."""
    small_batches(docs)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in batches:
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for name in set(langs):
                own = part.column("text").take(pa.array(np.flatnonzero(langs == name))).to_pylist()
                total = sums.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for a in range(0, len(own), batch):
                    total += np.bincount(trigrams(own[a:a + batch])[0], minlength=BUCKETS)
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(total[some])], names=["lang", "bucket", "n"])

    table = (rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
             .toArrow())  # BUCKETS rows for each language at most
    names = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((len(names), BUCKETS))
    at = np.array([names.index(x) for x in table["lang"].to_pylist()], dtype=np.int64)
    counts[at, table["bucket"].to_numpy()] = table["n"].to_numpy()
    return names, np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True))


def address(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract(host, r"([^.]+)$", 1)}


def evidence(pages: DataFrame, names: list[str], logs: np.ndarray, html: str, url: str, carry: list[str] | None) -> DataFrame:
    """``(page, host, domain, suffix, declared, t0 .., p0 ..)``: the text's
    log likelihoods and its posterior over the languages, and the page's other
    evidence."""
    rows = pages.select(row_of(pages if carry is None else pages.select(*carry), "page"),
                        *[c.alias(k) for k, c in address(F.col(url)).items()], F.col(html).alias("html"))
    size = len(names)
    likely = [f"t{i}" for i in range(size)]
    after = [f"p{i}" for i in range(size)]
    schema = T.StructType([*rows.schema.fields[:4], T.StructField("declared", T.StringType()),
                           *[T.StructField(c, T.DoubleType()) for c in likely + after]])
    sent = pages.sparkSession.sparkContext.broadcast(logs.astype(np.float32))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part in batches:
            raw = [x or "" for x in part.column("html").to_pylist()]
            texts = [main_text(x) or " ".join(b.text for b in blocks(x)) for x in raw]
            said = [next((g.lower() for g in m.groups() if g), None) if (m := DECLARED.search(x)) else None for x in raw]
            values = np.zeros((len(raw), size))
            for a in range(0, len(texts), 200):
                found, bounds = trigrams(texts[a:a + 200])
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                if len(full):
                    sums = np.add.reduceat(table[:, found].astype(np.float64), bounds[:-1][full], axis=1)
                    values[a + full] = (sums * np.minimum(1.0, EFFECTIVE / n[full])).T
            values -= values.max(axis=1, keepdims=True, initial=-np.inf) if size else 0
            odds = np.exp(values)
            odds /= odds.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("page", "host", "domain", "suffix")), pa.array(said, pa.string()),
                 *(pa.array(np.ascontiguousarray(x)) for x in [*values.T, *odds.T])], names=schema.names)

    return cut_lineage(rows.mapInArrow(read, schema))


def identified(pages: DataFrame, docs: DataFrame, html: str = "html", url: str = "url", lang: str = "lang", text: str = "text",
               carry: list[str] | None = None) -> DataFrame:
    """``(page, lang, probability, text_lang, declared, host)`` for every
    page; ``page`` holds the columns ``carry`` (all, if None)."""
    names, logs = fitted(docs, lang, text)
    if not names:
        none = F.lit(None).cast("string")
        return pages.select(row_of(pages if carry is None else pages.select(*carry), "page"), none.alias("lang"),
                            F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"),
                            address(F.col(url))["host"].alias("host"))
    table = evidence(pages, names, logs, html, url, carry)
    span = range(len(names))

    def counted(df: DataFrame, keys: list[str], of: str, to: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(f"{of}{i}").alias(f"{to}{i}") for i in span])

    def total(prefix: str) -> Column:
        return sum((F.col(f"{prefix}{i}") for i in span), F.lit(0.0))

    # sums of each level from those of the level below: one shuffle of pages, by host and with a map-side sum
    hosts = cut_lineage(counted(table, ["suffix", "domain", "host"], "p", "h"))
    domains = cut_lineage(counted(hosts, ["suffix", "domain"], "h", "d"))
    suffixes = cut_lineage(counted(domains, ["suffix"], "d", "s"))
    whole = suffixes.agg(*[F.sum(f"s{i}").alias(f"g{i}") for i in span]).first()
    everything = sum(whole) if whole[0] is not None else 0.0
    everywhere = [((whole[i] or 0.0) + 1.0) / (everything + len(names)) for i in span]
    declared = cut_lineage(counted(table.where("declared is not null"), ["declared"], "p", "c"))
    said = declared.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in span]).first()

    # how probable a page of language i declares what this one does, up to a factor
    hit = [F.when(F.col("declared") == names[i], RIGHT).otherwise(F.lit(WRONG)) for i in span]
    odds = {f"e{i}": F.when(F.col("declared").isin(names), F.log((F.col(f"c{i}") + hit[i]) / F.lit((said[i] or 0.0) + RIGHT + WRONG)))
            .otherwise(F.lit(0.0)) for i in span}
    declared = declared.select(F.col("declared").alias("said"), *[c.alias(k) for k, c in odds.items()])

    near = (hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix")
            .select("host", *[f"{p}{i}" for p in "hds" for i in span]))
    joined = (table.join(cut_lineage(near), "host").join(cut_lineage(declared), F.col("declared") == F.col("said"), "left"))

    def prior(i: int) -> Column:  # without the page's own share
        mean: Column = F.lit(everywhere[i])
        for level in "sdh":
            mean = (F.col(f"{level}{i}") - F.col(f"p{i}") + KAPPA * mean) / (total(level) - 1 + KAPPA)
        return F.greatest(mean, F.lit(1e-12))

    score = [F.col(f"t{i}") + F.coalesce(f"e{i}", F.lit(0.0)) + F.log(prior(i)) for i in span]
    ranked = joined.select("page", "host", "declared", F.array(*[F.struct(s.alias("s"), F.lit(names[i]).alias("l")) for i, s in zip(span, score)]).alias("all"),
                           F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("s"), F.lit(names[i]).alias("l")) for i in span]))["l"].alias("text_lang"))
    best = ranked.withColumn("best", F.array_max("all"))
    weight = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("best.s")))
    return best.select("page", F.col("best.l").alias("lang"), (1 / weight).alias("probability"), "text_lang", "declared", "host")
