"""Mixing sources to target weights (operator 2), with DataFrame functions only.

Every document gets a 60-bit hash of its content. To take a given number of
words from a source, the documents whose hash is at most the source's
threshold are taken; thresholds of growing budgets are nested. A threshold is
found without sorting documents: words are summed by source and hash bucket,
the bucket in which the budget runs out is the boundary bucket, and only that
one is split further, level by level, down to single hash values. The document
on the boundary is taken if that brings the sum nearer to the budget; of equal
rows on the boundary, which share a hash, so many are taken as do.

A source whose target exceeds its size gives all documents once (or twice)
and the rest of the target by hash. No document is taken more than twice.

Edge cases: a null text has size 0 and is never taken; null sources form one
source, ranked last; rows with equal ``doc_id`` and text have one hash, any of
them may be the ones taken at the boundary; an empty table gives an empty table; targets are 0 where no
source has words. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, row_of, text_of, words
from logweave.operators.ordering import range_numbered

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that each level resolves; their sum is 60.
LEVELS = (15, 15, 15, 15)
BITS = sum(LEVELS)
SEED = "mix-1"

def content_hash(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """60 bits of an MD5 over the seed, the id and the text."""
    whole = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text)
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("bigint")

def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
          carry: list[str] | None = None) -> DataFrame:
    """``(doc, source, size, hash)``."""
    kept = docs if carry is None else docs.select(*carry)
    t = text_of(text)
    return docs.select(row_of(kept), F.col(source).alias("source"), F.size(words(t)).cast("bigint").alias("size"),
                       content_hash(F.col(key), t).alias("hash"))

def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)``: ``share`` of all words dealt to the
    sources by weight, none above ``most`` times its size, the excess dealt
    again by weight.

    That ends at ``target = min(cap, level * weight)`` for one level. Sources
    reach their cap in order of ``cap / weight``; with the first ones capped,
    the rest of the budget gives a level, and the highest of these levels is
    the one (the sum of targets is a concave function of the level). They come
    from running sums over the table of sources."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the table has a row for each source, not for each document
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights))
    caps = by_source.select("source", "source_size", weight.alias("w"), (most * F.col("source_size")).alias("cap"))
    before = (Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    every = Window.partitionBy()
    run = caps.select("*", (share * F.sum("source_size").over(every)).alias("budget"), F.sum("w").over(every).alias("all_w"),
                      F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
                      F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    own_level = (F.col("budget") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    run = run.withColumn("level", F.max(own_level).over(every))
    target = F.least(F.col("cap"), F.col("level") * F.col("w"))
    return run.select("source", "source_size", F.round(target, 6).alias("target"))

def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``(source, source_size, target, full, cut, some, copies)``: every
    document of the source is taken ``full`` times, and once more where its hash
    is below ``cut``; of the ``copies`` rows whose hash is ``cut``, ``some`` are.
    ``sizes`` is a written table of ``(source, size, hash)``; each
    level reads it once and keeps at most ``2 ** bits`` sums for each source."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = goals.select("source", "source_size", "target", full.alias("full")).withColumn(
        "rest", F.col("target") - F.col("full") * F.col("source_size")).withColumns(
        {"prefix": F.lit(0).cast("bigint"), "taken": F.lit(0).cast("bigint"), "mass": F.lit(0).cast("bigint"), "copies": F.lit(0).cast("bigint")})
    left = BITS
    for bits in LEVELS:
        state = cut_lineage(state)
        edge = state.where("rest > 0").select(F.col("source").alias("s"), "prefix", "taken", "rest")
        left -= bits
        cell = F.floor(F.col("hash") / F.lit(1 << left)).cast("bigint") if left else F.col("hash")
        rows = sizes.where("size > 0").select("source", "size", cell.alias("cell"))
        hist = (rows.join(edge, rows["source"].eqNullSafe(edge["s"]) & (F.shiftright("cell", bits) == F.col("prefix")))
                .groupBy("s", "cell", "taken", "rest").agg(F.sum("size").alias("mass"), F.count(F.lit(1)).alias("copies")))
        up = F.sum("mass").over(Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        run = hist.select("s", "cell", "mass", "copies", "rest", (F.col("taken") + up).alias("upto"))
        # the first cell in which the budget runs out
        first = (run.where(F.col("upto") >= F.col("rest")).groupBy("s")
                 .agg(F.min_by(F.struct("cell", "mass", "copies", "upto"), "cell").alias("b"))
                 .select("s", F.col("b.cell").alias("cell"), F.col("b.mass").alias("m"), F.col("b.copies").alias("c"), (F.col("b.upto") - F.col("b.mass")).alias("u")))
        state = (state.join(first, state["source"].eqNullSafe(first["s"]), "left")
                 .select("source", "source_size", "target", "full", "rest", F.coalesce("cell", F.lit(0)).alias("prefix"),
                         F.coalesce("u", F.lit(0)).alias("taken"), F.coalesce("m", F.lit(0)).alias("mass"), F.coalesce("c", F.lit(0)).alias("copies")))
    cut = F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(F.col("prefix")).cast("bigint")
    # rows of one hash are equal and of one size
    some = F.floor((F.col("rest") - F.col("taken")) * F.col("copies") / F.col("mass") + 0.5).cast("bigint")
    some = F.when((F.col("rest") > 0) & (F.col("mass") > 0), F.least("copies", some)).otherwise(F.lit(0).cast("bigint"))
    return state.select("source", "source_size", "target", "full", cut.alias("cut"), some.alias("some"), "copies")

def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``(doc, source, size, source_size, target, times, taken)`` for every
    document. What the levels read again is a written table of three numbers a
    document. The thresholds are a written table with a row for each source:
    the planner broadcasts it by its bytes, or shuffles, splitting a hot source."""
    narrow = cut_lineage(sized(docs, text, source, key, [key]).select("source", "size", "hash"))
    cuts = cut_lineage(thresholds(narrow, targets(narrow))).withColumnRenamed("source", "s")
    rows = sized(docs, text, source, key, carry)
    met = rows.join(cuts, rows["source"].eqNullSafe(cuts["s"]), "left")
    at_cut = F.col("hash") == F.col("cut")
    more = F.when(F.col("hash") < F.col("cut"), 1).when(at_cut, (F.col("some") > 0).cast("int")).otherwise(0)
    split = cuts.where("0 < some and some < copies")
    if not split.isEmpty():
        # a source whose boundary runs through equal rows: these alone are numbered
        through = at_cut & (F.col("some") > 0) & (F.col("some") < F.col("copies")) & (F.col("size") > 0)
        edge = range_numbered(met.where(through).select("doc", "source", "size", "source_size", "target", "full", "some"), ["source"], [], "place")
        met = met.where(~F.coalesce(through, F.lit(False))).withColumn("more", more).drop("hash", "s", "cut", "some", "copies").unionByName(
            edge.withColumn("more", (F.col("place") < F.col("some")).cast("int")).drop("some", "place"))
    else:
        met = met.withColumn("more", more)
    times = F.when(F.col("size") > 0, F.col("full") + F.col("more")).otherwise(F.lit(0))
    return (met.select("doc", "source", "size", "source_size", "target", times.cast("bigint").alias("times"))
            .withColumn("taken", F.col("times") * F.col("size")))

def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the
    columns they came with."""
    return (mixed(docs, text, source, key).where("times > 0")
            .select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("doc.*"))

