"""Template scoring and ranking.

Inputs are template frequencies ``(log_id, template, cnt, first_idx, n_lines)``.
All arithmetic is column expressions; ranking is a per-log window whose
partitions hold templates (not lines), ordered by score then first
appearance (the reference's stable sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import literal_table

from logweave.functions.stem import stem_table
from logweave.functions.text import words
from logweave.functions.vocab import (ANOMALOUS, WEIGHT_ANOMALOUS, WEIGHT_OTHER,
                                      significant_stems)


def rarity(cnt="cnt", n="n_lines"):
    """``1 - cnt/N``."""
    return F.lit(1.0) - F.col(cnt) / F.col(n)


def temporal(first="first_idx", n="n_lines"):
    """``1 - first/N`` (earlier = likelier root cause)."""
    return F.lit(1.0) - F.col(first) / F.col(n)


def template_words(freq: DataFrame, col: str = "template") -> DataFrame:
    """F14 per template, as a set: ``(log_id, template, word)``."""
    return (freq.select("log_id", col, F.explode(F.array_distinct(words(F.col(col)))).alias("word"))
            .distinct())


def static_significance(freq: DataFrame) -> DataFrame:
    """Number of significant stems present among the stems of the
    template's words. Stemming runs once per distinct word (F15)."""
    spark = freq.sparkSession
    tw = template_words(freq)
    stems = stem_table(tw)
    sig = literal_table(spark, significant_stems(), "stem")
    hits = (tw.join(stems, "word").join(F.broadcast(sig), "stem", "left_semi")
            .groupBy("log_id", "template").agg(F.countDistinct("stem").alias("sig")))
    return (freq.join(hits, ["log_id", "template"], "left")
            .withColumn("sig", F.coalesce(F.col("sig"), F.lit(0)).cast("int")))


def rank_scores(scored: DataFrame, score: str = "score") -> DataFrame:
    """Rank per log by score desc, first appearance asc."""
    w = Window.partitionBy("log_id").orderBy(F.desc(score), F.asc("first_idx"))
    return scored.withColumn("rank", F.row_number().over(w))


def top_n(ranked: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` per log (Spark plans this as a window group limit)."""
    return ranked.where(F.col("rank") <= n)


def static_scores(freq: DataFrame) -> DataFrame:
    """``rarity * (sig + 1) * (1 + temporal)``, ranked."""
    s = static_significance(freq)
    s = s.withColumn("score", rarity() * (F.col("sig") + F.lit(1)) * (F.lit(1.0) + temporal()))
    return rank_scores(s)


def dynamic_significance(freq: DataFrame, learned: DataFrame) -> DataFrame:
    """S3: number of learned words (raw, set semantics) present in the template."""
    tw = template_words(freq)
    hits = (tw.join(learned.select("word").distinct(), "word", "left_semi")
            .groupBy("log_id", "template").agg(F.count(F.lit(1)).alias("dsig")))
    return (freq.join(hits, ["log_id", "template"], "left")
            .withColumn("dsig", F.coalesce(F.col("dsig"), F.lit(0)).cast("int")))


def dynamic_scores(freq: DataFrame, learned: DataFrame, labels: DataFrame) -> DataFrame:
    """``rarity * (dsig + 1) * weight``; weight 10 for ANOMALOUS
    labels, 0.01 for anything else or no label. Position is not used."""
    s = dynamic_significance(freq, learned)
    lab = labels.select("template", F.col("label"))
    s = s.join(lab, "template", "left")
    weight = F.when(F.col("label") == ANOMALOUS, F.lit(WEIGHT_ANOMALOUS)).otherwise(F.lit(WEIGHT_OTHER))
    s = s.withColumn("weight", weight).withColumn(
        "score", rarity() * (F.col("dsig") + F.lit(1)) * F.col("weight"))
    return rank_scores(s)
