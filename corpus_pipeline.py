"""A training corpus from ``documents``: five stages, each an operator of
``logweave.llm`` with its production parameters.

Each stage reads what the one before it kept, as a written table; all but the
last return the columns of documents. The last adds the place in the shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontam, host_rules, jaccard, mixing, sharding
from logweave.llm.common import cut_lineage, read, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host does."""
    return host_rules.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship_package(spark)
    return jaccard.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    ship_package(spark)
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``shard`` and ``slot`` (replacing columns so named)."""
    ship_package(spark)
    out = sharding.sharded(docs)
    return out.select(*[out["doc"][c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")], "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("shards", shards),
]

#: MinHash and the shuffle's random generator have no SQL form; ``tests/llm`` compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
