"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontam, fim, host_rules, htmltext, jaccard, langid, lm, mixing, prefix_trie, quotes, records, sharding, sql, warc
from logweave.llm.common import read

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    out = htmltext.extracted(read(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.select("page.page_id", "page.url", "text", "n_chars")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    out = mixing.mixed(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc.doc_id", "size", "source_size", "target", "taken")


LLM_ORACLE["op2_mixing"] = sql.MIXING


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score under the model of the training part."""
    out = lm.scored(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the shuffled shards."""
    out = sharding.sharded(read(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "size", F.crc32(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the items and places."""
    return decontam.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with its place in its thread."""
    out = quotes.threaded(read(spark, sf_dir, "conversations"))
    return out.select("message.conv_id", "message.turn", "message.role", F.col("own_text").alias("text"), "n_quoted_lines",
                      "parent_turn", "root_turn", "depth")


@query
def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's record as read back from the files."""
    import public_tokenizers

    index = records.write_and_index(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and its links."""
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures and the verdict."""
    out = host_rules.judged(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


LLM_ORACLE["op9_host_rules"] = sql.HOST_RULES


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its language."""
    out = langid.identified(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"), carry=["page_id", "url"])
    return out.select("page.page_id", "page.url", "lang", F.round("probability", 6).alias("probability"), "text_lang", "declared", "host")


@query
def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    out = warc.archived(read(spark, sf_dir, "pages"))
    return out.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast("bigint").alias("refers_to"))


LLM_ORACLE["op11_warc_archives"] = sql.WARC


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


LLM_ORACLE["op12_prefix_trie"] = sql.PREFIX_TRIE


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as cut for filling in its middle, and put together again."""
    out = fim.transformed(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(), 256).alias("restored_sha256"))


LLM_ORACLE["op13_fill_in_middle"] = sql.FILL_IN_MIDDLE
