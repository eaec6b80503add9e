"""End-to-end run over real files: text logs (one log per file) and an
optional markdown corpus, all modes at once - the Spark form of running the
reference's per-mode scripts on a log file, for any number of logs.

Cleaned lines and template counts are written to the shared folder once; the
results are lazily built on them, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import fix_heading_line
from logweave.operators import chi2, chunking, clusters, labels, retrieval, scoring, templates
from logweave.plans import modes
from logweave.session import cut_lineage
from logweave.sources import corpus, logs


def analyze_log_files(spark: SparkSession, log_path: str, corpus_path: str | None = None,
                      label_cache: DataFrame | None = None, miner: str = "similarity") -> dict[str, DataFrame]:
    """Mine, score and explain every log under ``log_path``.

    ``miner`` is ``"similarity"`` (M1b: trained on the log, frozen, every line
    matched) or ``"positional"`` (M1a: one template per key, no Python).

    ``label_cache`` (template, label) is an existing cache (SRC4); new
    templates get rule labels (L3) and are upserted (SNK1). With
    ``corpus_path`` the markdown files are repaired, sectioned, filtered and
    chunked, and each (log, mode) retrieval query gets its BM25 context.
    """
    lines = logs.with_clean(logs.scan_text_logs(spark, log_path, policy="empty"))
    lines = cut_lineage(lines)  # cleaned once for training, matching, clustering and the log text
    freq = cut_lineage(templates.mine_similarity(lines) if miner == "similarity" else templates.mine_positional(lines))
    static = scoring.static_scores(freq)
    empty = spark.range(0).select(F.lit("").alias("template"), F.lit("").alias("label"))
    existing = label_cache if label_cache is not None else empty
    delta = labels.unlabelled_templates(freq, existing)
    cache = labels.upsert_labels(existing, labels.rule_labels(delta.select("template").distinct()))
    learned = chi2.learned_words(cache)
    dynamic = scoring.dynamic_scores(freq, learned, cache)
    assigned = clusters.cluster_lines(lines).select("log_id", "line_no", F.col("clean").alias("line"), "cluster")
    rare = clusters.rare_clusters(assigned, keys=("log_id",)).select("log_id", "rank", F.col("line").alias("template"))
    events = (scoring.top_n(static, 5).select("log_id", "rank", "template").withColumn("extraction", F.lit("static"))
              .unionByName(scoring.top_n(dynamic, 5).select("log_id", "rank", "template")
                           .withColumn("extraction", F.lit("dynamic")))
              .unionByName(rare.withColumn("extraction", F.lit("cluster"))))
    ev = modes.format_events(events).join(modes.concat_query(events), ["log_id", "extraction"])
    translated = ev.where(F.col("extraction") == "dynamic").select("log_id", F.lower("rag_query").alias("translated"))
    all_modes = modes.run_all_modes(lines.select("log_id").distinct(), ev, translated)
    out = {"lines": lines, "template_freq": freq, "static_scores": static, "label_cache": cache,
           "learned_words": learned, "dynamic_scores": dynamic, "rare_clusters": rare, "modes": all_modes,
           "segments": logs.line_segments(lines)}
    if corpus_path is None:
        no_ctx = all_modes.select("log_id", "mode", F.lit(None).cast("string").alias("context")).where(F.lit(False))
        out["prompts"] = modes.build_prompts(all_modes, no_ctx)
        return out
    md = corpus.scan_markdown(spark, corpus_path).withColumn("line", fix_heading_line(F.col("line")))
    secs = chunking.filter_sections(chunking.split_headers(md))
    chunks = (chunking.chunk_texts(secs, ["doc_id", "source", "chunk_seq", "h2", "h3"])
              .withColumn("chunk_id", F.xxhash64("doc_id", "chunk_seq", "piece")))
    qs = all_modes.where(F.col("rag_query").isNotNull()).select(
        F.concat(F.col("log_id"), F.lit("#"), F.col("mode").cast("string")).alias("query_id"),
        F.col("rag_query").alias("query"))
    hits = retrieval.bm25_topk(chunks, qs, id_col="chunk_id")
    hits = retrieval.with_sections(hits.withColumnRenamed("doc_id", "chunk_id").withColumnRenamed("chunk_id", "doc_id"),
                                   chunks.withColumnRenamed("doc_id", "_d").withColumnRenamed("chunk_id", "doc_id"))
    ctx = modes.context_block(hits).select(F.split("query_id", "#")[0].alias("log_id"),
                                           F.split("query_id", "#")[1].cast("int").alias("mode"), "context")
    out.update({"chunks": chunks, "hits": hits, "contexts": ctx, "prompts": modes.build_prompts(all_modes, ctx)})
    return out
