"""Passage retrieval: BM25, exact cosine top-k, weighted reciprocal-rank
fusion (R5-R9). Many queries run in one job; nothing loops per query.

BM25 (Okapi; k1 = 1.5, b = 0.75; terms are case-sensitive whitespace tokens;
negative idf replaced by 0.25 x mean idf over the vocabulary):
  score(q, d) = sum over query tokens t (with repetition)
                idf(t) * tf(t,d) * (k1 + 1) / (tf(t,d) + k1 * (1 - b + b * dl / avgdl))
Only documents sharing a term with the query are scored; ties rank by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.text import whitespace_tokens
from logweave.session import BROADCAST_BYTES, cut_lineage

# fixed values: retriever parameters of the reference pipeline
K1 = 1.5
B = 0.75
EPSILON = 0.25
TOP_K = 5
COSINE_THRESHOLD = 0.3
BM25_WEIGHT = 0.3
VECTOR_WEIGHT = 0.7
RRF_C = 60
#: (Query, term, document) triples scored in a task.
TASK_PAIRS = 1 << 20


def bm25_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Corpus statistics that do not depend on the queries:
    ``term_idf(term, idf)`` over the whole vocabulary (negative idf floored
    to 0.25 x mean idf) and a one-row ``stats(n_docs, avgdl)``. Build once
    per corpus (and persist) - every query batch reuses them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"),
                     F.avg(F.size(whitespace_tokens(text))).alias("avgdl"))
    n_docs = stats.select("n_docs").scalar()
    dfreq = (docs.select(F.explode_outer(F.array_distinct(whitespace_tokens(text))).alias("term"))
             .where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    raw = dfreq.withColumn("idf_raw", F.log(n_docs - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5)))
    mean_idf = raw.agg(F.avg("idf_raw")).scalar()
    idf = raw.select("term", F.when(F.col("idf_raw") < 0, F.lit(EPSILON) * mean_idf)
                     .otherwise(F.col("idf_raw")).alias("idf"))
    return idf, stats


def query_profiles(queries: DataFrame, idf: DataFrame, qid_col: str = "query_id", qtext_col: str = "query") -> DataFrame:
    """``(query_id, profile)``: the terms of each query that the corpus knows,
    with repetition, sorted and joined by a space. A ranking depends on nothing
    else of a query, so queries of one profile share theirs; the profile is a
    query text itself. Queries without a known term have no hits and no row."""
    terms = queries.select(F.col(qid_col).alias("query_id"), F.explode(whitespace_tokens(F.coalesce(F.col(qtext_col), F.lit("")))).alias("term"))
    known = cut_lineage(terms.select("term").distinct().join(idf.select("term"), "term"))
    return terms.join(known, "term").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("profile"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "doc_id",
              text_col: str = "text", qid_col: str = "query_id", qtext_col: str = "query",
              index: tuple[DataFrame, DataFrame] | None = None, block_bytes: int = BROADCAST_BYTES, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` for every query at once.

    Postings are built only for terms that occur in some query (semi-join),
    in one tokenisation pass; ``index`` (from ``bm25_index``) supplies idf
    and corpus statistics, built here when not given. They are dealt out by
    document, to so many tasks that each scores some ``task_pairs`` triples
    (counted beforehand), and meet the queries' weighted terms in blocks of
    ``block_bytes``, each broadcast: a score is summed where its document lies,
    and neither a frequent term nor a larger corpus makes a task larger. The
    per-query top-k is a window group limit (partial top-k before the shuffle).
    """
    idf, stats = index if index is not None else bm25_index(docs, id_col, text_col)
    avgdl = stats.select("avgdl").scalar()
    qterms = (queries.select(F.col(qid_col).alias("query_id"),
                             F.explode(whitespace_tokens(F.coalesce(F.col(qtext_col), F.lit("")))).alias("term"))
              .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    weights = cut_lineage(qterms.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    vocab = weights.select("term").distinct()
    toks = docs.select(F.col(id_col).alias("doc_id"), whitespace_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    postings = cut_lineage(toks.select("doc_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term"))
                           .where(F.col("term").isNotNull())
                           .join(vocab, "term", "left_semi")
                           .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    users = weights.groupBy("term").agg(F.count(F.lit(1)).alias("users"),
                                        F.sum(64 + F.octet_length("term") + F.octet_length(F.coalesce(F.col("query_id").cast("string"), F.lit("")))).alias("bytes"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total, pairs = users.join(df, "term", "left").agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.col("users") * F.col("df")), F.lit(0))).first()
    blocks = max(1, -(-2 * total // block_bytes))
    tasks = max(2, pairs // (blocks * task_pairs) + 1)
    tf = F.col("tf")
    part = (F.col("weight") * (tf * F.lit(K1 + 1))
            / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / avgdl)))
    by_doc = postings.repartition(tasks, "doc_id")
    scored = None
    for block in range(blocks):
        own = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        more = by_doc.join(F.broadcast(own), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
        scored = more if scored is None else scored.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))


def unit_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """L2-normalise once (double precision); zero vectors stay zero."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return df.withColumn("_unit", F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, threshold: float = COSINE_THRESHOLD,
                qid_col: str = "query_id", qvec_col: str = "embedding", id_col: str = "doc_id",
                vec_col: str = "embedding", block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact cosine top-k with a similarity threshold,
    ``(query_id, rank, doc_id, score)``.

    The queries are the stated set that is compared with every row: they are
    taken in blocks of ``block_bytes`` of vectors (by a hash of their id, so many
    that a block stays below with room to spare), each broadcast while the corpus
    streams past. The threshold is applied in that pass, and the per-query top-k
    is a window group limit.
    """
    q = unit_vectors(queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("_qv")), "_qv") \
        .select("query_id", F.col("_unit").alias("qu"))
    c = unit_vectors(corpus.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("_cv")), "_cv") \
        .select("doc_id", F.col("_unit").alias("cu"))
    total = queries.agg(F.coalesce(F.sum(8 * F.greatest(F.size(qvec_col), F.lit(0)) + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes))
    pairs = None
    for block in range(blocks):
        own = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        sim = dot(F.col("qu"), F.col("cu"))
        part = c.join(F.broadcast(own), sim >= F.lit(threshold)).select("query_id", "doc_id", sim.alias("score"))
        pairs = part if pairs is None else pairs.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id"))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id", "score")


def hybrid_rrf(bm25: DataFrame, vector: DataFrame, texts: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", weights=(BM25_WEIGHT, VECTOR_WEIGHT), c: int = RRF_C) -> DataFrame:
    """Weighted reciprocal-rank fusion, de-duplicated by passage text.

    ``rrf(text) = sum_i w_i / (c + rank_i)``; order by rrf desc, then first
    appearance (BM25 list before vector list, by rank). The kept id is the
    first appearance's. ``(query_id, rank, doc_id, score)``.
    """
    t = texts.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_key"))
    both = (bm25.select("query_id", "doc_id", "rank", F.lit(0).alias("_src"), F.lit(weights[0]).alias("_w"))
            .unionByName(vector.select("query_id", "doc_id", "rank", F.lit(1).alias("_src"),
                                       F.lit(weights[1]).alias("_w")))
            .join(t, "doc_id"))
    fused = (both.groupBy("query_id", "_key")
             .agg(F.sum(F.col("_w") / (F.lit(c) + F.col("rank"))).alias("score"),
                  F.min(F.struct("_src", "rank", "doc_id")).alias("_first")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc("_first._src"), F.asc("_first.rank"))
    return fused.withColumn("rank", F.row_number().over(w)).select(
        "query_id", "rank", F.col("_first.doc_id").alias("doc_id"), "score")


def with_sections(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Source / Header 2 / Header 3 with the reference's defaults
    (``unknown`` and empty string)."""
    ch = chunks.select("doc_id", F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
                       F.coalesce(F.col("h2"), F.lit("")).alias("h2"), F.coalesce(F.col("h3"), F.lit("")).alias("h3"),
                       F.col("text"))
    return hits.join(ch, "doc_id", "left")
