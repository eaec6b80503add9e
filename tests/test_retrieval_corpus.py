"""Retrieval (R5-R7), chunking (R1, R3, F12), clusters (C3-C6), modes."""

import functools
import math

import pytest
from pyspark.sql import functions as F

from logweave.operators import chunking, clusters, retrieval
from logweave.plans import modes


def test_bm25_and_rrf_invariant(spark):
    docs = spark.createDataFrame([(1, "harq nack on pucch"), (2, "dtx on pucch detected"), (3, "sky is blue"),
                                  (4, "pucch pucch dtx"), (5, "nothing here"), (6, "harq harq harq")],
                                 "doc_id long, text string")
    qs = spark.createDataFrame([(0, "dtx pucch")], "query_id long, query string")
    bm = retrieval.bm25_topk(docs, qs)
    got = [r.doc_id for r in bm.orderBy("rank").collect()]
    assert set(got) == {1, 2, 4} and got[0] == 4
    vec = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 6, 3), (0, 5, 4), (0, 3, 5)],
                                "query_id long, doc_id long, rank int")
    fused = retrieval.hybrid_rrf(bm, vec, docs).orderBy("rank").collect()
    # every vector hit outranks every BM25-only hit: 0.7/65 > 0.3/61
    vec_ids = {1, 2, 6, 5, 3}
    first_bm_only = min(r.rank for r in fused if r.doc_id not in vec_ids)
    assert all(r.rank < first_bm_only for r in fused if r.doc_id in vec_ids)
    assert 5 <= len(fused) <= 10


def test_cosine_threshold(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.2])],
                              "doc_id long, embedding array<float>")
    got = [(r.doc_id, round(r.score, 4)) for r in retrieval.cosine_topk(q, c).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 0.7071)]


def test_pieces_are_bounded_and_cover_the_text():
    text = "\n\n".join(("para %d " % i) + " ".join(f"word{j}" for j in range(300)) for i in range(6))
    pieces = chunking.bounded_pieces(text, 1000, 100)
    assert all(len(p) <= 1000 for p in pieces) and len(pieces) > 6
    joined = " ".join(pieces)
    assert all(f"word{j}" in joined for j in range(300))
    assert [w for p in chunking.bounded_pieces(text, 1000, 0) for w in p.split()] == text.split()
    assert "".join(chunking.bounded_pieces("x" * 2500, 1000, 100)) == "x" * 2500 and chunking.bounded_pieces(" \n", 10, 2) == []
    assert chunking.bounded_pieces("a b c", 1, 0) == ["a", "b", "c"]
    # neighbours share words (overlap)
    assert any(set(pieces[i].split()[-5:]) & set(pieces[i + 1].split()[:20]) for i in range(len(pieces) - 1))


def test_split_headers_and_filter(spark):
    lines = ["## 1 Scope", "scope text", "## 5 MAC", "### 5.1 RA", "ra text", "", "second para", "```", "## not a header",
             "```", "#### 5.1.1.1 deep", "deep text", "## 6 Next", "next text"]
    df = spark.createDataFrame([(1, "a.md", i, l) for i, l in enumerate(lines)],
                               "doc_id long, source string, ord long, line string")
    ch = chunking.split_headers(df).orderBy("chunk_seq").collect()
    texts = [c.text for c in ch]
    assert texts[0] == "## 1 Scope\nscope text"
    assert texts[1] == "## 5 MAC  \n### 5.1 RA\nra text  \nsecond para\n```\n## not a header\n```"
    assert (ch[1].h2, ch[1].h3) == ("5 MAC", "5.1 RA")
    assert (ch[2].h2, ch[2].h3, ch[2].h4) == ("5 MAC", "5.1 RA", "5.1.1.1 deep")
    assert (ch[3].h2, ch[3].h3, ch[3].h4) == ("6 Next", None, None)
    kept = [c.h2 for c in chunking.filter_sections(chunking.split_headers(df)).collect()]
    assert "1 Scope" not in kept and "6 Next" in kept


def test_cluster_report_first_seen_ties(spark):
    rows = [(0, "a", "x"), (1, "a", "y"), (2, "b", "z"), (3, "b", "z"), (4, "c", "w"), (5, "a", "y"), (6, "a", "x")]
    df = spark.createDataFrame(rows, "line_no long, cluster string, line string")
    rep = {r.cluster: (r.rank, r.size, r.line) for r in clusters.cluster_report(df).collect()}
    assert rep == {"c": (1, 1, "w"), "b": (2, 2, "z"), "a": (3, 4, "x")}


def test_modes_and_prompts(spark):
    logs_df = spark.createDataFrame([("L",)], "log_id string")
    ev = spark.createDataFrame([("L", "static", 1, "A <*> x"), ("L", "static", 2, "B")],
                               "log_id string, extraction string, rank int, template string")
    eq = modes.format_events(ev).join(modes.concat_query(ev), ["log_id", "extraction"])
    r = eq.first()
    assert r.events_text == "1. A <*> x\n2. B" and r.rag_query == "A  x B"
    am = modes.run_all_modes(logs_df, eq, spark.createDataFrame([("L", "q")], "log_id string, translated string"))
    rows = {x.mode: x for x in am.collect()}
    assert len(rows) == 13 and rows[1].rag_tag == "wo_rag" and rows[5].rag_tag == "with_rag_concat"
    assert rows[6].rag_query == "q" and rows[5].rag_query == "A  x B" and not rows[3].writes_events
    ctx = spark.createDataFrame([("L", 5, "CTX")], "log_id string, mode int, context string")
    p = {x.mode: x for x in modes.build_prompts(am, ctx).collect()}
    assert p[5].prompt_tail.startswith("\n\n        RELEVANT CONTEXT (3GPP 38.321 + OAI MAC):\n        CTX")
    assert "FIVE ANOMALOUS EVENTS DETECTED:\n        1. A <*> x\n2. B" in p[5].prompt_tail
    assert p[1].prompt_head == "\n        MAC LAYER LOGS:\n        "


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"log_id", "rank", "template", "cnt", "first_idx", "sig", "score"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_scan_markdown_and_guards(spark, tmp_path):
    import pytest

    from logweave.sources.corpus import MissingInputError, require_paths, scan_markdown

    (tmp_path / "a.md").write_text("## 5.1.1 X\ntext\n")
    (tmp_path / "b.pdf").write_text("binary")
    lines = scan_markdown(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.line for r in lines] == ["## 5.1.1 X", "text", ""] and lines[0].source.endswith("a.md")
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(MissingInputError):
        scan_markdown(spark, str(empty))
    with pytest.raises(MissingInputError):
        require_paths(str(tmp_path / "chunks"), str(tmp_path))


def test_analyze_log_files_end_to_end(spark, tmp_path):
    from logweave.plans.runbook import analyze_log_files

    logs_dir = tmp_path / "logs"
    logs_dir.mkdir()
    body = []
    for i in range(30):
        body.append(f"\x1b[0m[NR_MAC]   UE {i % 3} CQI  {i % 4} MCS (1) {i % 5}")
        if i % 10 == 9:
            body.append(f"{i}.1s [MAC] NR HARQ NACK #{i} for RNTI=1 ProcessID={i % 16} dropped")
    (logs_dir / "du.txt").write_text("\n".join(body) + "\n")
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "spec.md").write_text("## 5.4.1 HARQ operation\nNACK handling and retransmission dropped\n\n"
                                  "## Foreword\nboilerplate\n## 5.2 CQI\nCQI reporting\n")
    out = analyze_log_files(spark, str(logs_dir), str(docs))
    top = out["static_scores"].orderBy("rank").first()
    assert "NACK" in top.template
    assert out["modes"].count() == 13
    assert out["chunks"].where("h2 = 'Foreword'").count() == 0
    prompts = {r.mode: r for r in out["prompts"].collect()}
    assert len(prompts) == 13 and "FIVE ANOMALOUS EVENTS DETECTED" in prompts[5].prompt_tail


def test_cosine_blocks_give_the_same_rows(spark):
    """Queries in one block and in many give the same hits, ties by id, zero and null vectors included."""
    import random

    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)] if i % 17 else [0.0] * 6) for i in range(120)] + [(500, None)]
    corpus = spark.createDataFrame(vectors, "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in vectors[::5]] + [("none", None)], "query_id string, embedding array<double>")
    one = sorted(map(tuple, retrieval.cosine_topk(queries, corpus).collect()))
    many = sorted(map(tuple, retrieval.cosine_topk(queries, corpus, block_bytes=600).collect()))
    assert one == many and one
    assert retrieval.cosine_topk(queries.limit(0), corpus).count() == 0


def test_queries_of_the_same_known_terms_share_a_profile(spark):
    docs = spark.createDataFrame([(i, f"link w{i % 5} beam" if i % 3 else f"link link {i}") for i in range(40)], "doc_id long, text string")
    qs = spark.createDataFrame([("a", "link w1 unknown7"), ("b", "other w1  link"), ("c", "link link w1"), ("d", "none here"), ("e", None), ("f", "beam"), ("f", "w2")],
                               "query_id string, query string")
    index = retrieval.bm25_index(docs)
    of = {r.query_id: r.profile for r in retrieval.query_profiles(qs, index[0]).collect()}
    assert of == {"a": "link w1", "b": "link w1", "c": "link link w1", "f": "beam w2"}
    whole = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in retrieval.bm25_topk(docs, qs, index=index).collect()}
    shared = spark.createDataFrame([(p, p) for p in set(of.values())], "query_id string, query string")
    hits = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in retrieval.bm25_topk(docs, shared, index=index).collect()}
    assert whole == {(q, rank): hit for q, p in of.items() for (p2, rank), hit in hits.items() if p2 == p} and len(whole) == 20


def test_bm25_scores_where_the_documents_lie(spark):
    """No term's postings meet in one task; blocks and tasks change no row."""
    docs = spark.createDataFrame([(i, f"link w{i % 7}") for i in range(60)], "doc_id long, text string")
    qs = spark.createDataFrame([(i, f"link w{i} w{i + 1}") for i in range(6)], "query_id long, query string")
    one = retrieval.bm25_topk(docs, qs)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(doc_id" in plan
    rows = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in one.collect())
    many = retrieval.bm25_topk(docs, qs, block_bytes=400, task_pairs=20)
    assert len(rows) == 30 and rows == sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in many.collect())


def test_queries_are_streamed_past_their_texts(spark):
    queries = spark.createDataFrame([(f"q{i}", "often" if i % 5 else f"p{i % 3}") for i in range(400)] + [("none", "unknown")], "query_id string, profile string")
    texts = spark.createDataFrame([(p, f"{p} " * 90) for p in ("often", "p0", "p1", "p2", "unused")], "profile string, context string")
    want = sorted((r.query_id, r.profile, f"{r.profile} " * 90) for r in queries.collect() if r.profile != "unknown")
    for task_bytes in (1 << 30, 20_000):
        got = modes.with_texts(queries, texts, "profile", "context", task_bytes)
        assert got.columns == ["query_id", "profile", "context"] and sorted(map(tuple, got.collect())) == want
    many = got.where("profile = 'often'").groupBy(F.spark_partition_id()).count().collect()
    assert len(many) > 2 and max(r["count"] for r in many) < 320


@pytest.mark.parametrize("name", ["chunk_listing", "context_block"])
def test_a_text_of_many_queries_is_not_joined_at_once(spark, monkeypatch, name):
    """All queries share a profile: neither side is built whole while the texts stream past."""
    from logweave.plans import catalog

    profiles = spark.createDataFrame([(f"ue-{i}#3", "ue ue") for i in range(50)], "query_id string, profile string")
    hits = spark.createDataFrame([("ue ue", i, i, "web", "", "", f"text {i}") for i in (1, 2)], "profile string, rank int, doc_id long, source string, h2 string, h3 string, text string")
    monkeypatch.setattr(catalog, "mode_profiles", lambda spark, d: profiles)
    monkeypatch.setattr(catalog, "mode_hits", lambda spark, d: hits)
    got = catalog.QUERIES[name](spark, "")
    rows = got.collect()
    assert sorted(r[0] for r in rows) == sorted(f"ue-{i}#3" for i in range(50)) and len({r[1] for r in rows}) == 1 and "text 2" in rows[0][1]
    joins = [line for line in _plan(got).splitlines() if "Join" in line and "profile" in line and "_part" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers_are_split_after_one_shuffle(spark):
    df = spark.createDataFrame([(1, "s", 0, "## a"), (1, "s", 1, "x"), (None, "s", 0, "lost")], "doc_id long, source string, ord long, line string")
    plan = _plan(chunking.split_headers(df))
    assert plan.count("Exchange ") == 1 and plan.count("Window [") <= 4
    assert [r.text for r in chunking.split_headers(df).collect()] == ["## a\nx"]


def test_document_lines_of_repeated_ids(spark, tmp_path):
    """Rows of one id: each is numbered from every start and has every source, as the joins by id gave them."""
    from logweave.plans.catalog import document_md_lines

    rows = [(1, "a", "x\ny"), (2, "b", "p\n\nq"), (2, None, "r\ns\nt"), (3, "c", None), (None, "d", "lost")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = document_md_lines(spark, str(tmp_path))
    assert _plan(df).count("Exchange hashpartitioning") == 1  # the lines are not shuffled again
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(1, "a", 0, "x"), (1, "a", 1, "y"), (3, "c", 0, "")]
    want += [(2, src, first + i, line) for src in ("b", None) for first in (0, 3) for text in (rows[1][2], rows[2][2]) for i, line in enumerate(text.split("\n"))]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_embedded_chunks_against_plain_tfidf(spark, tmp_path, monkeypatch):
    """Every chunk's weights by hand; a text is cut into words and hashed in one job."""
    from pyspark.ml.feature import HashingTF

    from logweave.plans import catalog

    texts = {1: "## One\na b b\u3000c\n## Two\na d", 2: "a\n\nb  e\tf", 3: " \n", 4: None, 5: "a " * 4000}
    spark.createDataFrame([(i, "s", t) for i, t in texts.items()], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cut = []
    monkeypatch.setattr(catalog, "spaced_words", lambda c, f=catalog.spaced_words, n=spark.sparkContext.accumulator(0): (cut.append(n), F.udf(
        lambda t: (n.add(1), t)[1])(f(c)))[1])
    got = {r.chunk_id: r.embedding for r in catalog.q_embed_chunks(spark, str(tmp_path)).collect()}
    chunks = {r.chunk_id: r.text.split() for r in catalog.q_chunk_corpus(spark, str(tmp_path)).withColumn("chunk_id", F.xxhash64("doc_id", "chunk_seq", "piece")).collect()}
    assert set(got) == set(chunks) and len(chunks) == 5 and cut[0].value == 5
    place = functools.cache(HashingTF(numFeatures=1 << 12).indexOf)
    slots = {i: {place(w) for w in words} for i, words in chunks.items()}
    for i, words in chunks.items():
        want = [0.0] * 4096
        for w in words:
            want[place(w)] += math.log((len(chunks) + 1) / (sum(place(w) in s for s in slots.values()) + 1))
        norm = math.sqrt(sum(x * x for x in want))
        assert got[i] == pytest.approx([x / norm if norm else 0.0 for x in want], abs=1e-6)
