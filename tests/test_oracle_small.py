"""Registered queries against their DuckDB formulations on the smallest fixture
(the full comparison at sf0.01 is tools/oracle_compare.py)."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CHEAP = ["clean_lines", "template_freq", "static_scores", "nack_streak", "event_impact", "asof_metrics",
         "cluster_report", "cosine_topk", "split_headers", "parse_trace", "chi2_words", "run_all_modes"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("fixture tables not present")
    con = duckdb.connect()
    for t in ("events", "documents", "labels", "embeddings", "benchmark", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_oracle(spark, duck, name):
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tools.oracle_compare import rows

    import __spark_entry__ as E

    got = E.queries()[name](spark, SF).toPandas()
    want = duck.sql(E.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_rows_only_queries_against_brute_force(spark):
    """Rows-only queries checked against plain Python on the small fixture."""
    import html

    import pandas as pd

    import __spark_entry__ as E
    from logweave.functions.stem import porter_stem

    q = E.queries()
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.html for r in q["html_unescape_full"](spark, SF).collect()}
    assert got == {p: html.unescape(h) for p, h in zip(pages.page_id, pages.html)}
    stems = q["stem_vocab"](spark, SF).collect()
    assert stems and all(r.stem == porter_stem(r.word) for r in stems)
    chunks = q["chunk_corpus"](spark, SF).collect()
    assert chunks and all(len(r.text) <= 5000 for r in chunks)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    words_in = {w for t in docs.text.fillna("") for w in t.split()}
    words_out = {w for r in chunks for w in r.text.split()}
    assert words_out <= words_in and len(words_out) >= 0.99 * len(words_in)


def test_drain_templates_equal_sequential_python(spark):
    """M1b on the small event log equals a sequential single-process run
    (every key group fits one chunk, so the result must be exact)."""
    import __spark_entry__ as E
    from test_mining import sequential_clusters
    from logweave.plans import catalog

    lines = catalog.event_lines(spark, SF).select("log_id", "line_no", "clean").toPandas()
    want = set()
    groups: dict = {}
    for r in lines.sort_values(["log_id", "line_no"]).itertuples():
        toks = r.clean.split(" ") if r.clean else []
        first = toks[0] if toks else ""
        key = (r.log_id, len(toks), "<*>" if any(ch.isdigit() for ch in first) else first)
        g = groups.setdefault(key, {})
        g.setdefault(r.clean, toks)
    for key, g in groups.items():
        for tmpl in sequential_clusters(list(g.values())):
            want.add((key[0], " ".join(tmpl)))
    got = {(r.log_id, r.template) for r in E.queries()["drain_templates"](spark, SF).collect()}
    assert got == want


def test_rows_only_vectors_and_listing(spark):
    import math

    import __spark_entry__ as E

    q = E.queries()
    names = sorted(r.name for r in q["list_sources"](spark, SF).collect())
    assert names == sorted(f for f in os.listdir(SF) if not f.endswith(".md"))
    for r in q["embed_chunks"](spark, SF).collect():
        norm = math.sqrt(sum(x * x for x in r.embedding))
        assert norm == 0.0 or abs(norm - 1.0) < 1e-4
    cl = q["cluster_lines"](spark, SF)
    lines = q["clean_lines"](spark, SF).groupBy("log_id").agg(F.count_distinct("clean").alias("n"), F.count(F.lit(1)).alias("all"))
    sizes = {r.log_id: (r.n, r.all) for r in lines.collect()}
    got = {}
    for r in cl.select("log_id", "cluster", "line_no").collect():
        got.setdefault(r.log_id, []).append(r.cluster)
    assert {k: len(v) for k, v in got.items()} == {k: n for k, (_, n) in sizes.items()}
    for k, v in got.items():  # every log has clusters of its own, as many as it can have up to 15
        assert sorted(set(v)) == list(range(len(set(v)))) and min(2, sizes[k][0]) <= len(set(v)) <= min(15, sizes[k][0])


def test_similarity_miner_queries_against_sequential_rule(spark):
    """Train in line order, freeze, match every line to the template with most literals."""
    import __spark_entry__ as E
    from test_mining import sequential_clusters

    q = E.queries()
    groups, logs = {}, {}
    for r in q["clean_lines"](spark, SF).orderBy("log_id", "line_no").collect():
        toks = r.clean.split(" ") if r.clean else []
        key = (r.log_id, len(toks), "<*>" if toks and any(c in "0123456789" for c in toks[0]) else toks[0] if toks else "")
        groups.setdefault(key, {}).setdefault(tuple(toks), None)
        logs.setdefault(r.log_id, []).append((key, toks, r.line_no))
    clusters = {k: sequential_clusters(list(map(list, lines))) for k, lines in groups.items()}
    want = {}
    for log, lines in logs.items():
        for key, toks, n in lines:
            fits = [(sum(a != "<*>" for a in c), -i, " ".join(c)) for i, c in enumerate(clusters[key]) if all(a in ("<*>", b) for a, b in zip(c, toks))]
            at = want.setdefault((log, max(fits)[2] if fits else "UNMATCHED"), [0, n, len(lines)])
            at[0] += 1
    got = {(r.log_id, r.template): [r.cnt, r.first_idx, r.n_lines] for r in q["drain_freq"](spark, SF).collect()}
    assert got == want
    scored = q["similarity_static_scores"](spark, SF).collect()
    assert {(r.log_id, r.template) for r in scored} == set(want)
    for r in scored:
        cnt, first, n = want[r.log_id, r.template]
        assert abs(r.score - (1 - cnt / n) * (r.sig + 1) * (1 + 1 - first / n)) < 1e-5
    assert {(r.log_id, r.template) for r in q["similarity_dynamic_scores"](spark, SF).collect()} == set(want)
