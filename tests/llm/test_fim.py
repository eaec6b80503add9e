"""Fill-in-the-middle: cuts, forms and the way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.llm import fim
from logweave.llm.queries import op13_fill_in_middle


def by_hand(doc_id, text, rate=100, spm=50):
    """The same by plain slices of the list of lines."""
    text = text or ""
    lines = text.splitlines(keepends=True) if not re.search("[\x0b\x0c\r\x1c-\x1e\x85  ]", text) else re.findall(fim.LINE, text)
    hashed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hashed[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1000, 40000])
@pytest.mark.parametrize("bits", [1, 2, 4])
def test_offsets_are_prefix_sums(n, bits):
    rng = random.Random(n)
    widths = [rng.choice((1, 1, 2, 80, 5000)) for _ in range(n)]
    units = fim.SkipList(widths, lane_bits=bits)
    assert n < 64 or len(units.lanes) > 2
    for _, passed, points in units.lanes:
        assert passed.sum() == n and points.sum() == sum(widths)
    for rank in {0, n, *(rng.randrange(n + 1) for _ in range(60))}:
        assert units.offset(rank) == sum(widths[:rank])


def test_express_lanes_shorten_the_way():
    lanes = fim.SkipList([3] * 100000).lanes
    assert len(lanes[-1][1]) < 40 and all(len(a[1]) < 0.4 * len(b[1]) for a, b in zip(lanes[1:-3], lanes[:-4]))


TEXTS = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\r\nb\x0bc d\x85e\n", "ä😀\nß\n" * 50, "has <P> mark\nx", "<S>", "x<M>",
         "ends with <\nand <P\nor <S", "<\n<P\n<M\n<S\n>" * 9, "long " * 400000 + "\n", "l\n" * 300000, "same\n" * 9, "same\n" * 9]


def test_transformed_equals_slices(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "no\nkey\n", None, None), (5, "two\nof one key", 1, "x"), (5, "two\nof one key", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int, form string")
    out = fim.transformed(df).withColumn("back", fim.restored())
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, (tuple(r.doc) for r in got))) == sorted(map(repr, rows))
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc.doc_id, r.doc.text)
        assert r.back == (r.doc.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(df.limit(0)).collect() == []


def test_rates_and_other_units(spark):
    df = spark.createDataFrame([(f"k{i}", f"some words here, {i}\nand more") for i in range(300)], "id string, body string")
    out = fim.transformed(df, key="id", text="body", unit=r"\S+\s*|\s+", rate=40, spm_rate=0).withColumn("back", fim.restored())
    forms = {r.form: r["count"] for r in out.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 80 <= forms["psm"] <= 160
    assert out.where("back <> doc.body or n <> 6").count() == 0
    with pytest.raises(Exception, match="whole text"):
        fim.transformed(df, key="id", text="body", unit=r"\w+").collect()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_fill_in_middle(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        n, form, prefix, middle, output = by_hand(r.doc_id, docs[r.doc_id])
        sha = hashlib.sha256(output.encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, prefix, middle, sha)
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_restored_is_native(spark):
    df = spark.createDataFrame([("<P>a<<S>c\n<M>b<P", "psm"), ("<S>c<P>a<M>b", "spm"), ("a", "plain"), ("<P><S><M>", "psm")], "output string, form string")
    assert [r[0] for r in df.select(fim.restored()).collect()] == ["a<b<Pc\n", "abc", "a", ""]
    assert df.select(F.lit(1)).count() == 4
