"""The trie of conversations: extents, names, sums, and a slow trie beside it."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import prefix_trie
from logweave.llm.queries import op12_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def n_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def rebuilt(convs, every=20):
    """``convs``: id -> turns in order."""
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, every))
        out[c] = list(convs.get(base, []))[:h] + turns[h:]
    return out


def by_hand(convs):
    """Every node, by listing all prefixes of all conversations."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    nodes = {}
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        saved = (len(m) - 1) * n_words(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in children
            below[p[:d]][1] += saved
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        nodes[p] = (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p] if p in children else 0, *below[p],
                    hashlib.sha256(ends.encode()).hexdigest())
    return sorted(nodes.values(), key=repr)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 33, 200])
def test_extents(n):
    rng = random.Random(n)
    for _ in range(20):
        lcp = np.array([0] + [rng.choice((0, 1, 2, 3, 9)) for _ in range(n - 1)])
        row = np.repeat(np.arange(n), 9)
        depth = np.tile(np.arange(1, 10), n)
        left, right = prefix_trie.extents(lcp, row, depth)
        for i, d, a, b in zip(row, depth, left, right):
            lo = hi = i
            while lo > 0 and lcp[lo] >= d:
                lo -= 1
            while hi < n - 1 and lcp[hi + 1] >= d:
                hi += 1
            assert (a, b) == (lo, hi)
        values = np.array([rng.randrange(99) for _ in range(n)])
        a, b = np.triu_indices(n)
        assert (prefix_trie.SparseMin(values).minimum(a, b) == [values[i:j + 1].min() for i, j in zip(a, b)]).all()


def conversations(seed, n=150):
    """Random ones that share beginnings: a very common first turn, copies, long ones."""
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", None, ""], ["hello you", "a b c", None, "", " \x0b ", "ä ö", "one\ntwo\tthree", "same"]
    convs = {}
    for c in rng.sample(range(-30, 8 * n), n):
        turns = [("system", "the common beginning of all")] * (rng.random() < 0.6)
        turns += [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.choice((0, 1, 2, 3, 5)))]
        convs[c] = turns or [("user", "alone")]
    ids = list(convs)
    for c in ids[:40]:
        convs[c] = convs[ids[50]]  # copies
    long = [("user", f"turn {i} {'x ' * (i % 3)}") for i in range(300)]
    convs |= {5001: long, 5002: long[:], 5003: long[:200] + [("user", "other")] + long[:80], 5004: long[:64], 5005: long[:65], 5006: long[:128] * 2,
              5020: long[:130], 5021: long[:3]}
    return convs


def table_of(spark, convs, seed=1):
    rows = [(c, i if i else None, r, t, 1, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    rows += [(None, 0, "user", "of no conversation", 1, "x"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n bigint, block string").repartition(5)


def empty_for_null(convs):
    return {c: [(r or "", t or "") for r, t in turns] for c, turns in convs.items()}


@pytest.mark.parametrize("run", [1, prefix_trie.RUN])
def test_trie_equals_listing(spark, run):
    convs = conversations(3)
    table = table_of(spark, convs)
    assert rows_of(prefix_trie.prefix_trie(table, run)) == by_hand(empty_for_null(convs))


def test_rebuilt_trie_equals_listing(spark):
    convs = conversations(4)
    table = table_of(spark, convs)
    want = rebuilt(empty_for_null(convs))
    assert any(not t for t in want.values())  # one without turns
    assert rows_of(prefix_trie.rebuilt_trie(table)) == by_hand(want)


def test_many_members_end_at_a_node(spark):
    rows = [(c, 0, "user", "the same words") for c in range(9000)] + [(c, 1, "user", "more") for c in range(0, 9000, 2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    same, more = [("user", "the same words")], [("user", "the same words"), ("user", "more")]
    assert rows_of(prefix_trie.prefix_trie(df)) == by_hand({c: same if c % 2 else more for c in range(9000)})


def test_ties_repeated_rows_and_long_texts(spark):
    long = "word " * 300000
    rows = [(1, 0, "a", long), (1, 0, "a", "x"), (1, 0, "a", "x"), (2, 0, "a", "x"), (2, 0, "a", long), (2, 0, "a", "x"), (3, None, "a", long)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = rows_of(prefix_trie.prefix_trie(df))
    deepest = [r for r in got if r[1] == 3]
    assert len(deepest) == 1 and deepest[0][:5] == (1, 3, 1, 2, 0)  # turns with equal numbers stand in one order
    assert {r[3] for r in got if r[1] == 0} == {3}


def test_empty_and_root_only(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    none = spark.createDataFrame([], schema)
    assert rows_of(prefix_trie.rebuilt_trie(none)) == rows_of(prefix_trie.prefix_trie(none)) == []
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = rows_of(prefix_trie.rebuilt_trie(spark.createDataFrame([(alone, 0, "user", "a")], schema)))
    assert got == by_hand({alone: []}) and got[0][5] == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy(F.col("turn").asc_nulls_first()).collect():
        convs[r.conv_id].append((r.role or "", r.text or ""))
    assert rows_of(op12_prefix_trie(spark, sf)) == by_hand(rebuilt(convs))
