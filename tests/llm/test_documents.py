"""Operators over documents, against brute force."""

import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from logweave.llm import decontam, host_rules, jaccard, lm, mixing, records, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(words):
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i:i + 8])].append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)})


def test_host_rules(docs):
    got = host_rules.judged(docs).select("doc.*", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept")
    names = got.columns
    rows = [dict(zip(names, r)) for r in got.collect()]
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeats(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * repeats(words) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_host_of_failures_is_rejected(spark):
    good, bad = " ".join(f"good{i}" for i in range(40)), "tiny"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(60)] + [(100 + i, bad if i % 10 else good, "junk") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = host_rules.drop_rejected(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 10}


def water(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark, docs):
    more = spark.createDataFrame([(100 + i, "w " * (i % 17), f"s{i % 5}", i, 0) for i in range(400)], docs.schema)
    df = docs.unionByName(more)
    rows = mixing.mixed(df).select("doc.doc_id", "doc.text", "source", "size", "source_size", "target", "taken").collect()
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
    goal, taken, longest = water(sizes), Counter(), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]], abs=1e-5)
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= longest[s]
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert sum(len(WORD.findall(r.text or "")) for r in out.collect()) == sum(taken.values())
    again = mixing.mixed(df.repartition(3)).select("doc.doc_id", "size", "taken").collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)


def test_mixing_takes_a_part_of_equal_rows(spark):
    rows = [(7, "five words are in here", "a", 0, 0)] * 200 + [(i, "w " * 20, "b", 0, 0) for i in range(100, 150)] + [(None, "x y", None, 1, 1)] * 90
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, row_id int").repartition(4)
    got = mixing.mixed(df).select("source", "size", "target", "taken").collect()
    assert len(got) == len(rows) and mixing.mix(df).columns == df.columns
    for s in ("a", "b", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= own[0]["size"] / 2 + 1e-6
    assert {r["taken"] // r["size"] for r in got if r["source"] == "a"} <= {0, 1, 2} and len({r["taken"] for r in got if r["source"] == "b"}) == 2
    again = mixing.mixed(df.repartition(7)).select("source", "size", "taken").collect()
    assert Counter((r["source"], r["taken"]) for r in again) == Counter((r["source"], r["taken"]) for r in got)


def spark_hash(*values):
    """Spark's 64-bit hash of integers of four bytes and texts."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", v) if isinstance(v, int) else v.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_sharding_equals_a_sequential_run(spark):
    texts = {i: f"text {i} " * (i % 7) for i in range(700)}
    df = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id bigint, text string, shard int").repartition(6)
    total = sum(len(t) + 1 for t in texts.values())
    n = max(16, -(-total // 900))
    buckets = [[] for _ in range(n)]
    for i, t in texts.items():
        buckets[spark_hash(sharding.SEED, str(i)) % n].append((spark_hash(sharding.SEED + 1, str(i), t), i))
    order = []
    for b, rows in enumerate(buckets):
        rows = [i for _, i in sorted(rows)]
        rng = np.random.default_rng([sharding.SEED, b])
        swaps = rng.integers(0, np.arange(len(rows), 0, -1)) if rows else []
        for i, j in zip(range(len(rows) - 1, -1, -1), swaps):
            rows[i], rows[j] = rows[j], rows[i]
        order += rows
    at = {i: n for n, i in enumerate(order)}
    want = {i: (16 * at[i] // 700, at[i] - -(-(16 * at[i] // 700) * 700 // 16)) for i in texts}
    got = sharding.sharded(df, bucket_bytes=900).select("doc.doc_id", "shard", "slot").collect()
    assert {r.doc_id: (r["shard"], r.slot) for r in got} == want
    again = sharding.sharded(df.repartition(3), bucket_bytes=900).select("doc.doc_id", "shard", "slot").collect()
    assert {r.doc_id: (r["shard"], r.slot) for r in again} == want


def test_sharding(spark, docs):
    more = spark.createDataFrame([(100 + i, f"text {i}", "s", i, 0) for i in range(500)], docs.schema)
    df = docs.unionByName(more)
    rows = sharding.sharded(df, bucket_bytes=700).select("doc.doc_id", "size", "shard", "slot").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id and r.doc_id >= 100]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.2  # no trace of the old order
    again = sharding.sharded(df.repartition(5), bucket_bytes=700).where("doc.doc_id >= 100").select("doc.doc_id", "shard").collect()
    assert {r.doc_id for r in again} == set(order)


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(3)
    counts = Counter(tuple(sharding.fisher_yates(3, rng)) for _ in range(6000))
    assert len(counts) == 6 and max(counts.values()) < 1200 and min(counts.values()) > 800
    assert len(sharding.fisher_yates(0, rng)) == 0


def edits(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_of_short_items(spark):
    """Items of every short length with as many edits as a tenth of it, and one more."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(f"i{m}", "".join(rng.choice(letters) for _ in range(m))) for m in range(1, 36)]
    texts = []
    for i, x in items:
        for n in {0, len(x) // 10, len(x) // 10 + 1}:
            y = list(x)
            for at in rng.sample(range(len(x)), min(n, len(x))):
                y[at] = rng.choice(["", y[at] + "9", "8"])
            texts.append((f"{i}-{n}", "0" * 40 + "".join(y) + "1" * 40))
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.hits(docs, bench).collect()}
    want = {(d, i): e for d, t in texts for i, x in items if (e := edits(x, t)) <= len(x) // 10}
    assert got == want and any(len(dict(items)[i]) in (10, 15, 20, 30) and e == len(dict(items)[i]) // 10 for (_, i), e in want.items())


def test_text_ids(spark):
    say = " ".join(f"word{i} and" for i in range(30))
    df = spark.createDataFrame([("b", say), ("a", say), ("ä", "quite another text"), (None, say)], "doc_id string, text string")
    got = {r.doc_id: r.class_id for r in jaccard.near_duplicates(df).collect()}
    assert got == {"a": "a", "b": "a", None: "a", "ä": "ä"}
    assert {r.doc_id for r in jaccard.dedup(df).collect()} == {"a", "ä"}


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "s", "", "rt")]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(12 + i)) for i in range(6)] + [(6, "tiny one"), (7, ""), (8, None), (9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")]
    texts = [None, "", say(60), items[0][1], "A " + items[6][1].upper() + "  !", "a" * 90]
    for n, (_, item) in enumerate(items[:6]):
        for share in (0.04, 0.08, 0.12, 0.2):
            chars = list(item)
            for p in rng.choice(len(chars), int(share * len(chars)), replace=False):
                chars[p] = rng.choice(["", "z", chars[p] + "q"])
            texts.append(say(10 + n) + "\n" + "".join(chars) + " " + say(8))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for (d, t), (i, x) in itertools.product(enumerate(texts), items):
        x = decontam.plain(x)
        if x and edits(x, decontam.plain(t)) <= len(x) // 10:
            want.add((d, i))
    got = decontam.hits(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 10
    for r in got.collect():
        assert r.edits == edits(decontam.plain(dict(items)[r.item_id]), decontam.plain(texts[r.doc_id]))
    assert {(r.doc_id, r.item_id) for r in decontam.hits(df, bench, block_bytes=100).collect()} == want
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def shingles(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(spark, docs, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, 90))
        for c in range(int(rng.integers(1, 7))):
            own = list(base)
            for p in rng.choice(90, int(rng.integers(0, 4)), replace=False):
                own[p] = str(rng.choice(words))
            rows.append((1000 + len(rows), " ".join(own), "s", 0, 0))
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 2)  # every bucket of three and more is dealt to blocks
    all_rows = df.collect()
    sets = [shingles(r.text) for r in all_rows]
    texts = ["\0".join(WORD.findall(r.text or "")).lower() for r in all_rows]
    link = lambda a, b: bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if link(a, b):
            x, y = group[a], group[b]
            group = [min(x, y) if z in (x, y) else z for z in group]
    want = []
    for a, r in enumerate(all_rows):
        ids = [all_rows[b].doc_id for b in range(len(sets)) if group[b] == group[a]]
        others = {texts[b] for b in range(len(sets)) if b != a and link(a, b) and texts[b] != texts[a]}
        copies = sum(t == texts[a] for t in texts) if sets[a] else 1
        want.append((r.doc_id, min((i for i in ids if i is not None), default=None), copies, len(others)))
    got = [tuple(r) for r in jaccard.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    stays = jaccard.dedup(df)
    assert stays.columns == df.columns and stays.count() == len(set(group))
    assert {r.doc_id for r in stays.collect()} == {w[1] for w in want}


@pytest.mark.parametrize("edges", [[(5, 1), (5, 2)], [(10, 1), (10, 5), (11, 2), (11, 5)], [(1, 1)], [(4, 3), (3, 2), (2, 1), (9, 8)]])
def test_linked_groups(spark, edges):
    least = {x: x for e in edges for x in e}
    for _ in least:
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    got = jaccard.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((u, root) for u, root in least.items() if u != root)


def test_bands_reach_the_recall():
    b = jaccard.n_bands()
    assert 1 - (1 - 0.8 ** jaccard.ROWS) ** b >= jaccard.RECALL > 1 - (1 - 0.8 ** jaccard.ROWS) ** (b - 1)


def test_lm_scores(spark, docs):
    got = lm.scored(docs, carry=["doc_id", "text"], block_bytes=1500, shard_bytes=900).select(
        "doc.*", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: ["<s>", *WORD.findall((t or "").translate(lower)), "</s>"]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    count, pair, context = Counter(), Counter(), Counter()
    for r in docs.collect():
        if not out(r.doc_id):
            t = tokens(r.text)
            count.update(t[1:]), pair.update(zip(t, t[1:])), context.update(t[:-1])
    kinds, n, v = Counter(a for a, _ in pair), sum(count.values()), len(count)
    assert len(got) == docs.count()
    for r in got:
        t = tokens(r.text)
        alone = [(count[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t[1:]]
        full = [(max(pair[a, b] - 0.75, 0) + 0.75 * kinds[a] * p) / context[a] if context[a] else p for a, b, p in zip(t, t[1:], alone)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(t) - 1, sum(count[w] > 0 for w in t[1:]), n)
        assert r.base_score == pytest.approx(np.log10(alone).sum()) and r.score == pytest.approx(np.log10(full).sum(), abs=2e-4 * len(t))


def test_hot_contexts_are_cut(spark, docs):
    rows = [(1000 + i, f"hot next{i % 400} hot a{i % 7} cold b{i}", "s", 0, 0) for i in range(600)]
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    get = lambda **a: sorted(map(tuple, lm.scored(df, carry=["doc_id"], block_bytes=4000, shard_bytes=1500, **a).collect()), key=str)
    whole, cut = get(), get(hot_tokens=60)
    assert whole == cut  # to the last bit
    n_shards = 40
    hot = lm.hot_contexts(df, "text", 30_000, 60, n_shards)
    hashes = {w: lm.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in (b"hot", b"cold", b"b5")}
    parts = dict(zip(hot[0].tolist(), hot[1].tolist()))
    assert parts[int(hashes[b"hot"])] >= 20 and parts[int(hashes[b"cold"])] >= 10 and parts[int(lm.START)] >= 10 and int(hashes[b"b5"]) not in parts
    texts, training = pa.array([r[1] for r in rows]), np.ones(len(rows), dtype=bool)
    most = lambda *a: max(len(lm.unpacked(p, 5)[3]) for _, p in lm.Block(texts, training, n_shards, *a).messages())
    assert most() > 400 and most(hot) < 150


def test_records_round_trip(spark, docs, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    odd = spark.createDataFrame([(200, "It's THE end,...of 3.14 <|endoftext|> a<|startoftext|>b \x7f\x01 ~!@ we'LL", "s", 0, 0),
                                 (201, "Ünï code\xa0x y é é \x1c a\x85b ΑΣ ΣΑ 한국 ſ", "s", 0, 0)], docs.schema)
    df = docs.unionByName(odd)
    index = records.write_and_index(df, path, f"file://{tmp_path}/out", file_bytes=2000)
    whole = tokenizers.Tokenizer.from_file(path)
    want = Counter((r.doc_id, tuple(whole.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in df.collect())
    rows = sorted(index.collect(), key=lambda r: (r.file_no, r.offset))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter(
        {(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())): n for (d, i), n in want.items()})
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len({r.file_no for r in rows}) > 1
    back = records.read_records(spark, f"file://{tmp_path}/out/records", index.drop("start"), seed=1).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == want


def test_damaged_record_is_noticed():
    good = records.frame(5, b"\1\0\2\0", 2)
    assert records.unframe(good)[0] == 5 and list(records.unframe(good)[1]) == [1, 2]
    for at in (0, 9, 15, len(good) - 2):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="wrong checksum"):
            records.unframe(bytes(bad))


def test_records_in_several_files_a_task(spark, tmp_path):
    """A session's limit of rows a file, or a writer's several files a task, doesn't upset the running counts; ids may be texts."""
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    df = spark.createDataFrame([(f"id {i:03}" if i else None, f"some words, {i} of them") for i in range(40)], "name string, text string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        index = records.write_and_index(df, path, f"file://{tmp_path}/out", key="name").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = sorted(index, key=lambda r: (r.doc_id is not None, r.doc_id or ""))
    assert [r.doc_id for r in rows] == [None, *(f"id {i:03}" for i in range(1, 40))]
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    # files of one task, as another writer leaves them
    frames = [records.frame(i, bytes(2 * i), 2) for i in range(9)]
    (tmp_path / "more").mkdir()
    for f in range(3):
        (tmp_path / "more" / f"part-00004-x-c00{f}.txt").write_bytes(b"".join(frames[3 * f:3 * f + 3]))
    read = sorted(records.read_index(spark, f"file://{tmp_path}/more").collect(), key=lambda r: (r.file_no, r.offset))
    assert [r.doc_id for r in read] == list(range(9)) and len({r.file_no for r in read}) == 3


def test_empty_tables(spark, empty, tmp_path):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "an item of the benchmark")], "item_id bigint, text string")
    for out in (host_rules.judged(empty), mixing.mixed(empty), mixing.mix(empty), sharding.sharded(empty), jaccard.near_duplicates(empty),
                jaccard.dedup(empty), decontam.hits(empty, some), decontam.hits(empty, bench), decontam.clean(empty, bench), lm.scored(empty)):
        assert out.count() == 0
    public = pytest.importorskip("public_tokenizers")
    assert records.write_and_index(empty, public.path("word_bpe_49k.json"), f"file://{tmp_path}/none").count() == 0
