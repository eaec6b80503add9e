"""Language-model scores from an Elias-Fano n-gram trie (operator 3).

The model is a bigram model with absolute discounting, interpolated with
smoothed word frequencies::

    P(w | v) = max(c(vw) - D, 0) / c(v) + D * n(v) / c(v) * P(w)
    P(w)     = (c(w) + 0.5) / (N + 0.5 * (V + 1))

``n(v)`` counts the distinct successors of v; the first of them follows a
start mark. All unknown words are one class, so P sums to one. Discounted
values and weights are kept as 16-bit codes in the trie.

The trie is cut by a hash of the context word, so that a shard holds a
context with its successors. A hot context, a word that occurs more than
``HOT_TOKENS`` times (or the start mark, in so many documents), is cut further
by a hash of the successor: its parts stand in as many shards as it has that
many occurrences. So neither a task nor the driver holds the model:

0. One pass counts the words that are frequent in some piece of the text; the
   driver gets the hot ones, at most the number of tokens / ``HOT_TOKENS`` * 2.

1. Documents are dealt into blocks by a hash of their id. A block counts its
   bigrams and sends each shard, once for each distinct bigram, the hashes and
   the counts in training documents (a very frequent bigram costs a block
   no more than a rare one). Every part of a hot context gets its count.
2. A shard sums the counts of all blocks, builds its part of the trie, writes
   it, and looks up each block's bigrams in it by successor search. It returns
   the codes, and the exact counts of the context words. The kinds of a hot
   context's successors are summed over its parts, so scores are the same
   however it is cut.
3. A block meets its answers and adds up its documents' scores.

Between the steps stand written tables; the driver gets N, V and the hot
contexts only.

Edge cases: a null or empty text has the end token only; null ids belong to
the training part, and are dealt out by their text; rows with equal ids or
texts are each scored (and trained on); an empty table gives an empty table,
and one without training documents scores every token as unknown; other
columns, whatever their names, pass through. Words are told apart by a 64-bit
hash.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import cut_lineage, row_of, text_of
from logweave.llm.trie import Trie, quantised, restored
from logweave.llm.vec import distinct, flat, mix, word_bounds, word_hashes

DISCOUNT = 0.75
#: Bytes of text in a block; bytes of all text for each shard.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
#: Occurrences of a context for each of its parts.
HOT_TOKENS = 1 << 20
START, END = np.uint64(1), np.uint64(2)  # no word's hash in practice
HELD_OUT = 1


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def packed(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a)
    return squeezed(out.getvalue())


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    source = io.BytesIO(zstandard.ZstdDecompressor().decompress(data))
    return [np.load(source) for _ in range(n)]


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper six bytes of hashes: enough to tell the successors of one
    context apart."""
    return np.ascontiguousarray((hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def long(parts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(parts), 8), dtype=np.uint8)
    out[:, :6] = parts
    return out.view("<u8").ravel()


#: Hashes of hot contexts, sorted, and the number of parts of each.
Hot = tuple[np.ndarray, np.ndarray]
NOT_HOT: Hot = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def parts_of(hashes: np.ndarray, hot: Hot) -> np.ndarray:
    """The number of parts of each context."""
    if not len(hot[0]):
        return np.ones(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(hot[0], hashes), len(hot[0]) - 1)
    return np.where(hot[0][at] == hashes, hot[1][at], 1)


def hot_contexts(docs: DataFrame, text: str, total: int, hot_tokens: int, n_shards: int) -> Hot:
    """The contexts that occur more than ``hot_tokens`` times (others may be
    among them from half of that on). A word is counted in the pieces in which
    it reaches its share of half of ``hot_tokens``, so no more than that half
    of its occurrences is missed."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(held: list[pa.Array]) -> pa.RecordBatch:
            data, offsets = flat(pa.chunked_array(held))
            starts, ends, _ = word_bounds(data, offsets)
            words, at = distinct(word_hashes(data, starts, ends, lower=True))
            n = np.bincount(at, minlength=len(words))
            use = n >= hot_tokens / 2 * len(data) / total
            return pa.RecordBatch.from_arrays([pa.array(np.append(words[use], START).view(np.int64)),
                                               pa.array(np.append(n[use], len(offsets) - 1))], names=["word", "n"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column("text"))
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield counts(held)
                held, size = [], 0
        if held:
            yield counts(held)

    if n_shards < 2 or total < hot_tokens:  # nothing to cut, or fewer tokens than that
        return NOT_HOT
    found = (docs.select(text_of(text).alias("text")).mapInArrow(frequent, "word bigint, n bigint")
             .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > hot_tokens / 2).collect())
    hashes = np.array([r["word"] for r in found], dtype=np.int64).view(np.uint64)
    # with what may have been missed; one part for each shard at most
    parts = np.array([min(n_shards, -(-(r["n"] + hot_tokens // 2) // hot_tokens)) for r in found], dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], parts[order]


class Block:
    """The tokens of some documents, as ranks of their distinct words, and
    the distinct bigrams among them, sorted by shard and context. The further
    parts of a hot context rank among the words, as contexts only."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, training: np.ndarray, n_shards: int, hot: Hot = NOT_HOT):
        data, offsets = flat(texts)
        starts, ends, bounds = word_bounds(data, offsets)
        n = np.diff(bounds) + 1  # with the end token
        self.bounds = np.concatenate(([0], np.cumsum(n)))
        total = int(self.bounds[-1])
        hashes = np.full(total, END)
        inner = np.ones(total, dtype=bool)
        inner[self.bounds[1:] - 1] = False
        hashes[inner] = word_hashes(data, starts, ends, lower=True)
        vocabulary, at = distinct(np.append(hashes, [START, END]))
        n_parts = parts_of(vocabulary, hot)
        further = np.repeat(np.arange(len(vocabulary)), n_parts - 1)
        first = np.cumsum(n_parts - 1) - (n_parts - 1)  # of each word's further parts
        part = np.concatenate((np.zeros(len(vocabulary), np.int64), np.arange(len(further)) - first[further] + 1))
        word = np.concatenate((np.arange(len(vocabulary)), further))
        # contexts of one shard stand together
        self.shard = ((mix(vocabulary[word]) % np.uint64(n_shards)).astype(np.int64) + part) % n_shards
        order = np.argsort(self.shard, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        del hashes, inner
        self.token = rank[at[:total]]
        before = np.empty_like(at[:total])
        before[1:] = at[:total - 1]
        before[self.bounds[:-1]] = at[total]
        place = rank[before]
        cut = np.flatnonzero(n_parts[before] > 1)
        if len(cut):
            which = (mix(vocabulary)[at[cut]] % n_parts[before[cut]].astype(np.uint64)).astype(np.int64)
            cut, which = cut[which > 0], which[which > 0]
            place[cut] = rank[len(vocabulary) + first[before[cut]] + which - 1]
        size = len(order)
        keys, self.bigram = distinct(place.astype(np.int64) * size + self.token)
        del before, place
        self.context, self.word = (keys // size).astype(np.int32), (keys % size).astype(np.int32)
        train = np.repeat(training, n)
        self.bigram_count = np.bincount(self.bigram[train], minlength=len(keys)).astype(np.uint32)
        word_count = np.bincount(at[:total][train], minlength=len(vocabulary)).astype(np.uint32)
        word_count[at[total]] = np.count_nonzero(training)  # the start mark's
        self.vocabulary, self.shard, self.word_count = vocabulary[word][order], self.shard[order], word_count[word][order]

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """``(shard, payload)``: for each context its hash, count as a word and
        number of successors; for each bigram the word's hash and the count."""
        shards, first = np.unique(self.shard, return_index=True)
        first = np.append(first, len(self.shard))
        cut = np.searchsorted(self.context, first)
        degree = np.bincount(self.context, minlength=len(self.vocabulary))
        for i, s in enumerate(shards):
            c, b = slice(first[i], first[i + 1]), slice(cut[i], cut[i + 1])
            yield int(s), packed([self.vocabulary[c], self.word_count[c], degree[c].astype(np.uint32),
                                  short(self.vocabulary[self.word[b]]), self.bigram_count[b]])

    def answers(self, payloads: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(counts of the words, weights of the contexts, values of the
        bigrams)`` from the shards' answers."""
        parts = [unpacked(payloads[int(s)], 3) for s in np.unique(self.shard)]
        counts, weights, values = (np.concatenate(x) for x in zip(*parts))
        return counts, restored(weights), restored(values)


def counted(messages: list[tuple[int, list[np.ndarray]]], discount: float, shard: int, n_shards: int,
            hot: Hot = NOT_HOT) -> tuple[bytes, int, int, tuple[np.ndarray, ...], Iterator[tuple[int, bytes]]]:
    """A shard: ``(trie in bytes, N, V, hot contexts, answers by block)``; of
    the hot contexts with a part here their hashes, counts and the kinds of
    successors in the part."""
    hashes = np.concatenate([m[0] for _, m in messages])
    contexts, at = distinct(hashes)
    counts = np.bincount(at, np.concatenate([m[1] for _, m in messages]), len(contexts)).astype(np.int64)
    of = np.repeat(at.astype(np.int64), np.concatenate([m[2] for _, m in messages]))
    words, w = distinct(long(np.concatenate([m[3] for _, m in messages])))
    keys, slot = distinct(of * max(1, len(words)) + w)
    del of, w
    times = np.bincount(slot, np.concatenate([m[4] for _, m in messages]), len(keys))
    del slot
    keys, times = keys[times > 0], times[times > 0]  # those of training documents
    c = keys // max(1, len(words))
    kinds = np.bincount(c, minlength=len(contexts))
    total = np.where(kinds > 0, counts, 0)  # each occurrence has one successor
    weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    trie = Trie.of(contexts[c], words[keys % max(1, len(words))], (times - discount) / total[c], contexts, weight)
    is_word = (contexts != START) & (mix(contexts) % np.uint64(n_shards) == np.uint64(shard))  # not a further part
    is_hot = parts_of(contexts, hot) > 1
    data = trie.to_bytes()

    def answers() -> Iterator[tuple[int, bytes]]:
        query = Trie.at(np.frombuffer(data, dtype=np.uint8))
        for block, (v, _, degree, word, _) in messages:
            context = np.repeat(v, degree)
            values, _ = query.find(context, long(word))
            _, weights = query.find(v, np.full(len(v), END))
            yield block, packed([counts[np.searchsorted(contexts, v)], weights, values])

    return data, int(counts[is_word].sum()), int((counts[is_word] > 0).sum()), (contexts[is_hot], counts[is_hot], kinds[is_hot]), answers()


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, discount: float = DISCOUNT,
           block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """``(doc, held_out, n_tokens, n_known, train_tokens, base_score, score)``;
    ``doc`` holds the columns ``carry`` (all, if None)."""
    number = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_blocks, n_shards = max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))
    hot = hot_contexts(docs, text, total, hot_tokens, n_shards)
    place = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    rows = docs.select(row_of(docs if carry is None else docs.select(*carry)), (number == HELD_OUT).alias("held_out"),
                       text_of(text).alias("text"), F.pmod(place, F.lit(n_blocks)).cast("int").alias("block"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a batch by block, compressed for the shuffle."""
        for batch in batches:
            block = batch.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            numbers, first = np.unique(block[order], return_index=True)
            found = []
            for own in np.split(order, first[1:]) if len(numbers) else []:
                out = pa.BufferOutputStream()
                part = batch.select(["doc", "held_out", "text"]).take(pa.array(own))
                with pa.ipc.new_stream(out, part.schema) as stream:
                    stream.write_batch(part)
                found.append(squeezed(out.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(found, pa.binary())], names=["block", "rows"])

    blocks = rows.mapInArrow(pack, "block int, rows binary")

    def unpack(table: pa.Table) -> pa.Table:
        read = zstandard.ZstdDecompressor()
        # in a fixed order: both passes over a block see the same rows in the same places
        parts = sorted(read.decompress(x) for x in table["rows"].to_pylist())
        return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parts]).combine_chunks()

    def ask(table: pa.Table) -> pa.Table:
        own = unpack(table)
        block = Block(own["text"], ~own["held_out"].to_numpy(zero_copy_only=False), n_shards, hot)
        shard, payload = zip(*block.messages())
        number = table["block"][0].as_py()
        return pa.table({"shard": pa.array(shard, pa.int32()), "block": pa.array([number] * len(shard), pa.int32()),
                         "payload": pa.array(payload, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        order = sorted(zip(table["block"].to_pylist(), table["payload"].to_pylist()))
        messages = [(b, unpacked(p, 5)) for b, p in order]
        shard = table["shard"][0].as_py()
        trie, n, v, heavy, answers = counted(messages, discount, shard, n_shards, hot)
        found = [(None, trie), *([(-1, packed(list(heavy)))] if len(heavy[0]) else []), *answers]
        return pa.table({"shard": pa.array([shard] * len(found), pa.int32()), "block": pa.array([b for b, _ in found], pa.int32()),
                         "n": pa.array([n] + [0] * (len(found) - 1), pa.int64()), "v": pa.array([v] + [0] * (len(found) - 1), pa.int64()),
                         "payload": pa.array([p for _, p in found], pa.binary())})

    asked = blocks.groupBy("block").applyInArrow(ask, "shard int, block int, payload binary")
    # rows without a block are the model, one for each shard; rows of block -1 the hot contexts
    model = cut_lineage(asked.groupBy("shard").applyInArrow(count, "shard int, block int, n bigint, v bigint, payload binary"))
    n, v = model.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    mass = n + 0.5 * (v + 1)
    hot_total, hot_kinds = np.zeros(len(hot[0]), np.int64), np.zeros(len(hot[0]), np.int64)
    for row in model.where("block = -1").select("payload").toLocalIterator() if len(hot[0]) else ():
        hashes, counts, kinds = unpacked(row["payload"], 3)
        at = np.searchsorted(hot[0], hashes)
        hot_total[at] = counts  # the same in each part
        hot_kinds[at] += kinds
    hot_weight = restored(quantised(np.where(hot_kinds > 0, discount * hot_kinds / np.maximum(hot_total, 1), 1.0)))
    schema = T.StructType([rows.schema["doc"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def add_up(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = unpack(table)
        block = Block(own["text"], ~own["held_out"].to_numpy(zero_copy_only=False), n_shards, hot)
        counts, weights, values = block.answers(dict(zip(replies["shard"].to_pylist(), replies["payload"].to_pylist())))
        at = np.flatnonzero(parts_of(block.vocabulary, hot) > 1)
        weights[at] = hot_weight[np.searchsorted(hot[0], block.vocabulary[at])]
        alone = (counts + 0.5) / mass
        chance = values + weights[block.context] * alone[block.word]
        first = block.bounds[:-1]
        base = np.add.reduceat(np.log10(alone)[block.token], first)
        score = np.add.reduceat(np.log10(chance)[block.bigram], first)
        known = np.add.reduceat((counts > 0)[block.token].astype(np.int64), first)
        return pa.table([own["doc"], own["held_out"], pa.array(np.diff(block.bounds)), pa.array(known),
                         pa.array(np.full(len(first), n, dtype=np.int64)), pa.array(base), pa.array(score)], names=schema.names)

    replies = model.where("block >= 0").select("block", "shard", "payload")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(add_up, schema)
