"""Benchmark decontamination by q-gram lemma filtering (operator 5).

A document holds a benchmark item if some part of it is within ``k`` edits
(insertion, deletion, substitution of a character) of the whole item, both in
lower case with white space runs as one blank; ``k`` is a tenth of the item's
characters, rounded down. Characters are compared, not words.

If an item of ``m`` characters aligns with ``k`` edits or fewer, item and part
share at least ``m - q + 1 - k q`` q-grams, and their diagonals (place in the
document minus place in the item) differ by ``k`` at most. So shared q-grams
are counted in diagonal bands of ``2 (k + 1)``, each overlapping half of the
next, which contain any run of ``k + 1`` diagonals; bands that reach the bound
are verified by a banded alignment. Short items have shorter q-grams, the
longest for which the bound is 1 at least.

The items are the stated query set: they are read in blocks of a fixed number
of bytes, each block scans all documents in one narrow pass without a shuffle.

Edge cases: null and empty texts hold nothing and null or blank items are held
by nothing; equal items are reported under each id, equal documents each for
themselves; ids are of any type; an empty table on either side gives no hits;
other columns, whatever their names, pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from logweave.llm.common import small_batches, text_of
from logweave.llm.vec import pieces

Q = 8
EDIT_RATE = 0.1
#: Bytes of items that are sent to the tasks at a time.
BLOCK_BYTES = 4 << 20
#: Characters of documents that are scanned at a time.
STEP = 1 << 20
#: Shared q-grams that are counted, and alignments that are made at a time.
PAIRS = 4 << 20
CASES = 512
PLACES = [T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("edits", T.IntegerType())]
_BASE = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().replace("\0", " ").split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` characters."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    char = code.astype(np.uint64)
    h, have, power = char, 1, _BASE[:1]
    while have * 2 <= q:  # runs of 2, 4, 8, ... characters
        h = h[:-have] * power + h[have:]
        power, have = power * power, have * 2
    out, at = h[:n].copy(), have
    while at < q:  # the rest character by character
        out = out * _BASE + char[at:at + n]
        at += 1
    return out * _BASE


def budget(m: int, rate: float = EDIT_RATE) -> int:
    """The edits that an item of ``m`` characters may have."""
    return int(rate * m)


def gram_size(m: int, k: int, q: int = Q) -> int:
    """Characters in a q-gram of an item of ``m`` characters that may have
    ``k`` edits: ``q``, or the most that still leave one q-gram untouched
    (an edit touches as many q-grams as they have characters)."""
    return min(q, max(1, m // (k + 1)))


def alignments(code: np.ndarray, items: list[np.ndarray], low: np.ndarray, width: np.ndarray, begin: np.ndarray,
               end: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(edits, start, stop)`` for many cases at once: the least edits between
    all of an item and a stretch of ``code[begin:end]``, over alignments on the
    ``width`` diagonals from ``low`` on (place in the code minus place in the
    item). Edits above ``k`` mean that there is none.

    One step for each character of an item, for all cases and diagonals; cases
    leave when they are through or have no cost within ``k``."""
    n_cases = len(items)
    far, one = np.int64(1 << 40), np.int64(1 << 24)  # a cost has its first diagonal in the low bits
    length = np.array([len(x) for x in items], dtype=np.int64)
    letters = np.zeros((n_cases, int(length.max(initial=0))), dtype=np.uint32)
    for c, x in enumerate(items):
        letters[c, :len(x)] = x
    edits, start, stop = k + 1, np.zeros(n_cases, dtype=np.int64), np.zeros(n_cases, dtype=np.int64)
    step = np.arange(int(width.max(initial=0)), dtype=np.int64)
    case = np.arange(n_cases)
    at = low[:, None] + step
    used = (at >= begin[:, None]) & (at <= end[:, None]) & (step < width[:, None])
    row = np.where(used, step, far)
    i = 0
    while len(case):
        i += 1
        at = at + 1
        char = code[np.clip(at - 1, 0, len(code) - 1)]
        new = row + one * (char != letters[case, i - 1][:, None])
        new[at <= begin[case][:, None]] = far
        np.minimum(new[:, :-1], row[:, 1:] + one, out=new[:, :-1])  # the item's character has no partner
        new = np.minimum.accumulate(new - step * one, axis=1) + step * one  # characters of the code have none
        outside = (at < begin[case][:, None]) | (at > end[case][:, None]) | (step >= width[case][:, None])
        new[outside] = far
        row = new
        least = row.min(axis=1)
        dead = (least >> 24) > k[case]
        through = length[case] == i
        good = np.flatnonzero(through & ~dead)
        if len(good):
            best = row[good].argmin(axis=1)
            edits[case[good]] = least[good] >> 24
            start[case[good]] = low[case[good]] + (least[good] & 0xFFFFFF)
            stop[case[good]] = low[case[good]] + best + i
        stay = ~(dead | through)
        if not stay.all():
            case, row, at = case[stay], row[stay], at[stay]
    return edits, start, stop


def _find(part: np.ndarray, item: bytes) -> int:
    """The first place of the item in ``part``, -1 if it isn't there."""
    raw, at = part.tobytes(), -1
    while (at := raw.find(item, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


class Items:
    """The q-grams of a block of items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE):
        texts = [(i, plain(t)) for i, t in rows]
        texts = [(i, t) for i, t in texts if t]
        self.ids = [i for i, _ in texts]
        self.texts = [t for _, t in texts]
        self.codes = [codes(t) for t in self.texts]
        self.raw = [c.tobytes() for c in self.codes]
        self.k = np.array([budget(len(c), rate) for c in self.codes], dtype=np.int64)
        sizes = np.array([gram_size(len(c), int(k), q) for c, k in zip(self.codes, self.k)], dtype=np.int64)
        by_q: dict[int, list[int]] = {}
        for n, size in enumerate(sizes.tolist()):
            by_q.setdefault(size, []).append(n)
        self.tables = [(size, *self._table(size, own)) for size, own in sorted(by_q.items())]
        lengths = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.bound = np.maximum(1, lengths - sizes + 1 - self.k * sizes)
        self.most = int(lengths.max(initial=0))

    def _table(self, size: int, own: list[int]) -> tuple[np.ndarray, ...]:
        grams = [gram_hashes(self.codes[n], size) for n in own]
        h = np.concatenate(grams)
        item = np.repeat(np.array(own), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        seen = np.zeros(1 << 22, dtype=bool)
        seen[keys >> np.uint64(42)] = True
        return seen, keys, np.append(first, len(h)), item[order], place[order]

    def bands(self, code: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(item, first, last)`` wherever a band, or each of some bands next
        to each other, shares enough q-grams."""
        for size, seen, keys, first, item, place in self.tables:
            h = gram_hashes(code, size)
            at = np.flatnonzero(seen[h >> np.uint64(42)])
            h = h[at]
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[slot] == h
            at, slot = at[same], slot[same]
            n = first[slot + 1] - first[slot]
            span = np.int64(len(code) + 2 * self.most + 2)
            found, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a, b in pieces(np.concatenate(([0], np.cumsum(n))), PAIRS):  # shared q-grams, a part at a time
                own, each = n[a:b], int(n[a:b].sum())
                entry = np.repeat(first[slot[a:b]] - np.cumsum(own) + own, own) + np.arange(each)
                who = item[entry]
                half = (np.repeat(at[a:b], own) - place[entry] + self.most) // (self.k[who] + 1)
                part, times = np.unique(who * span + half, return_counts=True)
                found, back = np.unique(np.concatenate((found, part)), return_inverse=True)
                count = np.bincount(back, np.concatenate((count, times)), len(found)).astype(np.int64)
            # a band is two halves, the second of one the first of the next
            after = np.searchsorted(found, found + 1)
            both = count + np.where(np.append(found, -1)[after] == found + 1, np.append(count, 0)[after], 0)
            found = found[both >= self.bound[found // span]]
            for own in np.split(found, np.flatnonzero(np.diff(found) > 1) + 1) if len(found) else ():
                yield int(own[0] // span), int(own[0] % span), int(own[-1] % span)

    def hits(self, code: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item, start, stop, edits)``: the best alignment of each
        item in each text that it occurs in. ``offsets``: where the texts
        begin in ``code``, which has a 0 after each."""
        cases: list[tuple[int, int, int, int, int, int]] = []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for who, band, last in self.bands(code):
            k, m = int(self.k[who]), len(self.codes[who])
            low = (band - 1) * (k + 1) - self.most  # the half before may share no q-gram and still be on the way
            high = (last + 2) * (k + 1) - self.most - 1
            # a band may touch a few neighbouring texts
            a = int(np.searchsorted(offsets, max(0, low), side="right")) - 1
            b = int(np.searchsorted(offsets, high + m, side="right")) - 1
            for text in range(max(0, a), min(b, len(offsets) - 2) + 1):
                begin, end = int(offsets[text]), int(offsets[text + 1]) - 1
                cut, stop = max(begin, low), min(end, high + m)
                if stop - cut < m - k:
                    continue
                if (same := _find(code[cut:stop], self.raw[who])) >= 0:
                    best[text, who] = min((0, cut + same - begin, cut + same - begin + m), best.get((text, who), (k + 1,)))
                else:
                    cases.append((text, who, low, high - low + 1, begin, end))
        for a in range(0, len(cases), CASES):
            text, who, low, width, begin, end = np.array(cases[a:a + CASES], dtype=np.int64).T
            k = self.k[who]
            found = alignments(code, [self.codes[w] for w in who], low, width, begin, end, k)
            for t, w, x, d, s, e, most in zip(*(v.tolist() for v in (text, who, begin, *found, k))):
                if d <= most and (d, s - x) < best.get((t, w), (most + 1,)):
                    best[t, w] = (d, s - x, e - x)
        for (text, who), (d, s, e) in sorted(best.items()):
            yield text, who, s, e, d


def _scan(column: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    texts = [plain(t) for t in column.to_pylist()]
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    for a, b in pieces(bounds, STEP):
        code = codes("\0".join([*texts[a:b], ""]))
        for text, *rest in items.hits(code, bounds[a:b + 1] - bounds[a]):
            yield a + text, *rest


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``, by a hash of their id."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(key).alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for block in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block).orderBy("i", "t").collect()]


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, start, stop, edits)``: each item that a document
    holds, with its best place in the document's plain text."""
    spark = docs.sparkSession
    small_batches(docs)
    out = None
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    item_type = items.schema[item_key].dataType
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", item_type), *PLACES])
    for block in blocks(items, item_key, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = Items(sent.value, rate=rate)
            for batch in batches:
                found = list(_scan(batch.column("text"), table))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), pa.array([table.ids[f[1]] for f in found], to_arrow_type(item_type)),
                     *(pa.array([f[c] for f in found], t) for c, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32())))],
                    names=["doc_id", "item_id", "start", "stop", "edits"])

        found = rows.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, in one narrow pass for each block."""
    spark, schema = docs.sparkSession, docs.schema
    small_batches(docs)
    at = docs.columns.index(text)
    for block in blocks(items, item_key, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = Items(sent.value, rate=rate)
            for batch in batches:
                good = np.ones(batch.num_rows, dtype=bool)
                for found in _scan(batch.column(at), table):
                    good[found[0]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, schema)
    return docs
