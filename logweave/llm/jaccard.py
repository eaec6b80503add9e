"""N-gram Jaccard join by MinHash banding (operator 8).

Documents are compared by the sets of their five-word shingles (a text of one
to four words has one shingle, all its words; words in ASCII lower case). A
link joins two different texts whose sets have a Jaccard similarity of at
least 0.8. Every text gets a MinHash signature, cut into bands of ``rows``
values; the number of bands is the least that finds a pair at the threshold
with the target recall. Texts that agree in a band meet in a bucket.

* Equal word sequences are grouped first: only one text of each class enters
  the join, its members share the result.
* A pair that meets in several bands belongs to the first; it is never a row.
  A bucket's task finds its own pairs from the signatures, verifies them on the
  full sets, and returns for each text its number of links and one edge to the
  root of its linked group within the task, so rows grow with the members.
* A large bucket is dealt out as pairs of blocks of bounded size. Each text
  with a pair of its own in a bucket sends its set there, others don't.
* Linked groups (connected components) come from rounds of large-star and
  small-star steps over those edges, each round a written table.

Edge cases: null, empty and blank texts have no shingles and no links, each
is a class of its own; null ids take part, a class id is the smallest id that
isn't null in its group (null if there is none); equal rows are copies of each
other; an empty table gives an empty table; other columns pass through
``dedup`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import BATCH_ROWS, bounded_broadcast, cut_lineage, row_of, small_batches
from logweave.llm.vec import flat, flat_bytes, mix, pieces, windows, word_bounds, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 4
#: A block of a large bucket holds about so many texts, and shingles.
BLOCK_TEXTS = 2048
BLOCK_SHINGLES = 1 << 20
#: Words of texts that are hashed at a time.
STEP = 1 << 18
#: Pairs of texts that are compared at a time.
PAIRS = 1 << 20
#: What a task is: a bucket, and two of its blocks (or one twice).
TASK = ("band", "hash", "i", "j")


def n_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands that finds a pair of similarity ``threshold``
    with probability ``recall``: ``1 - (1 - threshold ** rows) ** bands``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def shingled(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(a, b, words, word bounds, shingles, shingle bounds)`` for runs of
    texts ``a .. b - 1`` (hashes, in order of the text)."""
    data, offsets = flat(column)
    starts, ends, bounds = word_bounds(data, offsets)
    for a, b in pieces(bounds, STEP):
        part = slice(bounds[a], bounds[b])
        hashes = word_hashes(data, starts[part], ends[part], lower=True)
        yield a, b, hashes, bounds[a:b + 1] - bounds[a], *windows(hashes, bounds[a:b + 1] - bounds[a], size)


def sequence_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bytes for each text that tell word sequences apart."""
    out = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
        for c, salt in enumerate((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))):
            out[full, c] = mix(np.add.reduceat(mix(hashes + place * salt), bounds[:-1][full]))
    return out


def signatures(shingles: np.ndarray, bounds: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """A hash for each text and band, of the least values of ``rows`` random
    hash functions over the text's shingles. Every text has a shingle."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(bounds) - 1, bands), dtype=np.uint64)
    room = np.empty_like(short)
    for band in range(bands):
        for j in range(band * rows, band * rows + rows):
            np.multiply(short, factors[j], out=room)
            np.add(room, shifts[j], out=room)
            least = np.minimum.reduceat(room, bounds[:-1])
            out[:, band] = mix(out[:, band] + least + np.uint64(j + 1))
    return out


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD,
           recall: float = RECALL, size: int = SHINGLE) -> DataFrame:
    """A written table ``(doc, id, row_id, text, n, seq, bands)``: each row of
    ``docs`` with a number of its own, the number of its shingles, the key of
    its word sequence (null if it has no word) and its signature; ``doc`` has
    the columns ``carry``, or all but the text. One narrow pass over the texts."""
    small_batches(docs)
    bands = n_bands(threshold, recall)
    rows = docs.select(row_of(docs.drop(text).withColumn(key, F.col(key)) if carry is None else docs.select(*carry)), F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.IntegerType()), T.StructField("seq", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, bits = [], [], []
            for _, _, hashes, at, shingles, bounds in shingled(batch.column("text"), size):
                counts.append(np.diff(bounds))
                keys.append(sequence_keys(hashes, at))
                full = np.flatnonzero(counts[-1])
                own = np.zeros((len(at) - 1, bands), dtype=np.uint64)
                if len(full):
                    own[full] = signatures(shingles, np.append(bounds[:-1][full], bounds[-1]), bands)
                bits.append(own)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            none = n == 0
            seq = np.concatenate(keys).tobytes() if keys else b""
            values = pa.array(np.concatenate(bits).view(np.int64).ravel() if bits else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, bands, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n.astype(np.int32)),
                 pa.array([None if none[i] else seq[16 * i:16 * i + 16] for i in range(len(n))], pa.binary()), lists],
                schema=pa.schema([*batch.schema, ("n", pa.int32()), ("seq", pa.binary()), ("bands", lists.type)]))

    return cut_lineage(rows.mapInArrow(sign, schema).withColumn("row_id", F.monotonically_increasing_id()))


class Run:
    """Some whole tasks, their texts sorted by task, side and ``row_id``."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.table = table
        self.n = len(table)
        self.band, side = table["band"].to_numpy(), table["side"].to_numpy()
        flat_bits = table["bands"].combine_chunks().flatten().to_numpy()
        self.bits = flat_bits.reshape(self.n, -1)
        new = task_starts(table)
        task = np.cumsum(new) - 1
        self.task = task
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], self.n)
        self.start, self.end = starts[task], ends[task]
        middle = (self.end - np.add.reduceat(side, starts)[task]) if self.n else self.end  # where side 1 begins
        within = table["i"].to_numpy() == table["j"].to_numpy()
        self.first = np.where(within, np.arange(self.n) + 1, middle)
        self.count = np.where(side == 0, np.maximum(0, self.end - self.first), 0)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that belong to these tasks, in order of the left text:
        those of a task that meet in no band before the task's."""
        for a, b in pieces(np.concatenate(([0], np.cumsum(self.count))), PAIRS):
            n = self.count[a:b]
            left = np.repeat(np.arange(a, b), n)
            right = np.repeat(self.first[a:b] - np.cumsum(n) + n, n) + np.arange(len(left))
            for t in range(int(self.band[a:b].max(initial=0))):
                free = (self.band[left] <= t) | (self.bits[left, t] != self.bits[right, t])
                left, right = left[free], right[free]
            if len(left):
                yield left, right


def task_starts(table: pa.Table) -> np.ndarray:
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for c in TASK:
        v = table[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Run]:
    """The sorted rows of a partition as runs of whole tasks of about
    ``least`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(task_starts(table))[-1]) if len(table) else 0
            if last:
                yield Run(table.slice(0, last))
            held = table.slice(last).to_batches()
            size = sum(b.nbytes for b in held) if last else 0
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield Run(table)


def needed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that have a pair of their own in their task."""
    for run in runs(batches, 16 << 20):
        use = np.zeros(run.n, dtype=bool)
        for left, right in run.pairs():
            use[left] = use[right] = True
        yield from run.table.filter(pa.array(use)).to_batches(max_chunksize=BATCH_ROWS)


def verified_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each text of a task with verified links their number, and the first
    text of its linked group within the task."""
    for run in runs(batches, 8 << 20):  # the codes of its shingles take some ten times as much
        column = run.table["shingles"].combine_chunks()
        raw, at = flat_bytes(column)
        start, values = at // 8, raw.view(np.uint64)
        size = np.diff(start)
        # equal shingles of one task get one code; ``holder`` has the texts of each code
        tagged = mix(values + np.repeat(run.task, size).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        distinct, code = np.unique(tagged, return_inverse=True)
        holder = np.repeat(np.arange(run.n), size)[np.argsort(code, kind="stable")]
        first = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(distinct)))))
        links = np.zeros(run.n, dtype=np.int64)
        label = np.arange(run.n)
        for left, right in run.pairs():
            cuts = np.flatnonzero(np.diff(left)) + 1
            for x, partners in zip(left[np.append(0, cuts)].tolist(), np.split(right, cuts)):
                own = code[start[x]:start[x + 1]]
                n = first[own + 1] - first[own]
                met = holder[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                low = int(run.start[x])
                shared = np.bincount(met - low, minlength=int(run.end[x]) - low)[partners - low]
                found = partners[shared >= threshold * (size[x] + size[partners] - shared) - 1e-9]
                if len(found):
                    links[x] += len(found)
                    links[found] += 1
                    task = label[low:run.end[x]]
                    old = np.unique(np.append(label[found], label[x]))
                    if len(old) > 1:
                        task[np.isin(task, old)] = old[0]
        ids = run.table["row_id"].to_numpy()
        use = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(links[use]), pa.array(ids[label[use]])],
                                         names=["row_id", "n_links", "root"])


def by_task(tasks: DataFrame) -> DataFrame:
    return tasks.repartition(*TASK).sortWithinPartitions(*TASK, "side", "row_id")


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for the nodes of an undirected graph ``(u, v)`` of longs:
    the least node of its component, for every node but that one. Rounds of
    large-star and small-star steps, each a written table, until every u has one
    v and no v is a u; the number of rounds grows with the logarithm of the
    longest path."""

    def open_(stars: DataFrame) -> bool:
        chained = stars.join(stars.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        return not chained.isEmpty() or not stars.groupBy("u").count().where("count > 1").isEmpty()

    stars = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while open_(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut_lineage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
    return stars.select("u", F.col("v").alias("root"))


def linked(rows: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(classes, groups)`` of a table of :func:`signed`: ``classes`` is
    ``(seq, row_id, n_copies)`` with one row of each word sequence, ``groups``
    is ``(row_id, n_links, root)`` for the class rows that have links."""
    classes = cut_lineage(rows.where("seq is not null").groupBy("seq")
                          .agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"),
                               F.first("n").alias("n")))
    met = classes.select("row_id", "n", F.posexplode("bands").alias("band", "hash"))
    # buckets of two and more, with the number of blocks they are dealt to
    weight = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    buckets = (met.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("members"), weight.alias("k"))
               .where("members > 1").select("band", "hash", "k"))
    members = met.join(buckets, ["band", "hash"])
    block = F.pmod(F.xxhash64("row_id"), F.col("k")).cast("int")
    # block b meets every block: as side 0 with those after it and itself, as side 1 with those before it
    tasks = (members.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("row_id", "band", "hash", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
                     (F.col("b") > F.col("o")).cast("int").alias("side")))
    with_bits = tasks.join(classes.select("row_id", "bands"), "row_id").select("row_id", *TASK, "side", "bands")
    needed = cut_lineage(by_task(with_bits).mapInArrow(needed_texts, with_bits.schema))
    wanted = bounded_broadcast(needed.select("row_id").distinct(), 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row_id")
            for a, b, _, _, shingles, bounds in shingled(batch.column("text"), size):
                sets = [np.unique(shingles[bounds[i]:bounds[i + 1]]).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sets, pa.binary())], names=["row_id", "shingles"])

    sets = (rows.select("row_id", "text").join(wanted, "row_id", "left_semi")
            .mapInArrow(cut, "row_id bigint, shingles binary"))
    with_sets = by_task(needed.join(sets, "row_id"))
    verified = cut_lineage(with_sets.mapInArrow(lambda batches: verified_links(batches, threshold),
                                                "row_id bigint, n_links bigint, root bigint"))
    counts = verified.groupBy("row_id").agg(F.sum("n_links").alias("n_links"))
    roots = components(verified.select(F.col("row_id").alias("u"), F.col("root").alias("v")))
    groups = cut_lineage(counts.join(roots, counts["row_id"] == roots["u"], "left")
                         .select("row_id", "n_links", F.coalesce("root", "row_id").alias("root")))
    return classes.select("seq", "row_id", "n_copies"), groups


def grouped(rows: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``(row_id, id, n_copies, n_links, root)`` for every row of a table of
    :func:`signed`: the size of its class, the links of its text to other
    texts, and the number that its linked group shares."""
    classes, groups = linked(rows, threshold, size)
    known = classes.join(groups, "row_id", "left").select("seq", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                                                          F.coalesce("root", "row_id").alias("root"))
    return (rows.select("row_id", "id", "seq").join(known, "seq", "left")
            .select("row_id", "id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("root", "row_id").alias("root")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each document: its id, the least id of its linked group
    (``class_id``), the number of equal texts (``n_copies``) and of links to
    other texts (``n_links``)."""
    rows = cut_lineage(grouped(signed(docs, key, text, [key], threshold, recall), threshold))
    least = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    return (rows.join(least, "root")
            .select(F.col("id").alias("doc_id"), "class_id", F.col("n_copies").cast("bigint").alias("n_copies"), F.col("n_links").cast("bigint").alias("n_links")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each linked group, that with the least id (null ids
    last), with the columns it came with."""
    table = signed(docs, key, text, None, threshold)
    rows = cut_lineage(grouped(table, threshold))
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_id")).alias("s")).select("s.row_id")
    drops = cut_lineage(rows.join(stays, "row_id", "left_anti").select("row_id"))
    left = table.join(bounded_broadcast(drops, 16), "row_id", "left_anti")
    return left.select(*[F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
