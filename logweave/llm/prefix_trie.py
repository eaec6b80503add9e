"""The trie of conversations that begin alike (operator 12).

A node of depth d is a distinct sequence of d turns (role, text); its members
are the conversations that begin with it. With the conversations sorted, the
members of a node stand side by side, and neighbours share as many turns as
their longest common prefix (LCP) says. A sparse table holds the minimum of
the LCPs over every run of 1, 2, 4, ... neighbours; each candidate prefix
(conversation, depth) then finds how far its LCPs reach to the left and to the
right by two binary searches of its own, without a stack and independent of
all others. The candidate whose left extent is itself stands for the node.

How this is spread over tasks:

* A turn is two 64-bit hashes of its role, text and place. The sum of their
  four 32-bit halves over a prefix names the prefix (128 bits).
* A conversation is cut into blocks of ``BLOCK`` turns; a block knows the name
  of the prefix before it, so blocks of any conversation are worked on alike
  and the longest conversation is no row of its own. Equal blocks after equal
  prefixes are one row with a count: a group of copies shrinks before it is
  shuffled.
* Blocks are sorted over ranges, and a task reads its range in runs of
  ``RUN`` turns. A node whose members lie in several runs comes out of each
  with the members there; the parts have one name and are added up.
* What a node's subtree holds is summed along chains: a conversation owns the
  nodes whose smallest member it is, which are the lower end of its path. A
  chain's total goes to the prefixes above its top only, so the work stays in
  proportion to the turns.

Edge cases: a null role or text is empty; turns come in order of their number,
null first, equal numbers in order of the turns' hashes; equal rows are turns
each; rows without a conversation id belong to none and make no node; ids are
whole numbers; a conversation without turns is a member of the root only; an
empty table gives no node, not even a root; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, small_batches, text_of, words
from logweave.operators.ordering import range_numbered, running_sums

#: Turns in a block, turns that a task searches at a time, and ids in a piece of a member list.
BLOCK, RUN, PIECE = 64, 1 << 18, 4096
NAME = ["h1", "h2", "h3", "h4"]
KEY = ["depth", *NAME]


class SparseMin:
    """Minima over the runs of 1, 2, 4, ... neighbours of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def at_least(self, level: int, begin: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether the 2 ** level values from ``begin`` on are all there and
        not below ``least``."""
        table = self.levels[level]
        inside = (begin >= 0) & (begin < len(table))
        return inside & (table[np.where(inside, begin, 0)] >= least)

    def minimum(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum from ``first`` to ``last``, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.levels[k][first[on]], self.levels[k][last[on] - (1 << k) + 1])
        return out


def extents(lcp: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last row that share ``depth`` turns with ``row``;
    ``lcp[i]`` counts the turns that rows ``i - 1`` and ``i`` share."""
    table = SparseMin(lcp)
    left, right = row.copy(), row.copy()
    for level in range(len(table.levels) - 1, -1, -1):
        step = 1 << level
        # rows 1 ... have an LCP with the row before them; row 0 has none
        left -= step * ((left >= step) & table.at_least(level, left - step + 1, depth))
        right += step * table.at_least(level, right + 1, depth)
    return left, right


def flat(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def halves(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The four 32-bit halves of two columns of hashes, as rows of an array."""
    return np.stack([x & 0xFFFFFFFF, (x >> 32) & 0xFFFFFFFF, y & 0xFFFFFFFF, (y >> 32) & 0xFFFFFFFF])


class Blocks:
    """Blocks of turns as arrays: one of lengths, flat ones of the turns."""

    def __init__(self, table: pa.Table):
        turns = table["turns"].combine_chunks()
        turns = pa.concat_arrays(turns.chunks) if isinstance(turns, pa.ChunkedArray) else turns
        self.lengths = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x, y, self.n_words = (f.to_numpy(zero_copy_only=False) for f in turns.flatten().flatten())
        self.x, self.y = x, y
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.place = flat(self.lengths)
        self.block = table["block"].to_numpy()
        self.base = np.stack([table[n].to_numpy() for n in NAME])
        self.depth = self.block[self.row] * BLOCK + self.place + 1
        self.half = halves(x, y)
        # names of the prefixes that end with each turn
        total = np.cumsum(self.half, axis=1)
        first = self.starts[self.row]
        self.name = self.base[:, self.row] + total - total[:, first] + self.half[:, first]

    def lcp(self) -> np.ndarray:
        """Turns that each row shares with the row before, in this block."""
        out = np.zeros(len(self.lengths), np.int64)
        if len(out) > 1:
            both = np.minimum(self.lengths[1:], self.lengths[:-1])  # a block has a turn at least
            place = flat(both)
            a, b = np.repeat(self.starts[:-1], both) + place, np.repeat(self.starts[1:], both) + place
            differ = np.where((self.x[a] == self.x[b]) & (self.y[a] == self.y[b]), BLOCK, place)
            shared = np.minimum(np.minimum.reduceat(differ, np.cumsum(both) - both), both)
            together = (self.block[1:] == self.block[:-1]) & (self.base[:, 1:] == self.base[:, :-1]).all(axis=0)
            out[1:] = np.where(together, shared, 0)
        return out


def nodes_of_run(table: pa.Table) -> pa.RecordBatch:
    """The nodes of a run of sorted blocks, with the members in the run."""
    blocks = Blocks(table)
    left, right = extents(blocks.lcp(), blocks.row, blocks.place + 1)
    own = np.flatnonzero(left == blocks.row)
    left, right = left[own], right[own]
    counted = np.concatenate(([0], np.cumsum(table["n"].to_numpy())))
    name = blocks.name[:, own]
    above = name - blocks.half[:, own]
    columns = {"depth": blocks.depth[own], **dict(zip(NAME, name)), **{f"p{i + 1}": p for i, p in enumerate(above)},
               "n": counted[right + 1] - counted[left], "conv": SparseMin(table["conv"].to_numpy()).minimum(left, right),
               "n_words": blocks.n_words[own]}
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def in_runs(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows + len(batch.column("turns").flatten())
        if n >= turns:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def turns_of(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, pos, a, b, n_words)``: every turn's place in its conversation,
    hashes and words. Texts are read once and not shuffled."""
    role_, text_ = text_of(role), text_of(text)
    rows = messages.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("bigint").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), role_, text_).alias("a"),
        F.xxhash64(F.lit(2), text_, role_).alias("b"), F.size(words(text_)).cast("bigint").alias("n_words"))
    return range_numbered(cut_lineage(rows), ["conv"], [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")])


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, a, b, n_words)`` of the conversations as rebuilt, and
    ``(conv, length)`` of all of them: the first h turns of the conversation
    whose id is the multiple of ``every`` below, then the own ones after the
    first h; h is a hash of the id modulo ``most``."""
    turns = cut_lineage(turns)
    counts = cut_lineage(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    known = counts.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("first"))
    known = known.join(counts.select(F.col("conv").alias("first"), F.col("n").alias("m")), "first", "left")
    known = known.withColumn("taken", F.least("h", F.coalesce("m", F.lit(0))))
    known = cut_lineage(known.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = turns.where((F.col("conv") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "first")
    begin = heads.join(known.select("first", "conv", "h"), "first").where("pos < h")  # at most ``every`` conversations a turn, twice at 0
    rest = turns.join(known.select("conv", "h", "taken"), "conv").where("pos >= h").withColumn("pos", F.expr("taken + pos - h"))
    columns = ["conv", "pos", "a", "b", "n_words"]
    return begin.select(columns).unionAll(rest.select(columns)), known.select("conv", "length")


def blocks_of(turns: DataFrame) -> DataFrame:
    """``(conv, block, turns, h1 .. h4, s1 .. s4)``: blocks of a conversation
    with the name of the prefix before and what they add to it."""
    placed = turns.select("conv", "pos", F.xxhash64("a", "b", "pos").alias("x"), F.xxhash64("pos", "b", "a").alias("y"), "n_words")
    low, high = (lambda c: F.expr(f"{c} & 4294967295L")), (lambda c: F.expr(f"shiftrightunsigned({c}, 32)"))
    sums = [F.sum(v).alias(f"s{i + 1}") for i, v in enumerate((low("x"), high("x"), low("y"), high("y")))]
    listed = F.sort_array(F.collect_list(F.struct("pos", "x", "y", "n_words")))
    blocks = cut_lineage(placed.groupBy("conv", F.expr(f"pos div {BLOCK}").alias("block")).agg(listed.alias("turns"), *sums).withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["n_words"].alias("n_words")))))
    # only conversations of several blocks need sums over the blocks before
    several = blocks.where("block = 1").select("conv").distinct()
    halves_ = [f"s{i + 1}" for i in range(len(NAME))]
    long = cut_lineage(running_sums(blocks.join(several, "conv").select("conv", "block", *halves_), ["conv"], ["block"], F.expr("block div 1024"),
                                    {n: F.col(s) for n, s in zip(NAME, halves_)}, inclusive=False).where("block > 0").select("conv", "block", *NAME))
    return blocks.join(long, ["conv", "block"], "left").select(
        "conv", "block", "turns", *[F.coalesce(n, F.lit(0)).alias(n) for n in NAME], *halves_)


def nodes_of(blocks: DataFrame, run: int = RUN) -> DataFrame:
    """``(depth, h1 .. h4, p1 .. p4, n, conv, n_words)`` of every node but the
    root: its name and its parent's, members, smallest member, last words."""
    order = ["block", *NAME, "turns"]
    classes = blocks.groupBy(*order).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    names = [*KEY, *[f"p{i + 1}" for i in range(len(NAME))], "n", "conv", "n_words"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches, run):
            yield nodes_of_run(table)

    parts = classes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(search, ", ".join(f"{n} bigint" for n in names))
    return parts.groupBy(*KEY).agg(*[F.min(f"p{i + 1}").alias(f"p{i + 1}") for i in range(len(NAME))],
                                   F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("n_words").alias("n_words"))


def above_tops(blocks: DataFrame, chains: DataFrame, values: list[str]) -> DataFrame:
    """Sums of the chains' ``values`` by the prefixes above their tops;
    ``chains`` has the ``top`` (depth) of each ``conv``."""
    met = blocks.drop("s1", "s2", "s3", "s4").join(chains, "conv").where(f"block * {BLOCK} + 1 < top").select("block", *NAME, "turns", "top", *values)
    names = [*KEY, *values]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches, RUN):
            found = Blocks(table)
            on = np.flatnonzero(found.depth < table["top"].to_numpy()[found.row])
            columns = [found.depth[on], *found.name[:, on], *(table[v].to_numpy()[found.row[on]] for v in values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    out = met.mapInArrow(prefixes, ", ".join(f"{n} bigint" for n in names))
    return out.groupBy(*KEY).agg(*[F.sum(v).alias(f"{v}_below") for v in values])


def member_digests(ends: DataFrame) -> DataFrame:
    """``(depth, h1 .. h4, ends_sha256)``: SHA-256 of the ascending ids, joined
    by commas, of the conversations that end at each node. Ids are listed in
    pieces of a bounded range of ids; a task hashes the pieces as they come."""
    piece = F.expr(f"conv div {PIECE}").alias("piece")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    pieces = ends.groupBy(*KEY, piece).agg(listed).repartition(*KEY).sortWithinPartitions(*KEY, "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*((*key, sha.hexdigest()) for key, sha in done))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in KEY else pa.string()) for n, c in zip(names, columns)], names=names)

        names = [*KEY, "ends_sha256"]
        open_: tuple | None = None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(n).to_pylist() for n in [*KEY, "ids"])):
                if open_ and open_[0] == key:
                    open_[1].update(b"," + ids.encode())
                    continue
                if open_:
                    done.append(open_)
                open_ = (key, hashlib.sha256(ids.encode()))
            if done:
                yield batch_of(done)
        if open_:
            yield batch_of([open_])

    return pieces.mapInArrow(digest, ", ".join(f"{n} bigint" for n in KEY) + ", ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, run: int = RUN) -> DataFrame:
    """A row for each node: ``(conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256)``. The node's turns are the
    first ``depth`` of the conversation ``conv_id``."""
    small_batches(turns)
    lengths = cut_lineage(lengths)
    blocks = cut_lineage(blocks_of(turns))
    nodes = cut_lineage(nodes_of(blocks, run))
    parents = ["depth", *[f"p{i + 1}" for i in range(len(NAME))]]
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(p).alias(n) for p, n in zip(parents[1:], NAME)]]
    children = nodes.where("depth > 1").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    saved = ((F.col("n") - 1) * F.col("n_words")).alias("saved")
    known = cut_lineage(nodes.join(children, KEY, "left").select(
        *KEY, *parents[1:], "conv", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved,
        F.col("n_children").isNull().cast("bigint").alias("leaf")))

    # what a chain holds from each of its nodes down, and what hangs on the prefixes above it
    down = running_sums(known.select("conv", *KEY, "saved", "leaf"), ["conv"], [F.col("depth").desc()], F.expr("-(depth div 1024)"),
                        {"saved_own": F.col("saved"), "leaf_own": F.col("leaf")}).select(*KEY, "saved_own", "leaf_own")
    chains = cut_lineage(known.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).where("top > 1"))
    below = above_tops(blocks, chains, ["saved", "leaf"])

    last = blocks.join(lengths, "conv").where(f"block = (length - 1) div {BLOCK}")
    ends = last.select(F.col("length").alias("depth"), *[(F.col(n) + F.col(f"s{i + 1}")).alias(n) for i, n in enumerate(NAME)], "conv").unionAll(
        lengths.where("length = 0").select(F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(n) for n in NAME], "conv"))
    ends = cut_lineage(member_digests(ends))
    nobody = F.sha2(F.lit(""), 256)

    # the root is every depth-1 node's parent; deeper parents by name
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    total = known.agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.count(F.when(F.col("depth") == 1, 1)).alias("n")).first()
    at_root = ends.where("depth = 0").select("ends_sha256").first()
    schema = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
              "ends_sha256 string")
    nobody = hashlib.sha256(b"").hexdigest()
    top = [(root["conv_id"], 0, None, root["n_convs"], total["n"], total["leaf"] or 1, total["saved"] or 0, at_root[0] if at_root else nobody)]
    top = turns.sparkSession.createDataFrame(top if root["n_convs"] else [], schema)
    above = known.select(*[F.col(k).alias(p) for k, p in zip(KEY, parents)], F.col("conv").alias("parent")).withColumn("depth", F.col("depth") + 1)
    out = (known.where("depth > 1").join(above, parents)
           .unionByName(known.where("depth = 1").withColumn("parent", F.lit(root["conv_id"]).cast("bigint")))
           .join(down, KEY).join(below, KEY, "left").join(ends, KEY, "left"))
    plus = [(F.col(f"{v}_own") + F.coalesce(f"{v}_below", F.lit(0))) for v in ("leaf", "saved")]
    return top.unionAll(out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                                   "n_children", plus[0].alias("n_leaves"), plus[1].alias("saved_tokens"),
                                   F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256")))


def prefix_trie(messages: DataFrame, run: int = RUN, **columns) -> DataFrame:
    """The trie of a table's own conversations."""
    turns = cut_lineage(turns_of(messages, **columns))
    return trie(turns, turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length")), run)


def rebuilt_trie(messages: DataFrame, run: int = RUN, **columns) -> DataFrame:
    """The trie of the conversations rebuilt on shared beginnings."""
    return trie(*rebuilt(turns_of(messages, **columns)), run)
