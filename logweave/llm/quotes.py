"""Quotation linking of messages (operator 6).

A message's lines carry quote marks (``>``, nested ones as ``>>`` or ``> >``).
Lines of one depth that stand together are a passage. Passages are normalised
(marks, white space, line ends, case), so that a quote wrapped anew stays the
same, and hashed: all runs of ``SHINGLE`` words, or the whole of a shorter
passage (own text also by its short lines). A quoted hash belongs to the latest
message before that has it in its own passages (depth 0). Of a quoted passage
with at least half of its hashes found the message with most of them is the
original, the latest one on a tie: a part of a message may be quoted, or one
with a changed word. A message replies to the original of its shallowest quoted
passage (the latest, if several); without one it begins a thread of its own
unless ``by_turn`` links it to the greatest turn before its own.

The latest message with a hash is an as-of lookup over ranges sorted by
(conversation, hash, turn): a line that all messages of a large conversation
say and quote takes as many tasks as it needs, and each quote of it meets one
origin. Only conversations with quotes take part.

The result has a row for each message: its text without quotes and without
the lines that introduce them, its parent, the root and depth of its thread.
Reply order is (conversation, root, turn): a reply comes after what it
replies to. Roots come from doubling the parents' reach, so a thread of n
messages takes log2(n) rounds, each a written table; no conversation is
gathered in a task.

Edge cases: null and empty texts have no lines and link nothing; blank quoted
lines link nothing; a quote of nothing known stays unlinked (its text is
removed all the same); equal rows (same conversation and turn) are kept, each
with the same links; null conversations form one, null turns come first; an
empty table gives an empty table; other columns, whatever their names, pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, let, row_of, text_of
from logweave.operators.ordering import range_numbered
from logweave.operators.quality import asof

#: Words in a hashed run of a passage.
SHINGLE = 5
MARKS = r"^\s*((?:>\s?)+)"
#: Lines that introduce a quote, such as "On Monday, A. B. wrote:".
INTRODUCTION = r"(?i)^\s*(on\b.*\bwrote|.{0,80}\b(wrote|writes|said))\s*:\s*$"


def depth_of(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"\s", ""))


def normal(line: Column) -> Column:
    bare = F.regexp_replace(line, MARKS, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def hashes(text: Column) -> Column:
    """The hashes of a normalised passage: of its runs of words, or of the
    whole if it is shorter; none of an empty one."""
    def of_words(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
        runs = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(words) < SHINGLE, F.array(F.xxhash64(text))).otherwise(runs)
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(let(F.split(text, " "), of_words))


def parsed(messages: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """``(message, conv, turn, lines, passages)``: the lines with their depth
    and normalised form, and the passages with their depth and text, in order."""
    raw = F.split(F.regexp_replace(text_of(text), r"\r\n?", "\n"), "\n")
    lines = F.transform(raw, lambda x: F.struct(x.alias("line"), depth_of(x).alias("depth"), normal(x).alias("plain")))
    rows = cut_lineage(messages.select(row_of(messages, "message"), F.col(conversation).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                                       lines.alias("lines")))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1),
                      lambda i: (i == 0) | (F.get("lines", i - 1)["depth"] != F.get("lines", i)["depth"]))
    rows = rows.withColumn("starts", starts)

    def passage(s: Column, k: Column) -> Column:
        part = F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s)
        said = F.filter(F.transform(part, lambda x: x["plain"]), lambda x: x != "")
        return F.struct(F.get("lines", s)["depth"].alias("depth"), F.array_join(said, " ").alias("text"))
    return rows.withColumn("passages", F.transform("starts", passage)).drop("starts")


def own_text(lines: Column) -> Column:
    """The message without quoted lines and their introductions."""
    def stays(x: Column, i: Column) -> Column:
        introduces = x["line"].rlike(INTRODUCTION) & (F.coalesce(F.get(lines, i + 1)["depth"], F.lit(0)) > 0)
        return (x["depth"] == 0) & ~introduces
    kept = F.transform(F.filter(lines, stays), lambda x: x["line"])
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def links(table: DataFrame) -> DataFrame:
    """``(conv, turn, parent)``: which earlier message each message quotes."""
    quoted = cut_lineage(table.where(F.exists("passages", lambda p: (p["depth"] > 0) & (p["text"] != ""))).where("turn is not null")
                         .select("conv", "turn", "passages").distinct())
    with_quotes = cut_lineage(quoted.select("conv").distinct())
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-"))

    def key(of: str) -> Column:
        return F.concat_ws(":", conv, F.col(of).cast("string")).alias("key")

    asked = quoted.select("conv", "turn", F.posexplode("passages").alias("passage", "p")).where("p.depth > 0")
    asked = asked.withColumn("all", F.array_distinct(hashes(F.col("p.text"))))
    asked = asked.select("conv", "turn", "passage", F.col("p.depth").alias("depth"), F.size("all").alias("total"), F.explode("all").alias("hash"))
    asked = asked.select("conv", "turn", "passage", "depth", "total", key("hash"), (F.col("turn") * 2).alias("at"))
    own = F.flatten(F.transform(F.filter("passages", lambda p: p["depth"] == 0), lambda p: hashes(p["text"])))
    short = F.filter("lines", lambda x: (x["depth"] == 0) & (x["plain"] != "") & (F.size(F.split(x["plain"], " ")) < SHINGLE))
    own = F.array_distinct(F.concat(own, F.transform(short, lambda x: F.xxhash64(x["plain"]))))
    said = table.alias("t").join(with_quotes.alias("q"), F.col("t.conv").eqNullSafe(F.col("q.conv")), "left_semi").where("turn is not null")
    said = said.select("conv", "turn", F.explode(own).alias("hash")).select(key("hash"), (F.col("turn") * 2 + 1).alias("at"), F.col("turn").alias("origin"))

    met = asof(asked, said, "key", ["at"], "origin", ["origin"]).where("origin is not null")
    found = met.groupBy("conv", "turn", "passage", "depth", "total", "origin").agg(F.count(F.lit(1)).alias("n"))
    best = found.groupBy("conv", "turn", "passage", "depth", "total").agg(F.max(F.struct("n", "origin")).alias("b"), F.sum("n").alias("met"))
    best = best.where("2 * met >= total")
    return best.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("depth")).alias("d"), F.col("b.origin").alias("o"))).alias("p")).select(
        "conv", "turn", F.col("p.o").alias("parent"))


def rooted(edges: DataFrame) -> DataFrame:
    """``(conv, turn, parent, root, depth)`` for the messages that reply."""
    state = cut_lineage(edges.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = state.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("far"), F.col("depth").alias("more"))
        step = state.join(up, state["conv"].eqNullSafe(up["c"]) & (state["root"] == up["t"]), "left")
        if step.where("far is not null").isEmpty():
            return state
        state = cut_lineage(step.select("conv", "turn", "parent", F.coalesce("far", "root").alias("root"),
                                        (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def threaded(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", by_turn: bool = True) -> DataFrame:
    """``(message, own_text, n_quoted_lines, parent_turn, root_turn, depth)``
    for every message; sort by conversation, ``root_turn`` and turn for reply
    order. ``by_turn`` lets a message without a linked quote reply to the
    greatest turn before its own."""
    table = parsed(messages, conversation, turn, text)
    edges = links(table)
    if by_turn:
        turns = cut_lineage(range_numbered(table.where("turn is not null").select("conv", "turn").distinct(), ["conv"], [F.col("turn")], "place"))
        before = turns.select(F.col("conv").alias("c"), F.col("turn").alias("last"), (F.col("place") + 1).alias("p"))
        chain = turns.join(before, turns["conv"].eqNullSafe(before["c"]) & (turns["place"] == before["p"])).select("conv", "turn", "last")
        edges = (chain.withColumnsRenamed({"conv": "c", "turn": "t"})
                 .join(edges, F.col("c").eqNullSafe(F.col("conv")) & (F.col("t") == F.col("turn")), "full")
                 .select(F.coalesce("conv", "c").alias("conv"), F.coalesce("turn", "t").alias("turn"), F.coalesce("parent", "last").alias("parent")))
    threads = rooted(edges).withColumnsRenamed({"conv": "c", "turn": "t"})
    quoted = F.size(F.filter("lines", lambda x: x["depth"] > 0))
    return (table.select("message", "conv", "turn", own_text(F.col("lines")).alias("own_text"), quoted.cast("bigint").alias("n_quoted_lines"))
            .join(threads, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
            .select("message", "own_text", "n_quoted_lines", F.col("parent").alias("parent_turn"),
                    F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth")))


def write_conversations(messages: DataFrame, path: str, conversation: str = "conv_id", turn: str = "turn", **options) -> None:
    """Write the messages in reply order: files by ranges of conversation,
    root and turn (a long conversation may span files), sorted within."""
    order = [F.col(f"message.`{conversation}`"), F.col("root_turn"), F.col(f"message.`{turn}`")]
    out = threaded(messages, conversation, turn, **options)
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
