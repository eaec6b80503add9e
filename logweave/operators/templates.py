"""Template mining.

Lines are grouped the way the reference's prefix tree groups them: by
(log, token count, first token - replaced by ``<*>`` when it contains a
digit). M1a keeps, per group and position, the token when it is constant and
``<*>`` otherwise: a fold of lines, by task and then by group. M1b works on
*distinct* lines (a partial+final hash aggregate).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logweave.functions.vocab import UNMATCHED
from logweave.session import cut_lineage

WILDCARD = "<*>"
KEY = ["log_id", "n_tok", "first_key"]
HELD_CHARS = 1 << 24  # characters of templates that a task holds before it hands them on


def tokens(clean_col="clean"):
    c = F.coalesce(F.col(clean_col) if isinstance(clean_col, str) else clean_col, F.lit(""))
    return F.when(c == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(c, " "))


def with_key(lines: DataFrame, clean_col: str = "clean") -> DataFrame:
    """Add ``tokens``, ``n_tok`` and ``first_key`` (the prefix-tree key)."""
    t = lines.withColumn("tokens", tokens(clean_col))
    first = F.coalesce(F.element_at(F.col("tokens"), 1), F.lit(""))
    return (t.withColumn("n_tok", F.size("tokens"))
            .withColumn("first_key",
                        F.when(F.col("n_tok") == 0, F.lit(""))
                        .when(first.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(first)))


def distinct_lines(keyed: DataFrame, clean_col: str = "clean") -> DataFrame:
    """One row per distinct line of a log: (key, clean, tokens, cnt, first_line)."""
    return (keyed.groupBy(*KEY, clean_col)
            .agg(F.count(F.lit(1)).alias("cnt"), F.min("line_no").alias("first_line"))
            .withColumn("tokens", tokens(clean_col)))


class PositionalTemplate:
    """The M1a template of some lines of one key group, with their count and
    least line number. Two of them, of any lines, add up to that of all lines:
    a place keeps its token where both agree and is a wildcard else."""

    __slots__ = ("text", "toks", "cnt", "first")

    def __init__(self, text: str, cnt: int, first: Any):
        self.text, self.toks, self.cnt, self.first = text, None, cnt, first

    def add(self, text: str, cnt: int, first: Any) -> None:
        self.cnt += cnt
        if first is not None and (self.first is None or first < self.first):
            self.first = first
        if self.toks is None:
            if text == self.text:
                return
            self.toks = self.text.split(" ")
        self.toks = [a if a == b else WILDCARD for a, b in zip(self.toks, text.split(" "))]

    def template(self) -> str:
        return self.text if self.toks is None else " ".join(self.toks)


def _fold_positional(batches: Iterator[pa.RecordBatch], schema: pa.Schema, in_order: bool, held_chars: int) -> Iterator[pa.RecordBatch]:
    """Templates of the rows' key groups: a task's own share of each
    (``held_chars`` characters of lines at a time), or, from rows in order of
    their keys, the whole groups one after the other."""
    def out(groups: dict[tuple, PositionalTemplate]) -> pa.RecordBatch:
        rows = [(*key, t.template(), t.cnt, t.first) for key, t in groups.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    groups: dict[tuple, PositionalTemplate] = {}
    chars, last = 0, None
    for batch in batches:
        for *own, text, cnt, first in zip(*(c.to_pylist() for c in batch.columns)):
            key = tuple(own)
            group = groups.get(key)
            if group is not None:
                group.add(text, cnt, first)
                continue
            if chars >= held_chars and (not in_order or key != last):
                yield out(groups)
                groups, chars = {}, 0
            groups[key] = PositionalTemplate(text, cnt, first)
            chars, last = chars + len(text) + 200, key
    if groups:
        yield out(groups)


def positional_templates(lines: DataFrame, clean_col: str = "clean", held_chars: int = HELD_CHARS) -> DataFrame:
    """One template per (log_id, n_tok, first_key).

    Output ``(log_id, n_tok, first_key, template, cnt, first_idx)``.

    Templates add up (:class:`PositionalTemplate`), so the lines are folded in
    two steps, as in an aggregate: each task folds its own lines of a key group
    to one row, holding ``held_chars`` characters at a time, and these rows
    alone are shuffled, sorted by key and folded again. Neither a token nor a
    repeated line is shuffled, and a group of any size is many tasks' work.
    """
    keyed = with_key(lines, clean_col)
    rows = keyed.select(*KEY, F.coalesce(F.col(clean_col), F.lit("")).alias("template"), F.lit(1).cast("long").alias("cnt"),
                        F.col("line_no").alias("first_idx"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    arrow = to_arrow_schema(rows.schema)
    shares = rows.mapInArrow(lambda batches: _fold_positional(batches, arrow, False, held_chars), schema)
    ordered = shares.repartition(*KEY).sortWithinPartitions(*KEY)
    return ordered.mapInArrow(lambda batches: _fold_positional(batches, arrow, True, held_chars), schema)


def best_templates(uniq: DataFrame, templates: DataFrame, clean_col: str = "clean") -> DataFrame:
    """``(log_id, clean, template)`` of the distinct lines (key and ``clean``)
    that some template fully matches.

    A template is a mask (the positions of its literals) and a hash of the
    literals there. A line is probed once for each distinct mask of its key, by
    an equi-join on (key, mask, hash); literals are compared on a hit only, so
    a line meets the templates it may match and no others. The best hit is a
    maximum by aggregation.
    """
    t = templates if "cluster_id" in templates.columns else templates.withColumn("cluster_id", F.lit(0))
    t = t.withColumn("_tok", tokens("template")).where(F.size("_tok") == F.col("n_tok"))
    t = t.withColumn("_mask", F.filter(F.transform("_tok", lambda x, i: F.when(x != F.lit(WILDCARD), i)), lambda i: i.isNotNull()))
    literals = F.transform("_mask", lambda i: F.get("_tok", i))
    t = t.select(*KEY, "_mask", literals.alias("_lit"), F.xxhash64(literals).alias("_hash"), "cluster_id", "template")
    masks = t.select(*KEY, "_mask").distinct()
    probes = uniq.select(*KEY, clean_col).withColumn("_tok", tokens(clean_col)).join(masks, KEY)
    probes = probes.withColumn("_at", F.transform("_mask", lambda i: F.get("_tok", i)))
    probes = probes.select(*KEY, clean_col, "_mask", "_at", F.xxhash64("_at").alias("_hash"))
    hits = probes.join(t, [*KEY, "_mask", "_hash"]).where(F.col("_at") == F.col("_lit"))
    rank = F.struct(F.size("_mask").alias("n"), (-F.col("cluster_id")).alias("c"), F.col("template").alias("t"))
    return hits.groupBy("log_id", clean_col).agg(F.max(rank)["t"].alias("template"))


def match_templates(lines: DataFrame, templates: DataFrame, clean_col: str = "clean") -> DataFrame:
    """M2 + M3: give each line the final template that fully matches it.

    ``templates`` has ``(log_id, n_tok, first_key, cluster_id, template)`` (M1b)
    or the M1a shape (one template per key). A template matches when every
    position is equal or ``<*>``; among matches the one with most literal
    tokens wins, then the lowest cluster id. Lines without a match get
    ``UNMATCHED``. Distinct lines are matched (:func:`best_templates`); the
    written result is joined to the lines, so that a line repeated all over a
    log is split over tasks.
    """
    uniq = with_key(lines, clean_col).select(*KEY, clean_col).distinct()
    best = cut_lineage(best_templates(uniq, templates, clean_col))
    return (lines.join(best, ["log_id", clean_col], "left")
            .select(*lines.columns, F.coalesce("template", F.lit(UNMATCHED)).alias("template")))


def template_freq(matched: DataFrame) -> DataFrame:
    """M4-M6: ``(log_id, template, cnt, first_idx)`` + N per log.

    Partial+final hash aggregate; the template column is the grouping key, so a
    template holding a third of the lines is pre-aggregated map-side.
    """
    freq = matched.groupBy("log_id", "template").agg(F.count(F.lit(1)).alias("cnt"),
                                                     F.min("line_no").alias("first_idx"))
    n = matched.groupBy("log_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return freq.join(n, "log_id")


def mine_positional(lines: DataFrame, clean_col: str = "clean") -> DataFrame:
    """M1a -> M2 -> M4: template frequencies for every log.

    With M1a each line's template is the template of its own key, so the
    match pass reduces to an equi-join on the key (no per-line predicate).
    """
    return with_line_counts(template_counts(lines, clean_col))


def written_distinct(lines: DataFrame, clean_col: str = "clean") -> DataFrame:
    """The distinct lines of every log, written: training and matching read them."""
    return cut_lineage(distinct_lines(with_key(lines, clean_col), clean_col).drop("tokens"))


def mine_similarity(lines: DataFrame, clean_col: str = "clean", trained: DataFrame | None = None, uniq: DataFrame | None = None) -> DataFrame:
    """M1b -> M2/M3 -> M4: the templates are trained over the whole log, frozen
    (written), and every line is matched to the final ones; counts per log.
    ``trained`` gives templates of an earlier run, ``uniq`` the written distinct
    lines (:func:`written_distinct`) that they come from. Distinct lines carry
    their counts through, so no line is joined."""
    uniq = written_distinct(lines, clean_col) if uniq is None else uniq
    frozen = cut_lineage(_drain_distinct(uniq, clean_col)) if trained is None else trained
    best = best_templates(uniq, frozen, clean_col)
    freq = (uniq.join(best, ["log_id", clean_col], "left")
            .groupBy("log_id", F.coalesce("template", F.lit(UNMATCHED)).alias("template"))
            .agg(F.sum("cnt").alias("cnt"), F.min("first_line").alias("first_idx")))
    return with_line_counts(cut_lineage(freq))


def template_counts(lines: DataFrame, clean_col: str = "clean") -> DataFrame:
    """M1a -> M4/M5 without N: ``(log_id, template, cnt, first_idx)``."""
    tm = positional_templates(lines, clean_col)
    return (tm.groupBy("log_id", "template")
            .agg(F.sum("cnt").alias("cnt"), F.min("first_idx").alias("first_idx")))


def with_line_counts(freq: DataFrame) -> DataFrame:
    """Add N (lines per log) = sum of template counts: a partial+final
    aggregate to one row per log, joined back - no window over a log.
    Best applied to a materialized frequency table (it is read twice)."""
    n = freq.groupBy("log_id").agg(F.sum("cnt").alias("n_lines"))
    return freq.join(n, "log_id")


# ---------------------------------------------------------------------------
# Similarity split inside a key group (order dependent -> per group)
# ---------------------------------------------------------------------------

SIM_THRESHOLD = 0.4  # fixed value: similarity threshold of the reference miner


CHUNK_LINES = 50000  # distinct lines taken into Python at a time
BATCH_ROWS = 4096  # templates of finished groups that leave a task together


class SimilarityClusters:
    """The clusters of one key group, fed line by line.

    A line joins the most similar cluster when (equal non-wildcard tokens /
    length) reaches the threshold (ties: more wildcards, then the older
    cluster), which then wildcards every differing position; otherwise it
    founds a new one.

    ``postings`` has the clusters that hold a token at a position. A cluster
    similar enough shares at least ``need`` of a line's n tokens, hence at
    least one of any n - need + 1 of them: only the clusters in the shortest so
    many posting lists are compared with the line."""

    def __init__(self, n_tok: int):
        self.need = next(k for k in range(n_tok + 1) if n_tok == 0 or k / n_tok >= SIM_THRESHOLD)
        self.templates: list[list[str]] = []
        self.wildcards: list[int] = []
        self.postings: list[dict[str, set[int]]] = [{} for _ in range(n_tok)]

    def add(self, toks: list[str]) -> None:
        if not toks:
            self.templates = [[]]
            return
        lists = sorted((p.get(t, ()) for p, t in zip(self.postings, toks)), key=len)
        near = set().union(*lists[:len(toks) - self.need + 1])
        best = max(((self.equal(c, toks), self.wildcards[c], -c) for c in near), default=(0, 0, 0))
        if best[0] < self.need:
            self.templates.append(toks)
            self.wildcards.append(sum(t == WILDCARD for t in toks))
            for p, t in zip(self.postings, toks):
                if t != WILDCARD:
                    p.setdefault(t, set()).add(len(self.templates) - 1)
            return
        cluster = -best[2]
        template = self.templates[cluster]
        for i, (old, new) in enumerate(zip(template, toks)):
            if old != new and old != WILDCARD:
                self.postings[i][old].discard(cluster)
                template[i] = WILDCARD
                self.wildcards[cluster] += 1

    def equal(self, cluster: int, toks: list[str]) -> int:
        return sum(a == b != WILDCARD for a, b in zip(self.templates[cluster], toks))


def _drain_sorted(batches: Iterator[pa.RecordBatch], chunk_lines: int) -> Iterator[pa.RecordBatch]:
    """Cluster the key groups of a sorted partition one after the other; only
    the templates of the group at hand, and up to ``BATCH_ROWS`` of the groups
    before it, are kept: small groups leave together, as one batch."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*KEY, "cluster_id", "template"])

    def templates_of(key: list, clusters: SimilarityClusters) -> list[tuple]:
        return [(*key, i, " ".join(c)) for i, c in enumerate(clusters.templates)]

    key, clusters, done = None, None, []
    for batch in batches:
        for at in range(0, batch.num_rows, chunk_lines):
            part = batch.slice(at, chunk_lines)
            for *own, toks in zip(*(part.column(c).to_pylist() for c in [*KEY, "tokens"])):
                if own != key:
                    if clusters:
                        done += templates_of(key, clusters)
                    if len(done) >= BATCH_ROWS:
                        yield batch_of(done)
                        done = []
                    key, clusters = own, SimilarityClusters(len(toks))
                clusters.add(toks)
    if clusters:
        done += templates_of(key, clusters)
    if done:
        yield batch_of(done)


def drain_templates(lines: DataFrame, clean_col: str = "clean", chunk_lines: int = CHUNK_LINES, uniq: DataFrame | None = None) -> DataFrame:
    """Similarity-split templates per (log, key).

    Lines are deduplicated first (hash aggregate). The distinct lines of a key
    group are sorted by first appearance and clustered in that order, as a
    stream: a task holds the templates of one group and ``chunk_lines`` lines,
    whatever the size of the group, and the result is that of the sequential
    rule. A line is compared with the clusters that share rare tokens with it
    only, so the time grows with the distinct lines. The rule depends on the
    order, so one group is one task's work. ``uniq`` gives the distinct lines
    where they are known.
    """
    uniq = distinct_lines(with_key(lines, clean_col), clean_col) if uniq is None else uniq
    return _drain_distinct(uniq, clean_col, chunk_lines)


def _drain_distinct(uniq: DataFrame, clean_col: str, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    ordered = (uniq.select(*KEY, "first_line", clean_col).repartition(*KEY).sortWithinPartitions(*KEY, "first_line", clean_col)
               .select(*KEY, tokens(clean_col).alias("tokens")))
    schema = "log_id string, n_tok int, first_key string, cluster_id int, template string"
    return ordered.mapInArrow(lambda batches: _drain_sorted(batches, chunk_lines), schema)
