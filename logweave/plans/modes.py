"""Mode matrix, event/query/context formatting, prompt assembly and
artifact sinks (P1-P6, F16-F20, SNK4, SNK5).

The reference runs 13 modes one after another and recomputes extraction per
mode. Here every (log, mode) pair is a row: each extractor runs once for all
logs, and modes pick their inputs by joins on (log_id, extraction).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import strip_placeholders
from logweave.session import cut_lineage

# fixed values: the 13 modes as (mode, extraction, retrieval, prompt)
MODES = (
    (1, "none", "none", "baseline"),
    (2, "static", "concat", "baseline"),
    (3, "none", "translated", "baseline"),
    (4, "static", "none", "rca"),
    (5, "static", "concat", "rca"),
    (6, "static", "translated", "rca"),
    (7, "dynamic", "none", "rca"),
    (8, "dynamic", "concat", "rca"),
    (9, "dynamic", "translated", "rca"),
    (10, "cluster", "none", "rca"),
    (11, "cluster", "concat", "rca"),
    (12, "cluster", "translated", "rca"),
    (13, "external", "none", "rca"),
)

# fixed values: prompt formats; {log} marks where the log text goes
PROMPT_BASELINE_CONTEXT = (
    "\n        MAC LAYER LOGS:\n        {log}\n\n        RELEVANT CONTEXT (3GPP 38.321 + OAI MAC):\n        {context}\n\n"
    "        Analyze the wireless link quality from all of the given MAC layer logs and suggest improvement strategies.\n        ")
PROMPT_BASELINE = (
    "\n        MAC LAYER LOGS:\n        {log}\n\n"
    "        Analyze the wireless link quality from the given MAC layer logs and suggest improvement strategies.\n        ")
PROMPT_RCA_CONTEXT = (
    "\n        MAC LAYER LOGS:\n        {log}\n\n        RELEVANT CONTEXT (3GPP 38.321 + OAI MAC):\n        {context}\n\n"
    "        FIVE ANOMALOUS EVENTS DETECTED:\n        {events}\n\n"
    "        Find the root cause event from the five events listed above. Analyze the root cause event error and trace its "
    "impact on subsequent connection quality. Build a causal chain.\n        ")
PROMPT_RCA = (
    "     \n        MAC LAYER LOGS:\n        {log}\n\n"
    "        FIVE ANOMALOUS EVENTS DETECTED:\n        {events}\n\n"
    "        Find the root cause event from the five events listed above. Analyze the root cause event error and trace its "
    "impact on subsequent connection quality. Build a causal chain.\n        ")


def rag_tag(mode: Column) -> Column:
    """Artifact tag of a mode."""
    return (F.when(mode.isin(1, 4, 7, 10, 13), F.lit("wo_rag"))
            .when(mode.isin(2, 5, 8, 11), F.lit("with_rag_concat")).otherwise(F.lit("with_rag_llm")))


def writes_events(mode: Column) -> Column:
    """Key-event artifacts exist for modes 2-13 except 3."""
    return (mode >= 2) & (mode != 3)


def mode_structs() -> Column:
    """The mode table as an array literal (13 bounded elements)."""
    return F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(e).alias("extraction"), F.lit(r).alias("retrieval"),
                              F.lit(p).alias("prompt")) for m, e, r, p in MODES])


def format_events(events: DataFrame, text_col: str = "template") -> DataFrame:
    """F16: ``"1. t1\\n2. t2 ..."`` per (log, extraction) from ranked events."""
    keys = [c for c in ("log_id", "extraction") if c in events.columns]
    item = F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col(text_col)).alias("s"))
    return events.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "\n").alias("events_text"))


def concat_query(events: DataFrame, text_col: str = "template") -> DataFrame:
    """retrieval query = placeholders removed from each event, joined by one space."""
    keys = [c for c in ("log_id", "extraction") if c in events.columns]
    item = F.struct("rank", strip_placeholders(F.col(text_col)).alias("s"))
    return events.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), " ").alias("rag_query"))


def context_block(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """``[Source: s | Section: h2 / h3]\\n text`` blocks joined by a blank line."""
    s = F.concat(F.lit("[Source: "), F.col("source"), F.lit(" | Section: "), F.col("h2"), F.lit(" / "),
                 F.col("h3"), F.lit("]\n"), F.col("text"))
    return hits.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", s.alias("s")))), lambda x: x["s"]),
                     "\n\n").alias("context"))


def chunk_listing(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """``--- Chunk i ---\\nSource: s | Section: h2 / h3\\ntext\\n`` joined by newline."""
    s = F.concat(F.lit("--- Chunk "), F.col("rank").cast("string"), F.lit(" ---\nSource: "), F.col("source"),
                 F.lit(" | Section: "), F.col("h2"), F.lit(" / "), F.col("h3"), F.lit("\n"), F.col("text"), F.lit("\n"))
    return hits.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", s.alias("s")))), lambda x: x["s"]),
                     "\n").alias("listing"))


#: Bytes of joined texts that a task gives out.
TASK_BYTES = 64 << 20


def with_texts(queries: DataFrame, texts: DataFrame, key: str, text_col: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``queries`` with the text of their ``key`` (a row of ``texts`` for each
    key; queries without one have no row).

    Very many queries may share a text. A join that streams the texts past the
    queries makes all rows of a text at once and holds them, so the queries are
    the streamed side at every size. What a key's rows take is counted
    beforehand: a key beyond ``task_bytes`` is dealt to several tasks, each with
    a copy of its text, and there are so many tasks that each gives out some
    ``task_bytes``."""
    texts = cut_lineage(texts.select(key, text_col))
    size = 64 + F.coalesce(F.octet_length(text_col), F.lit(0))
    made = queries.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(texts.select(key, size.alias("_size")), key)
    made = cut_lineage(made.select(key, (F.col("_n") * F.col("_size")).alias("_made")))
    tasks = made.agg(F.coalesce(F.sum("_made"), F.lit(0))).first()[0] // task_bytes + 1
    # at most one row for ``task_bytes`` of the result
    hot = F.broadcast(made.where(F.col("_made") > task_bytes).select(key, F.expr(f"_made div {task_bytes}").alias("_more")))
    more = F.coalesce("_more", F.lit(0))
    own = F.xxhash64(*[c for c in queries.columns if c != key])
    dealt = queries.join(hot, key, "left").withColumn("_part", F.pmod(own, more + 1)).drop("_more")
    copies = texts.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), more))).drop("_more")
    return (dealt.repartition(tasks, key, "_part").join(copies.repartition(tasks, key, "_part").hint("merge"), [key, "_part"])
            .select(*queries.columns, text_col))


def validate_external_events(events: DataFrame, lines: DataFrame, text_col: str = "line") -> DataFrame:
    """P5: flag every externally supplied event line that does not occur
    verbatim in its log (semi join on (log_id, text))."""
    wanted = events.select("log_id", text_col).distinct()
    # filter the (large) line table by the (small) event table before any
    # de-duplication, so only matching lines are shuffled
    present = (lines.select("log_id", F.col("clean").alias(text_col)).join(wanted, ["log_id", text_col], "left_semi")
               .distinct().withColumn("_hit", F.lit(True)))
    return (events.join(present, ["log_id", text_col], "left")
            .withColumn("exists", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))


def next_generation(inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], previous: DataFrame | None = None, key: str = "log_id") -> DataFrame:
    """SNK5: derived values of keyed inputs (a row for each key), computed for
    the keys whose content is new only.

    A value is kept with the fingerprint of the input that it came from and the
    ``generation`` that computed it. ``previous`` is the generation before, as
    written; keys that are there with the same fingerprint keep their value, the
    others alone go through ``compute`` (rows of ``inputs`` to rows of the key
    and its values), and keys that are gone go. The result is a generation to be
    written; the ones before stay as they are, so a run that fails leaves the
    last good one."""
    content = [c for c in inputs.columns if c != key]
    # nulls are written out, so that columns can't be mistaken for each other
    mark = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    marked = inputs.withColumn("fingerprint", mark)
    if previous is None:
        generation, missing = 0, marked
    else:
        generation = (previous.agg(F.max("generation")).first()[0] or 0) + 1
        missing = marked.join(previous.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")
    fresh = (compute(missing.drop("fingerprint")).join(missing.select(key, "fingerprint"), key)
             .withColumn("generation", F.lit(generation).cast("bigint")))
    if previous is None:
        return fresh
    kept = previous.join(marked.select(key, "fingerprint"), [key, "fingerprint"], "left_semi")
    return fresh.unionByName(kept.select(fresh.columns))


def run_all_modes(logs: DataFrame, events_text: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per (log, mode) with its events text and retrieval query.
    ``events_text(log_id, extraction, events_text, rag_query)``,
    ``queries(log_id, translated)``. The mode fan-out is an explode of a
    13-element literal array (no join)."""
    m = logs.select("log_id", F.explode(mode_structs()).alias("m")).select("log_id", "m.*")
    m = m.withColumn("rag_tag", rag_tag(F.col("mode"))).withColumn("writes_events", writes_events(F.col("mode")))
    j = m.join(events_text, ["log_id", "extraction"], "left").join(queries, "log_id", "left")
    q = (F.when(F.col("retrieval") == "concat", F.col("rag_query"))
         .when(F.col("retrieval") == "translated", F.col("translated")))
    return j.select("log_id", "mode", "extraction", "retrieval", "prompt", "rag_tag", "writes_events",
                    "events_text", q.alias("rag_query"))


def _fill(template: str, events: Column, context: Column) -> tuple[Column, Column]:
    head, tail = template.split("{log}")
    parts = []
    rest = tail
    while rest:
        i_e, i_c = rest.find("{events}"), rest.find("{context}")
        cand = [(i, n) for i, n in ((i_e, "events"), (i_c, "context")) if i >= 0]
        if not cand:
            parts.append(F.lit(rest))
            break
        i, n = min(cand)
        parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(events if n == "events" else context, F.lit("")))
        rest = rest[i + len(n) + 2:]
    return F.lit(head), F.concat(*parts)


def build_prompts(modes: DataFrame, contexts: DataFrame, on: Sequence[str] = ("log_id", "mode")) -> DataFrame:
    """prompt per (log, mode) as ``head || <log text> || tail``. The log
    text itself stays in the segmented log table (it can be huge); head and
    tail carry the formats, events and retrieved context. ``on`` are the
    columns that give a mode's row its context (many may share one)."""
    j = modes.join(contexts, [*on], "left")
    use_ctx = F.col("retrieval") != "none"
    ev, ctx = F.col("events_text"), F.col("context")
    out = []
    for kind, with_ctx, tpl in (("baseline", True, PROMPT_BASELINE_CONTEXT), ("baseline", False, PROMPT_BASELINE),
                                ("rca", True, PROMPT_RCA_CONTEXT), ("rca", False, PROMPT_RCA)):
        h, t = _fill(tpl, ev, ctx)
        out.append(((F.col("prompt") == kind) & (use_ctx if with_ctx else ~use_ctx), h, t))
    head = F.when(out[0][0], out[0][1])
    tail = F.when(out[0][0], out[0][2])
    for cond, h, t in out[1:]:
        head = head.when(cond, h)
        tail = tail.when(cond, t)
    return j.select("log_id", "mode", head.alias("prompt_head"), tail.alias("prompt_tail"))


def write_artifacts(df: DataFrame, path: str) -> None:
    """SNK4: per (log, mode) artifacts.

    Folders per mode (13, bounded) and, inside, files range-partitioned and
    sorted by log_id: a reader of one log prunes folders by mode and row
    groups by log_id statistics, without one folder per device (which would
    mean millions of tiny files for millions of logs)."""
    (df.repartitionByRange("mode", "log_id").sortWithinPartitions("mode", "log_id")
     .write.mode("overwrite").partitionBy("mode").parquet(path))
