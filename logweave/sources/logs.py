"""SRC1/SRC2/SRC6: log-line scans.

A log is an ordered sequence of lines. Row order in Spark is not a contract,
so every line carries ``log_id`` and a dense 0-based ``line_no`` computed
from explicit order columns (never from partition order).

Blank-line policies (the reference has three):
  * ``"empty"``  - drop only exactly-empty lines (miners)
  * ``"strip"``  - drop lines that are empty after strip (pipelines)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.text import WS, clean_line, is_blank
from logweave.operators.ordering import dense_number, exclusive_prefix
from logweave.session import broadcast_below, cut_lineage

DOC_BUCKET = 4096  # documents per numbering bucket (bounds each window partition)


def _keep(policy: str):
    if policy == "empty":
        return lambda x: x != F.lit("")
    if policy == "strip":
        return lambda x: ~is_blank(x)
    if policy == "none":
        return lambda x: F.lit(True)
    raise ValueError(f"unknown blank-line policy {policy!r}")


def split_lines(text_col, policy: str = "empty"):
    """Array of the kept lines of a text (split on '\\n', like Python)."""
    return F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), _keep(policy))


def count_lines(text_col, policy: str = "empty"):
    """Number of kept lines without building the line array (regex count)."""
    t = F.coalesce(text_col, F.lit(""))
    if policy == "empty":
        return F.regexp_count(t, F.lit("[^\n]+"))
    if policy == "strip":
        return F.regexp_count(t, F.lit(f"[^\n]*[^\n{WS[1:-1]}][^\n]*"))
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1


#: Ordinal key of a line = segment * POS_STEP + place in the segment. A row's lines are an array, which Spark ends below 2^31 elements,
#: and a decimal of 38 digits holds every product with a 64-bit segment, so keys of two segments never meet.
POS_STEP = 1 << 31
ORDINAL = "decimal(38,0)"
#: Lines in a segment of a log file's text.
SEGMENT_LINES = 4096


def ordinal(seg: Column) -> Column:
    """The ordinal key of a segment's first line."""
    return (seg.cast("decimal(20,0)") * F.lit(POS_STEP).cast("decimal(11,0)")).cast(ORDINAL)


def segment_offsets(texts: DataFrame, log_col: str, order_col: str, text_col: str,
                    policy: str = "empty") -> DataFrame:
    """Per segment: number of kept lines and the dense number of its first
    line within the log, ``(log_id, seg, n_lines, offset)``. Narrow table
    (one row per segment), computed with the bucketed prefix sum."""
    sizes = texts.select(F.coalesce(F.col(log_col).cast("string"), F.lit("unknown")).alias("log_id"),
                         F.col(order_col).cast("long").alias("seg"),
                         count_lines(F.col(text_col), policy).alias("n_lines"))
    return exclusive_prefix(sizes, ["log_id"], ["seg"], bucket=F.floor(F.col("seg") / DOC_BUCKET),
                            weight=F.col("n_lines"), out="offset")


def lines_from_texts(texts: DataFrame, log_col: str, order_col: str, text_col: str,
                     policy: str = "empty", dense: bool = True) -> DataFrame:
    """Explode many texts into lines, ``(log_id, seg, line_no, raw)``.

    Segments of a log (e.g. documents) are ordered by the integer
    ``order_col``. With ``dense=True`` line numbers are 0-based and continue
    across segments (this joins the narrow per-segment offsets onto the
    lines). With ``dense=False`` ``line_no`` is the ordinal key
    ``seg * 2^31 + position`` (a decimal, which aggregates as a number does):
    same order, no join, no shuffle of text; operators that need a dense
    number for a few rows (e.g. a template's first line) convert it later with
    ``densify``.
    """
    segs = texts.select(F.coalesce(F.col(log_col).cast("string"), F.lit("unknown")).alias("log_id"),
                        F.col(order_col).cast("long").alias("seg"),
                        split_lines(F.col(text_col), policy).alias("_lines"))
    if not dense:
        # *_outer generators: Spark infers no "size(array) > 0" filter for them,
        # which it would push into the scan and so split every text twice
        return (segs.select("log_id", "seg", ordinal(F.col("seg")).alias("_base"), F.posexplode_outer("_lines").alias("_pos", "raw"))
                .where(F.col("raw").isNotNull())
                .select("log_id", "seg", (F.col("_base") + F.col("_pos")).cast(ORDINAL).alias("line_no"), "raw"))
    offsets = segment_offsets(texts, log_col, order_col, text_col, policy).select("log_id", "seg", "offset")
    return (segs.join(offsets, ["log_id", "seg"])
            .select("log_id", "seg", F.posexplode_outer("_lines").alias("_pos", "raw"), "offset")
            .where(F.col("raw").isNotNull())
            .select("log_id", "seg", (F.col("offset") + F.col("_pos")).alias("line_no"), "raw"))


def densify(df: DataFrame, col: str, offsets: DataFrame) -> DataFrame:
    """Turn ordinal keys in ``col`` (see ``lines_from_texts``) into dense
    line numbers by an equi-join with the per-segment offsets; ``df`` is a
    small per-template table, never the lines."""
    pos = F.pmod(F.col(col), F.lit(POS_STEP).cast(ORDINAL))
    seg = ((F.col(col) - F.col("_pos")) / F.lit(POS_STEP).cast("decimal(11,0)")).cast("long")
    t = df.withColumn("_pos", pos.cast("long")).withColumn("_seg", seg)
    o = offsets.select("log_id", F.col("seg").alias("_seg"), F.col("offset").alias("_off"))
    return (t.join(o, ["log_id", "_seg"], "left")
            .withColumn(col, F.col("_off") + F.col("_pos")).drop("_seg", "_pos", "_off"))


def scan_text_logs(spark: SparkSession, path: str, policy: str = "empty", log: str = "file") -> DataFrame:
    """SRC1 for real log files, ``(log_id, line_no, raw)``; a file of any size
    is read by as many tasks as it has splits.

    Kept lines are counted per (file, split); a prefix sum over a log's splits
    gives each split's first number, which is added to a line's place in its
    split. A log is a file (``log="file"``, its id the name without
    extension), or a folder of rotated files (``log="folder"``: the id is the
    folder's name, files come in order of the first number in their names,
    then by name; folders ``log_id=...`` name it as Spark writes them).

    Both passes read the same splits in the same order; a line whose place lies
    outside its split (a file that changed in between) stops the query.
    """
    reader = spark.read.option("lineSep", "\n")
    if log == "folder":
        reader = reader.schema("value string, log_id string")
    elif log != "file":
        raise ValueError(f"a log is a file or a folder, not {log!r}")
    raw = reader.text(path)
    file = F.col("_metadata.file_path")
    name = F.regexp_extract(file, r"([^/]+)$", 1)
    rows = raw.select(file.alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.coalesce("value", F.lit("")).alias("raw"),
                      (F.coalesce("log_id", F.lit("unknown")) if log == "folder" else F.regexp_extract(name, r"(.+?)(\.[^.]*)?$", 1)).alias("log_id"))
    rows = rows.where(_keep(policy)(F.col("raw"))).withColumn("_n", F.monotonically_increasing_id())
    splits = cut_lineage(rows.groupBy("log_id", "_file", "_start").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_lines")))
    # a log's splits in order: a row for each split of the input
    number = F.regexp_extract(F.regexp_extract("_file", r"([^/]+)$", 1), r"([0-9]+)", 1).try_cast("decimal(38,0)")
    before = Window.partitionBy("log_id").orderBy(number.asc_nulls_last(), "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut_lineage(splits.select(F.xxhash64("_file").alias("_a"), F.hash("_file").alias("_b"), "_start", "_first", "_lines",
                                       F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_offset")))
    lines = rows.withColumns({"_a": F.xxhash64("_file"), "_b": F.hash("_file")}).join(broadcast_below(splits, 64), ["_a", "_b", "_start"])
    place = F.col("_n") - F.col("_first")
    inside = (place >= 0) & (place < F.col("_lines"))
    number = F.when(inside, F.col("_offset") + place).otherwise(F.raise_error(F.lit("a log file changed while it was read")).cast("bigint"))
    return lines.select("log_id", number.alias("line_no"), "raw")


def write_text_logs(texts: DataFrame, path: str, log_col: str, order_col: str, text_col: str) -> None:
    """Write texts as log files, a folder ``log_id=...`` for each log, whose
    files' numbers follow the order: what ``scan_text_logs`` reads with
    ``log="folder"``. A log of any size spans as many files as its texts need."""
    t = texts.select(F.coalesce(F.col(log_col).cast("string"), F.lit("unknown")).alias("log_id"), F.col(order_col).alias("_order"),
                     F.coalesce(text_col, F.lit("")).alias("value"))
    t = t.repartitionByRange("log_id", "_order").sortWithinPartitions("log_id", "_order")
    t.select("log_id", "value").write.option("maxRecordsPerFile", 0).partitionBy("log_id").text(path)


def with_clean(lines: DataFrame) -> DataFrame:
    """F8 applied to ``raw``."""
    # non-null input keeps the derived keys non-nullable, so the optimizer
    # infers no IS NOT NULL filters that would copy the whole cleaning chain
    return lines.withColumn("clean", clean_line(F.coalesce(F.col("raw"), F.lit(""))))


def log_segments(lines: DataFrame, text_col: str = "clean") -> DataFrame:
    """SRC2, bounded form: the cleaned log as ordered text segments.

    The reference loads a whole log as one string; at scale one log can hold
    a third of all data, so the log text is kept as one segment per input
    segment (``seg``, e.g. a document), each the ``'\\n'``-join of its lines in
    ``line_no`` order. Concatenating segments by ``first_line`` gives the
    reference's string.
    """
    return (lines.groupBy("log_id", "seg")
            .agg(F.min("line_no").alias("first_line"),
                 F.count(F.lit(1)).alias("n_lines"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text_col))),
                                          lambda s: s[text_col]), "\n").alias("text")))


def line_segments(lines: DataFrame, size: int = SEGMENT_LINES, text_col: str = "clean") -> DataFrame:
    """SRC2 for logs without segments of their own: ``size`` consecutive lines
    make a segment, so no row holds a whole log."""
    return log_segments(lines.withColumn("seg", F.expr(f"line_no div {size}")), text_col)


def with_fallback(main: DataFrame, secondary: DataFrame, key: str = "log_id") -> DataFrame:
    """SRC6: the rows of the secondary log where one exists for the key, else
    those of the main log. (Rows are segments or lines; only the distinct keys
    of the secondary log take part in the join.)"""
    found = secondary.select(key).distinct()
    return secondary.select(main.columns).unionByName(main.join(found, key, "left_anti").select(main.columns))


# --------------------------------------------------------------------------
# Driver-table bindings
# --------------------------------------------------------------------------

def document_lines(documents: DataFrame, policy: str = "empty", dense: bool = True) -> DataFrame:
    """log_id = source, segments = documents in doc_id order."""
    return lines_from_texts(documents, "source", "doc_id", "text", policy, dense)


def document_offsets(documents: DataFrame, policy: str = "empty") -> DataFrame:
    return segment_offsets(documents, "source", "doc_id", "text", policy)


def _k(props):
    return F.coalesce(F.get_json_object(props, "$.k").cast("long"), F.lit(0))


def _s(c):
    return c.cast("string")


def render_event_log(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Render ``events`` as MAC-style text log lines, one log per user.

    Deterministic: every field is taken from the row (``props.k`` drives the
    radio values). Output ``(log_id, ts, event_id, raw)``.
    """
    kept = [] if bucket is None else ["_bucket"]
    events = events.select("user_id", "ts", "event_id", "event_type", _k(F.col("props")).alias("_k"), *([] if bucket is None else [bucket.alias("_bucket")]))
    k = F.col("_k")
    u = _s(F.col("user_id"))
    esc = F.lit("\x1b")
    body = (
        F.when(F.col("event_type") == "view",
               F.concat(F.lit("[NR_PHY]  UE "), u, F.lit(" CQI  "), _s(k % 16), F.lit(" MCS ("),
                        _s(k % 3), F.lit(") "), _s(k % 29), F.lit(" RSRP -"), _s(80 + k % 40)))
        .when(F.col("event_type") == "click",
              F.concat(F.lit("[MAC]  UE "), u, F.lit(" DL packet SENT size="), _s(1000 + k), F.lit(" bytes")))
        .when(F.col("event_type") == "purchase",
              F.concat(F.lit("[NR_MAC]   UE "), u, F.lit(" HARQ ACK pid "), _s(k % 16)))
        .when(F.col("event_type") == "error",
              F.concat(esc, F.lit("[93m[NR_MAC]   UE "), u, F.lit(" HARQ NACK pid "), _s(k % 16),
                       F.lit(" retx "), _s(k % 4), F.lit(" packet dropped")))
        .when(F.col("event_type") == "signup",
              F.concat(F.lit("[RRC]   UE "), u, F.lit(" RRC connection release requested, timer "), _s(k)))
        .otherwise(F.concat(F.lit("UE "), u, F.lit(" "), F.coalesce(F.col("event_type"), F.lit("event"))))
    )
    return events.select(F.concat(F.lit("ue-"), u).alias("log_id"), "ts", "event_id", *kept,
                         F.coalesce(F.concat(esc, F.lit("[0m"), body), F.lit("")).alias("raw"))


def event_log_lines(events: DataFrame, bucket: Column) -> DataFrame:
    """Rendered event log, numbered per user in (ts, event_id) order.
    Output ``(log_id, seg, line_no, raw)`` with seg = event_id. ``bucket``: a
    column of ``events`` as ``ordering.range_buckets`` adds."""
    r = render_event_log(events, bucket)
    n = dense_number(r, ["log_id"], ["ts", "event_id"], bucket=F.col("_bucket"))
    return n.select("log_id", F.col("event_id").alias("seg"), "line_no", "raw")
