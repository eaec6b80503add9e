"""Trace records: render typed radio events as text trace lines and parse
trace lines back into typed columns (F22, F23, F24).

Line format (record family 1): ``[LAYER][t.tttttt] EVENT | k v | k v ...``
with the layer left-justified to 5 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = r"^\[([A-Z]+) *\]\[([0-9]+\.[0-9]+)\] ?(.*)$"


def _field(body: Column, pattern: str) -> Column:
    v = F.regexp_extract(body, pattern, 1)
    return F.when(v == F.lit(""), F.lit(None)).otherwise(v)


def epoch_seconds_text(ts: Column) -> Column:
    """Exact ``seconds.micros`` text of a timestamp without a time zone."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.concat((F.floor(us / 1000000)).cast("string"), F.lit("."),
                    F.lpad((us % 1000000).cast("string"), 6, "0"))


def parse_trace(lines: DataFrame, col: str = "line") -> DataFrame:
    """layer, time, event name and the typed fields of a trace line."""
    line = F.col(col)
    body = F.regexp_extract(line, HEAD, 3)
    rest = F.concat(F.lit("|"), F.substring_index(body, "|", -1000000))
    return lines.select(
        "*",
        F.regexp_extract(line, HEAD, 1).alias("layer"),
        F.regexp_extract(line, HEAD, 2).try_cast("double").alias("t"),
        F.trim(F.regexp_extract(body, r"^([^|]*)", 1)).alias("event"),
        _field(rest, r"\bRNTI (\d+)").alias("rnti"),
        F.coalesce(_field(rest, r"\|\s*PID (\d+)"), _field(rest, r"\|\s*HARQ (\d+)")).try_cast("int").alias("harq_pid"),
        _field(rest, r"\|\s*Frame (\d+)").try_cast("int").alias("frame"),
        _field(rest, r"\bSub (\d+)").try_cast("int").alias("subframe"),
        _field(rest, r"\bSlot (\d+)").try_cast("int").alias("slot"),
        _field(rest, r"\|\s*TBS (\d+)").try_cast("int").alias("tbs"),
        _field(rest, r"\|\s*SINR (-?[0-9]+(?:\.[0-9]+)?)").try_cast("double").alias("sinr_db"),
        _field(rest, r"\|\s*RSRP (-?[0-9]+(?:\.[0-9]+)?)").try_cast("double").alias("rsrp_dbm"),
        _field(rest, r"\|\s*RSRQ (-?[0-9]+(?:\.[0-9]+)?)").try_cast("double").alias("rsrq_db"),
        _field(rest, r"\|\s*(ACK|NACK)\s*(?:\||$)").alias("harq_fb"),
        _field(rest, r"\|\s*Retx (\d+)").try_cast("int").alias("retx"),
        _field(rest, r"\|\s*WB-CQI (\d+)").try_cast("int").alias("cqi"),
        _field(rest, r"\|\s*MCS (\d+)").try_cast("int").alias("mcs"),
        _field(rest, r"\|\s*RI (\d+)").try_cast("int").alias("ri"),
        _field(rest, r"\|\s*LCID (\d+)").try_cast("int").alias("lcid"),
        _field(rest, r"\|\s*(\d+) B\s*(?:\||$)").try_cast("int").alias("size_bytes"),
        _field(rest, r"\|\s*IMSI (\d+)").try_cast("long").alias("imsi"),
        _field(rest, r"\bCell (\d+)").try_cast("int").alias("cell"),
    )


#: ``key value`` in a part of a trace line: words, then a number, a yes or no, or what a logarithm of zero prints.
PAIR = r"([A-Za-z][\w-]*(?: [A-Za-z][\w-]*)*?) (-?[0-9][^ ]*|[YN]|-?inf|-?nan)(?: |$)"
#: A part that is an amount alone, and one that is an outcome.
AMOUNT = r"^(-?[0-9][^ ]*|-?inf|-?nan) (dBm|dB|B)$"
OUTCOME = r"^(ACK|NACK)$"
#: The free-form family: ``<t>s [LAYER] event: KEY=value ...``.
FREE = r"^([0-9][0-9.e+-]*)s \[([A-Z]+)\] (.*)$"
ASSIGNED = r"([A-Za-z][\w-]*)=([^ ]+)"


def _pairs(text: Column, pattern: str) -> Column:
    p = F.lit(pattern)
    return F.zip_with(F.regexp_extract_all(text, p, 1), F.regexp_extract_all(text, p, 2), lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def _entry(key: Column, value: Column) -> Column:
    return F.array(F.struct(key.alias("key"), value.alias("value")))


def record_fields(lines: DataFrame, col: str = "line") -> DataFrame:
    """F23 as a grammar: ``layer``, ``t``, ``event`` and ``fields``, a map of
    every field that a trace line states, by its own name; typed columns come
    from it by a cast.

    A line of the first family is a fold over its parts between bars: ``key
    value`` pairs (units after a value are dropped, a key may have words), an
    outcome (key ``outcome``), or an amount alone (its unit is the key). A line
    of the free-form family has its ``KEY=value`` pairs, the number after ``#``
    (``count``) and what an arrow points at (``note``). Of a key that comes
    twice the last value counts. Other lines have a null layer and no field."""
    line = F.col(col)
    parts = F.split(F.regexp_extract(line, HEAD, 3), r"\|")

    def entries(part: Column) -> Column:
        text = F.trim(part)
        return (F.when(text.rlike(OUTCOME), _entry(F.lit("outcome"), text))
                .when(text.rlike(AMOUNT), _entry(F.regexp_extract(text, AMOUNT, 2), F.regexp_extract(text, AMOUNT, 1)))
                .otherwise(_pairs(text, PAIR)))
    none = F.array().cast("array<struct<key:string,value:string>>")
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), none, lambda done, part: F.concat(done, entries(part)))

    said = F.regexp_extract(line, FREE, 3)
    count, note = F.regexp_extract(said, r"#([0-9]+)", 1), F.trim(F.regexp_extract(said, "\u2192 *(.*)$", 1))
    free = F.concat(F.when(count != "", _entry(F.lit("count"), count)).otherwise(none), _pairs(F.split(said, "\u2192")[0], ASSIGNED),
                    F.when(note != "", _entry(F.lit("note"), note)).otherwise(none))
    is_free = line.rlike(FREE)
    all_ = F.when(is_free, free).when(line.rlike(HEAD), folded).otherwise(none)
    last = F.filter(F.col("_all"), lambda x, i: ~F.exists(F.slice("_all", i + 2, F.size("_all")), lambda y: y["key"] == x["key"]))
    event = F.when(is_free, F.regexp_extract(said, "^(.*?):?(?: (?:for )?[A-Za-z][\\w-]*=.*| #[0-9].*| \u2192.*| \\*\\*\\*.*)?$", 1)).otherwise(F.trim(parts[0]))
    known = is_free | line.rlike(HEAD)
    return lines.withColumn("_all", all_).select(
        *lines.columns, F.when(is_free, F.regexp_extract(line, FREE, 2)).when(known, F.regexp_extract(line, HEAD, 1)).alias("layer"),
        F.when(is_free, F.regexp_extract(line, FREE, 1)).when(known, F.regexp_extract(line, HEAD, 2)).try_cast("double").alias("t"),
        F.when(known, F.trim(event)).alias("event"), F.map_from_entries(last).alias("fields"))


def trace_rollup(records: DataFrame, device: str = "rnti") -> DataFrame:
    """Q7: counts and ranges by layer, event and device with all subtotals;
    ``level`` is the number of columns that a line sums over (3 for the grand
    total), which tells a subtotal from a missing device."""
    return (records.rollup("layer", "event", device)
            .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.avg("mcs").alias("avg_mcs"),
                 F.bit_count(F.grouping_id()).cast("int").alias("level")))


def trace_summary(records: DataFrame) -> DataFrame:
    """Q7: per layer / event counts and ranges, with rollup subtotals."""
    return (records.rollup("layer", "event")
            .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"),
                 F.avg("mcs").alias("avg_mcs")))


# Periodic per-UE statistics block (record family 2), one pattern per line
# kind, applied to cleaned lines (whitespace already collapsed).
UE_PATTERNS = {
    "sync": r"^UE RNTI (\w+) CU-UE-ID (\d+) (in-sync|out-of-sync) PH (-?\d+) dB PCMAX (-?\d+) dBm, "
            r"average RSRP (-?\d+) \((\d+) meas\)",
    "ulri": r"^UE (\w+): UL-RI (\d+), TPMI (\d+)",
    "dl": r"^UE (\w+): dlsch_rounds (\d+)/(\d+)/(\d+)/(\d+), dlsch_errors (\d+), pucch0_DTX (\d+), "
          r"BLER ([0-9.]+) MCS \((\d+)\) (\d+)",
    "ul": r"^UE (\w+): ulsch_rounds (\d+)/(\d+)/(\d+)/(\d+), ulsch_errors (\d+), ulsch_DTX (\d+), "
          r"BLER ([0-9.]+) MCS \((\d+)\) (\d+)",
    "mac": r"^UE (\w+): MAC: TX (\d+) RX (\d+) bytes",
    "lcid": r"^UE (\w+): LCID (\d+): TX (\d+) RX (\d+) bytes",
}


def _g(c, kind: str, i: int, typ: str | None = None):
    v = F.regexp_extract(c, UE_PATTERNS[kind], i)
    v = F.when(c.rlike(UE_PATTERNS[kind]), v)
    return v.cast(typ) if typ else v


def parse_ue_stats(lines: DataFrame, col: str = "line") -> DataFrame:
    """every line of a periodic statistics block -> one typed row.

    ``kind`` is sync / ulri / dl / ul / mac / lcid; fields that a kind does
    not carry are null. RNTI is kept as lower-case text without ``0x``.
    """
    c = F.col(col)
    kind = F.lit(None).cast("string")
    for k in reversed(list(UE_PATTERNS)):
        kind = F.when(c.rlike(UE_PATTERNS[k]), F.lit(k)).otherwise(kind)
    rnti = F.coalesce(*[_g(c, k, 1) for k in UE_PATTERNS])
    sched = {k: [_g(c, k, i) for i in range(2, 11)] for k in ("dl", "ul")}

    def pick(i, typ):
        return F.coalesce(sched["dl"][i], sched["ul"][i]).cast(typ)

    rounds = F.when(F.col("kind").isin("dl", "ul"), F.array(*[pick(i, "long") for i in range(4)]))
    return (lines.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "*", F.regexp_replace(F.lower(rnti), "^0x", "").alias("rnti"),
        _g(c, "sync", 2, "int").alias("cu_ue_id"), (_g(c, "sync", 3) == "in-sync").alias("sync"),
        _g(c, "sync", 4, "int").alias("ph_db"), _g(c, "sync", 5, "int").alias("pcmax_dbm"),
        _g(c, "sync", 6, "int").alias("rsrp_dbm"), _g(c, "sync", 7, "int").alias("rsrp_meas"),
        _g(c, "ulri", 2, "int").alias("ul_ri"), _g(c, "ulri", 3, "int").alias("tpmi"),
        rounds.alias("rounds"), pick(4, "long").alias("errors"), pick(5, "long").alias("dtx"),
        pick(6, "double").alias("bler"), pick(7, "int").alias("mcs_table"), pick(8, "int").alias("mcs"),
        _g(c, "lcid", 2, "int").alias("lcid"),
        F.coalesce(_g(c, "mac", 2, "long"), _g(c, "lcid", 3, "long")).alias("tx_bytes"),
        F.coalesce(_g(c, "mac", 3, "long"), _g(c, "lcid", 4, "long")).alias("rx_bytes")))


def ue_stat_records(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Assemble one ``ue_stats`` record per (``keys``..., rnti) from parsed
    lines: sync fields, uplink rank, ``dl``/``ul`` structs, MAC bytes and a
    map LCID -> bytes. Groups are one UE in one block (a handful of lines)."""
    def first(kind, col):
        return F.max(F.when(F.col("kind") == kind, F.col(col)))

    def sched(kind):
        return F.struct(*[first(kind, c).alias(c) for c in ("rounds", "errors", "dtx", "bler", "mcs_table", "mcs")])

    return parsed.groupBy(*keys, "rnti").agg(
        first("sync", "cu_ue_id").alias("cu_ue_id"), first("sync", "sync").alias("sync"),
        first("sync", "ph_db").alias("ph_db"), first("sync", "pcmax_dbm").alias("pcmax_dbm"),
        first("sync", "rsrp_dbm").alias("rsrp_dbm"), first("sync", "rsrp_meas").alias("rsrp_meas"),
        first("ulri", "ul_ri").alias("ul_ri"), first("ulri", "tpmi").alias("tpmi"),
        sched("dl").alias("dl"), sched("ul").alias("ul"),
        F.struct(first("mac", "tx_bytes").alias("tx"), first("mac", "rx_bytes").alias("rx")).alias("mac"),
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("kind") == "lcid", F.struct(
            "lcid", F.struct(F.col("tx_bytes").alias("tx"), F.col("rx_bytes").alias("rx"))))), lambda x: x.isNotNull()))
        .alias("lcid_bytes"))
