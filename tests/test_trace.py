"""Trace lines as records with named fields."""

import pytest
from pyspark.sql import functions as F

from logweave.operators import trace

# invented values in every layout that trace lines have
LINES = {
    "[PHY  ][0.100000] DL DATA SINR  | RNTI 7 | SINR 11.25 dB": ("PHY", 0.1, "DL DATA SINR", {"RNTI": "7", "SINR": "11.25"}),
    "[PHY  ][0.100000] DL CTRL SINR  | RNTI 7 | SINR -inf dB": ("PHY", 0.1, "DL CTRL SINR", {"RNTI": "7", "SINR": "-inf"}),
    "[PHY  ][0.2] DL PATHLOSS   | 88.40 dB": ("PHY", 0.2, "DL PATHLOSS", {"dB": "88.40"}),
    "[PHY  ][0.2] DL DATA SNR   | CELL-ID 3 | SNR 8.00 dB": ("PHY", 0.2, "DL DATA SNR", {"CELL-ID": "3", "SNR": "8.00"}),
    "[PHY  ][1.5] SLOT DATA     | Frame 12 Sub 4 Slot 1 | Cell 2 BWP 0 | ActiveUE 3 | UsedRE 90 UsedSym 6 | AvailRB 51 AvailSym 14": (
        "PHY", 1.5, "SLOT DATA", {"Frame": "12", "Sub": "4", "Slot": "1", "Cell": "2", "BWP": "0", "ActiveUE": "3", "UsedRE": "90", "UsedSym": "6",
                                  "AvailRB": "51", "AvailSym": "14"}),
    "[PHY  ][1.5] UE MEAS       | RNTI 9 | RSRP -91.30 dBm | RSRQ -10.2 dB | Serv Y CC 1": (
        "PHY", 1.5, "UE MEAS", {"RNTI": "9", "RSRP": "-91.30", "RSRQ": "-10.2", "Serv": "Y", "CC": "1"}),
    "[PHY  ][1.5] CQI FEEDBACK  | RNTI 9 | WB-CQI 12 | MCS 20 | RI 2": ("PHY", 1.5, "CQI FEEDBACK", {"RNTI": "9", "WB-CQI": "12", "MCS": "20", "RI": "2"}),
    "[PHY  ][1.5] UL TB SIZE    | RNTI 9 | TBS 333 B": ("PHY", 1.5, "UL TB SIZE", {"RNTI": "9", "TBS": "333"}),
    "[MAC  ][1.5] DL SCHED      | Frame 1 Slot 2 | RNTI 9 | MCS 3 | TBS 44 B | HARQ 5": (
        "MAC", 1.5, "DL SCHED", {"Frame": "1", "Slot": "2", "RNTI": "9", "MCS": "3", "TBS": "44", "HARQ": "5"}),
    "[MAC  ][1.5] DL HARQ       | RNTI 9 | PID 3 | NACK | Retx 2": ("MAC", 1.5, "DL HARQ", {"RNTI": "9", "PID": "3", "outcome": "NACK", "Retx": "2"}),
    "[MAC  ][1.5] SR REQ        | RNTI 9 | BWP_ID 1": ("MAC", 1.5, "SR REQ", {"RNTI": "9", "BWP_ID": "1"}),
    "[RLC  ][1.5] TX PDU        | RNTI 9 | LCID 4 | 1200 B": ("RLC", 1.5, "TX PDU", {"RNTI": "9", "LCID": "4", "B": "1200"}),
    "[RLC  ][1.5] TX DROP       | 77 B": ("RLC", 1.5, "TX DROP", {"B": "77"}),
    "[RRC  ][1.5] STATE         | IMSI 1 Cell 2 RNTI 3": ("RRC", 1.5, "STATE", {"IMSI": "1", "Cell": "2", "RNTI": "3"}),
    "[RRC  ][1.5] HO START      | IMSI 1 RNTI 3 | Src 2 --> Tgt 4": ("RRC", 1.5, "HO START", {"IMSI": "1", "RNTI": "3", "Src": "2", "Tgt": "4"}),
    "[RRC  ][1.5] HO END OK     | IMSI 1 | New Cell 4 | RNTI 3": ("RRC", 1.5, "HO END OK", {"IMSI": "1", "New Cell": "4", "RNTI": "3"}),
    "[RRC  ][1.5] RLF           | IMSI 1 | Cell 2 | Cell 3": ("RRC", 1.5, "RLF", {"IMSI": "1", "Cell": "3"}),
    "0.35s [MAC] NR HARQ NACK #3 for RNTI=8 ProcessID=2": ("MAC", 0.35, "NR HARQ NACK", {"count": "3", "RNTI": "8", "ProcessID": "2"}),
    "0.4s [MAC] NR HARQ NACK #4 for RNTI=8 ProcessID=2 *** STOP \u2192 no more": (
        "MAC", 0.4, "NR HARQ NACK", {"count": "4", "RNTI": "8", "ProcessID": "2", "note": "no more"}),
    "1s [RRC] NR UE CONNECTED: IMSI=1 RNTI=2 CellID=3": ("RRC", 1.0, "NR UE CONNECTED", {"IMSI": "1", "RNTI": "2", "CellID": "3"}),
    "2.5e-05s [RRC] NR UE CONTEXT RELEASED: IMSI=1 RNTI=2 \u2192 The end": ("RRC", 2.5e-05, "NR UE CONTEXT RELEASED", {"IMSI": "1", "RNTI": "2", "note": "The end"}),
    "1.25s [APP] DL packet SENT size=1024": ("APP", 1.25, "DL packet SENT", {"size": "1024"}),
    "no trace line at all": (None, None, None, {}),
    "": (None, None, None, {}),
}


def test_every_layout(spark):
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate([*LINES, None])], "id int, line string, t2 int")
    got = {r.id: (r.layer, r.t, r.event, r.fields) for r in trace.record_fields(df).collect()}
    for i, (line, want) in enumerate(LINES.items()):
        assert got[i] == want, line
    assert got[len(LINES)][:3] == (None, None, None)


@pytest.mark.parametrize("name", ["RNTI", "Retx"])
def test_fields_agree_with_the_typed_columns(spark, name):
    df = spark.createDataFrame([(x,) for x in LINES if x.startswith("[")], "line string")
    typed = {"RNTI": "rnti", "Retx": "retx"}[name]
    both = trace.parse_trace(df).join(trace.record_fields(df).select("line", "fields"), "line")
    assert both.where(~F.col(typed).cast("string").eqNullSafe(F.col("fields")[name])).count() == 0


def test_rollup_levels(spark):
    rows = [("MAC", "A", "1", 1.0, 3), ("MAC", "A", None, 2.0, 5), ("PHY", "B", "1", 3.0, None)]
    df = spark.createDataFrame(rows, "layer string, event string, rnti string, t double, mcs int")
    got = {(r.level, r.layer, r.event, r.rnti): (r.n, r.avg_mcs) for r in trace.trace_rollup(df).collect()}
    assert got[3, None, None, None] == (3, 4.0) and got[1, "MAC", "A", None] == (2, 4.0) and got[0, "MAC", "A", None] == (1, 5.0) and len(got) == 8


def test_fields_are_taken_from_a_line_once(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, 7, kind, '{"k": 5}') for i, kind in enumerate(["error", "purchase", "view", "click", "signup"])]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    events.selectExpr("event_id", "timestamp_ntz'2024-01-01' AS ts", "user_id", "event_type", "1D AS value", "props").write.parquet(str(tmp_path / "events.parquet"))
    fields = entry.queries()["trace_fields"](spark, str(tmp_path))
    got = {(r.event_id, r.key, r.value) for r in fields.collect()}
    assert {(0, "outcome", "NACK"), (1, "outcome", "ACK"), (2, "MCS", "5"), (3, "B", "1005"), (4, "IMSI", "100007")} <= got
    # the grammar has four searches for pairs; a filter pushed below would repeat them all
    assert fields._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 4
