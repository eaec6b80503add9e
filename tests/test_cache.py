"""SNK5: generations of derived values."""

import pytest

from logweave.plans import modes
from logweave.session import cut_lineage


@pytest.fixture()
def compute():
    def run(df):
        run.seen.append({r.log_id for r in df.select("log_id").collect()})
        return df.selectExpr("log_id", "upper(text) AS value")
    run.seen = []
    return run


def table(spark, rows):
    return spark.createDataFrame(rows, "log_id string, text string, more string")


def test_only_changed_logs_are_computed(spark, compute):
    rows = [(f"l{i}", f"text {i}", None) for i in range(10)]
    first = cut_lineage(modes.next_generation(table(spark, rows), compute))
    assert {(r.log_id, r.value, r.generation) for r in first.collect()} == {(k, t.upper(), 0) for k, t, _ in rows}
    changed = [(k, t + "!" if i % 2 else t, m) for i, (k, t, m) in enumerate(rows)]
    second = cut_lineage(modes.next_generation(table(spark, changed), compute, first))
    assert compute.seen[1] == {f"l{i}" for i in range(1, 10, 2)}
    assert {(r.log_id, r.value, r.generation) for r in second.collect()} == {(k, t.upper(), i % 2) for i, (k, t, _) in enumerate(changed)}
    # nothing changed; then some go, one is new, and a null moves to another column
    third = cut_lineage(modes.next_generation(table(spark, changed), compute, second))
    assert compute.seen[2] == set() and sorted(map(tuple, third.collect())) == sorted(map(tuple, second.collect()))
    last = [*changed[3:], ("new", "x", None), ("none", None, "x")]
    fourth = cut_lineage(modes.next_generation(table(spark, last), compute, third))
    assert compute.seen[3] == {"new", "none"} and fourth.count() == 9
    modes.next_generation(table(spark, [("none", "x", None)]), compute, fourth).collect()
    assert compute.seen[4] == {"none"}


def test_empty(spark, compute):
    none = table(spark, [])
    first = cut_lineage(modes.next_generation(none, compute))
    assert first.count() == 0
    assert modes.next_generation(table(spark, [("a", "b", "c")]), compute, first).count() == 1
