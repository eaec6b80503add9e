"""Clustering within each log."""

import math
import random

from pyspark.sql import functions as F

from logweave.operators import clusters


def lines_of(spark, logs):
    return spark.createDataFrame([(log, i, x) for log, lines in logs.items() for i, x in enumerate(lines)], "log_id string, line_no long, clean string")


def kinds(seed, n=60):
    """Three kinds of lines that share one word only, with a changing part."""
    rng = random.Random(seed)
    words = [["up", "link", "beam"], ["disk", "sector", "head"], ["queue", "drop", "late"]]
    return [f"the {' '.join(words[i % 3])} {rng.randrange(4)}" for i in range(n)]


def found(spark, logs, **options):
    return {(r.log_id, r.line_no): r.cluster for r in clusters.cluster_lines(lines_of(spark, logs), **options).collect()}


def test_kinds_are_told_apart_and_other_logs_change_nothing(spark):
    one = {"a": kinds(1)}
    got = found(spark, one, k=3)
    assert len(got) == 60 and sorted(set(got.values())) == [0, 1, 2]
    assert all(got["a", i] == got["a", i % 3] for i in range(60)) and [got["a", i] for i in range(3)] == [0, 1, 2]
    rng = random.Random(9)
    more = one | {"b": [" ".join(rng.choice("uvwxyz") for _ in range(5)) for _ in range(80)], "c": ["same line"] * 30, "d": ["one", "two"], "e": ["", ""],
                  "f": kinds(2)[:31]}
    both = found(spark, more, k=3)
    assert {k: v for k, v in both.items() if k[0] == "a"} == got
    assert all(both["f", i] == both["f", i % 3] for i in range(31))
    count = {log: len({v for (x, _), v in both.items() if x == log}) for log in more}
    assert count == {"a": 3, "b": 3, "c": 1, "d": 2, "e": 1, "f": 3}


def test_many_clusters(spark):
    rng = random.Random(4)
    logs = {"a": [" ".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(120)], "b": [f"w{i}" for i in range(9)]}
    got = found(spark, logs, k=7)
    count = {log: len({v for (x, _), v in got.items() if x == log}) for log in logs}
    assert count == {"a": 7, "b": 7}
    # equal lines share a cluster, clusters are numbered by first line
    by_line = {}
    for (log, i), c in got.items():
        assert by_line.setdefault((log, logs[log][i]), c) == c
    firsts = [min(i for (x, i), v in got.items() if x == "a" and v == c) for c in range(7)]
    assert firsts == sorted(firsts)


def test_vectors_equal_the_formula(spark):
    logs = {"a": ["x y", "x z z", "x", "x y"], "b": ["x y"], "c": [""]}
    got = {(r.log_id, r.clean): ({v.token: v.weight for v in r.vector}, r.cnt, r.first_line) for r in clusters.line_vectors(lines_of(spark, logs)).collect()}
    y, z = math.log(4 / 2), 2 * math.log(4 / 2)
    assert got[("a", "x y")][0] == {"y": 1.0} and got[("a", "x z z")][0] == {"z": 1.0} and y < z
    assert got[("a", "x")] == ({}, 1, 2) and got[("b", "x y")] == ({}, 1, 0) and got[("c", "")] == ({}, 1, 0) and got[("a", "x y")][1:] == (2, 0)
    hashed = clusters.hashed_vectors(clusters.line_vectors(lines_of(spark, logs)), 16).select(F.col("features"))
    assert all(len(r.features) == 16 for r in hashed.collect())


def test_logs_of_one_task_equal_logs_split_in_rounds(spark):
    rng = random.Random(8)
    logs = {f"l{n}": [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 90))] for n in range(12)}
    logs |= {"k": kinds(3), "same": ["x y"] * 9, "blank": ["", ""], "two": ["one", "two"]}
    whole = found(spark, logs, k=4)
    assert len(whole) == sum(map(len, logs.values()))
    assert whole == found(spark, logs, k=4, log_bytes=4000)


def test_lines_of_small_logs_are_shuffled_once(spark, monkeypatch):
    rounds = []
    split = clusters._split
    monkeypatch.setattr(clusters, "_split", lambda *a: rounds.append(1) or split(*a))
    logs = {"a": kinds(1), "b": kinds(2)}
    found(spark, logs, k=3)
    assert not rounds
    found(spark, logs, k=2, log_bytes=0)
    assert rounds


def test_projection_from_a_lines_own_slots(spark):
    """The projection's vectors hold a line's own slots and are written; it is the PCA of the whole vectors."""
    import numpy as np

    rng = random.Random(6)
    logs = {log: [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 9))) for _ in range(40)] for log in "uv"}
    vectors = clusters.line_vectors(lines_of(spark, logs)).cache()
    n = 8  # fewer slots than words, so that some share one
    hashed = clusters.hashed_vectors(vectors, n)
    assert not [word for word in ("lambda", "Join", "Aggregate") if word in hashed._jdf.queryExecution().optimizedPlan().toString()]
    slots = vectors.select("log_id", "clean", F.transform("vector", lambda x: F.struct(F.pmod(F.xxhash64(x["token"]), F.lit(n)), x["weight"])).alias("s"))
    want = {}
    for log, text, parts in slots.collect():
        dense = [0.0] * n
        for i, w in parts:
            dense[i] += w
        want[log, text] = dense
    got = {(r.log_id, r.clean): r.features for r in hashed.collect()}
    assert {k: list(v.toArray()) for k, v in got.items()} == want
    assert all(len(v.indices) < n or all(want[k]) for k, v in got.items()) and any(not len(v.indices) for v in got.values())

    assign = lines_of(spark, logs).withColumn("cluster", F.lit(1))
    full = {k: [0.0] * 256 for k in want}
    for log, text, parts in vectors.select("log_id", "clean", F.transform("vector", lambda x: F.struct(F.pmod(F.xxhash64(x["token"]), F.lit(256)), x["weight"]))).collect():
        for i, w in parts:
            full[log, text][i] += w
    rows = np.array([*full.values()])
    _, axes = np.linalg.eigh(np.cov(rows.T))
    want_xy = {k: np.abs(np.array(v) @ axes[:, [-1, -2]]) for k, v in full.items()}
    texts = {(log, i): x for log, lines in logs.items() for i, x in enumerate(lines)}
    got_rows = clusters.project_2d(vectors, assign).collect()
    assert len(got_rows) == len(texts)
    for r in got_rows:
        assert any(np.allclose(np.abs([r.x, r.y]), want_xy[log, r.text], atol=1e-8) for log in logs if (log, r.text) in want_xy)
    vectors.unpersist()
