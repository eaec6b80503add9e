"""Line clustering and rare-cluster events.

C1/C2 work on *distinct* lines of each log (weighted by their count), so they
scale with the vocabulary of lines, not with the raw log volume: a log whose
lines fit in ``LOG_BYTES`` is clustered where its lines lie after one shuffle,
a larger one by grouped aggregates over all tasks. C7 runs MLlib's PCA on them. C3-C6/C8 are plain aggregates over a cluster assignment, whether it
comes from C2 or is supplied.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from logweave.session import cut_lineage

N_CLUSTERS = 15     # fixed values: clusters built / smallest clusters reported
N_REPORTED = 5
ROUNDS = 2          # of nearest-centre steps in a split
#: Bytes of a log's distinct lines (texts and vectors) up to which one task clusters the log.
LOG_BYTES = 32 << 20


def cluster_sizes(assign: DataFrame, cluster: str = "cluster", pos: str = "line_no",
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """Size and first position of every cluster (per ``keys``, e.g. a log)."""
    return assign.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("size"), F.min(pos).alias("first_idx"))


def cluster_majority(assign: DataFrame, cluster: str = "cluster", line: str = "line",
                     pos: str = "line_no", keys: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent line per cluster; ties go to the line seen first.
    Two-step aggregate (counts per (cluster, line), then a top-1 per
    cluster over distinct lines) - ``mode()`` has no first-seen rule."""
    best = _line_counts(assign, cluster, line, pos, keys).groupBy(*keys, cluster).agg(_majority(line).alias("_b"))
    return best.select(*keys, cluster, F.col("_b.l").alias("line"), (-F.col("_b.neg")).alias("line_cnt"))


def _line_counts(assign: DataFrame, cluster: str, line: str, pos: str, keys: tuple[str, ...]) -> DataFrame:
    return assign.groupBy(*keys, cluster, line).agg(F.count(F.lit(1)).alias("line_cnt"), F.min(pos).alias("line_first"))


def _majority(line: str) -> Column:
    return F.min(F.struct((-F.col("line_cnt")).alias("neg"), F.col("line_first").alias("f"), F.col(line).alias("l")))


def cluster_report(assign: DataFrame, cluster: str = "cluster", line: str = "line",
                   pos: str = "line_no", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every cluster, smallest first, with its majority line.
    ``rank`` orders by size, then first appearance. Sizes and majority lines
    come from one count of the lines. The window holds one row per cluster (k
    rows per key), never lines."""
    known = [F.col(c).isNotNull() for c in (*keys, cluster)]
    per = _line_counts(assign.where(reduce(Column.__and__, known)), cluster, line, pos, keys)
    w = Window.partitionBy(*keys).orderBy("size", "first_idx") if keys else Window.orderBy("size", "first_idx")
    report = per.groupBy(*keys, cluster).agg(F.sum("line_cnt").alias("size"), F.min("line_first").alias("first_idx"), _majority(line).alias("_b"))
    return (report.select(*keys, cluster, "size", "first_idx", F.col("_b.l").alias("line"), (-F.col("_b.neg")).alias("line_cnt"))
            .withColumn("rank", F.row_number().over(w)))


def rare_clusters(assign: DataFrame, n: int = N_REPORTED, cluster: str = "cluster", line: str = "line",
                  pos: str = "line_no", keys: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` smallest clusters as (majority line, size) events."""
    return cluster_report(assign, cluster, line, pos, keys).where(F.col("rank") <= n)


def line_vectors(lines: DataFrame, text_col: str = "clean") -> DataFrame:
    """C1 fallback embedding: TF-IDF of each distinct line of a log among the
    log's distinct lines, L2-normalised, ``(log_id, clean, cnt, first_line,
    vector)``; ``vector`` has a (token, weight) for every token that not all
    lines share, each token for itself. A log's vectors depend on that log.

    A distinct line has a number, written with it, which its tokens carry in
    place of its text."""
    uniq = lines.groupBy("log_id", text_col).agg(F.count(F.lit(1)).alias("cnt"), F.min("line_no").alias("first_line"))
    uniq = cut_lineage(uniq.withColumn("_line", F.monotonically_increasing_id()))
    words = uniq.select("log_id", "_line", F.explode(F.split(text_col, " ")).alias("token")).where("token <> ''")
    tf = cut_lineage(words.groupBy("log_id", "_line", "token").agg(F.count(F.lit(1)).alias("tf")))
    n = uniq.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    idf = tf.groupBy("log_id", "token").agg(F.count(F.lit(1)).alias("df")).join(n, "log_id")
    idf = cut_lineage(idf.where("df < n").select("log_id", "token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf")))
    part = F.struct("token", (F.col("tf") * F.col("idf")).alias("weight"))
    vec = tf.join(idf, ["log_id", "token"]).groupBy("_line").agg(F.sort_array(F.collect_list(part)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]))
    vec = vec.withColumn("norm", norm).select("_line", F.transform("v", lambda x: F.struct(
        x["token"].alias("token"), (x["weight"] / F.col("norm")).alias("weight"))).alias("vector"))
    none = F.array().cast("array<struct<token:string,weight:double>>")
    return uniq.join(vec, "_line", "left").drop("_line").withColumn("vector", F.coalesce("vector", none))


def hashed_vectors(vectors: DataFrame, num_features: int = 1 << 8) -> DataFrame:
    """``line_vectors`` with ``features`` in place of ``vector``: an ML vector of
    ``num_features`` slots that tokens share by hash, the input of the 2-D
    projection (C7). It holds a line's own slots only and is written, since the
    projection reads it several times."""
    slots = F.transform("vector", lambda x: F.struct(F.pmod(F.xxhash64(x["token"]), F.lit(num_features)).cast("int").alias("i"), x["weight"].alias("w")))

    def sparse(parts: Column) -> Column:
        own = F.sort_array(F.array_distinct(F.transform(parts, lambda x: x["i"])))
        sums = F.transform(own, lambda i: F.aggregate(F.filter(parts, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["w"]))
        return F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(num_features).alias("size"), own.alias("indices"), sums.alias("values"))

    # the lambda names the slots once; the struct is an ML vector's storage
    rows = vectors.withColumn("features", F.get(F.transform(F.array(slots), sparse), F.lit(0))).drop("vector")
    return cut_lineage(rows, StructType([*rows.schema.fields[:-1], StructField("features", VectorUDT())]))


def _to_split(state: DataFrame, k: int) -> DataFrame:
    """``(log_id, node)``: the leaves that are split next, for every log those
    of the widest spread, as many as it lacks clusters. (Spread: what the
    weighted vectors' sum lacks in length of their weight.)"""
    sums = state.select("log_id", "node", "cnt", F.inline("v")).groupBy("log_id", "node", "t").agg(F.sum(F.col("cnt") * F.col("w")).alias("s"))
    length = sums.groupBy("log_id", "node").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    leaves = state.groupBy("log_id", "node").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("lines"), F.max("whole").alias("whole"),
                                                 F.min("first_line").alias("first"))
    spread = F.round(F.col("n") - F.coalesce("length", F.lit(0.0)), 6)
    leaves = leaves.join(length, ["log_id", "node"], "left").withColumn("spread", spread)
    divisible = (F.col("lines") > 1) & ~F.col("whole") & (F.col("spread") > 0)
    log = Window.partitionBy("log_id")  # at most k rows a log
    ranked = leaves.withColumn("all", F.count(F.lit(1)).over(log)).where(divisible).withColumn(
        "rank", F.row_number().over(log.orderBy(F.desc("spread"), "first")))
    return ranked.where(F.col("rank") <= k - F.col("all")).select("log_id", "node")


def _split(state: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every chosen leaf in two: by the nearer of two of its lines that are far
    apart (the farthest from its centre, and the farthest from that one), then
    by the nearer of the two sides' centres. Centres are a table keyed by (log,
    leaf, token)."""
    key = ["log_id", "node"]
    rows = cut_lineage(state.join(chosen, key, "left_semi"))
    parts = rows.select(*key, "first_line", "cnt", F.inline("v"))

    def with_dots(centres: DataFrame, columns: list[str]) -> DataFrame:
        dots = (parts.drop("cnt").join(centres, [*key, "t"]).groupBy(*key, "first_line")
                .agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns]))
        met = rows.join(dots, [*key, "first_line"], "left")
        return met.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 9) for c in columns})

    def lines(chosen_lines: DataFrame, name: str) -> DataFrame:
        return parts.join(chosen_lines, [*key, "first_line"], "left_semi").select(*key, "t", F.col("w").alias(name))

    mass = F.col("cnt") * F.col("w")
    middle = cut_lineage(parts.groupBy(*key, "t").agg(F.sum(mass).alias("s")))
    one = cut_lineage(with_dots(middle, ["s"]).groupBy(*key).agg(F.min_by("first_line", F.struct("s", "first_line")).alias("first_line")))
    from_one = with_dots(lines(one, "a"), ["a"]).join(one, [*key, "first_line"], "left_anti")
    two = cut_lineage(from_one.groupBy(*key).agg(F.min_by("first_line", F.struct("a", "first_line")).alias("first_line")))
    centres = lines(one, "a").join(lines(two, "b"), [*key, "t"], "full").select(*key, "t", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    for step in range(ROUNDS):
        centres = cut_lineage(centres)
        lengths = centres.groupBy(*key).agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("la"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("lb"))
        near = {x: F.when(F.col(f"l{x}") > 0, F.round(F.col(x) / F.col(f"l{x}"), 9)).otherwise(F.lit(0.0)) for x in "ab"}
        sided = with_dots(centres, ["a", "b"]).join(lengths, key, "left").withColumn("side", (near["b"] > near["a"]).cast("int"))
        sided = cut_lineage(sided.drop("a", "b", "la", "lb"))
        if step < ROUNDS - 1:
            centres = sided.select(*key, "side", "cnt", F.inline("v")).groupBy(*key, "t").agg(
                F.sum(F.when(F.col("side") == 0, mass).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("side") == 1, mass).otherwise(0.0)).alias("b"))
    both = sided.groupBy(*key).agg((F.min("side") < F.max("side")).alias("halved"))
    rows = sided.join(both, key)
    node = F.when(F.col("halved"), F.col("node") * 2 + F.col("side")).otherwise(F.col("node"))
    rows = rows.withColumn("node", node).withColumn("whole", ~F.col("halved")).drop("side", "halved")
    return cut_lineage(state.join(chosen, key, "left_anti").unionByName(rows))


def _nodes_of_log(cnt: np.ndarray, row: np.ndarray, token: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The leaf of every line of one log by the rounds of ``_to_split`` and
    ``_split``. Entry i of the vectors: line ``row[i]`` has ``w[i]`` at
    ``token[i]``; lines come in order of their first places."""
    node, whole = np.ones(len(cnt), np.int64), set()
    n_tokens = int(token.max()) + 1 if len(token) else 0
    mass = cnt[row] * w

    def centre(own: np.ndarray) -> np.ndarray:
        return np.bincount(token[own], mass[own], n_tokens)

    def dots(c: np.ndarray) -> np.ndarray:
        return np.bincount(row, w * c[token], len(cnt)).round(9)

    def vector(line: int) -> np.ndarray:
        own = row == line
        return np.bincount(token[own], w[own], n_tokens)

    def spread_of(leaf: int) -> tuple[float, int, int]:
        own = node == leaf
        spread = float(cnt[own].sum() - np.sqrt((centre(own[row]) ** 2).sum())) if own.sum() > 1 else 0.0
        return -round(spread, 6), int(np.argmax(own)), leaf

    leaves = {1: spread_of(1)}
    for _ in range(k - 1):
        ranked = sorted(leaves[x] for x in leaves if x not in whole and leaves[x][0] < 0)
        chosen = [leaf for *_, leaf in ranked[:k - len(leaves)]]
        if not chosen:
            break
        for leaf in chosen:
            lines = np.flatnonzero(node == leaf)
            one = lines[np.argmin(dots(centre((node == leaf)[row]))[lines])]
            others = lines[lines != one]
            a = vector(one)
            b = vector(others[np.argmin(dots(a)[others])])
            for step in range(ROUNDS):
                la, lb = np.sqrt((a ** 2).sum()), np.sqrt((b ** 2).sum())
                near = [(dots(x)[lines] / length).round(9) if length > 0 else np.zeros(len(lines)) for x, length in ((a, la), (b, lb))]
                side = near[1] > near[0]
                if step < ROUNDS - 1:
                    of = np.full(len(cnt), -1)
                    of[lines] = side
                    a, b = centre(of[row] == 0), centre(of[row] == 1)
            if side.any() and not side.all():
                node[lines] = node[lines] * 2 + side
                del leaves[leaf]
                leaves |= {x: spread_of(x) for x in (leaf * 2, leaf * 2 + 1)}
            else:
                whole.add(leaf)
    return node


def _log_clusters(log: pa.Table, text_col: str, k: int) -> pa.Table:
    """``(log_id, text, cluster)`` of the lines of one log."""
    log = log.sort_by([("first_line", "ascending"), (text_col, "ascending")]).combine_chunks()
    v = log["v"].combine_chunks()
    row = np.repeat(np.arange(len(log)), v.value_lengths().to_numpy(zero_copy_only=False))
    parts = v.flatten()
    _, token = np.unique(parts.field("t").to_numpy(), return_inverse=True)
    node = _nodes_of_log(log["cnt"].to_numpy().astype(float), row, token, parts.field("w").to_numpy(), k)
    _, at, place = np.unique(node, return_index=True, return_inverse=True)
    number = np.argsort(np.argsort(at))  # clusters in order of their first lines
    return pa.table({"log_id": log["log_id"], text_col: log[text_col], "cluster": pa.array(number[place], pa.int32())})


def _clustered_by_log(state: DataFrame, text_col: str, k: int) -> DataFrame:
    own = state.select("log_id", text_col, "cnt", "first_line", "v")
    return own.groupBy("log_id").applyInArrow(lambda log: _log_clusters(log, text_col, k), f"log_id string, `{text_col}` string, cluster int")


def cluster_lines(lines: DataFrame, k: int = N_CLUSTERS, text_col: str = "clean", vectors: DataFrame | None = None,
                  log_bytes: int = LOG_BYTES) -> DataFrame:
    """The lines of each log in at most ``k`` clusters, by bisecting
    (spherical) k-means over the log's distinct lines, weighted by how often
    each occurs. (Ward linkage needs all pairwise distances, O(n^2), so the
    divisive split is used instead.)

    A log whose distinct lines (texts and vectors) take ``log_bytes`` at most is
    clustered in one task, as many logs at a time as there are tasks: its lines
    are shuffled once, whatever the number of rounds. Larger logs are split all
    at once: a round takes every such log's widest leaves, and is a few grouped
    aggregates whose size is that of their distinct lines; none of them is a
    task's own. Both follow the same rule: a round splits a leaf at least in
    every log that lacks clusters, so there are at most ``k - 1`` rounds, and a
    log's clusters depend on its lines only. Clusters are numbered by their
    first line."""
    vec = vectors if vectors is not None else line_vectors(lines, text_col)
    v = F.transform("vector", lambda x: F.struct(F.xxhash64(x["token"]).alias("t"), x["weight"].alias("w")))
    state = vec.select("log_id", text_col, "cnt", "first_line", v.alias("v"), F.lit(1).cast("bigint").alias("node"), F.lit(False).alias("whole"))
    size = F.sum(64 + F.octet_length(text_col) + 16 * F.size("vector"))
    # at most one row for ``log_bytes`` of lines
    large = cut_lineage(vec.where("log_id IS NOT NULL").groupBy("log_id").agg(size.alias("size")).where(F.col("size") > log_bytes).select("log_id"))
    if large.isEmpty():
        assign = _clustered_by_log(state.where("log_id IS NOT NULL"), text_col, k)
    else:
        small = state.where("log_id IS NOT NULL").join(F.broadcast(large), "log_id", "left_anti")
        assign = _clustered_by_log(small, text_col, k).unionByName(
            _clustered_in_rounds(state.join(F.broadcast(large), "log_id", "left_semi"), text_col, k))
    return lines.join(cut_lineage(assign), ["log_id", text_col])


def _clustered_in_rounds(state: DataFrame, text_col: str, k: int) -> DataFrame:
    """``(log_id, text, cluster)`` for logs of any size."""
    state = cut_lineage(state)
    for _ in range(k - 1):
        chosen = cut_lineage(_to_split(state, k))
        if chosen.isEmpty():
            break
        state = _split(state, chosen)
    first = state.groupBy("log_id", "node").agg(F.min("first_line").alias("first"))
    number = first.withColumn("cluster", F.row_number().over(Window.partitionBy("log_id").orderBy("first")) - 1).drop("first")
    return state.join(number, ["log_id", "node"]).select("log_id", text_col, "cluster")


def project_2d(vectors: DataFrame, assign: DataFrame, text_col: str = "clean") -> DataFrame:
    """2-D projection for plotting: (x, y, text, line_number, cluster label)."""
    hashed = hashed_vectors(vectors.select("log_id", text_col, "vector"))
    pca = PCA(k=2, inputCol="features", outputCol="_xy").fit(hashed)
    xy = pca.transform(hashed).select("log_id", text_col, vector_to_array("_xy").alias("_a"))
    return (assign.join(xy, ["log_id", text_col])
            .select(F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"), F.col(text_col).alias("text"),
                    (F.col("line_no") + 1).alias("line_number"),
                    F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("cluster_label")))
