"""Exact k-means on integer vectors: stored distances loosened by norms of total displacement, failures rescanned.

Each vector keeps its squared distance to every centroid and the round in which it was measured. The history of all centroids is
kept (rounds x k x components, a few kilobytes), so a stored distance is loosened by the norm of the whole way its centroid has gone
since, which is never more than the sum of the ways of each round. Only centroids whose loosened bound could
still win are measured again, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.session import discard, scratch, staged

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components beyond it could carry a squared distance out of 64 bits.
LARGEST = 2**27
#: Relative slack of bounds, far above the rounding of roots in doubles.
SLACK = 1e-9


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to one integer centroid."""
    gap = points.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", gap, gap)


def reassign(points: np.ndarray, measured: np.ndarray, when: np.ndarray, cluster: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(measured, when, cluster, number of distances measured) after the centroids `history[-1]`.

    `measured` (n x k) are squared distances to the centroids of round `when` (n x k), `cluster` the assignment so far; negative
    `when` stands for never measured. Ties go to the smaller cluster number: a centroid is passed over only where it is
    certainly farther than the own one.
    """
    now, k = len(history) - 1, history.shape[1]
    measured, when = measured.copy(), when.copy()
    work = 0

    def measure(rows: np.ndarray, j: int) -> None:
        nonlocal work
        measured[rows, j] = squared(points[rows], history[now, j])
        when[rows, j] = now
        work += len(rows)

    for j in np.unique(cluster[cluster >= 0]):
        measure(np.flatnonzero(cluster == j), int(j))
    own = np.where(cluster >= 0, measured[np.arange(len(points)), np.maximum(cluster, 0)], np.iinfo(np.int64).max)
    nearest = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    # The way of each centroid from each round until now, as one norm each.
    moved = np.sqrt(((history[now].astype(np.float64) - history.astype(np.float64)) ** 2).sum(axis=2)) * (1 + SLACK)
    for j in range(k):
        bound = np.sqrt(measured[:, j].astype(np.float64)) * (1 - SLACK) - moved[np.maximum(when[:, j], 0), j]
        measure(np.flatnonzero((when[:, j] != now) & ((when[:, j] < 0) | (bound <= nearest))), j)
    fresh = np.where(when == now, measured, np.iinfo(np.int64).max)
    return measured, when, fresh.argmin(axis=1), work


def whole_components(embedding: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """array<long> of floor(scale * x), or null unless there are exactly `size` components, none null, NaN or infinite."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    sound = (F.size(values) == size) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(sound, F.transform(values, lambda x: F.floor(x * scale)))


def _points(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("point").to_pylist()), np.int32).reshape(-1, size)


def _pack(size: int):
    """Integer components as four bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("whole").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling; squared distances would not fit 64 bits")
            rows = values.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "point"])

    return run


def _step(history: np.ndarray):
    """One round: each row gets its nearest centroid, with bounds carried along."""
    rounds, k, size = history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            points = _points(batch, size)
            if rounds == 1:
                measured, when, cluster = np.zeros((n, k), np.int64), np.full((n, k), -1, np.int8), np.full(n, -1)
            else:
                measured = np.frombuffer(b"".join(batch.column("measured").to_pylist()), np.int64).reshape(n, k)
                when = np.frombuffer(b"".join(batch.column("when").to_pylist()), np.int8).reshape(n, k)
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
            measured, when, cluster, _ = reassign(points, measured, when, cluster, history)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("point"), pa.array(cluster.astype(np.int32)), pa.array(measured[np.arange(n), cluster]),
                pa.array([r.tobytes() for r in measured], pa.binary()), pa.array([r.tobytes() for r in when.astype(np.int8)], pa.binary()),
            ], ["vec_id", "point", "cluster", "distance", "measured", "when"])

    return run


def _sums(size: int):
    """Component sums of the clusters in a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            points, cluster = _points(batch, size), batch.column("cluster").to_numpy()
            for j in np.unique(cluster).tolist():
                own = points[cluster == j]
                n, total = held.get(j, (0, np.zeros(size, np.int64)))
                held[j] = (n + len(own), total + own.sum(axis=0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([
            pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()),
            pa.array([t.tolist() for _, t in held.values()], pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floor of the mean of each cluster's vectors; an empty cluster keeps its centroid. A row for each cluster and component reaches the driver."""
    size = centroids.shape[1]
    parts = assigned.select("point", "cluster").mapInArrow(_sums(size), "cluster int, n bigint, total array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("sum"))
    out = centroids.copy()
    for row in each.collect():
        out[row["cluster"], row["i"]] = int(row["sum"]) // row["n"]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of (vec_id, embedding) with exactly `size` components, none null, NaN or infinite, are kept and become integers
    floor(scale * x), which must stay within 2^27. Centroids start as the vectors with the smallest sha256 of
    `seed:vec_id` (rows without id last, ties by components); with fewer vectors there are as many centroids. Each of `rounds` rounds assigns every vector to its nearest
    centroid, ties to the smaller number, and moves each centroid to the floored mean of its vectors; empty ones stay. Then
    vectors are assigned once more. Repeated rows are vectors of their own. An empty table, or one without sound vectors, gives
    an empty result. Columns other than vec_id and embedding are not read.
    """
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, point binary"
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        kept = vectors.select("vec_id", whole_components(F.col("embedding"), size, scale).alias("whole")).where("whole is not null")
        state = staged(kept.mapInArrow(_pack(size), schema))
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        first = state.select("point", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "point").limit(clusters).collect()
        if not first:
            return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
        history = np.stack([np.frombuffer(r["point"], np.int32).astype(np.int64) for r in first])[None]
        for _ in range(rounds + 1):
            before = state
            state = staged(state.mapInArrow(_step(history), f"{schema}, cluster int, distance bigint, measured binary, when binary"))
            discard(before)
            if len(history) <= rounds:
                history = np.concatenate((history, _moved(state, history[-1])[None]))
        told = keep(state.select("vec_id", "cluster", "distance"))
    # A row for each cluster: at most `clusters` of them.
    inertia = {r["cluster"]: int(r["sum"]) for r in told.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    of_cluster = spark.createDataFrame([(j, inertia[j], sum(inertia.values()), names[j]) for j in sorted(inertia)],
                                       "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return told.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
