"""Centroid clustering by Lloyd's rounds that work on changes only.

Vectors are whole numbers, so sums are exact in any order. A written table holds each vector
with its owner and squared distance; the driver holds the sums and counts of the clusters
(`clusters` x `dims` numbers). A round gives the tasks the centroids and which of them
changed: a vector whose own centroid stands is compared with the changed ones only, one
whose owner moved with all. Vectors that go over to another cluster are transfers, their
components taken off one sum and added to the other: signed sums that each task adds up
before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Components beyond this are held at it: squared distances of 64 of them fit into a long.
MOST = (1 << 27) - 1
#: Vectors that a task compares at a time.
ROWS = 4096

_STATE = "vec_id long, q array<int>, cluster int, distance long, came_from int"


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int"))


def fit_for_use(vector: Column, dims: int) -> Column:
    """Whether a vector has dims components, none null or non-finite."""
    big = F.lit(float("inf"))
    return F.coalesce(F.size(vector) == dims, F.lit(False)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == big))


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors (rows of q) and centroids (rows of c)."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * q.shape[1] < 1 << 53:  # whole numbers that doubles hold exactly
        a, b = q.astype(np.float64), c.astype(np.float64)
    else:
        a, b = q.astype(np.int64), c.astype(np.int64)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def reassign(q: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids numbered in `changed` moved; a cluster of -1 is none yet. Ties go to the smaller number."""
    cluster, distance = cluster.copy(), distance.copy()
    moved = np.isin(cluster, changed) | (cluster < 0)
    if moved.any():
        d = squared(q[moved], centroids)
        best = d.argmin(1)
        cluster[moved], distance[moved] = best, d[np.arange(len(best)), best]
    rest = np.flatnonzero(~moved)
    if len(rest) and len(changed):
        d = squared(q[rest], centroids[changed])
        best = d.argmin(1)
        near, number = d[np.arange(len(best)), best], changed[best]
        wins = (near < distance[rest]) | ((near == distance[rest]) & (number < cluster[rest]))
        cluster[rest[wins]], distance[rest[wins]] = number[wins], near[wins]
    return cluster, distance


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, changed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """State rows with their new owners; came_from is the old one."""
    for whole_batch in batches:
        for at in range(0, len(whole_batch), ROWS):
            batch = whole_batch.slice(at, ROWS)
            old = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            owner, distance = reassign(_matrix(batch.column(1), centroids.shape[1]), old, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), centroids, changed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(old)], names=["vec_id", "q", "cluster", "distance", "came_from"]
            )


def _transfers(batches: Iterator[pa.RecordBatch], k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """One row per cluster that the task's moved vectors touch: signed sums of components and of vectors."""
    sums, counts, touched = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, bool)
    for batch in batches:
        q = _matrix(batch.column(0), dims).astype(np.int64)
        for column, sign in ((1, 1), (2, -1)):
            number = batch.column(column).to_numpy(zero_copy_only=False)
            there = number >= 0
            np.add.at(sums, number[there], sign * q[there])
            np.add.at(counts, number[there], sign)
            touched[number[there]] = True
    at = np.flatnonzero(touched)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in the order of that hash; of repeated ids the smallest vectors come first."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(rank.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that can be used, and the centroids.

    Vectors with another number of components than dims, or with null or non-finite ones, are
    left out; components become floor(scale * x), held within +-MOST. The first centroids
    are those of first_centroids, fewer than k where there are fewer vectors. Each round
    assigns all vectors to the nearest centroid (of equally near ones to the first) and then
    moves the non-empty centroids to the floor of their vectors' mean; at the end vectors
    are assigned once more. A null id counts as an empty one; rows that repeat an id or a
    vector are vectors of their own. Other columns are not read. An empty table gives an
    empty result and no centroids.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lloyd")
    vector = F.col(f"`{vector_col}`")
    used = vectors.filter(fit_for_use(vector, dims)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole(vector, scale).alias("q"))
    state = scratch.write(used.withColumns({"cluster": F.lit(-1), "distance": F.lit(0).cast("long"), "came_from": F.lit(-1)}), "round-0")
    centroids = first_centroids(state, k, seed)
    k = len(centroids)
    if not k:
        return state.select("vec_id", "cluster", "distance"), np.zeros((0, dims), np.int64)
    sums, counts, changed = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.arange(k)
    for number in range(1, rounds + 2):
        if not len(changed):  # no centroid moved, so no vector will
            break
        shared = spark.sparkContext.broadcast((centroids, changed))  # k x dims numbers
        step = state.select("vec_id", "q", "cluster", "distance").mapInArrow(lambda b, shared=shared: _round(b, *shared.value), _STATE)
        state = scratch.write(step, f"round-{number}")
        scratch.drop(f"round-{number - 1}")
        shared.unpersist()
        if number > rounds:
            break
        moved = state.filter("cluster <> came_from").select("q", "cluster", "came_from")
        found = moved.mapInArrow(lambda b: _transfers(b, k, dims), "cluster int, n long, sums array<long>")
        totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
        for row in found.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # at most k rows
            counts[row.cluster] += row.n
            sums[row.cluster] += np.array(row[2:], np.int64)
        filled = counts > 0
        after = centroids.copy()
        after[filled] = sums[filled] // counts[filled][:, None]
        changed = np.flatnonzero((after != centroids).any(1))
        centroids = after
    return state.select("vec_id", "cluster", "distance"), centroids


def digests(vectors: DataFrame, **parameters) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; the centroids' table has one row a cluster."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, **parameters)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    rows = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """Plain Lloyd rounds: every vector against every centroid in each of them."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INT AS c, q FROM (SELECT q, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v) ORDER BY h, q LIMIT {k})""",
    ]
    gap = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, {gap} AS d FROM v, c{t} c) GROUP BY r)")
        if t < rounds:
            parts.append(
                f"""m{t + 1} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (SELECT a.c, i, sum(v.q[i])::BIGINT AS s, count(*) AS n FROM a{t} a JOIN v ON v.r = a.r, range(1, {dims + 1}) g(i) GROUP BY a.c, i) GROUP BY c),
                c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{t} o LEFT JOIN m{t + 1} m ON m.c = o.c)"""
            )
    return "WITH " + ", ".join(parts) + f""" SELECT v.vec_id, a.c AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
        sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c"""
