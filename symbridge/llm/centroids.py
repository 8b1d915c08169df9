"""Centroid clustering of integer vectors, with block-norm screening before exact distances.

Vectors are cut into segments of `SEGMENT` components. By Cauchy and Schwarz the product of a vector and a centroid is at most the
product of their segment norms, so |x|^2 + |c|^2 - 2 <norms of x, norms of c> is a lower bound of the squared distance that costs one
multiplication a segment. Integer vectors, their squares and segment norms are computed once and written to shared storage; every round
screens with them, and only centroids whose bound does not exceed the best exact distance so far get an exact integer distance. A bound
is lowered by more than its rounding error, and pruning is strict, so ties still go to the smaller number.

A round is one scan: each task sums its members, and a row for each centroid and task is shuffled. Centroids (`CLUSTERS` vectors) travel
with the tasks; nothing else that a task needs grows with the input.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out. Null vec_id: kept; its
hash is that of `1:`. Repeated vec_ids: each row is a vector; equal hashes are ordered by their vectors. Fewer kept vectors than
centroids: as many centroids as vectors; none, or an empty table: no rows. Extra columns are ignored. An integer component over
`vectors.LARGEST` in size raises, since its squared distance may not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import materialise, table
from symbridge.llm.vectors import columns, floor_means, integers, packed, unpacked

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEGMENT = 4
SEED = "1:"
#: Rows screened at once, and what bounds are lowered by (a multiple of the rounding errors of SIZE products).
ROWS = 4096
SLACK = 1e-12

PREPARED = "vec_id long, v binary, norms binary, square long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def norms(v: np.ndarray) -> np.ndarray:
    """The norm of each segment of each row."""
    parts = v.reshape(len(v), -1, SEGMENT)
    return np.sqrt(np.einsum("nsk,nsk->ns", parts, parts).astype(np.float64))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, v = integers(batch.column(1), SIZE, SCALE)
        if len(rows):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), packed(v.astype("<i4")), packed(norms(v)), pa.array(np.einsum("nd,nd->n", v, v))], names=["vec_id", "v", "norms", "square"])


def nearest(v: np.ndarray, segments: np.ndarray, square: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, and how many exact distances that took."""
    theirs, squares = norms(centroids), np.einsum("kd,kd->k", centroids, centroids)
    cluster, distance, exact = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), 0
    for a in range(0, len(v), ROWS):
        x, top = v[a : a + ROWS], square[a : a + ROWS, None] + squares.astype(np.float64)
        bound = top - 2 * (segments[a : a + ROWS] @ theirs.T) - SLACK * top
        best = np.argmin(bound, 1)
        away = x - centroids[best]
        least = np.einsum("nd,nd->n", away, away)
        exact += len(x)
        first = best.copy()
        for j, c in enumerate(centroids):
            rows = np.flatnonzero((bound[:, j] <= least) & (first != j))
            away = x[rows] - c
            d = np.einsum("nd,nd->n", away, away)
            exact += len(rows)
            nearer = (d < least[rows]) | (d == least[rows]) & (j < best[rows])
            best[rows[nearer]], least[rows[nearer]] = j, d[nearer]
        cluster[a : a + ROWS], distance[a : a + ROWS] = best, least
    return cluster, distance, exact


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(batch.column(1), "<i4", SIZE).astype(np.int64), unpacked(batch.column(2), "<f8", SIZE // SEGMENT), batch.column(3).to_numpy()


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v, segments, square = _read(batch)
            cluster, _, _ = nearest(v, segments, square, centroids)
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            if len(held):
                sums[held] += np.add.reduceat(v[order], starts)
            counts += np.bincount(cluster, minlength=len(centroids))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(*_read(batch), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector with its cluster, distance and the cluster's figures."""
    spark = embeddings.sparkSession
    kept = materialise(columns(embeddings).mapInArrow(_prepare, PREPARED), "vectors")
    key = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(CLUSTERS).collect()  # CLUSTERS rows
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.stack([np.frombuffer(r["v"], "<i4") for r in first]).astype(np.int64)
    for _ in range(rounds):
        parts = kept.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(SIZE))).alias("sums")).collect():  # a row a centroid
            sums[r["cluster"]], counts[r["cluster"]] = r["sums"], r["n"]
        centroids = floor_means(sums, counts, centroids)
    assigned = materialise(kept.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    shown = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    figures = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select(*(c.split()[0] for c in RESULT.split(", ")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    floor = "(s - ((s % n) + n) % n) // n"
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY k LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        away = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(k, d * {CLUSTERS} + k) AS k, min(d) AS d FROM (SELECT r, k, CAST({away} AS BIGINT) AS d FROM kept, c{i}) GROUP BY r)")
        if i < ROUNDS:
            ctes += [
                f"m{i} AS (SELECT k, list({floor} ORDER BY p) AS c FROM (SELECT k, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept JOIN a{i} USING (r)) GROUP BY k, p) GROUP BY k)",
                f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))",
            ]
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} USING (k)"""


ORACLE = _oracle()
