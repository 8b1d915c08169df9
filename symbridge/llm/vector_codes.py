"""Vector code compression: a codebook for each of `PARTS` parts of integer vectors, trained by Lloyd's rounds with Elkan's bounds.

A row keeps, beside its integers, for every part the entry it is assigned to, one upper bound of the distance to that entry and one
lower bound for each entry of the codebook. After a round the bounds are shifted by how far the entries have moved, and an entry gets an
exact integer distance only if neither its lower bound nor half of its distance to the assigned entry is strictly over the upper bound.
Bounds are rounded to the safe side (upper ones up to 32 bits, lower ones down to 16 bits) and pruning is strict, so that entries at equal
distances are both measured and the lower index wins.

Rows with their bounds are written to shared storage after each round but the last, which is where a lost executor resumes; the lower
bounds take 2 bytes an entry and part. A round's means are sums of each task, a row for each part, entry and task. Codebooks (`ENTRIES`
entries a part) travel with the tasks.

Defined results: vectors that are null or hold a null or non-finite component are left out, and so are those whose length is not `size`
(64), which the parts of the common codebooks do not fit. Null vec_id: kept, after all others in the order of ids. Repeated vec_ids: each
row is a vector; equal ids are ordered by their vectors. Fewer kept vectors than entries: as many entries as vectors; none, or an empty
table: no rows. Rows with a null label share one label_error. Extra columns are ignored. An integer component over `vectors.LARGEST` in
size raises, since its squared distance may not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import looked_up, materialise, table
from symbridge.llm.vectors import columns, floor_means, integers, packed, unpacked

SIZE = 64
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows worked on at once.
ROWS = 4096
#: What a bound is widened by, over all rounding errors of its computation.
SLACK = 1e-9

STATE = "vec_id long, label long, v binary, entry binary, upper binary, lower binary"
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
MOST_HALF = np.float16(65504)


def down(x: np.ndarray) -> np.ndarray:
    """Halves not over x."""
    h = np.minimum(x * (1 - SLACK), MOST_HALF).astype(np.float16)
    return np.where(h > x, np.nextafter(h, np.float16(-np.inf)), h)


def up(x: np.ndarray) -> np.ndarray:
    """Singles not under x."""
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    away = x - c
    return np.einsum("...k,...k->...", away, away)


def begun(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of the rows of one part: all distances, exactly."""
    d = squared(x[:, None, :], book[None])
    entry = np.argmin(d, 1)  # the first of equals
    return entry, up(np.sqrt(d[np.arange(len(x)), entry])), down(np.sqrt(d))


def moved_on(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower) of the rows of one part after its codebook has moved, and how many exact distances that took."""
    n, shift = len(book), np.sqrt(squared(book, before)) * (1 + SLACK)
    half = np.sqrt(squared(book[:, None, :], book[None])) * (0.5 * (1 - SLACK))
    upper, lower = upper.astype(np.float64) + shift[entry], np.maximum(lower.astype(np.float64) - shift, 0)
    others = np.where(np.eye(n, dtype=bool), np.inf, half).min(1)
    open_ = np.flatnonzero(others[entry] <= upper)  # else no entry can be as near as the assigned one
    entry, exact = entry.copy(), len(open_)
    own = squared(x[open_], book[entry[open_]])
    upper[open_] = np.sqrt(own) * (1 + SLACK)
    lower[open_, entry[open_]] = np.sqrt(own) * (1 - SLACK)
    near = (lower[open_] <= upper[open_, None]) & (half[entry[open_]] <= upper[open_, None])
    near[np.arange(len(open_)), entry[open_]] = False
    at, j = np.nonzero(near)
    if len(at):
        d = squared(x[open_[at]], book[j])
        exact += len(at)
        lower[open_[at], j] = np.sqrt(d) * (1 - SLACK)
        rows, first = np.unique(at, return_index=True)
        best = np.minimum(np.minimum.reduceat(d * n + j, first), own[rows] * n + entry[open_[rows]])  # ties: the lower index
        entry[open_[rows]] = best % n
        upper[open_[rows]] = np.sqrt(best // n) * (1 + SLACK)
    return entry, up(upper), down(lower), exact


def _begin(books: np.ndarray):
    parts, n, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = unpacked(batch.column(2), "<i4", parts, width)
            for a in range(0, len(v), ROWS):
                x = v[a : a + ROWS].astype(np.int64)
                entry, upper, lower = (np.stack(z, 1) for z in zip(*(begun(x[:, p], books[p]) for p in range(parts)), strict=True))
                yield _state(batch, a, entry, upper, lower)

    return run


def _state(batch: pa.RecordBatch, a: int, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    kept = [batch.column(i).slice(a, ROWS) for i in range(3)]
    return pa.RecordBatch.from_arrays([*kept, packed(entry.astype(np.uint8)), packed(upper.astype("<f4")), packed(lower.astype("<f2").reshape(len(entry), -1))], names=["vec_id", "label", "v", "entry", "upper", "lower"])


def _each(batch: pa.RecordBatch, before: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, integers, entry, upper, lower) of runs of a batch's rows, after the codebooks have moved."""
    parts, n, width = books.shape
    v, entry, upper, lower = unpacked(batch.column(2), "<i4", parts, width), unpacked(batch.column(3), "u1", parts), unpacked(batch.column(4), "<f4", parts), unpacked(batch.column(5), "<f2", parts, n)
    for a in range(0, len(v), ROWS):
        rows = slice(a, a + ROWS)
        x, now = v[rows].astype(np.int64), entry[rows].astype(np.int64)
        new = [moved_on(x[:, p], now[:, p], upper[rows, p], lower[rows, p], before[p], books[p])[:3] for p in range(parts)]
        yield a, x, *(np.stack(z, 1) for z in zip(*new, strict=True))


def _move(before: np.ndarray, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, *bounds in _each(batch, before, books):
                yield _state(batch, a, *bounds)

    return run


def _code(before: np.ndarray, books: np.ndarray):
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x, entry, _, _ in _each(batch, before, books):
                error = squared(x, books[np.arange(parts), entry]).sum(1)
                shown = [bytes(r).hex() for r in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, ROWS), batch.column(1).slice(a, ROWS), pa.array(shown, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _sums(shape: tuple[int, int, int]):
    parts, n, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), "<i4", parts, width).astype(np.int64).reshape(-1, width)
            place = (unpacked(batch.column(1), "u1", parts).astype(np.int64) + n * np.arange(parts)).ravel()
            np.add.at(sums, place, x)
            counts += np.bincount(place, minlength=parts * n)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["place", "n", "sums"])

    return run


def means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry replaced by its members' floor(mean); a row for each part and entry comes to the driver."""
    parts, n, width = books.shape
    each = state.select("v", "entry").mapInArrow(_sums(books.shape), "place int, n long, sums array<long>")
    sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
    for r in each.groupBy("place").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect():
        sums[r["place"]], counts[r["place"]] = r["sums"], r["n"]
    return floor_means(sums, counts, books.reshape(-1, width)).reshape(books.shape)


def _prepare(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = integers(batch.column(1), size, SCALE)
            if len(rows):
                picked = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(2).take(picked), packed(v.astype("<i4"))], names=["vec_id", "label", "v"])

    return run


def encode(embeddings: DataFrame, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector with its code and errors."""
    spark = embeddings.sparkSession
    kept = materialise(columns(embeddings, F.col("label").cast("long").alias("label")).mapInArrow(_prepare(size), "vec_id long, label long, v binary"), "vectors")
    first = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()  # ENTRIES rows
    if not first:
        return spark.createDataFrame([], RESULT)
    width = size // PARTS
    before = books = np.stack([np.frombuffer(r["v"], "<i4").reshape(PARTS, width) for r in first], 1).astype(np.int64)
    state = kept.mapInArrow(_begin(books), STATE)
    for i in range(rounds):
        if i:
            state = state.mapInArrow(_move(before, books), STATE)
        state = materialise(state, "bounds")
        before, books = books, means(state, books)
    coded = materialise(state.mapInArrow(_code(before, books), "vec_id long, label long, code string, error long"), "codes")
    told = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = coded.select(F.struct(F.col("label").isNull(), F.coalesce("label", F.lit(0))).alias("_label"), "vec_id", "code", "error")
    sums = by_label.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return looked_up(by_label, sums, ["_label"], ["label_error"]).select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    width, floor = SIZE // PARTS, "(s - ((s % n) + n) % n) // n"
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) = {SIZE})",
        f"parts AS MATERIALIZED (SELECT r, p, list_slice(v, p * {width} + 1, p * {width} + {width}) AS x FROM kept, unnest(range({PARTS})) AS t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS c FROM parts WHERE r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        away = " + ".join(f"(x[{z}] - c[{z}]) * (x[{z}] - c[{z}])" for z in range(1, width + 1))
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, p, arg_min(k, d * {ENTRIES} + k) AS k, min(d) AS d FROM (SELECT r, p, k, {away} AS d FROM parts JOIN c{i} USING (p)) GROUP BY r, p)")
        if i < ROUNDS:
            ctes += [
                f"m{i} AS (SELECT p, k, list({floor} ORDER BY z) AS c FROM (SELECT p, k, z, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS e, generate_subscripts(x, 1) AS z FROM parts JOIN a{i} USING (r, p)) GROUP BY p, k, z) GROUP BY p, k)",
                f"c{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (p, k))",
            ]
    return f"""WITH {", ".join(ctes)},
coded AS (SELECT r, string_agg(lower(lpad(hex(k), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


ORACLE = _oracle()
