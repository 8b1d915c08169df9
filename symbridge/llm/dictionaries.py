"""Looking up every distinct fingerprint of a corpus in corpus-wide tables, without a row per word.

Documents are dealt into buckets by their content. A first pass sends, for each bucket, its distinct fingerprints to the segment of
the fingerprint space that they belong to, packed as byte strings; each segment is a partition of its own, which holds its share of all
fingerprints and answers; a second pass brings each bucket's answers to its documents, which stream past them. Segments and
buckets are hashed, so no word, source or group of copies makes one of them large, and their numbers follow the bytes of the texts,
so what a task holds does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 1 << 25
BUCKET_BYTES = 1 << 24
#: kind of the rows that hold documents; answers have smaller ones.
DOCUMENTS = 9

_DEALT = "bucket int, kind int, part int, data binary"


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, by one pass over their lengths."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def segments(n_bytes: int) -> int:
    """A power of two that gives each segment about SEGMENT_BYTES of so many bytes of keys, 16 at least."""
    return 1 << max(4, (-(-n_bytes // SEGMENT_BYTES) - 1).bit_length())


def buckets(spark: SparkSession, n_bytes: int) -> int:
    """Buckets of about BUCKET_BYTES of text, or smaller ones where some cores would have none."""
    return max(4, -(-n_bytes // BUCKET_BYTES), min(spark.sparkContext.defaultParallelism, n_bytes >> 21))


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("_id", "text"), F.lit(n)).cast("int").alias("bucket")


def pack(values: np.ndarray) -> bytes:
    """8-byte values as bytes, first bytes of all together and so on, which compresses where they are sorted or small."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed_: list[bytes], dtype: np.dtype = np.uint64) -> np.ndarray:
    """The values of some pack()ed byte strings."""
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(dtype).ravel() for x in packed_]
    return np.concatenate([*parts, np.zeros(0, dtype)])


def packed(groups: np.ndarray, keys: np.ndarray, counts: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """(group, segment, keys, counts) rows of keys that are sorted within sorted groups."""
    if not len(keys):
        return groups, keys.astype(np.int32), [], []
    segment = (keys >> np.uint64(64 - (n_segments - 1).bit_length())).astype(np.int32)
    cut = np.flatnonzero((np.diff(groups) != 0) | (np.diff(segment) != 0)) + 1
    first = np.concatenate([[0], cut])
    return groups[first], segment[first], [pack(x) for x in np.split(keys, cut)], [pack(x) for x in np.split(counts, cut)]


def merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some packed rows, sorted, with their summed counts."""
    k, c = unpack(keys), unpack(counts, np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def by_segment(rows: DataFrame, n: int) -> DataFrame:
    """rows with each of the n segments in a partition of its own."""
    return rows.repartitionById(n, "segment")


def columns_of(batches: Iterator[pa.RecordBatch]) -> list[list]:
    """The columns of a whole partition, which is bounded, as lists; none of an empty one."""
    held = [b for b in batches if b.num_rows]
    return [[x for b in held for x in b.column(i).to_pylist()] for i in range(held[0].num_columns)] if held else []


def narrow(x: np.ndarray) -> np.ndarray:
    """Small non-negative numbers in as few bytes as they need, which sort faster."""
    return x.astype(np.uint16 if int(x.max(initial=0)) < 1 << 16 else np.uint32)


def blocks(names: list[str]):
    """Documents (bucket first, then the columns named) as compressed blocks of one bucket each, an Arrow stream in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(narrow(of), kind="stable")
            rows = batch.take(pa.array(order)).select(names)
            cut = np.flatnonzero(np.diff(of[order])) + 1
            begin, end = np.concatenate([[0], cut]), np.append(cut, len(of))
            data = []
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows.slice(a, b - a))
                data.append(sink.getvalue().to_pybytes())
            if len(of):
                n = len(begin)
                yield pa.RecordBatch.from_arrays([pa.array(of[order][begin], pa.int32()), pa.array(np.full(n, DOCUMENTS), pa.int32()), pa.array(np.zeros(n), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "part", "data"])

    return run


def beside_answers(docs: DataFrame, answers: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Rows of each of n buckets, a partition each: its answers (bucket, kind, part, data) by kind and part, then its documents in blocks."""
    dealt_ = docs.select("bucket", *columns).mapInArrow(blocks(columns), _DEALT)
    return answers.select("bucket", "kind", "part", "data").unionAll(dealt_).repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind", "part")


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[int, list[bytes]], Iterator[pa.RecordBatch]]]:
    """(answers by kind, documents) of each bucket of beside_answers(); the documents are to be read before the next bucket."""
    rows = (r for batch in batches for i in range(0, batch.num_rows, 64) for r in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns), strict=True))
    for _, own in groupby(rows, itemgetter(0)):
        answers: dict[int, list[bytes]] = {}
        for _, kind, _, data in own:
            if kind == DOCUMENTS:
                yield answers, (b for d in chain([data], (r[3] for r in own)) for b in pa.ipc.open_stream(d))
                break
            answers.setdefault(kind, []).append(data)
