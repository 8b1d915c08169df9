"""Dictionary-compressed WARC archives: a trained Zstandard dictionary in a leading skippable frame, each record its own frame.

Equal payloads are stored once: of the pages with one payload that of the largest page_id is a response, the others revisit it. Which that is
is looked up by the digests of repeated payloads (`shared.looked_up`), so a payload that very many pages have is not gathered. Each
task writes its rows, ordered by page, to archives of bounded size on shared storage (written under a temporary name, then moved, so
a repeated task replaces its archives by equal ones), and the archives are read back as binary files.

The dictionary is trained on the first `SAMPLE_BYTES` bytes of at most `SAMPLE` pages (of the smallest id hash); too few pages: none.

Defined results: null html: an empty payload. Null page_id: a response under no id, never referred to. Repeated rows of the largest
page_id: each is a response. Empty table: no archive, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import looked_up, shared_dir, table

SAMPLE = 400
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 112_640
ARCHIVE_BYTES = 32 << 20
LEVEL = 3

# The magic numbers of the dictionary's skippable frame and of a Zstandard frame, the record version.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary trained on a bounded sample of the payloads; empty if there is too little to learn from."""
    import zstandard

    picked = pages.select("page_id").dropna().distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)  # ids alone: every task sends its SAMPLE smallest
    sized = F.substring(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 1, SAMPLE_BYTES)
    rows = pages.join(F.broadcast(picked), "page_id").groupBy("page_id").agg(F.min(sized).alias("b")).orderBy("page_id").collect()
    samples = [bytes(r["b"]) for r in rows if r["b"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _field(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record without; both tell the payload's length and digest."""
    head = [
        VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{url}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_field(url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page: {refers_to}"] if refers_to is not None else []),
        "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(payload) if refers_to is None else 0}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (payload if refers_to is None else b"") + b"\r\n\r\n"


def _write(folder: str, learned: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        trained = zstandard.ZstdCompressionDict(learned) if learned else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
        task, number, size, records, out, attempt = TaskContext.get().partitionId(), 0, 0, 0, None, uuid.uuid4().hex

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{root}/_{attempt}-{number}", f"{root}/part-{task:05d}-{number:05d}.warc.zst")

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= ARCHIVE_BYTES:
                    close()
                    number, size = number + (out is not None), 0
                    out = store.open_output_stream(f"{root}/_{attempt}-{number}", compression=None)
                    if learned:
                        out.write(struct.pack("<II", SKIPPABLE, len(learned)) + learned)
                page_id, url, html, refers_to = row
                frame = packer.compress(record(page_id, url, (html or "").encode(), refers_to))
                out.write(frame)
                size += len(frame)
                records += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([records], pa.int64())], names=["records"])

    return run


def write(pages: DataFrame, folder: str) -> int:
    """Writes archives of pages (page_id, url, html) to the folder; the number of records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    repeated = hashed.groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    dealt = looked_up(hashed, repeated, ["sha"], ["largest"]).select("page_id", "url", "html", F.when(F.col("page_id") < F.col("largest"), F.col("largest")).alias("refers_to"))
    written = dealt.sortWithinPartitions("page_id", "url", "html").mapInArrow(_write(folder, dictionary(rows)), "records long")
    return written.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).collect()[0]["n"]


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    import zstandard

    at, learned = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", data, 4)[0]
        learned, at = zstandard.ZstdCompressionDict(data[8 : 8 + n]), 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=learned) if learned else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        one = reader.decompressobj()
        parts, start = [], at
        while not one.eof:
            if start >= len(data):
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(view[start : start + 65_536]))
            start += 65_536
        at = min(start, len(data)) - len(one.unused_data)
        yield b"".join(parts)


def parsed(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of a record; a response's payload is measured anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:40]}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    payload = rest[: int(fields["Content-Length"])]
    told, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (digest(payload) != told or rest[len(payload) :] != b"\r\n\r\n"):
        raise ValueError("a payload does not match its digest")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return int(page) if page else None, len(payload) if kind == "response" else int(fields["X-Payload-Length"]), told, kind, int(refers) if refers else None, fields["WARC-Target-URI"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            name = path.as_py().rpartition("/")[2]
            rows = [(*parsed(r), name) for r in frames(content.as_py())]
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 4096], strict=True), kinds, strict=True)], names=names)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(_read, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    if not write(table(spark, sf_dir, "pages"), folder):
        return spark.createDataFrame([], RECORDS).drop("url", "archive")
    return read(spark, folder).drop("url", "archive")


ORACLE = """
WITH hashed AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
    SELECT hex, array_to_string(list_transform(range(1, 41), lambda i: [ '0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111' ][strpos('0123456789abcdef', substr(hex, CAST(i AS INTEGER), 1))]), '') AS b
    FROM (SELECT DISTINCT hex FROM hashed)
),
digests AS (
    SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
        + 16 * CAST(substr(b, CAST(i * 5 + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(b, CAST(i * 5 + 2 AS INTEGER), 1) AS INTEGER) + 4 * CAST(substr(b, CAST(i * 5 + 3 AS INTEGER), 1) AS INTEGER)
        + 2 * CAST(substr(b, CAST(i * 5 + 4 AS INTEGER), 1) AS INTEGER) + CAST(substr(b, CAST(i * 5 + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), '') AS digest
    FROM bits
),
largest AS (SELECT hex, max(page_id) AS top FROM hashed GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < top THEN top END AS refers_to
FROM hashed JOIN digests USING (hex) JOIN largest USING (hex)
"""
