"""Line dedup in DataFrame functions only: long lines that many documents share are kept in one of them.

Lines are normalised, exploded with their positions and hashed (128 bits). The documents of each hash are counted, distinct ones and
after partial aggregation, with the largest of them. Lines over the threshold are dropped by position: a lookup of their hashes, which
splits hot ones (`shared.looked_up`), gives the dropped positions of each document, and the document is put together again from its
other positions. Only hashes, ids and positions are shuffled to find these; the texts move once, to meet their dropped positions, and
not at all where those are few enough to be broadcast by Spark.

Defined results: a null or empty text is one empty line. A null doc_id counts as one document, smaller than all others. Rows of one
doc_id are one document: each row has its result, and lines shared by them alone are no repeats. A line repeated within its document
counts once, and goes or stays at all its places. All lines dropped: an empty text. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import id_in, id_out, looked_up, table

LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """A stripped line with A-Z lower-cased; lower() does that at once where all is ASCII."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def long_lines(rows: DataFrame, least_length: int) -> DataFrame:
    """_id, _key, pos and hash (h1, h2) of the lines of rows (_id, _key, text) that may be dropped."""
    each = rows.select("_id", "_key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("_id", "_key", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
    key = key_of(F.col("line"))
    return each.where(F.length("line") >= least_length).select("_id", "_key", "pos", key.alias("line")).select("_id", "_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def dropped(rows: DataFrame, least_length: int, least_documents: int) -> DataFrame:
    """_id, _key and the dropped positions of the rows that lose lines."""
    each = long_lines(rows, least_length)
    shared = each.groupBy("h1", "h2").agg(F.countDistinct("_id").alias("n"), F.max("_id").alias("holder")).where(F.col("n") >= least_documents)
    found = looked_up(each, shared, ["h1", "h2"], ["holder"]).where(F.col("holder") != F.col("_id"))
    return found.groupBy("_id", "_key").agg(F.collect_set("pos").alias("dropped"))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines at other positions than those gone, joined; lines and positions are worked out once a row."""
    all_ = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.transform(F.array(F.struct(lines.alias("lines"), F.array_except(all_, gone).alias("at"))), lambda s: F.array_join(F.transform(s["at"], lambda i: s["lines"][i]), "\n"))[0]


def deduplicate(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is kept of each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(id_in().alias("_id"), text.alias("text")).withColumn("_key", F.xxhash64("text"))
    met = rows.join(dropped(rows, least_length, least_documents), ["_id", "_key"], "left")
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return met.select(
        id_out(F.col("_id")).alias("doc_id"), n.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_kept(F.split("text", "\n"), F.col("dropped"))).alias("text"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE len(k) >= {LEAST_LENGTH} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
marked AS (SELECT keyed.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
