"""N-gram Jaccard join by chosen paths: sets of five-word shingles with a similarity of 0.8 or more.

Documents of equal shingle sets are one set with a count. Sets are split recursively on sampled shared tokens: in each of `RUNS`
independent runs a set goes down the path of its sampled tokens (min-wise hashes of its shingles), until its bucket holds at most
`SMALL` sets or the path is `DEPTH` long; a bucket is compared by brute force. At similarity s a run keeps a pair together with
probability s, or s**DEPTH under the most common tokens, so the runs bring the recall over `1 - (1 - 0.8**DEPTH)**RUNS` (0.9998).
A bucket that is still large, in sets or in shingles, is dealt out as pairs of blocks of `SMALL` sets or `SHINGLES` shingles, each its own
group of rows, so nothing is capped.
Buckets with the same members as an earlier run's are compared once; a pair that met in an earlier run is not counted again
(each set carries its bucket of every run). Only sums by set and a spanning forest leave a bucket, never its pairs.

Result by document: class_id (smallest id of its connected class) and n_links (other documents of similarity 0.8 or more, copies
included). Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a text of one to four words has one shingle, all of it.

Defined results: null, empty or wordless text: a class of its own, no links. Null id: class and links as for others, null as its own
id; it is the smallest. Repeated rows: copies of each other. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import id_in, id_out, materialise, table
from symbridge.llm.textops import Words, mixed, slices
from symbridge.operators.components import components

SHINGLE = 5
THRESHOLD = 0.8
RUNS = 12
DEPTH = 3
SMALL = 512
#: Shingles that a block holds, about: with long texts a block has fewer sets.
SHINGLES = 4_000_000

_SEEDS = mixed(np.arange(1, RUNS * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, first[r]:first[r+1] of row r) of the distinct shingles of each row, sorted within it."""
    words, rows = Words(raw, at), len(at) - 1
    prints = words.prints()
    grams, where = words.grams(prints, SHINGLE)
    row = words.row[where]
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = np.array([int(mixed(np.add.reduce(prints[words.first[r] : words.first[r + 1]] * mixed(np.arange(1, n[r] + 1, dtype=np.uint64)), keepdims=True))[0]) for r in short], np.uint64)
    grams, row = np.concatenate([grams, whole]), np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[fresh], row[fresh]
    return grams, np.searchsorted(row, np.arange(rows + 1))


def sums(values: np.ndarray, first: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """ufunc over values[first[r]:first[r+1]] for each r; 0 where that is empty."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = ufunc.reduceat(values, first[some])
    return out


def set_prints(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each row's set (int64)."""
    return sums(mixed(grams), first, np.add).view(np.int64), sums(mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first, np.bitwise_xor).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, at in slices(batch.column(1)):
            grams, first = shingles(raw, at)
            f1, f2 = set_prints(grams, first)
            tokens = np.stack([sums(grams * s, first, np.minimum) for s in _SEEDS], 1).view(np.int64)
            offsets = pa.array(np.arange(0, tokens.size + 1, tokens.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(f1), pa.array(f2), pa.array(np.diff(first), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(tokens.ravel()))],
                names=["_id", "t", "f1", "f2", "n", "tokens"],
            )


def _leaves(sets: DataFrame) -> DataFrame:
    """(f1, f2, n, run, leaf): the bucket of each set in each run."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.lit(RUNS - 1)),
        lambda r: F.struct(r.alias("run"), *(F.xxhash64(r, *(F.element_at("tokens", r * DEPTH + 1 + d) for d in range(k + 1))).alias(f"k{k}") for k in range(DEPTH))),
    )
    rows = sets.select("f1", "f2", "n", F.explode(hashed).alias("h")).select("f1", "f2", "n", "h.*")
    leaf = F.col(f"k{DEPTH - 1}")
    for k in range(DEPTH - 1):
        large = (rows if k == 0 else rows.where(f"large{k - 1}")).groupBy(f"k{k}").count().where(F.col("count") > SMALL).select(f"k{k}", F.lit(True).alias(f"large{k}"))
        rows = rows.join(large, f"k{k}", "left")
    for k in reversed(range(DEPTH - 1)):
        leaf = F.when(F.col(f"large{k}"), leaf).otherwise(F.col(f"k{k}"))
    return rows.select("f1", "f2", "n", "run", leaf.alias("leaf"))


def _compare(sizes: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, leaves: np.ndarray, run: int, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked copies by set, number of the local root by set) of a bucket, or of a pair of its blocks."""
    n = len(sets)
    may = np.triu(np.ones((n, n), bool), 1) if not side.any() else (side[:, None] == 0) & (side[None, :] == 1)
    for r in range(run):
        may &= leaves[:, r, None] != leaves[None, :, r]
    may &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    root = np.arange(n)
    if not may.any():
        return np.zeros(n, np.int64), root
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(n), sizes), count[token] > 1
    owner, token = owner[shared], (np.cumsum(count > 1) - 1)[token[shared]]
    both, order = np.zeros((n, n)), np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        low, high = np.searchsorted(token, [a, a + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[owner[low:high], token[low:high] - a] = 1
        both += held @ held.T
    link = may & (both * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9)
    link |= link.T
    while True:  # the smallest number that each set is linked to, directly or not
        least = np.minimum(root, np.where(link, root[None, :], n).min(1))
        least = least[least]
        if (least == root).all():
            return link.astype(np.int64) @ copies, root
        root = least


def _buckets(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            grams = [h[0] for h in held]
            links, root = _compare(np.array([len(g) for g in grams]), grams, np.array([h[3] for h in held]), np.stack([h[4] for h in held]), held[0][5], np.array([h[6] for h in held]), threshold)
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array([held[i][1] for i in some], pa.int64()), pa.array([held[root[i]][1] for i in some], pa.int64()), pa.array(links[some])], names=["f1", "root", "links"])

        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keys = list(zip(*(columns[c].to_pylist() for c in ("leaf", "i", "j")), strict=True))
            rest = {c: columns[c].to_pylist() for c in ("f1", "f2", "copies", "leaves", "run", "side")}
            for a, b, raw, at in slices(columns["text"]):
                grams, first = shingles(raw, at)
                f1, f2 = set_prints(grams, first)
                for r in range(b - a):
                    if (f1[r], f2[r]) != (rest["f1"][a + r], rest["f2"][a + r]):
                        continue  # another text under the same id
                    if keys[a + r] != key and held:
                        yield done()
                        held = []
                    key = keys[a + r]
                    if any(h[1] == rest["f1"][a + r] and h[2] == rest["f2"][a + r] for h in held[-1:]):
                        continue  # a repeated row
                    held.append((grams[first[r] : first[r + 1]].copy(), rest["f1"][a + r], rest["f2"][a + r], rest["copies"][a + r], np.array(rest["leaves"][a + r]), rest["run"][a + r], rest["side"][a + r]))
        if held:
            yield done()

    return run


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(sketches: _id, f1, f2, n by document; sets: f1, f2, rep, same, copies, class, links, first), both on shared storage."""
    texts = docs.select(id_in().alias("_id"), F.col("text").cast("string").alias("text")).select("_id", "text", F.xxhash64("text").alias("t"))
    sketches = materialise(texts.mapInArrow(_sketch, "_id long, t long, f1 long, f2 long, n int, tokens array<long>"), "sketches")
    by_id = sketches.where("n > 0").groupBy("f1", "f2", "_id").agg(F.min("t").alias("t"), F.count("*").alias("same"), F.min("n").alias("n"), F.min("tokens").alias("tokens"))
    sets = by_id.groupBy("f1", "f2").agg(F.min(F.struct("_id", "t", "same")).alias("least"), F.sum("same").alias("copies"), F.min("n").alias("n"), F.min("tokens").alias("tokens"))
    sets = materialise(sets.select("f1", "f2", F.col("least._id").alias("rep"), F.col("least.t").alias("t"), F.col("least.same").alias("same"), "copies", "n", "tokens"), "sets")
    leaves = materialise(_leaves(sets), "leaves")
    buckets = leaves.groupBy("leaf").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.expr("bit_xor(xxhash64(f1, f2))").alias("members"), F.min("run").alias("run")).where("size > 1")
    first = buckets.groupBy("members", "size", "n").agg(F.min(F.struct("run", "leaf")).alias("b")).select("b.leaf", "size", F.col("n").alias("shingles"))
    within = leaves.join(first, "leaf")
    blocks = F.ceil(F.greatest(F.col("size") / SMALL, F.col("shingles") / SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("f1", "f2"), F.col("blocks")).cast("int")
    dealt = (
        within.withColumn("blocks", blocks).withColumn("block", block).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("f1", "f2", "leaf", "run", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), F.when(F.col("x") < F.col("block"), 1).otherwise(0).alias("side"))
    )
    paths = leaves.join(within.select("f1", "f2").distinct(), ["f1", "f2"]).groupBy("f1", "f2").agg(F.sort_array(F.collect_list(F.struct("run", "leaf"))).alias("l")).select("f1", "f2", F.col("l.leaf").alias("leaves"))
    whole = paths.join(sets.select("f1", "f2", F.col("rep").alias("_id"), "t", "copies"), ["f1", "f2"]).join(texts, ["_id", "t"])
    rows = dealt.join(whole, ["f1", "f2"]).select("leaf", "i", "j", "side", "f1", "f2", "copies", "leaves", "run", "text")
    compared = materialise(rows.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "f1", "f2").mapInArrow(_buckets(threshold), "f1 long, root long, links long"), "links")
    links = compared.groupBy("f1").agg(F.sum("links").alias("links"))
    roots = components(compared.where("f1 <> root"), "f1", "root", lambda df: materialise(df, "labels"))
    known = sets.drop("tokens", "t", "n").join(roots.withColumnRenamed("node", "f1"), "f1", "left").join(links, "f1", "left").withColumn("root", F.coalesce("root", "f1"))
    least = known.groupBy("root").agg(F.min(F.struct("rep", "f1", "f2")).alias("least"))
    known = known.join(least, "root").select("f1", "f2", "rep", "same", "copies", F.col("least.rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), ((F.col("least.f1") == F.col("f1")) & (F.col("least.f2") == F.col("f2"))).alias("first"))
    return sketches.select("_id", "f1", "f2", "n"), known


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    sketches, sets = classes(docs, threshold)
    found = sketches.join(sets.select("f1", "f2", "class", (F.col("copies") - 1 + F.col("links")).alias("links")), ["f1", "f2"], "left")
    return found.select(id_out(F.col("_id")).alias("doc_id"), id_out(F.coalesce("class", "_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, one row of each class (that of the smallest id) and the rows without a word."""
    names = docs.columns
    at = names.index("text")
    mark = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in names))  # own columns begin with more underscores than any other
    f1, f2, n, rep, same = (mark + c for c in ("f1", "f2", "n", "rep", "same"))
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"{f1} long", f"{f2} long", f"{n} int"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column(at).cast(pa.large_string())):
                grams, first = shingles(raw, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *map(pa.array, set_prints(grams, first)), pa.array(np.diff(first), pa.int32())], names=[*names, f1, f2, n])

    _, sets = classes(docs, threshold)
    marked = docs.mapInArrow(prints, schema)
    stays = sets.where("first").select(F.col("f1").alias(f1), F.col("f2").alias(f2), F.col("rep").alias(rep), F.col("same").alias(same))
    kept = marked.where(F.col(n) > 0).join(stays, [f1, f2]).where(id_in() == F.col(rep))
    twice = kept.where(F.col(same) > 1).dropDuplicates([f1, f2])
    own = [F.col(f"`{c}`") for c in names]
    return kept.where(F.col(same) == 1).select(own).unionAll(twice.select(own)).unionAll(marked.where(F.col(n) == 0).select(own))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
walk(a, b) AS (SELECT a, b FROM e UNION SELECT walk.a, e.b FROM walk JOIN e ON e.a = walk.b)
SELECT d.doc_id, least(d.doc_id, coalesce(r.low, d.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links FROM documents d
LEFT JOIN (SELECT a, min(b) AS low FROM walk GROUP BY a) r ON r.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = d.doc_id
"""
