"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

Two strings of length w within k edits share at least w + 1 - q(k + 1) character q-grams, all near one diagonal. Each document's
q-grams are looked up in the benchmark's; hits are counted in overlapping bands of diagonals; bands with fewer hits than the
bound, within w characters, are dropped; what is left is verified by alignment in a band. A document is contaminated where w
characters of an item stand within k edits; shorter items must stand whole, with edits in proportion.

Letters A-Z are lower-cased and white space characters are alike; positions are code points of the text as given. The benchmark
is read in blocks of at most `BLOCK_CHARS` characters, whose index (under 25 bytes a character) is broadcast, so what a task holds is
bounded however large the benchmark is; each block is a scan of the documents.

Defined results: null or empty text or item, or an item shorter than q: no match. Null id: kept as null. Repeated rows of documents:
each reports its matches. Repeated items: each is reported. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import table
from symbridge.llm.textops import mixed

Q = 12
REGION = 80
#: One edit for this many characters of a region.
CHARS_PER_EDIT = 20
BLOCK_CHARS = 8_000_000
RUN_CHARS = 1 << 19

MATCHES = "doc_id long, item_id long, start long, end long, edits long, shared long"

_STEP = np.array(0x9E3779B97F4A7C15, np.uint64)


def points(text: str) -> np.ndarray:
    """Code points, A-Z lower-cased, white space characters made spaces."""
    out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    out[(out >= 65) & (out <= 90)] += 32
    out[(out >= 9) & (out <= 13)] = 32
    return out


def qgrams(at: np.ndarray, q: int = Q) -> np.ndarray:
    """Fingerprints of the q-grams of code points, by doubling."""
    have: np.ndarray = mixed(at.astype(np.uint64) + np.uint64(1))
    out, size, done, one = None, 1, 0, _STEP[None]
    rest = q
    while rest:
        if rest & 1:
            m = len(at) - done - size + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            out = have[:m] if out is None else out[:m] * one + have[done : done + m]
            done += size
        rest >>= 1
        if rest:
            if len(have) <= size:
                return np.zeros(0, np.uint64)
            have = have[:-size] * one + have[size:]
            one = one * one
            size *= 2
    return mixed(out)


class Index:
    """The q-grams of a block of items, sorted, and a bit table that turns most other q-grams away."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q, region: int = REGION):
        self.q, self.region = q, region
        self.ids, self.items = [i for i, _ in items], [points(t) for _, t in items]
        grams = [qgrams(p, q) for p in self.items]
        keys = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.zeros(0, np.int32)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.shift = np.uint64(64 - max(16, int(np.ceil(np.log2(max(1, len(keys))))) + 3))
        self.table = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.table[self.keys >> self.shift] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text positions, index rows) of all shared q-grams."""
        maybe = np.flatnonzero(self.table[grams >> self.shift])
        low, high = np.searchsorted(self.keys, grams[maybe], "left"), np.searchsorted(self.keys, grams[maybe], "right")
        n = high - low
        at = np.repeat(maybe, n)
        return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)

    def bound(self, length: int) -> tuple[int, int, int]:
        """(region, edits, least number of shared q-grams) for an item of this length."""
        w = min(self.region, length)
        k = min(w // CHARS_PER_EDIT, max(0, (w + 1) // self.q - 1))
        return w, k, w + 1 - self.q * (k + 1)

    def matches(self, text: str) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, start, end, edits, shared q-grams) of each contaminated stretch of text."""
        at = points(text)
        where, row = self.hits(qgrams(at, self.q))
        return self.verified(at, where, row) if len(where) else []

    def verified(self, at: np.ndarray, where: np.ndarray, row: np.ndarray) -> list[tuple[int | None, int, int, int, int]]:
        out = []
        order = np.argsort(self.item[row], kind="stable")
        where, row = where[order], row[order]
        item, place = self.item[row], self.place[row].astype(np.int64)
        for of in np.split(np.arange(len(row)), np.flatnonzero(np.diff(item)) + 1):
            x = int(item[of[0]])
            w, k, least = self.bound(len(self.items[x]))
            if len(of) < least:
                continue
            p, d = place[of], where[of] - place[of]
            width = max(1, k) * 2
            found: list[tuple[int, int, int, int]] = []
            for half in (0, width // 2):  # bands overlap by half, so k diagonals always lie in one of them
                band = (d + half) // width
                order = np.lexsort((p, band))
                cuts = np.flatnonzero(np.diff(band[order])) + 1
                for own in np.split(order, cuts):
                    if len(own) >= least:
                        found += self._regions(at, self.items[x], p[own], d[own], w, k, least)
            stretches: list[tuple[int, int, int, int]] = []
            for a, b, edits, shared in sorted(found, key=lambda f: (f[0], -f[1])):
                if stretches and a < stretches[-1][1]:  # found in both bands, or one goes on where the other ends
                    o = stretches.pop()
                    a, b, edits, shared = o[0], max(b, o[1]), max(edits, o[2]), max(shared, o[3])
                stretches.append((a, b, edits, shared))
            out += [(self.ids[x], *s) for s in stretches]
        return out

    def _regions(self, at: np.ndarray, item: np.ndarray, p: np.ndarray, d: np.ndarray, w: int, k: int, least: int) -> list[tuple[int, int, int, int]]:
        """Verified stretches of one band: windows of w item characters that hold enough hits, joined where they overlap."""
        found: list[tuple[int, int, int, int]] = []
        first = 0
        while first < len(p):
            start = int(min(p[first], len(item) - w))
            low, last = (int(x) for x in np.searchsorted(p, [start, start + w - self.q + 1]))
            if last - low < least:
                first += 1
                continue
            hit = banded(item[start : start + w], at, start + int(np.median(d[low:last])), k)
            if hit is None:
                hit, last = self._earlier(at, item, p, d, w, k, least, first, start, last)
            if hit is not None:
                a, b, edits = hit
                if found and a <= found[-1][1] + k and a >= found[-1][0]:
                    o = found.pop()
                    found.append((o[0], max(o[1], b), max(o[2], edits), o[3] + max(0, last - first)))
                else:
                    found.append((a, b, edits, last - low))
                first = max(last, first + 1)
            else:
                first += 1
        return found

    def _earlier(self, at: np.ndarray, item: np.ndarray, p: np.ndarray, d: np.ndarray, w: int, k: int, least: int, first: int, start: int, last: int) -> tuple[tuple[int, int, int] | None, int]:
        """The best alignment of the windows that begin after the hit before and hold enough hits (edits near a copy's begin hide its first q-grams), and the end of its hits."""
        starts = np.arange(int(p[first - 1]) + 1 if first else 0, start)
        ends = np.searchsorted(p, starts + w - self.q + 1)
        starts, ends = starts[ends - first >= least], ends[ends - first >= least]
        if not len(starts):
            return None, last
        near = starts + np.array([int(np.median(d[first:e])) for e in ends])
        edits = _least_edits(item[starts[:, None] + np.arange(w)], at, near, k)
        best = len(edits) - 1 - int(edits[::-1].argmin())
        if edits[best] > k:
            return None, last
        return banded(item[starts[best] : starts[best] + w], at, int(near[best]), k), int(ends[best])


def _band(k: int) -> np.ndarray:
    """Diagonals about that of any hit: another hit of the band is up to 2k - 1 away, and the alignment up to k from there."""
    return np.arange(-3 * k - 1, 3 * k + 2)


def _least_edits(patterns: np.ndarray, text: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The edits banded() finds for each row of patterns near its start, all rows at once; more than k where it finds none."""
    n, w = patterns.shape
    offsets = _band(k)
    slots = np.arange(len(offsets))
    cost = np.zeros((n, len(offsets)), np.int64)
    for i in range(w):
        at = starts[:, None] + i + offsets
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == patterns[:, i, None])
        best = np.where(inside, cost + ~same, w + 1)
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(best - slots, axis=1) + slots
        if cost.min() > k:
            break
    return cost.min(axis=1)


def banded(pattern: np.ndarray, text: np.ndarray, start: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of pattern in text near text[start:], at most k edits, by alignment in a band of diagonals; else None."""
    if 0 <= start and start + len(pattern) <= len(text) and np.array_equal(pattern, text[start : start + len(pattern)]):
        return start, start + len(pattern), 0
    offsets = _band(k)
    cost = np.zeros(len(offsets), np.int64)  # the pattern may begin anywhere in the band
    origin = start + offsets
    for i, c in enumerate(pattern):
        at = start + i + offsets
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(len(at), bool)
        same[inside] = text[at[inside]] == c
        best, came = cost + ~same, origin.copy()
        best[~inside] = len(pattern) + 1
        up = np.append(cost[1:] + 1, len(pattern) + 1)  # pattern character left out
        take = up < best
        best[take], came[take] = up[take], np.append(origin[1:], -1)[take]
        for j in range(1, len(best)):  # text character left out
            if best[j - 1] + 1 < best[j]:
                best[j], came[j] = best[j - 1] + 1, came[j - 1]
        cost, origin = best, came
        if cost.min() > k:
            return None
    j = int(cost.argmin())
    return max(0, int(origin[j])), min(len(text), start + len(pattern) + int(offsets[j])), int(cost[j])


def _scan(index):
    """Matches of documents (doc_id, text); index is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(batch.column(0)[r].as_py(), *m) for r, m in _group_all(index.value, batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(6)], names=["doc_id", "item_id", "start", "end", "edits", "shared"])

    return run


def _group(index: Index, texts: list[str]) -> list[tuple[int, tuple]]:
    """(number of the text, match) of some texts, looked up together."""
    at = points("\0".join(texts))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    where, row = index.hits(qgrams(at, index.q))
    text = np.searchsorted(starts, where, "right") - 1
    keep = where + index.q < starts[text + 1]
    where, row, text = where[keep], row[keep], text[keep]
    out = []
    cuts = np.flatnonzero(np.diff(text)) + 1
    for own in np.split(np.arange(len(text)), cuts) if len(text) else ():
        t = int(text[own[0]])
        out += [(t, m) for m in index.verified(at[starts[t] : starts[t + 1] - 1], where[own] - starts[t], row[own])]
    return out


def _blocks(bench: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    for r in bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") >= Q).toLocalIterator():
        if block and size + len(r["text"]) > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def contaminated(docs: DataFrame, bench: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each stretch of a document that matches an item: doc_id, item_id, start, end, edits, shared q-grams."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [texts.mapInArrow(_scan(spark.sparkContext.broadcast(Index(block))), MATCHES) for block in _blocks(bench, block_chars)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], MATCHES)


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without a match; decided per row, so null and repeated ids do no harm."""
    at = docs.columns.index("text")
    out = docs
    for block in _blocks(bench, BLOCK_CHARS):
        index = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {r for r, _ in _group_all(index.value, batch.column(at))}
                yield batch.filter(pa.array([r not in bad for r in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def _group_all(index: Index, column: pa.Array) -> Iterator[tuple[int, tuple]]:
    group, first, size = [], 0, 0
    for r in range(len(column)):
        group.append(column[r].as_py() or "")
        size += len(group[-1]) + 1
        if size > RUN_CHARS or r == len(column) - 1:
            yield from ((first + g, m) for g, m in _group(index, group))
            group, first, size = [], r + 1, 0


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
