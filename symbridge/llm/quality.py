"""Quality rules: gradient-boosted trees over document statistics, with two fixed rules before them.

The trees are trained on a bounded sample of labelled rows (`SAMPLE` of them, those of the smallest id hash), flattened into
numpy node arrays and scored for whole Arrow batches at once. On the features of `FALLING` a larger value never raises a
document's score (monotonic constraints). Statistics always cover whole texts.

Defined results: null or empty text: no words, so base_failed and not kept. Null id: kept as null. Repeated rows: judged alike.
Empty table: no rows. No labels, or labels of one class: the fixed rules alone decide. Label rows with a null are not used.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import table
from symbridge.llm.textops import Words, slices

#: Most labelled rows that the trees are trained on.
SAMPLE = 4000
MIN_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEAT_PERCENT = 30
KEEP_AT = 0.5

FEATURES = (
    "log_words", "word_chars", "symbols", "dup_lines", "repeat_words", "capitals", "digits", "exclaims", "bars", "stops",
    "line_breaks", "distinct_words", "same_as_last", "wide",
)
#: A larger share of these never makes a document better.
FALLING = ("symbols", "dup_lines", "repeat_words", "same_as_last")

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _is(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOL, _BAR, _EXCLAIM, _STOP, _BREAK = _is("#*$%&|<>"), _is("|"), _is("!"), _is("."), _is("\n")
_CAPITAL, _DIGIT = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("0123456789")


def _sums(raw: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(weight[raw], out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeated_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By row, the lines with a word that equal an earlier line of the row."""
    out, data = np.zeros(len(at) - 1, np.int64), raw.tobytes()
    for r in range(len(at) - 1):
        lines = data[at[r] : at[r + 1]].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            worded = [x for x in lines if x.strip(b" \t\r\v\f")]
            out[r] = len(worded) - len(set(worded))
    return out


def statistics(raw: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of STATS and the feature matrix of a run of rows."""
    words, rows = Words(raw, at), len(at) - 1
    n_words = np.diff(words.first)
    point = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=point[1:])
    chars = point[at[1:]] - point[at[:-1]]
    length = point[words.end] - point[words.start]
    word_chars = np.bincount(words.row, length, rows).astype(np.int64)
    prints = words.prints()
    grams, first = words.grams(prints, REPEAT_WINDOW)
    row = words.row[first].astype(np.uint64)
    keys = grams + row * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + REPEAT_WINDOW, -1)
    repeat = np.bincount(words.row, np.cumsum(cover)[:-1] > 0, rows).astype(np.int64)
    own = words.row[1:] == words.row[:-1]
    echo = np.bincount(words.row[1:][own & (prints[1:] == prints[:-1])], minlength=rows)
    # distinct words by row, counted over (row, print) in row order
    by = np.lexsort((prints, words.row))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (prints[by[1:]] != prints[by[:-1]]) | (words.row[by[1:]] != words.row[by[:-1]])
    distinct = np.bincount(words.row[by[fresh]], minlength=rows)
    symbols, lines = _sums(raw, at, _SYMBOL), _repeated_lines(raw, at)
    breaks = _sums(raw, at, _BREAK)
    some, worded = np.maximum(chars, 1), np.maximum(n_words, 1)
    matrix = np.stack([
        np.log1p(n_words), word_chars / worded, symbols / some, lines / (breaks + 1), repeat / worded,
        _sums(raw, at, _CAPITAL) / some, _sums(raw, at, _DIGIT) / some, _sums(raw, at, _EXCLAIM) / worded, _sums(raw, at, _BAR) / worded,
        _sums(raw, at, _STOP) / worded, breaks / worded, distinct / worded, echo / worded, 1 - chars / np.maximum(np.diff(at), 1),
    ], 1)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat}, matrix


@dataclass
class Trees:
    """Flattened trees: node i sends a row left if its feature is at most threshold; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, matrix: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(matrix), self.start), np.arange(len(matrix))
        for root in self.roots:
            node = np.full(len(matrix), root)
            for _ in range(self.depth):
                node = np.where(matrix[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return 1 / (1 + np.exp(-out))


def train(matrix: np.ndarray, good: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, shrink: float = 1.0) -> Trees:
    """Boosted trees for the log-odds of good, second-order gains over binned features, FALLING features constrained."""
    falls = np.array([f in FALLING for f in FEATURES])
    edges = [np.unique(np.quantile(matrix[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(matrix.shape[1])]
    binned = np.stack([np.searchsorted(e, matrix[:, f], "left") for f, e in enumerate(edges)], 1)
    odds = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(odds / (1 - odds)))
    nodes: list[list[float]] = []
    roots, score = [], np.full(len(good), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me, total_g, total_h = len(nodes), g[rows].sum(), h[rows].sum()
        value = float(np.clip(total_g / (total_h + shrink), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, None)
        for f in range(matrix.shape[1]) if level < depth and len(rows) >= 20 else ():
            gl, hl = (np.cumsum(np.bincount(binned[rows, f], x[rows], len(edges[f]) + 1))[:-1] for x in (g, h))
            if not len(gl):
                continue
            left, right = np.clip(gl / (hl + shrink), low, high), np.clip((total_g - gl) / (total_h - hl + shrink), low, high)
            gain = gl**2 / (hl + shrink) + (total_g - gl) ** 2 / (total_h - hl + shrink) - total_g**2 / (total_h + shrink)
            gain[(hl < 1) | (total_h - hl < 1) | (falls[f] & (left < right))] = -1
            if gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax()), float(left[gain.argmax()]), float(right[gain.argmax()])))
        if best[1]:
            f, k, left, right = best[1]
            goes, middle = binned[rows, f] <= k, (left + right) / 2
            lows, highs = ((middle, low), (high, middle)) if falls[f] else ((low, low), (high, high))
            a = grow(rows[goes], g, h, level + 1, lows[0], highs[0])
            b = grow(rows[~goes], g, h, level + 1, lows[1], highs[1])
            nodes[me][:4] = [f, edges[f][k], a, b]
        else:
            score[rows] += rate * value
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(good)), good - p, p * (1 - p), 0, -np.inf, np.inf))
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots), depth, start)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees for labels.quality = 1, from at most `sample` labelled documents; None if there is nothing to tell apart."""
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in slices(batch.column(1)):
                matrix = statistics(raw, at)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(matrix), pa.list_(pa.float64()))], names=["quality", "f"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most `sample` ids
    held = known.select("quality", "text").mapInArrow(rows, "quality int, f array<double>").orderBy("quality", "f").limit(2 * sample).collect()  # in order, so that trees are the same each time
    good = np.array([r["quality"] >= 1 for r in held], float)
    return train(np.array([r["f"] for r in held]), good) if 0 < good.sum() < len(good) else None


def verdicts(column: pa.Array, trees: Trees | None) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(first row, end row, statistics with base_failed, score and kept) of a text column."""
    for a, b, raw, at in slices(column):
        stats, matrix = statistics(raw, at)
        failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEAT_PERCENT * stats["n_words"])
        score = trees.score(matrix) if trees else np.ones(b - a)
        yield a, b, stats | {"base_failed": failed, "kept": ~failed & (score >= KEEP_AT), "score": score}


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, out in verdicts(batch.column(1), trees):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, out.values())], names=["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {STATS}, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of docs, all columns, that are kept."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [pa.array(out["kept"]) for _, _, out in verdicts(pc.cast(batch.column(at), pa.large_string()), trees)]
            if good:
                yield batch.filter(pa.concat_arrays(good))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
