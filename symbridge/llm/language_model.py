"""Language-model scoring with a log-frequency Bloom filter of quantised bigram counts, one filter for each segment of the pairs.

Learning: training documents' words and pairs are counted over the whole corpus, by segments of the fingerprint space. Word counts stay
exact. A pair counted c times enters its segment's filter once for each level 1 .. 1 + floor(log2 c), and the counts are dropped: the
model on shared storage (`learn`) is a file for each filter, and a table of words and of what the pairs take from each first word. A filter
takes `BITS` bits an entry, however many there are, so false positives do not rise with the corpus.

Scoring: each bucket of documents sends its distinct words and pairs to their segments, whose tasks read their filter and ask it for
level after level until one is missing, so a count is read as a power of two not above it (or, rarely, above: a false positive). The
answers come back in the order of the keys, which the bucket's task finds again, so keys travel one way only. Filters are read by the tasks
of their segments and not broadcast, since they grow with the corpus.

Probability of w after h: (max(q(h, w) - d, 0) + b(h) * p1(w)) / c(h), with q the count read from the filter, d the absolute discount from
the numbers of pairs seen once and twice, p1 = (c + 1) / (N + V + 1), and b(h) = c(h) - sum over w of (q(h, w) - d): what discounts and
rounding down take from h, summed over the pairs that the filter holds. So the probabilities after h sum to 1 over all known words and
one unknown word; only false positives add to that, on average (1 - d) * f * V / c(h) with f under 5e-5. After an unseen h it is p1.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, known by 64-bit fingerprints, in pairs by 32 bits of each; filters are asked by 48 bits
of a pair. An end token closes each document.

Defined results: null or empty text: the end token alone. Null id: as its text "" in the split, kept as null. Repeated rows: scored and
counted each. Empty table: no rows. No training document: counts are 0 and every score comes from p1 = 1. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.dictionaries import beside_answers, bucket, buckets, by_segment, columns_of, dealt, merged, narrow, pack, packed, segments, text_bytes, unpack
from symbridge.llm.shared import id_in, id_out, materialise, shared_dir, table
from symbridge.llm.textops import LOWER, Words, mixed, slices, unmixed

BITS = 24
PROBES = 8
FLUSH_WORDS = 2_000_000
#: Bytes of keys that reach the segments for each byte of text, about.
KEY_SHARE = 3

#: The fingerprints of the end token and of a document's start.
END, START = (int(x) for x in mixed(np.array([1, 2], np.uint64)))
#: The bits of a pair that its filter knows.
ASKED = np.uint64(0xFFFFFFFFFFFF0000)
#: Kinds of rows: asked or counted words and pairs; words with counts and sums by first word of the model.
UNI, PAIR, WORDS, CONTEXT = range(4)

#: counts: how often each key was seen, or the bucket that asks for it.
_ROWS = "segment int, what int, keys binary, counts binary"
_MODEL = "what int, segment int, keys binary, data binary, total long, kinds long, once long, twice long"
_ANSWERS = "bucket int, kind int, part int, data binary"


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, token before) of a run of rows, words and ends, in order within each row."""
    words, rows = Words(raw, at), len(at) - 1
    place = np.arange(len(words)) + words.row
    ends = words.first[1:] + np.arange(rows)
    row, token = np.empty(len(words) + rows, np.int64), np.empty(len(words) + rows, np.uint64)
    row[place], row[ends] = words.row, np.arange(rows)
    words.raw = LOWER[raw]
    token[place], token[ends] = words.prints(), np.uint64(END)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])[:rows]] = np.uint64(START)
    return row, token, before


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Fingerprints of pairs: the upper 32 bits of both words, mixed."""
    return mixed((before & np.uint64(0xFFFFFFFF00000000)) | (token >> np.uint64(32)))


def contexts(pairs_: np.ndarray) -> np.ndarray:
    """The 32 bits of the first word of each pair."""
    return unmixed(pairs_) >> np.uint64(32)


def _rows(what: int, of: np.ndarray, keys: np.ndarray, values: np.ndarray, n_segments: int) -> pa.RecordBatch:
    """Rows of a kind, one for each segment of keys that are sorted by it."""
    _, segment, k, c = packed(of, keys, values, n_segments)
    return pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(np.full(len(k), what), pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=[x.split()[0] for x in _ROWS.split(", ")])


def _flushed(batches: Iterator[pa.RecordBatch], flush) -> Iterator[pa.RecordBatch]:
    """flush(bucket or zeros, word, pair) of each token, for FLUSH_WORDS of the batches' texts at a time."""
    held, n = [], 0
    for batch in batches:
        of = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, raw, at in slices(batch.column(0)):
            row, token, before = tokens(raw, at)
            held.append((of[a:b][row], token, pairs(before, token)))
            n += len(row)
            if n >= FLUSH_WORDS:
                yield from flush(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield from flush(*map(np.concatenate, zip(*held, strict=True)))


def _count(n_segments: int):
    """Words and pairs of training documents (text, 0) with their counts, by segment."""

    def flush(_: np.ndarray, words: np.ndarray, both: np.ndarray) -> Iterator[pa.RecordBatch]:
        for what, keys in ((UNI, words), (PAIR, both)):
            k, counts = np.unique(keys, return_counts=True)
            yield _rows(what, np.zeros(len(k), np.int32), k, counts.astype(np.int64), n_segments)

    return lambda batches: _flushed(batches, flush)


def _ask(n_segments: int):
    """The distinct words and pairs of each bucket of documents (text, bucket), by segment; each bucket asks for the start too, which no document counts as a word."""
    shift = np.uint64(64 - (n_segments - 1).bit_length())

    def flush(of: np.ndarray, words: np.ndarray, both: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.unique(of)
        for what, keys, group in ((UNI, np.append(words, np.full(len(some), START, np.uint64)), np.append(of, some)), (PAIR, both & ASKED, of)):
            order = np.argsort(keys)
            order = order[np.argsort(narrow((keys[order] >> shift).astype(np.int64) * (int(of.max(initial=0)) + 1) + group[order]), kind="stable")]
            k, g = keys[order], group[order]
            fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])[: len(k)]
            k, g = k[fresh], g[fresh]
            yield _rows(what, np.zeros(len(k), np.int32), k, g, n_segments)

    return lambda batches: _flushed(batches, flush)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(float))[1]


def positions(keys: np.ndarray, level: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which keys are still asked for, their bits) for each probe of a level; send() tells which of them go on."""
    start, step = mixed(keys ^ mixed(np.array([2 * level], np.uint64))), mixed(keys ^ mixed(np.array([2 * level + 1], np.uint64)))
    open_ = np.arange(len(keys))
    for probe in range(PROBES):
        at = (start[open_] + np.uint64(probe) * step[open_]) >> np.uint64(32)
        goes_on = yield open_, (at * np.uint64(bits)) >> np.uint64(32)
        if goes_on is not None:
            open_ = open_[goes_on]


class Filter:
    """A log-frequency Bloom filter of one segment's pairs, of `BITS` an entry."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Filter:
        level = levels(counts)
        size = max(8, int(level.sum()) * BITS)
        if size >= 1 << 32:
            raise ValueError("a segment has too many pairs")
        bits = np.zeros(size, bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            for _, at in positions(keys[level >= j], j, size):
                bits[at] = True
        return cls(bits)

    @classmethod
    def read(cls, data: bytes) -> Filter:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8)).view(bool))

    def written(self) -> bytes:
        """The filter as bytes, its size a multiple of 8, as BITS is."""
        return np.packbits(self.bits).tobytes()

    def store(self, folder: str, segment: int) -> None:
        """Writes the segment's file; a repeated task replaces it by an equal one."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part = f"{root}/_{uuid.uuid4().hex}"
        with files.open_output_stream(part, compression=None) as out:
            out.write(self.written())
        files.move(part, f"{root}/filter-{segment}")

    @classmethod
    def load(cls, folder: str, segment: int) -> Filter | None:
        """The segment's filter; none if nothing was learned there."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/filter-{segment}"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path, compression=None) as data:
            return cls.read(data.read())

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The largest power of two whose level, and all below, hold each key; 0 if none does."""
        out, open_, level = np.zeros(len(keys)), np.arange(len(keys)), 1
        while len(open_) and level < 64:
            probes = positions(keys[open_], level, self.size)
            here, at = next(probes)
            while True:
                hit = self.bits[at]
                try:
                    here, at = probes.send(hit)
                except StopIteration:
                    open_ = open_[here[hit]]
                    break
            out[open_] = 2.0 ** (level - 1)
            level += 1
        return out


def _by_bucket(buckets_: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, distinct numbers by bucket, cuts between buckets) of numbers in order."""
    order = np.argsort(narrow(buckets_), kind="stable")
    b, x = buckets_[order], numbers[order]
    fresh = np.concatenate([[True], (b[1:] != b[:-1]) | (x[1:] != x[:-1])])[: len(b)]
    b, x = b[fresh], x[fresh]
    return b, x, np.flatnonzero(np.diff(b)) + 1


def _learn(n_segments: int, folder: str):
    """Of a segment: the sums of its words and pairs, its words with their counts, and what it takes from the pairs' first words; its filter goes to the folder."""
    shift = np.uint64(32 - (n_segments - 1).bit_length())
    names = [c.split()[0] for c in _MODEL.split(", ")]
    kinds = [pa.int32()] * 2 + [pa.binary()] * 2 + [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := columns_of(batches)):
            return
        segment, out = rows[0][0], []
        for what in (UNI, PAIR):
            keys, counts = merged(*([x for w, x in zip(rows[1], rows[i], strict=True) if w == what] for i in (2, 3)))
            out.append((what, segment, None, None, int(counts.sum()), len(counts), int((counts == 1).sum()), int((counts == 2).sum())))
            if what == UNI:
                out.append((WORDS, segment, pack(keys), pack(counts), 0, 0, 0, 0))
                continue
            learned = Filter.of(keys & ASKED, counts)
            learned.store(folder, segment)
            heads, of = np.unique(contexts(keys), return_inverse=True)
            kinds_, sums = np.bincount(of, minlength=len(heads)), np.bincount(of, learned.counts(keys & ASKED), len(heads)).astype(np.int64)
            goal = (heads >> shift).astype(np.int64)
            cut = np.flatnonzero(np.diff(goal)) + 1
            for g, h, t, q in zip(goal[[0, *cut]] if len(goal) else (), np.split(heads, cut), np.split(kinds_, cut), np.split(sums, cut), strict=False):
                out.append((CONTEXT, int(g), pack(h), pack(np.concatenate([t, q])), 0, 0, 0, 0))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=names)

    return run


def _answer(discount: float, docs: int, folder: str):
    """Of a segment: for each bucket that asks, its words' counts and back-off masses, and how its pairs are read from the filter, in the order of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := columns_of(batches)):
            return
        of = lambda what, i: [x for w, x in zip(rows[1], rows[i], strict=True) if w == what]
        segment, out = rows[0][0], []

        def asked(what: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(distinct keys, bucket, each bucket's keys as their numbers, cuts between buckets)."""
            keys, of_ = unpack(of(what, 2)), unpack(of(what, 3), np.int64)
            order = np.argsort(keys)
            keys, of_ = keys[order], of_[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            return keys[first], *_by_bucket(of_, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))))

        keys, b, x, cut = asked(UNI)
        if len(b):
            known, counts = merged(of(WORDS, 2), of(WORDS, 3))
            held = np.zeros(len(keys), np.int64)
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                held = np.where(known[i] == keys, counts[i], 0)
            held = np.where(keys == np.uint64(START), docs, held)
            each = [np.split(unpack([d], np.int64), 2) for d in of(CONTEXT, 3)]
            heads, at = np.unique(unpack(of(CONTEXT, 2)), return_inverse=True)
            kinds, sums = (np.bincount(at, np.concatenate([*(e[i] for e in each), np.zeros(0, np.int64)]), len(heads)) for i in (0, 1))
            mass = np.zeros(len(keys))
            if len(heads):
                i = np.minimum(np.searchsorted(heads, keys >> np.uint64(32)), len(heads) - 1)
                there = (heads[i] == keys >> np.uint64(32)) & (held > 0)
                mass = np.where(there, np.maximum(held - sums[i] + discount * kinds[i], discount), 0.0)
            out += [(int(o), UNI, segment, pack(np.concatenate([held[k], mass[k].view(np.int64)]))) for o, k in zip(b[[0, *cut]], np.split(x, cut), strict=True)]
        keys, b, x, cut = asked(PAIR)
        if len(b):
            learned = Filter.load(folder, segment)
            read = np.zeros(len(keys)) if learned is None else learned.counts(keys)
            code = levels(read).astype(np.uint8)  # 0 for 0, else 1 + log2
            out += [(int(o), PAIR, segment, c.tobytes()) for o, c in zip(b[[0, *cut]], np.split(code[x], cut), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate([pa.int32()] * 3 + [pa.binary()])], names=["bucket", "kind", "part", "data"])

    return run


def _score(total: int, kinds: int, discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for answers, documents in dealt(batches):
            words = [np.split(unpack([x], np.int64), 2) for x in answers[UNI]]
            count, mass = (np.concatenate([w[i] for w in words]) for i in (0, 1))
            mass, code = mass.view(float), np.frombuffer(b"".join(answers[PAIR]), np.uint8)
            held = [(part.slice(a, b - a), *tokens(raw, at)) for part in documents for a, b, raw, at in slices(part.column("text"))]
            token = np.concatenate([*(h[2] for h in held), np.array([START], np.uint64)])
            known, number = np.unique(token, return_inverse=True)
            start = number[-1]
            before = np.concatenate([h[3] for h in held])
            first = before == np.uint64(START)
            of = np.where(first, start, np.concatenate([[0], number[:-2]]))
            asked, pair = np.unique(pairs(before, token[:-1]) & ASKED, return_inverse=True)
            if len(known) != len(count) or len(asked) != len(code):
                raise ValueError("a bucket's answers are not those to its documents")
            own = (np.where(known == np.uint64(START), 0, count) + 1) / (total + kinds + 1)
            own, c1 = own[number[:-1]], count[of].astype(float)
            c2 = np.minimum(np.where(code > 0, 2.0 ** (code.astype(float) - 1), 0)[pair], c1)
            p = np.where(c1 > 0, (np.maximum(c2 - discount, 0) + mass[of] * own) / np.maximum(c1, 1), own)
            columns = (np.ones(len(own)), (count > 0)[number[:-1]], np.log10(own), np.log10(p))
            end = 0
            for part, row, _, _ in held:
                at = slice(end, end + len(row))
                end += len(row)
                sums = [np.bincount(row, x[at], part.num_rows) for x in columns]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("train"), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(np.full(part.num_rows, total), pa.int64()), *map(pa.array, sums[2:])],
                    names=["_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


@dataclass(frozen=True)
class Model:
    """A learned model: its table (_MODEL) and the folder of its filters, by so many segments, and its sums."""

    table: DataFrame
    filters: str
    segments: int
    total: int
    kinds: int
    discount: float
    documents: int


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(id_in().alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def learn(docs: DataFrame, n: int | None = None) -> Model:
    """A model of the documents, in n segments (as many as their texts ask for)."""
    n = n or segments(KEY_SHARE * text_bytes(docs))
    counted = _text(docs).select("text", F.lit(0).alias("bucket")).mapInArrow(_count(n), _ROWS)
    filters = shared_dir(docs.sparkSession, "filters")
    held = materialise(by_segment(counted, n).mapInArrow(_learn(n, filters), _MODEL), "model")
    stats = {r["what"]: r for r in held.where(F.col("what").isin(UNI, PAIR)).groupBy("what").agg(*(F.sum(c).alias(c) for c in ("total", "kinds", "once", "twice"))).collect()}
    uni, both = stats.get(UNI), stats.get(PAIR)
    total, kinds = (uni["total"], uni["kinds"]) if uni else (0, 0)
    once, twice = (both["once"], both["twice"]) if both else (0, 0)
    return Model(held, filters, n, total, kinds, once / (once + 2 * twice) if once else 0.5, docs.count())


def score_with(model: Model, docs: DataFrame, train) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of the documents; train is a Column that tells who taught the model."""
    n, n_buckets = model.segments, buckets(docs.sparkSession, text_bytes(docs))
    rows = docs.select(id_in().alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), train.alias("train"))
    rows = rows.select("_id", "text", "train", bucket(n_buckets))
    asked = rows.select("text", "bucket").mapInArrow(_ask(n), _ROWS)
    known = model.table.where(F.col("what").isin(WORDS, CONTEXT)).select("segment", "what", "keys", F.col("data").alias("counts"))
    answers = by_segment(asked.unionAll(known), n).mapInArrow(_answer(model.discount, model.documents, model.filters), _ANSWERS)
    scored = beside_answers(rows, answers, ["_id", "text", "train"], n_buckets).mapInArrow(
        _score(model.total, model.kinds, model.discount), "_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.select(id_out(F.col("_id")).alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, train) -> DataFrame:
    """score_with() a model of the rows that the Column train picks."""
    return score_with(learn(docs.where(train), segments(KEY_SHARE * text_bytes(docs))), docs, train)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return score(table(spark, sf_dir, "documents"), train)
