"""Substring deduplication: compressed FM-indexes per shard, searched for the matching statistics of streamed text.

Windows of `WINDOW` words are kept together by their minimiser (the smallest fingerprint of their `GRAM`-word runs): the windows of
one minimiser occurrence form a segment of at most 32 words, and equal windows always have equal minimisers. Segments whose
minimiser occurs once in the corpus cannot repeat and go no further. Equal segments become one, with its first place; all later
places are removed whole. The distinct segments are dealt to shards by minimiser; a shard builds a wavelet matrix over the
Burrows-Wheeler transform of its segments and searches the segments backward: each step prepends a word, and at a depth over
WINDOW the interval widens to that of the first WINDOW words, so it always holds all places of the window at hand. Where a place
before this one exists, the window is reported.

A minimiser that occurs more than `HOT` times (a passage that very many documents share, each with other words around it) is dealt
out window by window, by the window's own fingerprint, so that it spreads over all shards. The first pass, which counts the
minimisers, tells which these are, so distinct segments are never gathered or joined by minimiser to find out.

Word and window identity is by 64-bit fingerprints. Windows are judged on the input; all covered words are removed.

Defined results: null or empty text: no words, the hash of an empty text. Null id: smallest id, kept as null. Repeated rows (same id and
text): one document, judged alike. Rows of one id with different texts: judged apart, in the order of a hash of the text. Empty
table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.dictionaries import beside_answers, bucket, buckets, by_segment, columns_of, dealt, merged, pack, packed, segments, text_bytes, unpack
from symbridge.llm.shared import id_in, id_out, looked_up, materialise, table
from symbridge.llm.textops import BREAKS, Words, mixed, slices

WINDOW = 20
GRAM = 8
HOT = 4096
SHARD_WORDS = 1_000_000
FLUSH = 300_000

_ASKED = "segment int, bucket int, keys binary, counts binary"
_MARKED = "kind int, _id long, key long, start int, n int, mini long, words string, n_words long, sha string"


class Segments:
    """The segments of a run of rows: minimiser, row, first word (within the run of rows) and number of windows."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.words = words = Words(raw, at)
        h = words.grams(words.prints(), GRAM)
        grams = np.full(max(0, len(words) - GRAM + 1), np.iinfo(np.uint64).max, np.uint64)
        grams[h[1]] = h[0]
        self.mini = np.zeros(0, np.uint64)
        self.first = self.n = self.row = np.zeros(0, np.int64)
        span, count = WINDOW - GRAM + 1, len(words) - WINDOW + 1
        if count <= 0:
            return
        least, width = grams, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:count], least[span - width : span - width + count])
        whole = words.row[:count] == words.row[WINDOW - 1 :]
        fresh = np.ones(count, bool)
        # the same occurrence goes on unless the minimum changes, was the word that has been left, or another row begins
        fresh[1:] = (least[1:] != least[:-1]) | (grams[: count - 1] == least[:-1]) | ~whole[:-1]
        fresh &= whole
        self.first = np.flatnonzero(fresh)
        ends = np.append(self.first[1:], count)
        filled = np.concatenate([[0], np.cumsum(whole)])
        self.n = filled[ends] - filled[self.first]
        # the smallest fingerprints are all small, so they are mixed again to be spread over the segments
        self.mini, self.row = mixed(least[self.first]), words.row[self.first]


def _ask(n_segments: int):
    def flush(of: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        group, key = np.concatenate([*of, np.zeros(0, np.int32)]), np.concatenate([*keys, np.zeros(0, np.uint64)])
        order = np.lexsort((key, group))
        group, key = group[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])[: len(key)])
        counts = np.diff(np.append(first, len(key)))
        g, segment, k, c = packed(group[first], key[first], counts.astype(np.int64), n_segments)
        yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(g[: len(k)], pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["segment", "bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, keys, n = [], [], 0
        for batch in batches:
            buckets_ = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            for a, b, raw, at in slices(batch.column(0)):
                found = Segments(raw, at)
                of.append(buckets_[a:b][found.row])
                keys.append(found.mini)
                n += len(found.mini)
                if n >= FLUSH:
                    yield from flush(of, keys)
                    of, keys, n = [], [], 0
        yield from flush(of, keys)

    return run


def _repeated(hot: int):
    """Of each bucket's minimisers in a segment, those that occur more than once in the corpus (kind 0), and more than `hot` times (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := columns_of(batches)):
            return
        segment, of, asked, counted = rows
        keys, counts = merged(asked, counted)
        by: dict[int, list[bytes]] = {}
        for b, k in zip(of, asked, strict=True):
            by.setdefault(b, []).append(k)
        mine = [np.unique(unpack(k)) for k in by.values()]
        for kind, over in enumerate((1, hot)):
            often = keys[counts > over]
            told = [pack(m[np.isin(m, often, assume_unique=True)]) for m in mine]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), *(pa.array(np.full(len(by), x), pa.int32()) for x in (kind, segment[0])), pa.array(told, pa.binary())], names=["bucket", "kind", "part", "data"])

    return run


def joined(raw: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words with one space between, whatever stood there."""
    length = words.end - words.start
    starts = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    out = np.full(int(length.sum()) + len(words), 0x20, np.uint8)
    step = np.ones(int(length.sum()), np.int64)
    if len(words):
        at = np.cumsum(length)[:-1]
        step[at] = 2
        step[0] = 0
        out[np.cumsum(step)] = raw[~BREAKS[raw]]
    return out, starts, starts + length


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _MARKED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def none(k: int, n: int) -> pa.Array:
        return pa.nulls(n, kinds[k])

    def work(rows: pa.RecordBatch, keys: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, marks = rows.column("_id"), rows.column("key")
        for a, b, raw, at in slices(rows.column("text")):
            found = Segments(raw, at)
            words = found.words
            data, start, end = joined(raw, words)
            whole = data.tobytes()
            n = np.diff(words.first)
            shas = [hashlib.sha256(whole[start[x] : end[y - 1]] if y > x else b"").hexdigest() for x, y in zip(words.first[:-1], words.first[1:], strict=True)]
            mine = np.zeros(0, np.int64)
            if len(keys) and len(found.mini):
                mine = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, found.mini), len(keys) - 1)] == found.mini)
            again = np.zeros(b - a, bool)
            again[found.row[mine]] = True
            # only a document that may lose words is kept with its text
            kept = [whole[start[x] : end[y - 1]] if held else None for held, x, y in zip(again, words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(b - a), pa.int32()), ids.slice(a, b - a), marks.slice(a, b - a), *(none(k, b - a) for k in range(3, 6)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(shas)], names=names
            )
            if len(mine):
                first, last = found.first[mine], found.first[mine] + found.n[mine] + WINDOW - 2
                texts = [whole[x:y] for x, y in zip(start[first].tolist(), end[last].tolist(), strict=True)]
                row = pa.array(a + found.row[mine])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(1 + np.isin(found.mini[mine], hot), pa.int32()), ids.take(row), marks.take(row), pa.array(first - words.first[found.row[mine]], pa.int32()), pa.array(found.n[mine], pa.int32()), pa.array(found.mini[mine].view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), none(7, len(mine)), none(8, len(mine))],
                    names=names,
                )

    for answers, documents in dealt(batches):
        keys, hot = (unpack(answers.get(kind, [])) for kind in (0, 1))  # sorted, as segments are in order
        for rows in documents:
            yield from work(rows, keys, hot)


class Bits:
    """A bit vector with the number of ones before each block of 64 bits: half a bit more for each bit."""

    def __init__(self, bits: np.ndarray):
        held = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed_ = np.packbits(bits.astype(np.uint8), bitorder="little")
        held[: len(packed_)] = packed_
        self.blocks = held.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks))[:-1]]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.blocks[block] & mask)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The place of each one, by its number from 0."""
        block = np.searchsorted(self.before, number, "right") - 1
        word, rest, low = self.blocks[block], number - self.before[block].astype(np.int64), np.zeros(len(number), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count((word >> low.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            go = ones <= rest
            rest, low = np.where(go, rest - ones, rest), np.where(go, low + width, low)
        return (block << 6) + low


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector for each bit of a symbol, from the highest."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        depth, self.levels, now = max(1, int(kinds - 1).bit_length()), [], symbols
        start, every = np.zeros(kinds, np.int64), np.arange(kinds)
        for level in reversed(range(depth)):
            bit = ((now >> level) & 1).astype(bool)
            bits, zeros = Bits(bit), len(now) - int(bit.sum())
            self.levels.append((level, bits, zeros))
            ones = bits.rank(start)
            start = np.where((every >> level) & 1, zeros + ones, start - ones)
            now = np.concatenate([now[~bit], now[bit]])
        self.start = start

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at - self.start[symbols]


class FMIndex:
    """A compressed Burrows-Wheeler index of segments of word numbers (1..), each closed by 0, sorted to a depth over WINDOW.

    Held are the wavelet matrix, a bit for each suffix that begins another first WINDOW words, a bit for each such group of several, and the
    first place of those groups; suffixes themselves and their groups are dropped when these are made.
    """

    def __init__(self, text: np.ndarray, kinds: int):
        n = len(text)
        rank, depth, kept = text.astype(np.int64), 1, {}
        while depth <= WINDOW:
            kept[depth] = rank
            ahead = np.zeros(n, np.int64)
            ahead[: n - depth] = rank[depth:]
            key = rank * (int(rank.max(initial=0)) + 1) + ahead
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            depth *= 2
        rest, same = WINDOW, np.ones(n - 1, bool)
        # neighbours in order that agree on their first WINDOW words, told from the ranks at powers of two
        shift = 0
        for power in sorted(kept, reverse=True):
            if rest >= power:
                ranks = np.zeros(n + WINDOW, np.int64)
                ranks[:n] = kept[power]
                same &= ranks[order[1:] + shift] == ranks[order[:-1] + shift]
                rest, shift = rest - power, shift + power
        begins = np.concatenate([[True], ~same, [True]])
        low = np.flatnonzero(begins[:-1])
        several = np.diff(np.append(low, n)) > 1
        self.begins, self.several = Bits(begins), Bits(several)
        self.first = np.minimum.reduceat(order, low)[several].astype(np.int32)
        self.bwt = WaveletMatrix(text[order - 1], kinds)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])[:-1].astype(np.int32)

    def backward(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns with one more word before them."""
        return self.less[words] + self.bwt.rank(words, low), self.less[words] + self.bwt.rank(words, high)

    def widened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, first place) of the interval of the first WINDOW words at each place; the first place of a lone one is beyond all."""
        group = self.begins.rank(low + 1) - 1
        low, high = self.begins.select(group), self.begins.select(group + 1)
        first = np.full(len(low), np.iinfo(np.int32).max, np.int64)
        many = np.flatnonzero(high - low > 1)
        first[many] = self.first[self.several.rank(group[many])]
        return low, high, first


def repeated_windows(text: np.ndarray, kinds: int, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which places of text begin a window that also begins earlier; segments (first, length) are streamed backward, all at once."""
    index, out = FMIndex(text, kinds), np.zeros(len(text), bool)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    low, high = np.zeros(len(first), np.int64), np.full(len(first), len(text))
    for step in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -step, "left"))  # segments longer than step
        low, high = low[:n], high[:n]
        at = first[:n] + length[:n] - 1 - step
        low, high = index.backward(text[at], low, high)
        if step >= WINDOW - 1:
            low, high, earliest = index.widened(low)
            out[at] = earliest < at
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).sort_by([("_id", "ascending"), ("key", "ascending"), ("start", "ascending")])
    prints, count = [], []
    for column in rows.column("words").chunks:
        for _, _, raw, at in slices(column):
            words = Words(raw, at)
            prints.append(words.prints())
            count.append(np.diff(words.first))
    length = np.concatenate(count)
    kinds, number = np.unique(np.concatenate(prints), return_inverse=True)
    first = np.cumsum(length + 1) - length - 1
    text = np.zeros(int(length.sum()) + len(length), np.int64)
    text[np.arange(len(number)) + np.repeat(np.arange(len(length)), length)] = number + 1
    again = repeated_windows(text, len(kinds) + 1, first, length)
    before = np.concatenate([[False], again[:-1]])
    begins, ends = np.flatnonzero(again & ~before), np.flatnonzero(np.append(~again & before, again[-1:]))  # segments are closed by 0, so runs end within them
    of = np.searchsorted(first, begins, "right") - 1
    a = rows.column("start").combine_chunks().to_numpy(zero_copy_only=False)[of] + begins - first[of]
    at = pa.array(of)
    yield pa.RecordBatch.from_arrays([rows.column("_id").combine_chunks().take(at), rows.column("key").combine_chunks().take(at), pa.array(a, pa.int32()), pa.array(a + ends - begins + WINDOW - 1, pa.int32())], names=["_id", "key", "a", "b"])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, runs = batch.column(0), batch.column(1), batch.column(3)
        for lo, hi, raw, at in slices(batch.column(2)):
            words = Words(raw, at)
            gone = np.zeros(len(words) + 1, np.int64)
            for r in range(hi - lo):
                values = runs[lo + r].values
                a, b = (words.first[r] + values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
            gone = np.cumsum(gone)[:-1] > 0
            data, start, end = joined(raw, words)
            whole, removed, shas = data.tobytes(), [], []
            for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                kept = x + np.flatnonzero(~gone[x:y])
                removed.append(y - x - len(kept))
                cut = np.flatnonzero(np.diff(kept) > 1)
                from_, to = kept[np.concatenate([[0], cut + 1])] if len(kept) else kept, kept[np.append(cut, len(kept) - 1)] if len(kept) else kept
                shas.append(hashlib.sha256(b" ".join(whole[start[i] : end[j]] for i, j in zip(from_, to, strict=True))).hexdigest())
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), pa.array(removed, pa.int64()), pa.array(shas)], names=["_id", "key", "n_removed", "kept"])


def removals(marked: DataFrame) -> DataFrame:
    """(_id, key, a, b): ranges of words covered by windows that start earlier elsewhere; marked has the segments (kind 1, and 2 where the minimiser is hot)."""
    place = F.struct("_id", "key", "start")
    each = marked.where("kind > 0").select("_id", "key", "start", "n", "mini", "words", "kind", F.xxhash64("mini", "words").alias("same"))
    firsts = each.groupBy("same").agg(F.min(F.struct("_id", "key", "start", "n", "mini", "words", "kind")).alias("f"), F.count("*").alias("times")).select("same", "times", "f.*")
    firsts = materialise(firsts, "segments")
    # only segments that occur again are looked up; places of one that very many have are told by broadcast, and not gathered
    known = lambda df, key: df.where("times > 1").select(key, place.alias("place"), "times")
    apart = F.struct("_id", "key", "start") != F.col("place")
    later = looked_up(each.select("_id", "key", "start", "n", "same"), known(firsts, "same"), ["same"], ["place"], "times", held=True).where(apart)
    cold = firsts.where("kind = 1").select(F.col("mini").alias("route"), "_id", "key", "start", "words")
    parts = firsts.where("kind = 2").select("_id", "key", "start", F.split("words", " ").alias("w"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    window = F.array_join(F.slice("w", F.col("i") + 1, WINDOW), " ")
    windows = parts.select("_id", "key", (F.col("start") + F.col("i")).cast("int").alias("start"), window.alias("words"))
    windows = materialise(windows.select("_id", "key", "start", "words", F.xxhash64("words").alias("route")), "windows")
    single = materialise(windows.groupBy("route").agg(F.min(F.struct("_id", "key", "start", "words")).alias("f"), F.count("*").alias("times")).select("route", "times", "f.*"), "single")
    elsewhere = looked_up(windows.select("_id", "key", "start", "route"), known(single, "route"), ["route"], ["place"], "times", held=True).where(apart)
    shards = max(1, -(-(firsts.count() + windows.count() // 2) * 30 // SHARD_WORDS))
    found = cold.unionByName(single.drop("times")).repartition(max(shards, 1), "route").select("_id", "key", "start", "words").mapInArrow(_shard, "_id long, key long, a int, b int")
    cover = lambda df, n: df.select("_id", "key", F.col("start").alias("a"), (F.col("start") + n + WINDOW - 1).cast("int").alias("b"))
    return found.unionAll(cover(later, F.col("n"))).unionAll(cover(elsewhere, F.lit(1)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    n_bytes = text_bytes(docs)
    n, n_buckets = segments(n_bytes // 2), buckets(docs.sparkSession, n_bytes)
    rows = docs.select(id_in().alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("_id", "text", F.xxhash64("text").alias("key"), bucket(n_buckets))
    asked = rows.select("text", "bucket").mapInArrow(_ask(n), _ASKED)
    answers = by_segment(asked, n).mapInArrow(_repeated(HOT), "bucket int, kind int, part int, data binary")
    marked = materialise(beside_answers(rows, answers, ["_id", "key", "text"], n_buckets).mapInArrow(_mark, _MARKED), "marked")
    runs = removals(marked).groupBy("_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))  # bounded by the document
    held = marked.where("kind = 0 AND words IS NOT NULL").select("_id", "key", "words")
    rest = held.join(runs, ["_id", "key"]).select("_id", "key", "words", "runs").mapInArrow(_rest, "_id long, key long, n_removed long, kept string")
    rest = rest.groupBy("_id", "key").agg(F.max("n_removed").alias("n_removed"), F.max("kept").alias("kept"))
    whole = marked.where("kind = 0").select("_id", "key", "n_words", "sha")
    return whole.join(rest, ["_id", "key"], "left").select(id_out(F.col("_id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


ORACLE = """
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i AS start, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM words, unnest(range(1, len(w) - 18)) AS t(i)),
firsts AS (SELECT h, min(doc_id * 10000000 + start) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, start + k AS pos FROM windows JOIN firsts USING (h), unnest(range(0, 20)) AS t(k) WHERE doc_id * 10000000 + start > first),
each AS (SELECT doc_id, i AS pos, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY pos) AS rest FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM words LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
