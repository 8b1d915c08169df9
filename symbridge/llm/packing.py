"""Packing: token sequences of a fixed length by non-negative least squares over length combinations.

Texts become token ids (an end id closes each), are cut into whole windows and one remainder, and the histogram of piece lengths
(at most `window` numbers, whatever the input) is all that the driver sees. It enumerates shallow combinations of lengths that
fill a window exactly, solves their repeat counts against the histogram by non-negative least squares, rounds them, and packs
what is left greedily (longest first, then the longest that fits). The plan is a table of runs "pieces number a..b of length l
go to sequences s.. at offset o"; pieces are numbered within their length by two small aggregates, so no group of equal lengths
is ever sorted or gathered.

Defined results: null or empty text: the end id alone. Null id: kept as null. Repeated rows: each is packed. Empty table: no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbridge.llm.shared import id_in, id_out, materialise, table

WINDOW = 2048
END_ID = 1
#: Step of the second length of a triple; pairs are enumerated in full.
TRIPLE_STEP = 64
ROUNDS = 80
CACHE_WORDS = 400_000

PIECES = "_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, seq long"

_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


# The byte-level pre-tokeniser's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def same_ids(tokenizer):
    """A tiktoken encoding of a byte-level `tokenizers` vocabulary, which gives the same ids several times faster."""
    import tiktoken

    # printable bytes stand for themselves in the vocabulary's strings, the others for the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=True).items() if token not in special}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts by a `tokenizers` file, each distinct word encoded once; texts with a special token as they are.

    The pre-tokeniser never joins the two sides of one space between non-spaces, so a text is cut there and the ids of the cuts
    are kept in a bounded table.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 65536 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.same = same_ids(self.tokenizer)
        (self.line_break,) = self.same.encode_ordinary("\n")
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], words: set[str], lead: str) -> None:
        new = [w for w in words if w not in known and w and w == w.strip()]  # others cannot be cut off at a space
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = [w for w in words if w and w == w.strip()]
        alone = [w for w in new if "\n" in w]
        known.update((w, np.array(self.same.encode_ordinary(lead + w), self.kind).tobytes()) for w in alone)
        new = [w for w in new if "\n" not in w]
        for i in range(0, len(new), 8192):  # a line break is a token of its own before a word
            some = new[i : i + 8192]
            ids = np.array(self.same.encode_ordinary("".join([f"\n{lead}{w}" for w in some])), self.kind)
            at = (np.append(np.flatnonzero(ids == self.line_break), len(ids)) * self.kind.itemsize).tolist()
            data, skip = ids.tobytes(), self.kind.itemsize
            known.update((w, data[a + skip : b]) for w, a, b in zip(some, at[:-1], at[1:], strict=True))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        cuts: list[list[str] | None] = []
        inner: set[str] = set()
        for text in texts:
            if any(s in text for s in self.special):
                cuts.append(None)
                continue
            cut = text.split(" ")
            inner.update(cut[1:])
            cuts.append(cut)
        self._learn(self.after_space, inner, " ")
        self._learn(self.at_start, {c[0] for c in cuts if c}, "")
        for text, cut in zip(texts, cuts, strict=True):
            if not text:
                yield np.zeros(0, self.kind)
            elif cut is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
            else:
                try:
                    yield np.frombuffer(self.at_start[cut[0]] + b"".join(map(self.after_space.__getitem__, cut[1:])), self.kind)
                except KeyError:  # white space beside a space
                    first, *rest = _INNER_SPACE.split(text)
                    yield np.array([i for x in (first, *(" " + r for r in rest)) for i in self.same.encode_ordinary(x)], self.kind)



_encoders: dict[str, Encoder] = {}


def _pieces(tokenizer: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                some = [t or "" for t in texts.slice(at, 256).to_pylist()]
                for doc, tokens in zip(ids.slice(at, 256).to_pylist(), encoder.encode(some), strict=True):
                    full = np.append(tokens, end_id).astype("<u4")
                    for start in range(0, len(full), window):
                        piece = full[start : start + window]
                        n = len(piece)
                        out.append((doc, start, n, zlib.crc32(piece.tobytes()), len(full), part, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.int32(), pa.int64()], strict=True)],
                    names=["_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq"],
                )

    return run


def combinations(held: np.ndarray, window: int, step: int = TRIPLE_STEP) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to window, over lengths that occur; held: count by length."""
    at = np.flatnonzero(held[: window + 1])
    at = at[at > 0]
    pairs = at[(2 * at <= window) & (held[window - at] > 0) & (at < window)]
    rows = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    for b in range(step, window, step):
        a = at[at <= b]
        c = window - b - a
        good = c >= b
        a, c = a[good], c[good]
        good = (held[b] > 0) & (held[c] > 0)
        rows.append(np.stack([a[good], np.full(int(good.sum()), b), c[good]], 1))
    return np.concatenate(rows)


def nonnegative_least_squares(rows: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - held|, A counting each combination's lengths, by multiplicative updates."""
    used = rows > 0
    goal = np.where(used, held[rows], 0).sum(1).astype(float)
    x = np.full(len(rows), held.sum() / max(1, 3 * len(rows)), float)
    for _ in range(rounds):
        now = np.bincount(rows.ravel(), np.where(used, x[:, None], 0).ravel(), len(held))
        x *= goal / np.maximum(np.where(used, now[rows], 0).sum(1), 1e-12)
    return x


def plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that together use each length exactly as often as it occurs."""
    held = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        held[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if held[window]:
        out.append(((window,), int(held[window])))
        held[window] = 0
    rows = combinations(held, window)
    if len(rows):
        times = np.rint(nonnegative_least_squares(rows, held)).astype(np.int64)
        for k in np.argsort(-times, kind="stable"):
            if times[k] < 1:
                break
            lengths = [int(v) for v in rows[k] if v]
            most = min(int(held[v]) // lengths.count(v) for v in lengths)
            if n := min(most, int(times[k])):
                out.append((tuple(lengths), n))
                for v in lengths:
                    held[v] -= n
    while held.any():
        left, room, lengths = held.copy(), window, []
        while room > 0 and len(fit := np.flatnonzero(left[: room + 1])):
            v = int(fit[-1])
            lengths.append(v)
            left[v] -= 1
            room -= v
        n = min(int(held[v]) // lengths.count(v) for v in set(lengths))
        out.append((tuple(lengths), n))
        for v in lengths:
            held[v] -= n
    return out


def runs(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first piece number, end, first sequence, offset) of the plan's places."""
    out, used, sequence = [], {}, 0
    for lengths, n in planned:
        offset = 0
        for v in lengths:
            first = used.get(v, 0)
            out.append((v, first, first + n, sequence, offset))
            used[v] = first + n
            offset += v
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all texts of docs (doc_id, text) with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = docs.select(id_in().alias("_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(cut.mapInArrow(_pieces(tokenizer, window, end_id), PIECES), "pieces")
    held = pieces.groupBy("length", "part").agg((F.max("seq") + 1).alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    places = spark.createDataFrame(runs(plan(counts, window)) or [(0, 0, 0, 0, 0)], "p_length long, p_first long, p_end long, p_sequence long, p_offset long")
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    numbered = pieces.join(held.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["length", "part"]).withColumn("number", F.col("before") + F.col("seq"))
    placed = numbered.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("number") >= F.col("p_first")) & (F.col("number") < F.col("p_end")))
    return placed.select(
        id_out(F.col("_id")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p_sequence") + F.col("number") - F.col("p_first")).alias("sequence_id"), F.col("p_offset").alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
