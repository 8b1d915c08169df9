"""Personal data by a skip-chain conditional random field over the tokens of each document.

Fixed patterns find the base spans (email, ip, card, phone). Tokens with a digit or an at sign are the nodes of a random field
per document: node potentials from token shape, chain potentials between neighbours, and skip potentials between tokens that are the
same or similar (same letters and digits, same name at a host), however far away: each is tied to the first of them that is base, or
else to the first. Loopy message passing, until messages rest, gives marginals; a token whose best label is a kind becomes a further
span. Base tokens are clamped to their kind, so base spans always stay. All other tokens are "none" by definition and drop out of the
graph.

Node, chain and skip weights are trained together, by pseudo-likelihood, on at most `SAMPLE_DOCS` documents and `SAMPLE_TOKENS` tokens,
labelled by the base patterns. Half of the tokens are hidden in training: their shape is not seen and they count as no base
token, so that what a neighbour or a repeat tells must be learnt from the edges.

Defined results: null or empty text: no spans. Null id: kept as null. Repeated rows: judged alike. Empty table: no rows. Extra
columns are ignored (kept by redact()). Long texts cost linear time: no pattern backtracks over a run more than once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 2000
SAMPLE_TOKENS = 20_000
#: Message passing ends when no message changes by more than TOLERANCE, or after ROUNDS.
TOLERANCE = 1e-3
ROUNDS = 200

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CLUE = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_PLAIN = re.compile(r"[^0-9a-z]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    if not _CLUE.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


N_FEATURES = 18


def _features(token: str) -> list[float]:
    digits = len(_DIGITS.findall(token))
    letters = sum(c.isalpha() for c in token)
    host = token.rpartition("@")[2] if "@" in token else ""
    parts = token.strip(".,;:!?()").split(".")
    four = len(parts) == 4 and all(p.isdigit() for p in parts)
    card = 13 <= digits <= 19 and luhn("".join(_DIGITS.findall(token)))
    return [
        1.0, float("@" in token), float("." in host.strip(".")), float(token.count("@") == 1 and token[0] != "@"), float(digits >= 3), float(digits >= 7),
        float(9 <= digits <= 15), float(card), float(13 <= digits <= 19 and not card), float(letters == 0), letters / len(token),
        float(four), float(four and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in parts)),
        float(len(parts) == 4 and letters == 0), float(token[0] == "+"), float("-" in token and letters == 0), float(digits == 4 and letters == 0), min(len(token), 40) / 40,
    ]


@dataclass
class Graph:
    """The nodes of some documents: their row, place, features, base label (0: none), the neighbour before (or -1), and skip edges (pairs of nodes)."""

    row: array
    start: array
    end: array
    features: np.ndarray
    label: array
    chain: array
    skip: np.ndarray
    hidden: np.ndarray


def graph(texts: list[str], spans: list[list[Span]], hide: Callable[[int, int], bool] | None = None) -> Graph:
    """The graph of some documents with their base spans; hide (of row and place) tells which tokens are hidden."""
    row, begin, end, label, chain, features, hidden = array("q"), array("q"), array("q"), array("b"), array("q"), array("f"), array("b")
    skip: list[tuple[int, int]] = []
    for r, (text, base) in enumerate(zip(texts, spans, strict=True)):
        if not _CLUE.search(text):
            continue
        alike: dict[str, list[int]] = {}
        base_at = sorted((a, b, k) for k, a, b in base)
        near, reach, here = 0, [], (-1, -1)  # spans that may cover the token; index and word number of the node before
        for number, m in enumerate(_WORD.finditer(text)):
            token = m[0]
            if not _CLUE.search(token):
                continue
            while near < len(base_at) and base_at[near][0] < m.end():
                reach.append(base_at[near])
                near += 1
            reach = [s for s in reach if s[1] > m.start()]
            me = len(row)
            row.append(r)
            a, b = m.span()
            while b > a + 1 and text[b - 1] in ".,;:!?)\"'":
                b -= 1
            while a < b - 1 and text[a] in "(\"'":
                a += 1
            begin.append(a)
            end.append(b)
            features.extend(_features(token))
            label.append(min((1 + k for _, _, k in reach), default=0))
            hidden.append(hide is not None and hide(r, a))
            chain.append(here[0] if here[1] == number - 1 else -1)
            plain = _PLAIN.sub("", token.lower())
            name = token.lower().partition("@")[0].strip("(\"'") if "@" in token[1:] else ""
            for k in [plain] * (len(plain) >= 4) + ["@" + name] * (len(name) >= 3):
                alike.setdefault(k, []).append(me)
            here = (me, number)
        for same in alike.values():
            anchor = next((i for i in same if label[i] and not hidden[i]), same[0])
            skip += [(i, anchor) for i in same if i != anchor]
    edges = np.unique(np.sort(np.array(skip, np.int64).reshape(-1, 2), 1), axis=0)
    return Graph(row, begin, end, np.frombuffer(features, np.float32).reshape(-1, N_FEATURES), label, chain, edges, np.frombuffer(hidden, np.int8).astype(bool))


@dataclass
class Field:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels of the token before x labels
    skip: np.ndarray  # labels x labels, symmetric

    def label(self, g: Graph) -> np.ndarray:
        """The label of the largest marginal of each node."""
        fixed = np.array(g.label, np.int64)
        return np.where(fixed > 0, fixed, self.marginals(g).argmax(1))

    def marginals(self, g: Graph) -> np.ndarray:
        """The logarithm of each node's marginal, but for a constant, by damped loopy message passing; base nodes are clamped."""
        unary = g.features @ self.node
        fixed = np.array(g.label, np.int64)
        unary[fixed > 0] = -30
        unary[np.flatnonzero(fixed > 0), fixed[fixed > 0]] = 30
        back = np.array(g.chain, np.int64)
        after = np.flatnonzero(back >= 0)
        of, to = np.concatenate([back[after], g.skip[:, 0]]), np.concatenate([after, g.skip[:, 1]])
        if len(of):
            kind = np.repeat([0, 1], [len(after), len(g.skip)])
            source, target = np.concatenate([of, to]), np.concatenate([to, of])
            weight = np.stack([self.chain, self.skip])[kind]
            weight = np.concatenate([weight, weight.transpose(0, 2, 1)])  # [message, source label, target label]
            reverse = np.concatenate([np.arange(len(to)) + len(to), np.arange(len(to))])
            message = np.zeros((len(source), unary.shape[1]))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                out = (belief[source] - message[reverse])[:, :, None] + weight
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None]).sum(1))
                new = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
                change = np.abs(new - message).max()
                message = new
                if change < TOLERANCE:
                    break
            np.add.at(unary, target, message)
        return unary


def train(features: np.ndarray, label: np.ndarray, before: np.ndarray, after: np.ndarray, skip: np.ndarray, rounds: int = 400) -> Field:
    """All weights together, by pseudo-likelihood: each label given the token's features, the labels before and after (-1: none) and the counts of labels at its skip edges."""
    n = len(KINDS) + 1
    goal = np.eye(n)[label]
    one = lambda x: np.eye(n)[np.maximum(x, 0)] * (x >= 0)[:, None]
    before, after, size = one(before), one(after), max(1, len(label))
    field = Field(np.zeros((features.shape[1], n)), np.zeros((n, n)), np.zeros((n, n)))
    moment = [np.zeros_like(w) for w in (field.node, field.chain, field.skip)]
    for _ in range(rounds):
        z = features @ field.node + before @ field.chain + after @ field.chain.T + skip @ field.skip
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        rest = (goal - p) / size
        pull = skip.T @ rest
        slopes = (features.T @ rest, before.T @ rest + (after.T @ rest).T, (pull + pull.T) / 2)
        for w, m, slope in zip((field.node, field.chain, field.skip), moment, slopes, strict=True):
            m *= 0.9
            m += slope - 1e-4 * w
            w += 0.5 * m
    return field


def _hidden(doc: int, at: int) -> bool:
    return bool(zlib.crc32(f"{doc}:{at}".encode()) & 1)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Field:
    """A field trained on a bounded sample: the documents with a digit or an at sign of the smallest id hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    picked = texts.select("doc_id").dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    n = len(KINDS) + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            g = graph(some, [base_spans(t) for t in some], lambda r, a: _hidden(ids[r], a))
            label, chain = np.array(g.label, np.int64), np.array(g.chain, np.int64)
            before, after, skip = np.full(len(label), -1), np.full(len(label), -1), np.zeros((len(label), n))
            held = np.flatnonzero(chain >= 0)
            before[held], after[chain[held]] = label[chain[held]], label[held]
            for i, j in (g.skip.T, g.skip.T[::-1]):
                np.add.at(skip, (i, label[j]), 1)
            seen = np.where(g.hidden[:, None] & (np.arange(N_FEATURES) > 0), 0, g.features)  # the bias stays
            lists = lambda x: pa.array(x.astype(float).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r in g.row], pa.int64()), pa.array(g.start, pa.int64()), lists(seen), *(pa.array(x, pa.int32()) for x in (label, before, after)), lists(skip)],
                names=["doc_id", "start", "f", "label", "before", "after", "skip"],
            )

    known = texts.join(F.broadcast(picked), "doc_id").mapInArrow(rows, "doc_id long, start long, f array<double>, label int, before int, after int, skip array<double>")
    held = known.orderBy(F.xxhash64("doc_id"), "doc_id", "start", "f").limit(sample_tokens).collect()
    column = lambda c, width: np.array([r[c] for r in held], float).reshape(-1, width)
    return train(column("f", N_FEATURES), *(np.array([r[c] for r in held], int) for c in ("label", "before", "after")), column("skip", n))


def spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind, then start."""
    base = [base_spans(t) for t in texts]
    g = graph(texts, base)
    more: dict[int, list[Span]] = {}
    if g.row:
        label = field.label(g)
        for i in np.flatnonzero((label > 0) & (np.array(g.label, np.int64) == 0)):
            more.setdefault(g.row[i], []).append((int(label[i]) - 1, g.start[i], g.end[i]))
    return [(b, sorted(b + more.get(r, []))) for r, b in enumerate(base)]


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = spans([t or "" for t in batch.column(1).slice(at, 1024).to_pylist()], field)
                counts = [[sum(s[0] == k for s in b) for b, _ in found] for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1024), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]), pa.array([written(a) for _, a in found])],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, found: list[Span]) -> str:
    """text with each span (the longer of overlapping ones) replaced by its kind in brackets."""
    out, end = [], 0
    for k, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs, all columns, with every span of text replaced; n_chars, if there, is the new length."""
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [None if t is None else redacted(t, s) for t, (_, s) in zip(texts, spans([t or "" for t in texts], field), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in new], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
