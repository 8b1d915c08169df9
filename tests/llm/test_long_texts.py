"""Texts of hundreds of thousands of words go whole through every operator on texts."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symbridge.llm import decontamination, language_model, licenses, lines, near_duplicates, packing, pii, quality, substrings

WORDS = 300_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(40_000)]
    body = rng.choices(vocabulary, k=WORDS)
    item = "what is the boiling point of the third compound of the list that follows after the second one in this long question of ours"
    body[5000] = "mail joe.smith@mail.example.com or 10.20.30.40"
    body[WORDS - 7] = "Released under the MIT License."
    body[WORDS - 3] = item
    for i in range(30, WORDS, 31):
        body[i] += "\n"
    long = " ".join(body)
    return {1: long, 2: long + " with some more words at its end", 3: "a short text of some words", 4: None, 5: "shared line that is long enough to be kept once"}, item


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(sorted(texts[0].items()), "doc_id long, text string").repartition(2).cache()


def test_licenses(docs, texts):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    words = licenses.template_words(texts[0][1].lower())
    at = next(i for i in range(len(words) - 1, 0, -1) if words[i : i + 2] == ["mit", "license"])
    for d in (1, 2):
        assert (got[d]["labels"], got[d]["base_labels"], got[d]["first_word"], got[d]["n_base"], got[d]["score"]) == ("mit", "mit", at, 1, 1.0)
    assert got[1]["n_words"] == len([w for w in words if w]) and got[3]["labels"] == ""


def test_decontamination(spark, docs, texts):
    bench = spark.createDataFrame([(7, texts[1]), (8, "another question that stands nowhere in these texts at all, whatever one asks of it")], "item_id long, text string")
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 7), (2, 7)} and all(texts[0][1][r["start"] : r["end"]].strip() == texts[1] for r in got if r["edits"] == 0)


def test_substrings(docs, texts):
    got = {r["doc_id"]: r for r in substrings.deduplicate(docs).collect()}
    n = len(texts[0][1].split())
    assert (got[1]["n_words"], got[1]["n_removed"], got[2]["n_removed"]) == (n, 0, n)
    assert got[2]["kept_sha256"] == hashlib.sha256(b"with some more words at its end").hexdigest()


def test_near_duplicates(docs):
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.join(docs).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_language_model(docs, texts):
    got = {r["doc_id"]: r for r in language_model.score(docs, F.col("doc_id") != 2).collect()}
    assert got[2]["n_tokens"] == len(texts[0][2].split()) + 1 and got[2]["score"] > got[2]["base_score"] and np.isfinite([r["score"] for r in got.values()]).all()


def test_personal_data(docs):
    got = {r["doc_id"]: r for r in pii.find(docs, pii.fit(docs)).collect()}
    assert [(got[d]["n_email"], got[d]["n_ip"]) for d in (1, 2, 3, 4)] == [(1, 1), (1, 1), (0, 0), (0, 0)]


def test_quality(docs, texts):
    got = {r["doc_id"]: r for r in quality.judge(docs, None).collect()}
    assert got[1]["n_words"] == len(texts[0][1].split()) and got[1]["kept"] and got[3]["base_failed"]


def test_packing(docs, texts):
    encoder = packing.Encoder(packing.default_tokenizer())
    want = {d: np.append(next(encoder.encode([t or ""])), 1).astype("<u4") for d, t in texts[0].items()}
    pieces = collections.defaultdict(list)
    for r in packing.pack(docs, packing.default_tokenizer()).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for d, ids in want.items():
        end = 0
        for start, length, crc in sorted(pieces[d]):
            assert start == end and crc == zlib.crc32(ids[start : start + length].tobytes())
            end += length
        assert end == len(ids)


def test_lines(docs, texts):
    got = {r["doc_id"]: r for r in lines.deduplicate(docs, 40, 2).collect()}
    each = texts[0][1].split("\n")
    held = {s.strip() for s in texts[0][2].split("\n")}
    stay = [s for s in each if len(s.strip()) < 40 or s.strip() not in held]
    assert (got[1]["n_lines"], got[1]["n_dropped"], got[1]["text"]) == (len(each), len(each) - len(stay), "\n".join(stay)) and got[1]["n_dropped"] > 9000
    assert got[2]["n_dropped"] == 0 and got[4]["n_lines"] == 1
