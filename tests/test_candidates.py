"""Whole-database candidates: classes by an inverted index, names by bags of characters, ten best, against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from symbridge.functions import similarity
from symbridge.jobs import QUERIES, join_queries
from symbridge.operators import matching
from tests.conftest import SF

FUNCTIONS = "rva bigint, name string, instruction_count bigint, size bigint, mnemonics map<string,bigint>, semantic_sha256 string"


def close(a, b):
    return 1.0 if a == b == 0 else min(a, b) / max(a, b)


def cos(a, b):
    if not a and not b:
        return 1.0
    x, y = sum(v * v for v in a.values()), sum(v * v for v in b.values())
    return sum(a[k] * b.get(k, 0) for k in a) / (x**0.5 * y**0.5) if x and y else 0.0


def name_ratio(a, b):
    a, b = ("" if n.startswith("sub_") else n.lower() for n in (a, b))
    return 0.5 if not a and not b else 0.25 if not a or not b else SequenceMatcher(None, a, b).ratio()


def eligible(a, b):
    if a[5] is not None and a[5] == b[5]:
        return True
    if close(a[2], b[2]) < 0.25 or close(a[3], b[3]) < 0.2:
        return name_ratio(a[1], b[1]) >= 0.72
    return cos(a[4], b[4]) >= 0.45


def functions(seed, n):
    rng = random.Random(seed)
    names = ["alpha_one", "alpha_two", "sub_1", "sub_2", "renderFrame", "renderFrames", "", "x" * 30]
    counts = lambda: {rng.choice("abcdef"): rng.randint(0, 4) for _ in range(rng.randint(0, 4))}
    return [(i, rng.choice(names), rng.choice([0, 1, 2, 7, 30, 100]), rng.choice([0, 16, 64, 900]), counts(), rng.choice(["h1", "h2", None, f"u{i}"])) for i in range(n)]


def test_ten_most_similar_equal_all_pairs(spark):
    fs = functions(4, 150)
    df = spark.createDataFrame(fs, FUNCTIONS)
    got = {}
    for r in matching.ten_most_similar(df.where("rva < 60"), df).collect():
        got.setdefault(r["t_rva"], []).append((r["rank"], r["f_rva"], round(r["cosine"], 9)))
    for a in fs[:60]:
        want = sorted(((-round(cos(a[4], b[4]), 12), -b[0]) for b in fs if eligible(a, b)))[:10]
        assert sorted(got.get(a[0], [])) == [(i + 1, -b, round(-c, 9)) for i, (c, b) in enumerate(want)], a


def test_candidates_keep_all_columns_with_many_targets(spark, monkeypatch):
    df = spark.createDataFrame(functions(5, 80), FUNCTIONS)
    few = sorted(map(str, matching.gated_candidates(df, df).collect()))
    monkeypatch.setattr(matching, "MOST_TARGETS", 3)
    assert sorted(map(str, matching.gated_candidates(df, df).collect())) == few and few


def test_ten_most_similar_on_the_tables(spark):
    p = {r["func"]: r for r in join_queries._profiled(spark, SF).collect()}
    ids = sorted(p)
    dims = sorted({k for r in p.values() for k in r["mnemonics"]})
    m = np.array([[p[i]["mnemonics"].get(d, 0) for d in dims] for i in ids], float)
    unit = np.sqrt((m * m).sum(1))
    cosine = np.round(m @ m.T / (unit[:, None] * unit[None]), 12)
    n, z = (np.array([p[i][c] for i in ids], float) for c in ("instruction_count", "size"))
    near = (np.minimum.outer(n, n) / np.maximum.outer(n, n) >= 0.25) & (np.minimum.outer(z, z) / np.maximum.outer(z, z) >= 0.2)
    sha = np.array([p[i]["semantic_sha256"] for i in ids])
    named = [i for i, f in enumerate(ids) if not p[f]["name"].startswith("sub_")]
    ok = near & (cosine >= 0.45 - 1e-13) | (sha[:, None] == sha[None])
    for i in named:
        for j in named:
            ok[i, j] |= not near[i, j] and name_ratio(p[ids[i]]["name"].replace(" ", ""), p[ids[j]]["name"].replace(" ", "")) >= 0.72
    got = {}
    for r in QUERIES["j15_ten_most_similar"](spark, SF).collect():
        got.setdefault(r["target"], []).append((r["rank"], r["candidate"]))
    for i, f in enumerate(ids):
        best = sorted(np.flatnonzero(ok[i]), key=lambda j: (-cosine[i, j], -ids[j]))[:10]
        assert sorted(got[f]) == [(k + 1, ids[j]) for k, j in enumerate(best)]


def test_names_meet_only_where_they_can_be_similar(spark):
    rng = random.Random(8)
    words = ["get", "Set", "Player", "actor", "Value", "Form", "update", "render", "Scene", "Light", "Quest", "Object", "Ref", "Handle", "::", "_", "2", "Ex"]
    names = ["".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(400)] + ["", "sub_12", None, "é" * 12, "É" * 12 + "x", "a" * 250 + "b", "a" * 240]
    left = spark.createDataFrame([(n,) for n in names[:200] + names[400:]], "left string").distinct()
    right = spark.createDataFrame([(n,) for n in names[100:]], "right string").distinct()
    got = {tuple(r) for r in similarity.similar_names(left, right, 0.72).collect()}
    every = similarity.name_similarity(left.crossJoin(right), "left", "right", "s")
    want = {(r["left"], r["right"]) for r in every.where(F.col("s") >= 0.72).collect()}
    assert got == want and len(want) > 100
    compared = similarity.name_candidates(left, right, 0.72).count()
    assert len(want) <= compared < 0.05 * every.count()


def test_few_of_the_names_of_the_tables_are_compared(spark):
    names = spark.read.parquet(f"{SF}/part.parquet").select(F.concat_ws("::", "p_name", "p_type", "p_brand").alias("n")).distinct()
    left, right = names.withColumnRenamed("n", "left"), names.withColumnRenamed("n", "right")
    compared, found = similarity.name_candidates(left, right, 0.72).count(), similarity.similar_names(left, right, 0.72).count()
    want = similarity.name_similarity(left.crossJoin(right), "left", "right", "s").where(F.col("s") >= 0.72).count()
    assert compared < 0.5 * names.count() ** 2
    assert found == want
