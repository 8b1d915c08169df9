"""Every registered query against its SQL on the smallest tables, and the plans at large."""

import itertools
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from symbridge.jobs import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import TABLES, same


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, key):
    same(spark, QUERIES[key], ORACLES[key], SF)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def ratio(a, b, junk=True):
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=junk).ratio()


def test_sequence_ratios_of_all_turns_are_difflibs(spark):
    turns = {(r["conv_id"], r["turn"]): r["text"] or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = {(r["conv_id"], r["turn"]): r["ratio"] for r in QUERIES["m4_sequence_ratio"](spark, SF).collect()}
    assert got == {k: pytest.approx(ratio(t, turns[k[0], k[1] + 1]), abs=1e-6) for k, t in turns.items() if (k[0], k[1] + 1) in turns}


def test_name_similarities_are_difflibs(spark):
    kind = r"^(?:qword|dword|word|byte|unk|off|stru|asc|loc|sub)_[0-9a-f]+$"
    pair = lambda n: re.sub(r"\s+", "", re.sub(r"0x[0-9a-f]+|[0-9a-f]{7,}", "#", re.sub(r"^(?:j_|nullsub_|sub_)[0-9a-f]+$", "", n.lower())))
    reference = lambda n: re.sub(r"[^a-z0-9_]+", "", re.sub(r"[0-9a-f]{7,}", "#", re.sub(kind, "", n.lower())))
    plain = lambda n: re.sub(r"[^a-z0-9_]+", "", n.lower())
    names = {r["p_partkey"]: (r["p_name"], f"sub_{r['p_partkey']:X}" if r["p_partkey"] % 4 == 0 else f"{r['p_type']} {r['p_name']}") for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    got = QUERIES["m5_name_similarity"](spark, SF).collect()
    assert len(got) == len(names)
    for r in got:
        a, b = names[r["p_partkey"]]
        x, y, u, v = pair(a), pair(b), reference(a), reference(b)
        assert r["pair"] == pytest.approx(0.5 if not x and not y else 0.25 if not x or not y else ratio(x, y), abs=1e-6)
        assert r["reference"] == pytest.approx(ratio(u, v) if u and v else 0.0, abs=1e-6)
        assert r["strict"] == pytest.approx(0.0 if re.match(kind, a.lower()) or re.match(kind, b.lower()) else ratio(plain(a), plain(b)), abs=1e-6)


def test_context_scores_are_difflibs(spark):
    from symbridge.jobs.registry import view

    by = {}
    for r in view(spark, SF, "instr").collect():
        by.setdefault(r["func"], {})[r["idx"]] = (r["sig"], r["mnemonic"])
    want = {}
    for f, old in by.items():
        new = by.get(f + 1)
        if f % 2 == 0 and new:
            window = lambda b, i: [b[k][0] for k in range(max(0, i - 3), min(len(b), i + 4))]
            for i, j in itertools.product(old, new):
                place = abs(i / max(1, len(old) - 1) - j / max(1, len(new) - 1))
                score = 0.4 * ratio(old[i][0], new[j][0]) + 0.35 * ratio(window(old, i), window(new, j)) + 0.2 * max(0, 1 - place) + 0.05 * (old[i][1] == new[j][1])
                want[f, i, j] = pytest.approx(min(1, score + 0.15) if f % 3 == 0 and i == j else score, abs=2e-6)
    assert {(r["func"], r["idx"], r["new_idx"]): r["score"] for r in QUERIES["m8_context_score"](spark, SF).collect()} == want


def test_decompile_scores_are_difflibs(spark):
    from symbridge.functions.scalars import mnemonic_sequence, normalize_pseudocode

    c = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text", normalize_pseudocode(F.col("text")).alias("p"), mnemonic_sequence(F.split("text", "\n")).alias("m")).collect()
    turns = {(r["conv_id"], r["turn"]): r for r in c}
    near = lambda a, b: 1.0 if a == b == 0 else min(a, b) / max(a, b)
    want = {}
    for k, a in turns.items():
        if b := turns.get((k[0], k[1] + 1)):
            s, t = set(a["text"].split(" ")), set(b["text"].split(" "))
            lines = near(len(a["text"].split("\n")), len(b["text"].split("\n")))
            want[k] = pytest.approx(0.35 * ratio(a["p"], b["p"], False) + 0.3 * ratio(a["m"], b["m"], False) + 0.15 * near(len(a["text"]), len(b["text"])) + 0.1 * lines + 0.1 * len(s & t) / len(s | t), abs=2e-6)
    assert {(r["conv_id"], r["turn"]): r["score"] for r in QUERIES["m9_decompile_score"](spark, SF).collect()} == want


def test_decompile_comparison_is_difflibs(spark):
    from symbridge.functions.scalars import mnemonic_sequence, normalize_pseudocode

    c = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text", normalize_pseudocode(F.col("text")).alias("p"), mnemonic_sequence(F.split("text", "\n")).alias("m")).collect()
    turns = {(r["conv_id"], r["turn"]): r for r in c if r["text"] is not None}
    near = lambda a, b: 1.0 if a == b == 0 else min(a, b) / max(a, b)
    want = {}
    for k, a in turns.items():
        if b := turns.get((k[0], k[1] + 1)):
            if k[1] % 2:
                first = lambda t: t["text"][:64].encode().hex()
                want[k[0] * 1000 + k[1]] = pytest.approx(ratio(first(a), first(b), False), abs=2e-6)
            else:
                s, t = set(a["text"].split(" ")), set(b["text"].split(" "))
                calls = near(a["text"].count(",") + 1, b["text"].count(",") + 1)
                want[k[0] * 1000 + k[1]] = pytest.approx(0.35 * ratio(a["p"], b["p"], False) + 0.3 * ratio(a["m"], b["m"], False) + 0.15 * near(len(a["text"]), len(b["text"])) + 0.1 * calls + 0.1 * len(s & t) / len(s | t), abs=2e-6)
    assert {r["og_id"]: r["combined_score"] for r in QUERIES["m9_decompile_comparison"](spark, SF).collect()} == want


def test_batched_ratios_are_difflibs():
    import random

    from symbridge.functions import sequences

    rng = random.Random(9)
    word = lambda k, n: "".join(rng.choices("abcdefgh"[:k], k=n))
    pairs = [(word(k := rng.randint(1, 8), rng.choice([0, 1, 3, 9, 30, 63, 64, 65, 150])), word(k, rng.choice([0, 1, 5, 12, 40, 64, 70]))) for _ in range(6000)]
    pairs += [(word(5, rng.randint(100, 260)), word(5, rng.randint(190, 320))) for _ in range(150)]
    pairs += [(a, "".join(c for c in a if rng.random() < 0.9)) for a in (word(8, rng.randint(0, 64)) for _ in range(2000))] + [("é\U0001f600x", "\U0001f600é"), ("", "")]
    for junk in (True, False):
        got = sequences.ratios([a for a, _ in pairs], [b for _, b in pairs], junk)
        assert got.tolist() == [SequenceMatcher(None, a, b, autojunk=junk).ratio() for a, b in pairs]
    lists = [([rng.choice(["mov", "add", "ret", "x" * 20]) for _ in range(rng.randint(0, 9))], [rng.choice(["mov", "add", "jmp"]) for _ in range(rng.randint(0, 9))]) for _ in range(2000)]
    assert sequences.ratios([np.array(a, object) for a, _ in lists], [np.array(b, object) for _, b in lists]).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in lists]


@pytest.mark.parametrize("key", ["j7_ceiling_lookup", "j10_containing_function", "j15_gated_candidates", "p17_ranges", "a8_coverage_report", "w11_dense_groups"])
def test_no_cartesian_product(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    """sf0.001 eight times, with keys of orders of one to seven digits."""
    folder, copies = str(tmp_path_factory.mktemp("long_keys")), spark.range(8).select(F.when(F.col("id") > 0, 990_000 + F.col("id") * 1501).otherwise(0).alias("by"))
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        rows.crossJoin(copies).withColumn(key, F.col(key) + F.col("by")).select(rows.columns).write.parquet(f"{folder}/{table}.parquet")
    for table in set(TABLES) - {"orders", "lineitem"}:
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("key", ["j15_gated_candidates", "j15_ten_most_similar"])
def test_candidates_equal_sql_with_long_keys(spark, long_keys, key):
    same(spark, QUERIES[key], ORACLES[key], long_keys)


@pytest.mark.parametrize("key", ["j21_type_chain", "j22_valid_locators", "s10_discovered_headers"])
def test_words_of_a_memory_are_not_broadcast(spark, key):
    # some ten words are unpacked from each row, so their size looks like that of the rows
    assert "BroadcastExchange" not in QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pair_scores_come_from_few_scans_and_shuffles(spark):
    plan = QUERIES["m6_pair_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= 3 and len(re.findall("Exchange ", plan)) <= 4


def test_labels_of_components_are_not_broadcast(spark):
    from symbridge.operators.components import checkpointed, components

    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a bigint, b bigint")
    assert sorted(map(tuple, components(links, cut=cut).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_key_differences_are_one_aggregate(spark):
    from symbridge.operators.lookups import key_differences

    a, b = (spark.createDataFrame([(k,) for k in keys], "k bigint") for keys in ([1, 1, 2, None, None], [2, 3, None]))
    out = key_differences(a, b, "k")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "left"), (3, "right"), (None, "left"), (None, "right")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["w10_first_last_wins"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_counts_of_a_function_are_dealt_once(spark):
    # a side of the cosines is shuffled as instructions and not again; the lines of pair scores are dealt once, for numbering and buckets
    plan = QUERIES["m2_cosine"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) <= 3 and "l_quantity" not in plan
    from symbridge.jobs import score_queries
    from symbridge.operators import profiles

    seen, table = [], profiles.clustered
    try:
        profiles.clustered = lambda rows, *a, **k: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or table(rows, *a, **k)
        score_queries.m6(spark, SF)
        score_queries.m8(spark, SF)
    finally:
        profiles.clustered = table
    assert [len(re.findall(r"\bExchange ", p)) for p in seen] == [1, 1] and all("REPARTITION_BY_NUM" in p for p in seen)


def test_long_pairs_are_matched_together(monkeypatch):
    import random

    import pyarrow as pa

    from symbridge.functions import sequences

    rng = random.Random(3)
    text = lambda k, n: "".join(rng.choices("abcdefghijklmnopqrst"[:k], k=n))
    old = [text(rng.randint(1, 20), rng.choice([65, 129, 254, 255, 400, 900])) for _ in range(60)]
    pairs = [(a, text(20, 300)) for a in old] + [(a, a[: len(a) // 3] + "Z" + a[len(a) // 3 :]) for a in old] + [("ab" * 300, "ba" * 310), ("\U0001f600" * 70 + "x", "x" + "\U0001f600" * 90), ("a" * 500, "b")]
    want = [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    monkeypatch.setattr(sequences, "SequenceMatcher", None)  # none of these is matched by itself
    assert sequences.ratios([a for a, _ in pairs], [b for _, b in pairs], False).tolist() == want
    twice = pairs + [(None, "a"), ("a", None), ("", ""), ("", "a")] + pairs[::-1]
    got = sequences.column_ratios(pa.array([a for a, _ in twice]), pa.array([b for _, b in twice]), False)
    assert got.to_pylist() == [*want, None, None, 1.0, 0.0, *want[::-1]]
    lists = sequences.column_ratios(pa.array([None, ["a", "b", None], [], ["q"], ["x", "y", "x"]])[1:], pa.array([["a"], ["b", None, "a"], [], None, ["y", "x"]])[1:])
    assert lists.to_pylist() == [pytest.approx(4 / 6), 1.0, None, pytest.approx(0.8)]


def test_evidence_numbers_instructions_once(spark):
    plan = QUERIES["d5_review_evidence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # its lists read what was numbered, once for both sides


def test_reports_make_text_after_sorting(spark, monkeypatch):
    from symbridge.sources import listings

    plans = []
    write = listings.write_text
    monkeypatch.setattr(listings, "write_text", lambda lines, *rest, **more: (plans.append(lines._jdf.queryExecution().optimizedPlan().toString()), write(lines, *rest, **more)))
    QUERIES["s7_comparison_workload"](spark, SF)
    assert len(plans) == 3
    for plan in plans:  # from the last step to the first
        assert "concat_ws" in plan and "concat_ws" not in plan[plan.index("RepartitionByExpression") :]
    assert all("format_string" not in plan[plan.index("RepartitionByExpression") :] for plan in plans[:2])


def test_coreferences_read_exports_that_were_cut(spark, monkeypatch):
    from symbridge.jobs import workloads

    sides, rank = [], workloads.rank_coreferences
    monkeypatch.setattr(workloads, "rank_coreferences", lambda og, ae, targets: (sides.extend([og, ae]), rank(og, ae, targets))[1])
    QUERIES["w7_coreference_workload"](spark, SF)
    assert all("l_orderkey" not in side._jdf.queryExecution().optimizedPlan().toString() for side in sides)


def test_scores_on_a_class_bound_equal_sql(spark, tmp_path):
    """Functions of few instructions, many pairs with a score of 0.55, 0.72 or 0.88 but for rounding: the classes and scores of the SQL, to the last bit."""
    import random
    from datetime import datetime

    rng = random.Random(8)
    day, line = datetime(1996, 3, 9), "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    # a pair of sf0.1 (134786), then chance
    given = [(0, 1, 19763, 635, 33.0, "A", "O"), (0, 6, 18451, 429, 36.0, "A", "O"), (0, 7, 4988, 972, 2.0, "N", "O"), (1, 4, 8798, 516, 12.0, "A", "O"), (1, 6, 11998, 918, 21.0, "A", "F"), (1, 7, 16293, 168, 30.0, "N", "O")]
    given += [(k, i, rng.randrange(7), rng.randrange(5), float(rng.randrange(3)), rng.choice("ANR"), "O") for k in range(2, 8000) for i in range(rng.randint(1, 4))]
    rows = [(k, i, p, s, q, 1.0 * i, 0.0, 0.0, f, t, day) for k, i, p, s, q, f, t in given]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(8000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    for table in set(TABLES) - {"orders", "lineitem"}:
        (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    for key in ("m7_classify", "m6_pair_score"):
        got = same(spark, QUERIES[key], ORACLES[key], str(tmp_path))
        assert len(got) == 4000 and (key != "m7_classify" or ("review", 0) in got)
