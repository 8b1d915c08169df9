"""Golden rows and properties of the operators beyond what the queries cover."""

import bisect
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from symbridge.functions import scalars as s
from symbridge.jobs import workloads
from symbridge.functions import similarity as m
from symbridge.operators import components, decisions, intervals, lookups, matching, profiles
from symbridge.sources import address_library, listings
from symbridge.sources.folders import new_folder


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_scalars_golden(spark):
    assert column(spark, ["ff", " 0x1F ", "", None, "xyz", "ffffffffffffffff"], "string", s.parse_hex) == [255, 31, None, None, None, -1]
    assert column(spark, ["12", "0x10", "-3", "1.5", None], "string", s.parse_decimal) == [12, 16, -3, None, None]
    assert column(spark, ["010", "0b101", "0o17", "0", "0x10"], "string", s.parse_auto) == [None, 5, 15, 0, 16]
    assert column(spark, ["SUB_1F", "sub_1F", "a b 12345678", None, "x0xAB"], "string", s.pair_name) == ["", "", "ab#", "", "x#"]
    assert column(spark, [".text", "IDATA", ".rdata$r", "const", "mybss", ".weird", None], "string", s.segment_class) == ["code", "import", "readonly", "readonly", "data", ".weird", ""]
    assert column(spark, [".?AVB@A@@", ".?AV@@", "x", ".?AVX@@"], "string", s.decode_type_string) == ["A::B", None, None, "X"]
    assert column(spark, ["`anonymous namespace'::A<B>", "9a", "", "a-b"], "string", s.sanitize) == ["__A_B_", "_9a", "anonymous", "ab"]
    with pytest.raises(Exception, match="not an integer"):
        column(spark, ["zz"], "string", lambda c: s.parse_hex(c, strict=True))


def test_operands_and_displacements(spark):
    assert column(spark, [[1, 5, 0, 2], [0], [], [9]], "array<int>", lambda c: s.signature(F.lit("mov"), c)) == ["mov:reg,imm", "mov:", "mov:", "mov:other"]
    assert column(spark, [0x10000, -0x10000, 0x10001], "bigint", lambda c: s.displacement_class(c, F.lit("[rax]"))) == ["object", "object", None]
    assert column(spark, [8], "bigint", lambda c: s.displacement_class(c, F.lit("[RIP+8]"))) == [None]


def test_sequence_ratio_is_difflib(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=rng.randint(0, 300))) for _ in range(60)]
    pairs = [(i, rng.choice(words), rng.choice(words)) for i in range(80)] + [(80, "", ""), (81, "", "a"), (82, None, "a")]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    for junk in (True, False):
        got = {r["i"]: r["r"] for r in m.sequence_ratio(df, "a", "b", "r", junk).collect()}
        assert len(got) == len(pairs)
        for i, a, b in pairs:
            assert got[i] == pytest.approx(SequenceMatcher(None, a or "", b or "", autojunk=junk).ratio())


def test_scores_of_equal_sides_are_one(spark):
    df = spark.createDataFrame([({"a": 2, "b": 1}, ["x"], 3), ({}, [], 0)], "m map<string,bigint>, s array<string>, n bigint")
    out = df.select(m.cosine(F.col("m"), F.col("m")), m.jaccard(F.col("s"), F.col("s")), m.closeness(F.col("n"), F.col("n"))).collect()
    assert all(v == pytest.approx(1.0) for r in out for v in r)
    assert df.select(m.cosine(F.col("m"), F.create_map(F.lit("c"), F.lit(1).cast("bigint")))).first()[0] == 0


def test_name_forms(spark):
    df = spark.createDataFrame([("sub_1", "sub_2"), ("sub_1", "Foo"), ("Foo", "Foo"), (None, "Foo")], "a string, b string")
    got = {(r["a"], r["b"]): (r["p"], r["q"], r["t"]) for r in m.name_similarity(m.name_similarity(m.name_similarity(df, "a", "b", "p"), "a", "b", "q", "reference"), "a", "b", "t", "strict").collect()}
    assert got[("sub_1", "sub_2")] == (0.5, 0.0, 0.0)
    assert got[("sub_1", "Foo")] == (0.25, 0.0, 0.0)
    assert got[("Foo", "Foo")] == (1.0, 1.0, 1.0)
    assert got[(None, "Foo")] == (0.25, 0.0, 0.0)


@pytest.mark.parametrize("forward", [True, False])
def test_nearest_is_bisect(spark, forward):
    rng = random.Random(2)
    at = sorted(rng.sample(range(-500, 5000), 200))
    keys = [rng.randint(-900, 5600) for _ in range(300)] + at[:5]
    found = intervals.nearest(spark.createDataFrame([(k,) for k in keys], "k bigint"), spark.createDataFrame([(a, f"r{a}") for a in at], "ea bigint, name string"), "k", "ea", forward, buckets=7)
    want = []
    for k in keys:
        i = bisect.bisect_left(at, k) if forward else bisect.bisect_right(at, k) - 1
        hit = at[i] if 0 <= i < len(at) else None
        want.append((k, hit, None if hit is None else f"r{hit}"))
    assert rows(found) == sorted(want, key=str)


def test_nearest_on_no_rows(spark):
    found = intervals.nearest(spark.createDataFrame([(1,)], "k bigint"), spark.createDataFrame([], "ea bigint"), "k", "ea", True)
    assert rows(found) == [(1, None)]


@pytest.mark.parametrize("forward", [True, False])
def test_nearest_with_one_far_address_and_null_keys(spark, forward):
    at = [*range(0, 4000, 10), 2**62]
    keys = [-5, 3, 1999, 3995, 2**61, None, 2**62 + 1]
    found = intervals.nearest(spark.createDataFrame([(k,) for k in keys], "k bigint"), spark.createDataFrame([(a,) for a in at], "ea bigint"), "k", "ea", forward, buckets=50)
    want = {k: None if k is None else min((a for a in at if a >= k), default=None) if forward else max((a for a in at if a <= k), default=None) for k in keys}
    assert {r["k"]: r["ea"] for r in found.collect()} == want
    cuts = intervals._spot([10, 20, 30, 40, 50, 60, 70, 80, 90, 100])
    got = spark.range(0, 120, 5).select("id", cuts(F.col("id")).alias("n")).collect()
    assert all(r["n"] == min(10, r["id"] // 10) for r in got)


def test_containing_with_ranges_of_all_lengths(spark):
    spans = [(0, 16, "a"), (4096, 4096 + 2**18 + 1, "b"), (2**20, 2**20 + 2**40, "t"), (-(2**63), 2**63 - 1, "all"), (50, 50, "none"), (2**50, 2**50 + 8, "z")]
    points = [0, 15, 16, 5000, 2**20, 2**30, 2**50 + 7, 2**62, -9, None]
    r = spark.createDataFrame(spans, "start_ea bigint, end_ea bigint, n string")
    p = spark.createDataFrame([(x,) for x in points], "ea bigint")
    want = [(x, n) for x in points for s, e, n in spans if x is not None and s <= x < e]
    assert sorted(rows(intervals.containing(p, r, "ea", how="inner").select("ea", "n"))) == sorted(want)
    some = [s for s in spans if s[2] != "all"]
    got = rows(intervals.containing(p, r.where("n <> 'all'"), "ea").select("ea", "n"))
    hits = [(x, n) for x in points for s, e, n in some if x is not None and s <= x < e]
    assert sorted(got, key=str) == sorted(hits + [(x, None) for x in points if x not in {h[0] for h in hits}], key=str)
    assert intervals.containing(p, r.limit(0), "ea").count() == len(points)


def test_containing_with_a_hot_range(spark):
    ranges = spark.createDataFrame([(0, 10, 0, 3), (1, 20, 4000, 9000), (2, 30, 9000, 9000)], "n int, x int, start_ea bigint, end_ea bigint")
    points = spark.createDataFrame([(i,) for i in [0, 2, 3, 3999, 4000, 8999, 9000]] + [(5000,)] * 90, "ea bigint")
    got = rows(intervals.containing(points, ranges, "ea").select("ea", "n"))
    assert got == sorted([(0, 0), (2, 0), (3, None), (3999, None), (4000, 1), (8999, 1), (9000, None)] + [(5000, 1)] * 90, key=str)


def test_components_are_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(components.components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {x: find(x) for x in parent}


def test_pointer_closure_with_a_cycle(spark):
    words = spark.createDataFrame([(108, 10), (208, 100), (308, 200), (18, 100), (900, 901)], "ea bigint, qword bigint")
    got = rows(components.pointer_closure(spark.createDataFrame([(10,)], "ea bigint"), words))
    assert got == [(10,), (100,), (200,), (300,)]


def test_blocked_candidates_equal_all_pairs(spark):
    rng = random.Random(4)
    names = ["alpha_one", "alpha_two", "sub_1", "sub_2", "renderFrame", "renderFrames", "", "x" * 30]
    fs = [(i, rng.choice(names), rng.choice([0, 1, 2, 7, 30, 100]), rng.choice([0, 16, 64, 900]), {rng.choice("abc"): rng.randint(1, 4), rng.choice("abc"): 1}, rng.choice(["h1", "h2", None, f"u{i}"])) for i in range(60)]
    df = spark.createDataFrame(fs, "rva bigint, name string, instruction_count bigint, size bigint, mnemonics map<string,bigint>, semantic_sha256 string")
    got = {(r[0], r[1]) for r in matching.gated_candidates(df.where("rva < 12"), df).select("t_rva", "f_rva").collect()}

    def close(a, b):
        return 1.0 if a == b == 0 else min(a, b) / max(a, b)

    def cos(a, b):
        return sum(a[k] * b.get(k, 0) for k in a) / (sum(v * v for v in a.values()) ** 0.5 * sum(v * v for v in b.values()) ** 0.5)

    def norm(n):
        return "" if n.startswith("sub_") else n.lower()

    def name(a, b):
        a, b = norm(a), norm(b)
        return 0.5 if not a and not b else 0.25 if not a or not b else SequenceMatcher(None, a, b).ratio()

    want = set()
    for a in fs[:12]:
        for b in fs:
            if a[5] is not None and a[5] == b[5] or (name(a[1], b[1]) >= 0.72 if close(a[2], b[2]) < 0.25 or close(a[3], b[3]) < 0.2 else cos(a[4], b[4]) >= 0.45):
                want.add((a[0], b[0]))
    assert got == want
    counts = {r["t_rva"]: (r["candidates"], r["total"]) for r in matching.gate_counts(df.where("rva < 12"), df).collect()}
    assert counts == {a[0]: (sum(x == a[0] for x, _ in want), sum(y for x, y in want if x == a[0])) for a in fs[:12]}


def test_last_wins_on_a_hot_key(spark):
    df = spark.createDataFrame([(1, i, f"v{i}") for i in range(500)] + [(2, 7, "x")], "k int, pos int, v string")
    assert rows(lookups.last_wins(df, ["k"], ["pos"])) == [(1, 499, "v499"), (2, 7, "x")]
    assert rows(lookups.first_wins(df, ["k"], ["pos"])) == [(1, 0, "v0"), (2, 7, "x")]


def test_strict_joins_fail(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "row int"), spark.createDataFrame([(1,)], "row int")
    with pytest.raises(Exception, match="export lacks row 2"):
        lookups.pair_exports(a, b, strict=True).collect()
    with pytest.raises(Exception, match="key on one side only"):
        lookups.equal_key_join(a, b, "row").collect()


def test_override_conflict_fails(spark):
    candidates = spark.createDataFrame([(1, 5, "medium", "e", "yes")], "og_id bigint, ae_rva bigint, confidence_tier string, evidence string, manual_review string")
    o = "og_id bigint, ae_rva bigint, confidence_tier string, evidence string, replacement_strategy string, allow_candidate_correction string"
    with pytest.raises(Exception, match="override conflicts"):
        lookups.apply_overrides(candidates, spark.createDataFrame([(1, 6, "high", "r", "id_only", "no")], o)).collect()
    with pytest.raises(Exception, match="without an address: 1"):
        lookups.apply_overrides(candidates, spark.createDataFrame([(1, None, "high", "r", "id_only", "yes")], o)).collect()
    got = lookups.apply_overrides(candidates, spark.createDataFrame([(1, 6, None, None, None, "Yes"), (9, None, None, None, None, None)], o)).collect()
    assert [(r["ae_rva"], r["confidence_tier"], r["evidence"], r["replacement_strategy"], r["resolution_source"], r["manual_review"]) for r in got] == [(6, "high", "targeted_override", "id_only", "targeted_override", "no")]
    got = lookups.apply_overrides(candidates, spark.createDataFrame([(1, 6, "high", "r", "id_only", "yes")], o)).first()
    assert (got["ae_rva"], got["original_ae_rva"], got["confidence_tier"]) == (6, 5, "high")


def test_apply_ids(spark):
    files = spark.createDataFrame([("a.h", "REL::ID(1) REL::ID( 2 ) REL::ID(3)\n"), ("b.h", "REL::ID(11)")], "file string, text string")
    resolved = "file string, og_id bigint, new_id bigint"
    got = {r["file"]: (r["text"], r["replaced"], r["already"]) for r in decisions.apply_ids(files, spark.createDataFrame([("a.h", 1, 2), ("a.h", 2, 22), ("b.h", 1, 11)], resolved)).collect()}
    assert got["a.h"] == ("REL::ID(2) REL::ID(22) REL::ID(3)\n", 2, 0)
    assert got["b.h"] == ("REL::ID(11)", 0, 1)
    with pytest.raises(Exception, match="conflicting new ids"):
        decisions.apply_ids(files, spark.createDataFrame([("a.h", 1, 2), ("a.h", 1, 3)], resolved)).collect()
    with pytest.raises(Exception, match="in neither form"):
        decisions.apply_ids(files, spark.createDataFrame([("a.h", 77, 78)], resolved)).collect()


def test_library_round_trip_and_checks(spark, tmp_path):
    rng = random.Random(5)
    data = [(v, rng.randint(0, 10**12), rng.randint(0, 10**10)) for v in ("1-10-163-0", "1-11-221-0") for _ in range(1000)]
    folder = new_folder(spark, "library")
    assert address_library.write(spark.createDataFrame(data, "version string, id bigint, rva bigint"), folder) == 2000
    assert rows(address_library.read(spark, folder).select("version", "id", "rva")) == sorted(data, key=str)
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "version-1-0-0-0.bin").write_bytes((1).to_bytes(8, "little") + bytes(24))
    with pytest.raises(Exception, match="do not fit"):
        address_library.read(spark, f"file://{bad}").collect()
    assert rows(address_library.read(spark, f"file://{bad}", strict=False)) == [("1-0-0-0", 0, 0, 0)]


def test_source_tree_and_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.cpp").write_text("x REL::ID(5) REL::ID ( 6 )\nfunc_t y{ REL::ID(7) };\n")
    (tmp_path / "Types_IDs.h").write_text("inline constexpr REL::ID A{ 1 };\ninline constexpr auto B{ REL::Offset(0x10), REL::ID(2) };\ninline constexpr REL::ID A{ 3 };\n")
    (tmp_path / "notes.txt").write_text("REL::ID(9)")
    every = listings.source_lines(spark, f"file://{tmp_path}")
    tokens = decisions.id_tokens(listings.source_lines(spark, f"file://{tmp_path}", generated=False))
    assert sorted((r["og_id"], r["line"], r["kind"]) for r in tokens.collect()) == [(5, 1, "data_or_global"), (6, 1, "data_or_global"), (7, 2, "function")]
    header = {r["name"]: [(v["kind"], v["value"]) for v in r["values"]] for r in listings.parse_header(every.where(F.col("file").endswith("_IDs.h"))).collect()}
    assert header == {"A": [("id", 3)], "B": [("id", 2), ("offset", 16)]}


def test_pair_table_numbers_records(spark, tmp_path):
    text = '\ufeffName;OG_Addr;OG_REL_ID;AE_221_Addr;AE_221_REL_ID\r\n a\0b ;0x10;1;20;2\r\n\r\n"two\n\nlines";;x;zz;0x3\r\n"say ""hi"";";30;;;\r\n'
    (tmp_path / "pairs.csv").write_bytes(text.encode())
    got = sorted(tuple(r) for r in listings.pair_table(spark, str(tmp_path / "pairs.csv")).collect())
    assert got == [(2, "ab", 16, 1, 32, 2), (3, "two\n\nlines", None, None, None, 3), (4, 'say "hi";', 48, None, None, None)]


def test_replacements_are_selected_by_tier_match_and_place(spark):
    schema = "og_id bigint, official_ae_id bigint, confidence_tier string, existing_ae_id_status string, address_library_status string, replacement_strategy string, locations string"
    one = (1, 11, "high", "conflict", "resolved_unique", None, "lib/src/a.cpp:3,lib/src/a.cpp:9,other/b.cpp:1,lib/include/c.h:2")
    rows_ = [one, (2, 12, "medium", "match", "resolved_unique", "id_only", "lib/src/a.cpp:1"), (3, 13, "high", "match", "resolved_aliases", "id_only", ""), (4, 14, "high", None, "resolved_unique", "rewrite_global_pointer", ""), (5, 15, None, None, "resolved_unique", None, "")]
    report = spark.createDataFrame(rows_, schema)
    assert rows(decisions.select_replacements(report, "lib").drop("place")) == [(1, 11, "lib/include/c.h"), (1, 11, "lib/src/a.cpp")]
    assert len(rows(decisions.select_replacements(report, "lib", ("high",), include_existing=True))) == 3
    with pytest.raises(Exception, match="no source location"):
        decisions.select_replacements(spark.createDataFrame([(*one[:6], "other/b.cpp:1")], schema), "lib").collect()


def test_overrides_checks(spark, tmp_path):
    assert listings.read_overrides(spark, None).count() == 0
    (tmp_path / "o.csv").write_text("og_id;ae_rva;confidence_tier;evidence;replacement_strategy;allow_candidate_correction\n1;0x10;high;e;id_only;no\n1;0x20;high;e;id_only;no\n")
    with pytest.raises(ValueError, match="repeated"):
        listings.read_overrides(spark, f"file://{tmp_path}/o.csv")


def test_one_instruction_function_has_position_zero(spark):
    i = spark.createDataFrame([(1, 0, "a:")], "func int, idx int, sig string")
    assert profiles.contexts(i).select("position", "window").first()[:] == (0.0, ["a:"])


def test_slot_runs_bounds(spark):
    words = spark.createDataFrame([(8 * i, 1) for i in range(600)], "ea bigint, qword bigint")
    starts = spark.createDataFrame([(0,), (8 * 599,), (8 * 700,)], "start bigint")
    assert rows(profiles.slot_runs(starts, words, F.col("qword") > 0)) == [(0, 512), (4792, 1), (5600, 0)]


def test_score_and_audit_workload(spark):
    from symbridge.jobs import workloads

    base = {"status": "ok", "size": 64, "raw_name": "Foo", "instruction_count": 4, "mnemonics": {"mov": 3, "ret": 1}, "instruction_shapes": {"mov:reg": 3}, "semantic_sha256": "h", "basic_block_count": 1, "cfg_edge_count": 0, "object_displacements": {"8": 1}}
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(listings.FUNCTION_RECORD)
    fields = [f.name for f in schema["function"].dataType.fields]
    make = lambda row, side, f: (None, row, f"n{row}", 16 * row, row, 32 * row, row + 100, side, tuple(f.get(k) for k in fields))
    og = spark.createDataFrame([make(1, "og", base), make(2, "og", base), make(3, "og", {"status": "no_function"}), make(4, "og", base)], schema)
    ae = spark.createDataFrame([make(1, "ae", base), make(2, "ae", base | {"semantic_sha256": "x", "size": 32, "object_displacements": {"16": 1}}), make(3, "ae", base)], schema)
    got = {r["csv_row"]: r for r in workloads.score_pairs(og, ae).collect()}
    assert (got[1]["classification"], got[1]["score"]) == ("exact_semantics", 1.0)
    assert (got[2]["classification"], got[2]["score"]) == ("strong", round(1 - 0.04 - 0.05, 4))
    assert (got[3]["classification"], got[3]["score"]) == ("unresolved", 0.0)
    assert set(got) == {1, 2, 3}
    source = spark.createDataFrame([("a.cpp", 1, "REL::ID(1) REL::ID(2)"), ("a.cpp", 2, "func_t REL::ID(9)")], "file string, line int, text string")
    library = spark.createDataFrame([(0, 1, 16), (1, 2, 32)], "pos bigint, id bigint, rva bigint")
    out = workloads.audit_sources(source, workloads.score_pairs(og, ae), library)
    assert rows(out["uses"].select("og_id", "mapped", "classification")) == [(1, "yes", "exact_semantics"), (2, "yes", "strong"), (9, "no", "unmapped")]
    assert rows(out["unmapped"]) == [(9, 1, "function", "a.cpp:2")]
    assert rows(out["coverage"].select("og_id", "status")) == [(1, "resolved"), (2, "resolved"), (9, "missing")]
    assert rows(out["changes"].select("og_id", "og_only_offsets", "ae_only_offsets")) == [(2, "0x8", "0x10")]


def test_exports_to_ranked_candidates(spark):
    code = {1: ["push:1", "call:7", "mov:1", "ret:0"], 2: ["mov:1", "call:7", "call:7", "ret:0"]}
    old = spark.createDataFrame([(f, i, sig, sig.split(":")[0]) for f, sigs in code.items() for i, sig in enumerate(sigs)], "func bigint, idx bigint, sig string, mnemonic string")
    new = old.withColumn("func", F.col("func") + 100)
    xrefs = spark.createDataFrame([(50, 1, 1), (50, 2, 1), (51, 2, 2)], "og_id bigint, func bigint, idx bigint")
    accesses = spark.createDataFrame([(101, 1, 900, "Alpha", ".data"), (102, 1, 900, "Alpha", ".data"), (102, 2, 901, "sub_99", ".data")], "func bigint, idx bigint, target bigint, name string, segment string")
    pairs = spark.createDataFrame([(2, 1, 101), (3, 2, 102)], "row int, og_rva bigint, ae_rva bigint")
    quality = spark.createDataFrame([(2, 0.9, True), (3, 0.8, False)], "pair_row int, pair_score double, exact boolean")
    scored = workloads.context_scores(xrefs, old, new, accesses, pairs, quality)
    best = {(r["og_id"], r["pair_row"]): max((x["score"], x["candidate"]) for x in scored.collect() if (x["og_id"], x["pair_row"]) == (r["og_id"], r["pair_row"])) for r in scored.collect()}
    assert best == {(50, 2): (1.0, 900), (50, 3): (1.0, 900), (51, 3): (1.0, 901)}
    schema = "og_id bigint, rva bigint, name string, instruction_count bigint, size bigint, basic_block_count bigint, cfg_edge_count bigint, mnemonics map<string,bigint>, instruction_shapes map<string,bigint>, semantic_sha256 string, calls array<string>, callers array<string>, strings array<string>, member_offsets array<string>"
    row = lambda i, rva, name, n, sha, calls: (i, rva, name, n, n * 4, 2, 1, {"mov": n, "ret": 1}, {"mov:1": n}, sha, calls, [], [], [])
    targets = spark.createDataFrame([row(50, 10, "Alpha", 9, "x", ["1"]), row(51, 11, "sub_11", 30, "y", ["2"])], schema)
    functions = spark.createDataFrame([row(None, 900, "Alpha", 9, "x", ["1"]), row(None, 901, "sub_99", 28, "z", ["2"]), row(None, 902, "Beta", 8, "w", [])], schema).drop("og_id")
    mapped = spark.createDataFrame([(902,)], "rva bigint")
    globals_ = spark.createDataFrame([(50, "Alpha"), (51, "sub_3")], "og_id bigint, og_name string")
    got = workloads.rank_candidates(targets, functions, mapped, scored, scored, quality, globals_)
    top = {r["og_id"]: (r["candidate"], r["confidence"]) for r in got["semantic"].where("rank = 1").collect()}
    assert top[50] == (900, "exact_unique") and top[51][0] == 901
    assert {(r["og_id"], r["candidate"], r["agrees"]) for r in got["call"].where("rank = 1").collect()} == {(50, 900, True), (51, 901, True)}
    data = {r["og_id"]: r for r in got["data"].where("rank = 1").collect()}
    assert (data[50]["confidence"], data[50]["ae_name"], data[50]["ae_segment"], data[50]["name_score"]) == ("strong_name", "Alpha", ".data", 1.0)
    assert data[51]["name_score"] == 0.0
    in_text = workloads.context_scores(xrefs.withColumn("og_segment", F.lit(".text")), old, new, accesses, pairs, quality)
    in_data = workloads.context_scores(xrefs.withColumn("og_segment", F.lit(".bss")), old, new, accesses, pairs, quality)
    assert in_text.count() == 0 and in_data.count() == scored.count()


def test_build_libraries(spark, tmp_path):
    from symbridge.jobs import workloads

    head = "x\n" * listings.HEADER_LINES
    at = lambda v: f"{listings.IMAGE_BASE + v:X}"
    (tmp_path / "1.1.0_1.2.0.txt").write_text(head + f"{at(1)}\t{at(10)}\n{at(2)}\t{at(20)}\textra\n{at(3)}\n")
    (tmp_path / "1.2.0_1.3.0.txt").write_text(head + f"{at(10)}\t{at(100)}\n{at(77)}\t{at(100)}\n")
    (tmp_path / "readme.txt").write_text("no")
    got = rows(workloads.build_libraries(spark, f"file://{tmp_path}", new_folder(spark, "libraries")).select("version", "id", "rva"))
    assert got == [("1-1-0-0", 0, 1), ("1-1-0-0", 1, 2), ("1-2-0-0", 0, 10), ("1-2-0-0", 0, 77), ("1-2-0-0", 1, 20), ("1-3-0-0", 0, 100)]


def test_map_unmatched_workload(spark):
    from symbridge.jobs import workloads

    scored = spark.createDataFrame([(1, 50, 0.95, True, False), (1, 60, 0.5, False, False)], "og_id bigint, candidate bigint, score double, exact_hash boolean, mapped_to_other boolean")
    access = spark.createDataFrame([(1, 1, 7, 50, 0.9), (2, 1, 7, 50, 0.95)], "xref bigint, og_id bigint, pair_row int, candidate bigint, score double")
    data = spark.createDataFrame([(9, 2, 7, 70, 0.9, 0.9)], "xref bigint, og_id bigint, pair_row int, candidate bigint, score double, name_score double")
    quality = spark.createDataFrame([(7, 0.9, True)], "pair_row int, pair_score double, exact boolean")
    used = spark.createDataFrame([(1, "function"), (2, "data_or_global"), (3, "function"), (4, "function")], "og_id bigint, kinds string")
    confirmed = spark.createDataFrame([(3, 90, "strong")], "og_id bigint, ae_rva bigint, classification string")
    special = spark.createDataFrame([], "og_id bigint, ae_rva bigint, evidence string")
    library = spark.createDataFrame([(0, 500, 50), (1, 700, 70), (2, 701, 70)], "pos bigint, id bigint, rva bigint")
    overrides = listings.read_overrides(spark, None)
    got = {r["og_id"]: r for r in workloads.map_unmatched(scored, access, data, quality, used, confirmed, special, library, overrides).collect()}
    assert (got[1]["confidence_tier"], got[1]["official_ae_id"], got[1]["address_library_status"]) == ("high", 500, "resolved_unique")
    assert (got[2]["evidence"], got[2]["official_ae_ids"]) == ("strong_name", "700,701")
    assert (got[3]["evidence"], got[3]["address_library_status"]) == ("confirmed_csv_pair_strong", "rva_missing_from_address_library")
    assert (got[4]["evidence"], got[4]["address_library_status"]) == ("no_function_candidate", "unresolved_candidate")


def test_migrate_headers(spark):
    from symbridge.jobs import workloads

    source = spark.createDataFrame([("h", 1, "inline constexpr REL::ID A{ 1 };"), ("h", 2, "inline constexpr REL::ID Gone{ 2 };")], "file string, line int, text string")
    parts = spark.createDataFrame([("A", 0, 16, 5), ("B", 0, 48, None)], "name string, slot int, rva bigint, id bigint")
    library = spark.createDataFrame([(0, 1, 8), (1, 5, 16)], "pos bigint, id bigint, rva bigint")
    lines, status = workloads.migrate_headers(source, parts, library)
    assert rows(lines.select("line")) == [("inline constexpr std::array<REL::ID, 1> A{ REL::ID(5) };",), ("inline constexpr std::array<REL::Offset, 1> B{ REL::Offset(0x30) };",)]
    assert rows(status.select("name", "status")) == [("A", "replace_with_ae_ids"), ("B", "new_in_ae_export"), ("Gone", "name_missing_and_old_id_absent")]


def test_slot_runs_at_the_edges_of_blocks(spark):
    """Runs over masks and blocks, of any alignment and sign, against counting; no start or word is sorted or looked up by itself."""
    rng = random.Random(3)
    at = [base + 8 * i for base in (0, 3, -8 * 700, 8 * 511, 1 << 40, -(1 << 63)) for i in range(1400) if rng.random() < 0.995] + [8 * i for i in range(3000, 3000 + 520)] + [(1 << 63) - 8 * i for i in range(1, 5)]
    words = {a: (2 if rng.random() < 0.99 else 0) for a in at}
    starts = sorted(set(rng.sample(at, 1500) + [0, 8, 8 * 63, 8 * 64, 8 * 511, 8 * 512, -8, 8 * 3000, 8 * 3007, 1 << 50]))
    df = spark.createDataFrame([(a,) for a in starts] * 2 + [(None,)], "start bigint")
    w = spark.createDataFrame([*words.items(), (None, 2)], "ea bigint, qword bigint")
    for most in (512, 5, 64, 700):
        run = lambda a: next((i for i in range(most) if words.get(a + 8 * i, 0) <= 1), most)  # noqa: B023, E731
        got = profiles.slot_runs(df, w, F.col("qword") > 1, most)
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(a, run(a)) for a in starts] + [(None, 0)], key=str), most


@pytest.mark.parametrize("sizes", [(1 << 13, 1 << 19), (40, 64), (45, 200)])
def test_conflicts_name_the_other_high_ids(spark, monkeypatch, sizes):
    """Against all pairs: ids with rows of several tiers, rows without an rva or evidence, and texts dealt as long and as short ones."""
    monkeypatch.setattr(decisions, "LONG", sizes[0])
    monkeypatch.setattr(decisions, "TEXTS", sizes[1])
    rng = random.Random(5)
    given = [(rng.randrange(60), rng.choice([None, 1, 2, 2, 2, 3, 4, 5, 6]), rng.choice(["high", "medium", "review", "unresolved"]), rng.choice(["a", "b", "", None])) for _ in range(150)]
    given += [(900, 7, "high", "a"), (900, 7, "medium", "a"), (901, 8, "medium", "a"), (None, 2, "review", "a")]
    want = []
    for i, rva, tier, evidence in given:
        others = sorted({j for j, at, t, _ in given if t == "high" and rva is not None and at == rva and i is not None and j != i})
        if tier in ("medium", "review") and others:
            tier, evidence = "review", None if evidence is None else evidence + "_rva_conflicts_with_high_id_" + ",".join(map(str, others))
        want.append((i, rva, tier, evidence))
    df = spark.createDataFrame(given, "og_id bigint, ae_rva bigint, confidence_tier string, evidence string")
    assert rows(decisions.demote_conflicts(df)) == sorted(want, key=str)


def test_texts_of_crowded_rvas_are_written_once(spark, tmp_path):
    """Of 250 MB of texts, 3 MB are different: a file holds each of these once, if rows of a text stand together and few texts share a partition."""
    high = spark.range(2 * 30000).select((F.col("id") + 10_000_000).alias("og_id"), (F.col("id") % 2).alias("ae_rva"), F.lit("high").alias("confidence_tier"), F.lit("sure").alias("evidence"))
    doubtful = spark.range(960).select(F.col("id").alias("og_id"), (F.col("id") % 2).alias("ae_rva"), F.lit("review").alias("confidence_tier"), F.concat(F.lit("kind"), (F.col("id") / 2 % 6).cast("int")).alias("evidence"))
    path = tmp_path / "out"
    out = decisions.demote_conflicts(high.unionAll(doubtful))
    out.write.parquet(str(path))
    assert sum(f.stat().st_size for f in path.iterdir()) < 8_000_000
    back = spark.read.parquet(str(path))
    texts = back.where("og_id < 960").groupBy("ae_rva", "evidence").count().collect()
    want = {(a, f"kind{k}_rva_conflicts_with_high_id_" + ",".join(str(10_000_000 + i) for i in range(a, 60000, 2))) for a in (0, 1) for k in range(6)}
    assert {(r["ae_rva"], r["evidence"]): r["count"] for r in texts} == dict.fromkeys(want, 80)
    per = out.where("og_id < 960").groupBy(F.spark_partition_id().alias("p")).agg(F.collect_set("evidence").alias("e")).select(F.aggregate("e", F.lit(0), lambda n, x: n + F.length(x)).alias("n")).collect()
    assert max(r["n"] for r in per) < 1 << 20
