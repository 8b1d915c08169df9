"""Workloads from tables to reports: records, discovery of headers, co-references, decompile comparison, rewritten sources."""

import hashlib
import json
import os
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symbridge.jobs import discovery, records, workloads
from symbridge.operators import decisions, intervals, matching
from symbridge.sources import listings, rewrites

PAIRS = "row int, name string, og_rva bigint, og_id bigint, ae_rva bigint, ae_id bigint"
SEGMENTS = "name string, start_ea bigint, end_ea bigint"


def test_function_records(spark):
    functions = spark.createDataFrame([(0x1000, 0x1040, "f1", "One", "int f()"), (0x2000, 0x2010, "f2", "Two", "")], "start_ea bigint, end_ea bigint, raw_name string, demangled_name string, type string")
    code = [
        (0x1000, 0, 0x1000, "call", "call:near", None, None, 0x2000, None), (0x1000, 1, 0x1005, "mov", "mov:reg,displ", "16", None, None, 0x5000), (0x1000, 2, 0x1009, "mov", "mov:reg,displ", "16", "-8", None, 0x6000),
        (0x1000, 3, 0x1010, "jmp", "jmp:near", None, None, 0x1000, None), (0x1000, 4, 0x1015, "call", "call:near", None, None, 0x2000, None), (0x2000, 0, 0x2000, "ret", "ret:", None, None, None, 0x1000),
    ]
    instructions = spark.createDataFrame(code, "func bigint, idx bigint, ea bigint, mnemonic string, sig string, object_disp string, stack_disp string, callee bigint, data_ref bigint")
    blocks = spark.createDataFrame([(0x1000, 0x1000, [0x1010]), (0x1000, 0x1010, [0x1000, 0x1010])], "func_ea bigint, start_ea bigint, successors array<bigint>")
    chunks = spark.createDataFrame([(0x1000, 0x1000, 0x1040), (0x1000, 0x3000, 0x3004)], "func_ea bigint, start_ea bigint, end_ea bigint")
    strings = spark.createDataFrame([(0x6000, "Hello")], "ea bigint, text string")
    names = spark.createDataFrame([(0x2000, "f2"), (0x5000, "g_Data")], "ea bigint, name string")
    segments = spark.createDataFrame([(".text", 0x1000, 0x4000), (".data", 0x5000, 0x7000)], SEGMENTS)
    pairs = spark.createDataFrame([(2, "p", 0x1004, 10, 0x9000, 20), (3, "q", 0x2000, 11, 0x9100, 21), (4, "r", 0x8000, 12, 0x9200, 22), (5, "open", 0x2000, 13, None, None), (6, "again", 0x2000, 14, 0x9300, 24)], PAIRS)
    got = {r["row"]: r for r in records.function_records(pairs, "og", functions, instructions, blocks, chunks, strings, names, segments).collect()}
    assert set(got) == {2, 3, 4, 6} and got[4]["function"]["status"] == "no_function" and got[4]["function"]["requested_rva"] == 0x8000
    f = got[2]["function"]
    assert (f["status"], f["requested_rva"], f["start_rva"], f["size"], f["chunk_count"], f["instruction_count"]) == ("ok", 0x1004, 0x1000, 0x44, 2, 5)
    assert f["mnemonics"] == {"call": 2, "mov": 2, "jmp": 1} and f["instruction_shapes"]["mov:reg,displ"] == 2 and f["object_displacements"] == {"16": 2} and f["stack_displacements"] == {"-8": 1}
    assert f["semantic_sha256"] == hashlib.sha256("".join(c[4] + "\n" for c in code[:5]).encode()).hexdigest()
    assert (f["basic_block_count"], f["cfg_edge_count"], f["cfg_back_edge_count"]) == (2, 3, 2)
    csv = [(3, 11, 21), (5, 13, None), (6, 14, 24)]
    assert [(c["rva"], c["name"], c["segment"], [tuple(x) for x in c["csv"]]) for c in f["calls"]] == [(0x2000, "f2", ".text", csv)]
    assert [(c["rva"], c["name"], c["segment"]) for c in f["data_refs"]] == [(0x5000, "g_Data", ".data")] and [tuple(s) for s in f["strings"]] == [(0x6000, "Hello")]
    assert [c["rva"] for c in f["jumps"]] == [0x1000] and [c["rva"] for c in f["callers"]] == [0x1000] and [c["rva"] for c in f["incoming_data_refs"]] == [0x2000]
    g = got[3]["function"]
    assert [c["rva"] for c in g["callers"]] == [0x1000] and g["calls"] == [] and g["chunk_count"] == 1 and g["size"] == 0x10 and g["basic_block_count"] == 0
    whole = records.function_records(pairs, "og", functions, instructions, blocks, chunks, strings, names, segments)
    shown = records.function_records(pairs, "og", functions, instructions, blocks, chunks, strings, names, segments, {"calls": F.size("calls"), "mnemonics": F.array_join(F.sort_array(F.map_keys("mnemonics")), ",")})
    assert {r["row"]: (r["calls"], r["mnemonics"]) for r in shown.select("row", "function.calls", "function.mnemonics").collect()} == {2: (1, "call,jmp,mov"), 3: (0, "ret"), 4: (None, None), 6: (0, "ret")}
    overlapping = segments.unionAll(spark.createDataFrame([(".late", 0x1800, 0x4000), (".also", 0x5000, 0x5001)], SEGMENTS))
    used = spark.createDataFrame([(0x2000,), (0x5000,), (0x9000,), (0x2000,)], "rva bigint")
    told = {r["rva"]: (r["reference"]["name"], r["reference"]["segment"], len(r["reference"]["csv"])) for r in records.references(used, names, overlapping, pairs, "og_rva").collect()}
    assert told == {0x2000: ("f2", ".text", 3), 0x5000: ("g_Data", ".also", 0), 0x9000: ("", "", 0)}
    other = whole.withColumn("side", F.lit("ae"))
    report = {r["csv_row"]: (r["classification"], r["score"]) for r in workloads.score_pairs(whole, other).collect()}
    assert report == {2: ("exact_semantics", 1.0), 3: ("exact_semantics", 1.0), 4: ("unresolved", 0.0), 6: ("exact_semantics", 1.0)}


def test_comparison_and_its_summary_come_from_one_pass(spark, tmp_path):
    import csv

    schema = StructType.fromDDL(listings.FUNCTION_RECORD)
    base = {"status": "ok", "demangled_name": "A;b", "size": 40, "instruction_count": 9, "mnemonics": {"mov": 9}, "instruction_shapes": {"mov:": 9}, "semantic_sha256": "h", "object_displacements": {"8": 1, "16": 1}, "basic_block_count": 2, "cfg_edge_count": 1}
    make = lambda row, side, **more: {"row": row, "side": side, "csv_name": f"n{row}", "og_rva": row * 16, "ae_rva": row * 32, "og_id": row, "ae_id": row + 100, "function": base | more}
    og = spark.createDataFrame([make(3, "og"), make(2, "og"), make(4, "og"), make(5, "og"), make(9, "og")], schema)
    ae = spark.createDataFrame([make(2, "ae"), make(3, "ae", semantic_sha256="x", object_displacements={"8": 1, "32": 1}), make(4, "ae", status="no_function"), make(5, "ae", semantic_sha256="y", size=4, instruction_count=1, mnemonics={"b": 1}, instruction_shapes={"c": 1}, basic_block_count=9, demangled_name="zz")], schema)
    counts = workloads.compare_exports(og, ae, f"file://{tmp_path}")
    assert counts == {"og_records": 5, "ae_records": 4, "compared": 4, "exact_semantics": 1, "strong": 1, "likely": 0, "review": 0, "suspect": 1, "unresolved": 1, "missing_side": 1, "offset_changes": 1}
    with open(tmp_path / "comparison.csv", encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f, delimiter=";"))
    assert list(rows[0]) == workloads.COMPARISON_FIELDS and [r["csv_row"] for r in rows] == ["2", "3", "4", "5"]
    assert (rows[0]["score"], rows[0]["exact_semantic_hash"], rows[0]["og_rva"], rows[0]["og_name"], rows[0]["og_calls"]) == ("1.0000", "yes", "0x20", "A;b", "0")
    assert (rows[2]["classification"], rows[2]["score"], rows[2]["ae_status"]) == ("unresolved", "0.0000", "no_function")
    with open(tmp_path / "members.csv", encoding="utf-8-sig", newline="") as f:
        assert [(r["csv_row"], r["common_offsets"], r["og_only_offsets"], r["ae_only_offsets"]) for r in csv.DictReader(f, delimiter=";")] == [("3", "0x8", "0x10", "0x20")]
    with open(tmp_path / "suspects.csv", encoding="utf-8-sig", newline="") as f:
        assert [r["csv_row"] for r in csv.DictReader(f, delimiter=";")] == ["4", "5"]
    summary = (tmp_path / "summary.txt").read_text().splitlines()
    assert summary[0] == "OG records: 5" and summary[-1] == "Rows with object/member displacement changes: 1"


def test_records_survive_their_file(spark, tmp_path):
    pairs = spark.createDataFrame([(2, "p", 0x1004, 10, 0x9000, 20)], PAIRS)
    e = lambda ddl: spark.createDataFrame([], ddl)
    none = records.function_records(pairs, "ae", e("start_ea bigint, end_ea bigint, raw_name string, demangled_name string, type string"), e("func bigint, idx bigint, ea bigint, mnemonic string, sig string, object_disp string, stack_disp string, callee bigint, data_ref bigint"),
        e("func_ea bigint, start_ea bigint, successors array<bigint>"), e("func_ea bigint, start_ea bigint, end_ea bigint"), e("ea bigint, text string"), e("ea bigint, name string"), e(SEGMENTS))
    listings.write_records(none, str(tmp_path / "records"))
    back = listings.read_records(spark, str(tmp_path / "records")).collect()
    assert [(r["row"], r["function"]["status"], r["function"]["requested_rva"]) for r in back] == [(2, "no_function", 0x9000)]


def test_discovery_of_headers(spark):
    text, rdata, data = 0x1000, 0x10000, 0x20000
    segments = spark.createDataFrame([(".text", text, text + 0x4000), (".rdata", rdata, rdata + 0x4000), (".data", data, data + 0x4000)], SEGMENTS)
    strings = [(data + 0x10, ".?AVActor@Game@@"), (data + 0x110, ".?AVLight@@"), (data + 0x210, "no type"), (0x90010, ".?AVElsewhere@@"), (data + 0x310, ".?AVBare@@")]
    dwords, qwords = [], []

    def locator(at, descriptor, bases=2, signature=1):
        dwords.extend([(at, signature), (at + 12, descriptor), (at + 16, at + 0x40), (at + 0x40, 0), (at + 0x48, bases), (at + 0x4C, at + 0x80), (at + 0x80, 0)])

    def table(at, of, slots):
        qwords.extend([(at, of), *((at + 8 + 8 * i, f) for i, f in enumerate(slots)), (at + 8 + 8 * len(slots), 0)])

    locator(rdata + 0x100, data)  # Game::Actor, two tables
    locator(rdata + 0x300, data)
    locator(rdata + 0x500, data + 0x100)  # Light
    locator(rdata + 0x700, data + 0x300, signature=7)  # Bare: no valid locator
    table(rdata + 0x1000, rdata + 0x100, [text, text + 0x100, text + 0x200])
    table(rdata + 0x1100, rdata + 0x300, [text])
    table(rdata + 0x1200, rdata + 0x500, [text + 0x300, text, text + 0x400, text])
    table(rdata + 0x1300, rdata + 0x500, [])  # no code: no table
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    q = frame(qwords, "ea bigint, qword bigint")
    found = discovery.discover_types(frame(strings, "ea bigint, text string"), frame(dwords, "ea bigint, dword bigint"), q, segments)
    assert sorted((r["name"], r["key"], r["rva"]) for r in found["types"].collect()) == [("Bare", "Bare", data + 0x300), ("Game::Actor", "Game__Actor", data), ("Light", "Light", data + 0x100)]
    assert sorted((r["key"], r["table"], r["slots"]) for r in found["tables"].collect()) == [("Game__Actor", rdata + 0x1008, 3), ("Game__Actor", rdata + 0x1108, 1), ("Light", rdata + 0x1208, 4)]
    code = [
        (0x3000, 0x3000, 0, "lea", "rax", data + 0x808, None), (0x3100, 0x3100, 0, "jmp", "", None, 0x3000), (0x3200, 0x3200, 0, "lea", "rdx", data + 0x900, None), (0x3200, 0x3207, 1, "lea", "rcx", data + 0x910, None),
        (text + 0x400, text + 0x400, 0, "mov", "rax", data + 0xA04, None), (text + 0x400, text + 0x408, 1, "mov", "rax", data + 0xA08, None), (0x3300, 0x3300, 0, "jmp", "", None, 0x3300),
    ]
    instructions = frame(code, "func bigint, ea bigint, idx bigint, mnemonic string, operand string, data_ref bigint, callee bigint")
    pairs = frame([(2, "NS::Debris::GetRTTI(void)", 1, 1, 0x3100, 70), (3, "_dynamic_initializer_for__NiNode::ms_RTTI__", 2, 2, 0x3200, 71), (4, "Loop::GetRTTI(void)", 3, 3, 0x3300, 72), (5, "Unknown::GetRTTI(void)", 4, 4, 0x3000, 73)], PAIRS)
    known = frame([("Debris",), ("NiNode",), ("Loop",), ("Light",)], "name string")
    engine = discovery.discover_engine_types(pairs, instructions, q, found["tables"], known, segments)
    assert sorted(map(tuple, engine.collect()), key=str) == [("Debris", data + 0x808, "getrtti_csv"), ("Light", data + 0xA08, "vtable_slot_2"), ("Loop", None, "unresolved"), ("NiNode", data + 0x910, "dynamic_initializer")]
    library = frame([(0, 500, data), (1, 501, rdata + 0x1008), (2, 502, rdata + 0x1208), (3, 503, data + 0x808)], "pos bigint, id bigint, rva bigint")
    out = discovery.headers(found, engine, library, pairs)
    lines = lambda name, tables: sorted(r["line"] for r in listings.header_lines(out[name], tables).collect())
    at = lambda v: f"REL::Offset(0x{v:X})"
    assert lines("RTTI", False) == [f"inline constexpr auto Bare{{ {at(data + 0x300)} }};", "inline constexpr auto Game__Actor{ REL::ID(500) };", f"inline constexpr auto Light{{ {at(data + 0x100)} }};"]
    assert lines("VTABLE", True) == [f"inline constexpr std::array<REL::ID, 1> Light{{ REL::ID(502) }};", f"inline constexpr std::array<REL::Offset, 2> Game__Actor{{ {at(rdata + 0x1008)}, {at(rdata + 0x1108)} }};"]
    assert lines("Ni_RTTI", False) == ["inline constexpr auto Debris{ REL::ID(503) };", f"inline constexpr auto Light{{ {at(data + 0xA08)} }};", f"inline constexpr auto NiNode{{ {at(data + 0x910)} }};"]
    report = {r["name"]: r for r in out["report"].collect()}
    assert (report["Game__Actor"]["col_count"], report["Game__Actor"]["vtable_count"], report["Game__Actor"]["missing_vtable_rvas"]) == (2, 2, f"0x{rdata + 0x1108:X}")
    assert {(r["kind"], r["name"]) for r in out["missing"].collect()} == {("RTTI", "Light"), ("RTTI", "Bare"), ("VTABLE", "Game__Actor"), ("NiRTTI", "Light"), ("NiRTTI", "NiNode")}


def record(row, side, refs, status="ok"):
    return (row, side, (status, [(rva, name, segment, []) for rva, name, segment in refs]))


def test_coreferences_from_records(spark):
    schema = f"row int, side string, function struct<status:string,data_refs:{listings.REFERENCE}>"
    rng = random.Random(3)
    names, segments = ["g_Player", "g_PlayerRef", "g_World", "qword_140", "kSettings", ""], [".data", ".rdata", ".bss"]
    refs = lambda: [(rng.randrange(10), rng.choice(names), rng.choice(segments)) for _ in range(rng.randrange(5))]
    distinct = lambda r: list({x[0]: x for x in sorted(r)}.values())
    og = [record(i, "og", distinct(refs()), "ok" if i % 9 else "no_function") for i in range(60)]
    ae = [record(i, "ae", distinct(refs())) for i in range(60)]
    targets = spark.createDataFrame([(100 + i, i) for i in range(0, 14, 2)], "og_id bigint, rva bigint")
    got = {}
    for r in workloads.rank_coreferences(spark.createDataFrame(og, schema), spark.createDataFrame(ae, schema), targets).collect():
        got.setdefault(r["og_id"], []).append(r)

    def klass(s):
        return {".data": "data", ".rdata": "readonly", ".bss": "data"}[s]

    def score(a, b):
        norm = lambda n: "" if n.startswith("qword_") else n.lower()
        a, b = norm(a), norm(b)
        return SequenceMatcher(None, a, b).ratio() if a and b else 0.0

    for target in range(0, 14, 2):
        total, anchors, single, all_anchors, names_, last = Counter(), {}, Counter(), set(), Counter(), {}
        for a, b in zip(og, ae, strict=True):
            if a[2][0] != "ok":
                continue
            for rva, name, segment, _ in a[2][1]:
                if rva != target:
                    continue
                all_anchors.add(a[0])
                names_[name] += 1
                for c, n, s, _ in b[2][1]:
                    if klass(s) == klass(segment):
                        total[c] += 1 / len(b[2][1]) + 0.35 + 2 * score(name, n)
                        anchors.setdefault(c, set()).add(a[0])
                        single[c] += len(b[2][1]) == 1
                        last[c] = n
        mine = got[100 + target]
        if not total:
            assert [(r["confidence"], r["rank"], r["anchor_count"]) for r in mine] == [("unresolved", None, 0)]
            continue
        assert len(total) <= 10  # all are kept
        assert {r["candidate"]: (r["vote_score"], r["unique_anchor_count"], r["single_candidate_anchors"], r["ae_name"], r["anchor_count"]) for r in mine} == {
            c: (pytest.approx(total[c], abs=2e-6), len(anchors[c]), single[c], last[c], len(all_anchors)) for c in total
        }
        assert mine[0]["og_name"] in {n for n, k in names_.items() if k == max(names_.values())}


def test_decompile_comparison(spark, tmp_path):
    ddl = "og_id bigint, official_ae_id bigint, symbol_name string, kind string, confidence_tier string, match_evidence string, side string, target bigint, name string, size bigint, pseudocode string, instructions array<string>, calls array<bigint>, strings array<string>, first_64_bytes string"
    f = lambda i, code, ins, calls, strs, size=40: (i, i + 1, f"s{i}", "function", "medium", "e", "og", i * 16, f"n{i}", size, code, ins, calls, strs, None)
    g = lambda i, b: (i, i + 1, f"s{i}", "data", "review", "e", "og", i * 16, f"n{i}", None, None, None, None, None, b)
    old = [f(1, "v1 = sub_1000 + 1;", ["mov eax, 1", "ret"], [1, 2], ["a", "b"]), f(2, None, [], [], []), f(3, "x", ["mov a"], [1], [], 0), g(4, "00ff" * 32), g(5, "")]
    new = [f(1, "v9 = sub_2000 + 22; // note", ["mov ebx, 2", "add", "ret"], [1], ["a"], 50), f(2, "", None, None, None), f(3, "", [], [], ["z"]), g(4, "00fe" * 32), g(5, "00")]
    out = workloads.compare_decompiles(spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl))
    got = {r["og_id"]: r for r in out.collect()}
    mn = SequenceMatcher(None, "mov ret", "mov add ret", autojunk=False).ratio()
    assert (got[1]["pseudocode_ratio"], got[1]["mnemonic_ratio"], got[1]["size_ratio"], got[1]["call_count_ratio"], got[1]["string_jaccard"]) == (1.0, round(mn, 6), 0.8, 0.5, 0.5)
    assert got[1]["combined_score"] == pytest.approx(0.35 + 0.3 * mn + 0.15 * 0.8 + 0.05 + 0.05, abs=1e-6)
    assert got[2]["combined_score"] == 1.0 and got[3]["combined_score"] == 0.0
    assert got[4]["pseudocode_ratio"] is None and got[4]["combined_score"] == round(SequenceMatcher(None, "00ff" * 32, "00fe" * 32, autojunk=False).ratio(), 6) and got[5]["combined_score"] == 0.0
    told = workloads.report_decompiles(spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl), f"file://{tmp_path}/decompiles.csv")
    assert told == {"candidates_compared": 5, "functions_compared": 3, "at_least_085": 1, "at_least_070": 2, "under_050": 1}
    report = (tmp_path / "decompiles.csv").read_bytes().decode("utf-8-sig").split("\r\n")
    assert report[0].startswith("og_id;official_ae_id;") and len(report) == 7 and report[4].startswith("4;5;review;data;e;s4;0x40;0x40;n4;n4;;;;;;;;0.")
    with pytest.raises(Exception, match="one side only"):
        workloads.compare_decompiles(spark.createDataFrame(old[:2], ddl), spark.createDataFrame(new, ddl)).collect()


def test_evidence_lines(spark):
    rows = spark.createDataFrame([(1, 11, "sym", "data", "review", "ev", "match?", 64, 80), (2, 12, "s2", "data", "high", "ev", "conflict", 64, 80), (3, 13, "s3", "data", "medium", "ev", "match", 64, 80)],
        "og_id bigint, official_ae_id bigint, symbol_name string, kind string, confidence_tier string, evidence string, existing_ae_id_status string, ae_rva bigint, og_rva bigint")
    picked = decisions.review_selection(rows, "og")
    none = lambda ddl: spark.createDataFrame([], ddl)
    names = spark.createDataFrame([(80, "g")], "ea bigint, name string")
    words = spark.createDataFrame([(80 + 8 * i, i) for i in range(8)], "ea bigint, qword bigint")
    instructions = spark.createDataFrame([(16, 20, "mov", 80)], "func bigint, ea bigint, text string, data_ref bigint")
    functions = spark.createDataFrame([(16, "user")], "start_ea bigint, name string")
    out = decisions.global_evidence(picked, words, instructions, functions, names, spark.createDataFrame([(".data", 64, 128)], SEGMENTS))
    line = json.loads(decisions.evidence_lines(out).first()["line"])
    assert {k: line[k] for k in ("kind", "side", "og_id", "official_ae_id", "symbol_name", "confidence_tier", "match_evidence", "target_rva")} == {
        "kind": "data", "side": "og", "og_id": 1, "official_ae_id": 11, "symbol_name": "sym", "confidence_tier": "review", "match_evidence": "ev", "target_rva": "0x50"
    }
    assert line["evidence"]["name"] == "g" and line["evidence"]["segment"] == ".data" and line["evidence"]["first_64_bytes"] == "".join(f"{i:02x}" + "00" * 7 for i in range(8))
    assert line["evidence"]["xrefs"] == [{"from_rva": 20, "function_rva": 16, "function_name": "user", "text": "mov"}]
    assert none("a int").count() == 0


REPORT = "og_id bigint, official_ae_id bigint, confidence_tier string, existing_ae_id_status string, address_library_status string, replacement_strategy string, locations string"


def tree(tmp_path):
    for name, text in {"include/a.h": "REL::ID(1)\r\nREL::ID( 2 ) é", "src/b.cpp": "x REL::ID(11) y", "src/c.cpp": "REL::ID(5)"}.items():
        path = tmp_path / "Lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return lambda: {p: (tmp_path / "Lib" / p).read_bytes().decode() for p in ("include/a.h", "src/b.cpp", "src/c.cpp")}


def test_sources_are_rewritten_as_a_whole(spark, tmp_path):
    now = tree(tmp_path)
    before, folder = now(), f"file://{tmp_path}"
    row = lambda old, new, where: (old, new, "high", "conflict", "resolved_unique", "id_only", where)
    report = spark.createDataFrame([row(1, 11, "Lib/include/a.h:1,Lib/src/b.cpp:1"), row(2, 1, "Lib/include/a.h:2"), row(2, 1, "Lib/include/a.h:9")], REPORT)
    want = {"selected_rows": 3, "files_affected": 1, "tokens_replaced": 2, "already_applied": 1}
    assert {r["metric"]: r["value"] for r in rewrites.apply_report(spark, report, folder, "Lib").collect()} == want and now() == before
    assert {r["metric"]: r["value"] for r in rewrites.apply_report(spark, report, folder, "Lib", apply=True).collect()} == want
    assert now() == before | {"include/a.h": "REL::ID(11)\r\nREL::ID(1) é"}
    assert sorted(os.listdir(tmp_path)) == ["Lib"]
    lost = spark.createDataFrame([row(77, 78, "Lib/src/c.cpp:1"), row(5, 6, "Lib/src/c.cpp:1")], REPORT)
    with pytest.raises(Exception, match="in neither form"):
        rewrites.apply_report(spark, lost, folder, "Lib", apply=True).collect()
    assert now()["src/c.cpp"] == before["src/c.cpp"]


def test_a_change_after_reading_is_seen(spark, tmp_path, monkeypatch):
    """A file that changes after its text was read, but before it is staged, keeps the change, and no other is written; names need no escapes."""
    now = tree(tmp_path)
    odd = tmp_path / "Lib/src/b c%20é.cpp"
    odd.write_text("REL::ID(5)")
    folder, cut = f"file://{tmp_path}", rewrites.checkpointed
    row = lambda old, new, where: (old, new, "high", "conflict", "resolved_unique", "id_only", where)
    report = spark.createDataFrame([row(5, 6, "Lib/src/c.cpp:1,Lib/src/b c%20é.cpp:1"), row(11, 12, "Lib/src/b.cpp:1")], REPORT)

    def changing(df):
        out = cut(df)
        if "replaced" in out.columns:
            (tmp_path / "Lib/src/c.cpp").write_text("REL::ID(5) more")
        return out

    monkeypatch.setattr(rewrites, "checkpointed", changing)
    before = now()
    with pytest.raises(Exception, match="1 files have changed meanwhile, the first is Lib/src/c.cpp"):
        rewrites.apply_report(spark, report, folder, "Lib", apply=True)
    assert now() == before | {"src/c.cpp": "REL::ID(5) more"} and odd.read_text() == "REL::ID(5)"
    monkeypatch.setattr(rewrites, "checkpointed", cut)
    monkeypatch.setattr(rewrites.Rewriter, "commit", None)  # tasks compare and move, not a commit in the driver
    got = {r["metric"]: r["value"] for r in rewrites.apply_report(spark, report, folder, "Lib", apply=True).collect()}
    assert got == {"selected_rows": 2, "files_affected": 3, "tokens_replaced": 3, "already_applied": 0}
    assert now() == before | {"src/c.cpp": "REL::ID(6) more", "src/b.cpp": "x REL::ID(12) y"} and odd.read_text() == "REL::ID(6)"
    assert sorted(os.listdir(tmp_path)) == ["Lib"]


def test_a_repeated_move_finds_its_work_done(spark, tmp_path):
    from symbridge.sources.ordered_files import moved

    (tmp_path / "staged").mkdir()
    for n in range(3):
        (tmp_path / f"staged/{n}").write_text(f"text {n}")
    files = spark.createDataFrame([(f"{tmp_path}/staged/{n}", f"to {n}") for n in range(3)], "staged string, file string")
    moved(files.limit(2), f"file://{tmp_path}")
    moved(files, f"file://{tmp_path}")
    assert [(tmp_path / f"to {n}").read_text() for n in range(3)] == ["text 0", "text 1", "text 2"]
    with pytest.raises(Exception, match="nowhere"):  # what is staged, and can't be moved, is an error
        (tmp_path / "staged/0").write_text("again")
        moved(files.limit(1).withColumn("file", F.lit("nowhere/0")), f"file://{tmp_path}")


def test_changed_or_lost_sources_stay(spark, tmp_path):
    now = tree(tmp_path)
    before, folder = now(), f"file://{tmp_path}"
    spark.dataSource.register(rewrites.RewrittenFiles)
    rows = [(f"{folder}/Lib/{p}", "new " + t, hashlib.sha256(t.encode()).hexdigest()) for p, t in before.items()]
    put = lambda df: df.write.format("rewritten_files").mode("append").save(folder)
    with pytest.raises(Exception, match="1 files have changed"):
        put(spark.createDataFrame([*rows[:2], (*rows[2][:2], "other")], "path string, text string, digest string").repartition(3))
    assert now() == before and sorted(os.listdir(tmp_path)) == ["Lib"]
    broken = spark.createDataFrame(rows, "path string, text string, digest string").repartition(3).withColumn("text", F.when(F.col("path").endswith("c.cpp"), F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        put(broken)
    assert now() == before and sorted(os.listdir(tmp_path)) == ["Lib"]
    put(spark.createDataFrame(rows, "path string, text string, digest string").repartition(3))
    assert now() == {p: "new " + t for p, t in before.items()}


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_votes_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(1)
    rows = [(i, i % 3, i % 5, i % 2, rng.choice([0.7885, 0.788, 0.9, 1 / 3]), rng.random() * 1.5, i % 4 == 0, f"n{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "xref bigint, og_id int, pair_row int, candidate int, top double, weight double, exact boolean, ae_name string").repartition(parts)
    got = {(r["og_id"], r["candidate"]): (r["vote_score"], r["mean_score"], r["ae_name"]) for r in matching.votes(df, ("ae_name",)).collect()}
    for key in got:
        mine = [r for r in rows if (r[1], r[3]) == key]
        total = sum(round(r[5] * 1e9) for r in mine)
        tops = sum(round(r[4] * 1e9) for r in mine)
        assert got[key] == ((2 * total + 1000) // 2000 / 1e6, (2 * tops + len(mine) * 10**5) // (len(mine) * 2 * 10**5) / 1e4, mine[-1][7])


def test_nearest_of_one_hot_key(spark):
    keys = spark.range(1_000_000).select(F.lit(500).cast("bigint").alias("key"), "id").unionAll(spark.range(5).select((F.col("id") * 400).alias("key"), -F.col("id")))
    rows = spark.createDataFrame([(499, "a"), (501, "b"), (1200, "c")], "at bigint, name string")
    got = intervals.nearest(keys, rows, "key", "at", forward=True, buckets=8).groupBy("key", "name").count().collect()
    assert {(r["key"], r["name"], r["count"]) for r in got} == {(500, "b", 1_000_000), (0, "a", 1), (400, "a", 1), (800, "c", 1), (1200, "c", 1), (1600, None, 1)}


def test_grouping_clustered_instructions_shuffles_nothing(spark):
    from symbridge.operators import profiles

    code = spark.range(2000).select((F.col("id") % 37).alias("func"), F.col("id").alias("idx"), F.lit("mov").alias("mnemonic"), F.concat(F.lit("mov:"), F.col("id") % 3).alias("sig"), F.col("id").alias("data_ref"))
    i = profiles.clustered(code, 4)
    for df in (profiles.count_maps(i, {"m": "mnemonic", "s": "sig"}).join(profiles.semantic_hash(i), "func"), profiles.contexts(i), profiles.preceding(i)):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(profiles.contexts(i), profiles.contexts(code)) and same(profiles.semantic_hash(i), profiles.semantic_hash(code))


def test_evidence_of_both_sides_looks_at_a_function_once(spark):
    rows = spark.createDataFrame([(1, 11, "s", "function", "review", "ev", "conflict", 1001, 1002), (2, 12, "t", "function", "medium", "ev", None, 5000, 2000)],
        "og_id bigint, official_ae_id bigint, symbol_name string, kind string, confidence_tier string, evidence string, existing_ae_id_status string, ae_rva bigint, og_rva bigint")
    picked = decisions.review_selection(rows, "ae221").unionAll(decisions.review_selection(rows, "og"))
    code = spark.createDataFrame([(1000, 1000, "b", 2000, 3000), (1000, 1004, "a", 2000, None), (2000, 2000, "c", None, 1000)], "func bigint, ea bigint, text string, callee bigint, data_ref bigint")
    functions, names = spark.createDataFrame([(1000, 1010, "f"), (2000, 2010, "g")], "start_ea bigint, end_ea bigint, name string"), spark.createDataFrame([(2000, "g")], "ea bigint, name string")
    shown = {"instructions": F.array_join("instructions", " "), "calls": F.size("calls"), "callers": F.array_join(F.col("callers.rva").cast("array<string>"), ",")}
    out = decisions.function_evidence(picked, code, functions, spark.createDataFrame([(3000, "text")], "ea bigint, text string"), names, shown)
    got = {(r["side"], r["og_id"]): (r["status"], r["name"], r["instructions"], r["calls"], r["strings"], r["callers"], [tuple(x) for x in r["incoming_data_refs"] or []]) for r in out.collect()}
    f = ("ok", "f", "b a", 2, ["text"], None, [(2000, 2000, "g", 0)])
    assert got == {("ae221", 1): f, ("og", 1): f, ("og", 2): ("ok", "g", "c", 0, [], "1000,1000", []), ("ae221", 2): ("not_a_function", None, None, None, None, None, [])}
