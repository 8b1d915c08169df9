"""Queries of whole workloads over tables that stand in for exports: records, header discovery, co-references, decompile comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.jobs import discovery, records, workloads
from symbridge.jobs.registry import query, view
from symbridge.operators.components import checkpointed
from symbridge.sources import listings
from symbridge.sources.folders import new_folder

_LIST = "coalesce(array_to_string(list_sort(list(DISTINCT {c})), ','), '')"
_ADDRESSED = "i AS (SELECT func * 1024 AS func, idx, func * 1024 + idx * 16 AS ea, mnemonic, sig, callee * 1024 AS callee, data_ref * 1024 AS data_ref FROM instr)"


def _addressed(spark: SparkSession, d: str) -> DataFrame:
    f, near = F.col("func") * 1024, F.abs("disp") <= 65536
    disp = F.when(near, F.col("disp").cast("string"))
    return view(spark, d, "instr").select(
        f.alias("func"), "idx", (f + F.col("idx") * 16).alias("ea"), "mnemonic", "sig", F.when(F.col("data_ref") % 4 > 1, disp).alias("object_disp"), F.when(F.col("data_ref") % 4 < 2, disp).alias("stack_disp"),
        (F.col("callee") * 1024).alias("callee"), (F.col("data_ref") * 1024).alias("data_ref"),
    )


@query(
    "s6_records_from_tables",
    f"""SELECT * FROM (WITH {_ADDRESSED}, asked AS (SELECT CAST(o_orderkey AS INTEGER) AS row, o_custkey * 1024 + o_orderkey % 60 AS og_rva, CASE WHEN o_orderkey % 10 <> 4 THEN o_orderkey END AS og_id FROM orders), strings AS (SELECT s_suppkey * 1024 AS ea, s_name AS text FROM supplier WHERE s_suppkey % 10 = 0),
        here AS (SELECT og_rva AS rva, count(*) AS n FROM asked GROUP BY 1), named AS (SELECT c_custkey * 4096 AS rva, c_name AS name FROM customer),
        told AS (SELECT rva, rva || ':' || coalesce(name, '') || ':' || coalesce(n, 0) AS shown FROM (SELECT callee AS rva FROM i UNION SELECT data_ref FROM i UNION SELECT func FROM i UNION SELECT ea FROM i) LEFT JOIN named USING (rva) LEFT JOIN here USING (rva)),
        own AS (SELECT func, count(*) AS n, sha256(string_agg(sig || chr(10), '' ORDER BY idx)) AS sha, {_LIST.format(c="CASE WHEN mnemonic = 'call' THEN c.shown END")} AS calls, {_LIST.format(c="CASE WHEN mnemonic <> 'call' THEN c.shown END")} AS jumps,
            {_LIST.format(c="CASE WHEN s.ea IS NULL THEN r.shown END")} AS data_refs, {_LIST.format(c="text")} AS strings FROM i JOIN told c ON c.rva = callee JOIN told r ON r.rva = data_ref LEFT JOIN strings s ON s.ea = data_ref GROUP BY func),
        maps AS (SELECT func, string_agg(mnemonic || '=' || n, ',' ORDER BY mnemonic) AS mnemonics FROM (SELECT func, mnemonic, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY func),
        callers AS (SELECT callee AS func, {_LIST.format(c="shown")} AS callers FROM i JOIN told ON rva = func GROUP BY 1), incoming AS (SELECT data_ref AS func, {_LIST.format(c="shown")} AS incoming FROM i JOIN told ON rva = ea GROUP BY 1)
        SELECT row, og_id, CASE WHEN start_ea IS NULL THEN 'no_function' ELSE 'ok' END AS status, start_ea AS start_rva, end_ea - start_ea AS size, own.n AS instructions, sha, coalesce(mnemonics, '') AS mnemonics,
            coalesce(calls, '') AS calls, coalesce(jumps, '') AS jumps, coalesce(data_refs, '') AS data_refs, coalesce(strings, '') AS strings, coalesce(callers, '') AS callers, coalesce(incoming, '') AS incoming
        FROM (SELECT * FROM asked WHERE og_id IS NOT NULL) p LEFT JOIN func f ON og_rva >= f.start_ea AND og_rva < f.end_ea LEFT JOIN own ON own.func = start_ea LEFT JOIN maps ON maps.func = start_ea LEFT JOIN callers c ON c.func = start_ea LEFT JOIN incoming n ON n.func = start_ea)""",
    "instr", "func",
)
def s6_records(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_custkey") * 1024
    pairs = view(spark, d, "orders").select(k.cast("int").alias("row"), F.lit("p").alias("name"), (at + k % 60).alias("og_rva"), F.when(k % 10 != 4, k).alias("og_id"), k.alias("ae_rva"), k.alias("ae_id"))
    f = view(spark, d, "func")
    functions = f.select("start_ea", "end_ea", F.col("name").alias("raw_name"), F.col("name").alias("demangled_name"), F.lit("").alias("type"))
    block = f.select(F.col("start_ea").alias("func_ea"), "start_ea", "end_ea")
    strings = view(spark, d, "supplier").where("s_suppkey % 10 = 0").select((F.col("s_suppkey") * 1024).alias("ea"), F.col("s_name").alias("text"))
    names = view(spark, d, "customer").select((F.col("c_custkey") * 4096).alias("ea"), F.col("c_name").alias("name"))
    segments = spark.createDataFrame([(".text", 0, 1 << 40)], "name string, start_ea bigint, end_ea bigint")
    told = lambda x: F.concat_ws(":", x["rva"].cast("string"), x["name"], F.size(x["csv"]).cast("string"))
    joined = lambda c, f=told: F.array_join(F.sort_array(F.transform(c, f)), ",")
    maps = F.array_join(F.transform(F.sort_array(F.map_entries("mnemonics")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    shown = {"mnemonics": maps, **{c: joined(c) for c in records.LISTS}, "strings": joined("strings", lambda x: x["text"])}
    r = records.function_records(pairs, "og", functions, _addressed(spark, d), block.select("func_ea", "start_ea", F.array("start_ea").alias("successors")), block, strings, names, segments, shown)
    given = lambda c, name=None: F.coalesce(f"function.{c}", F.lit("")).alias(name or c)
    return r.select(
        "row", "og_id", "function.status", "function.start_rva", "function.size", F.col("function.instruction_count").alias("instructions"), F.col("function.semantic_sha256").alias("sha"), given("mnemonics"),
        *(given(c) for c in ("calls", "jumps", "data_refs", "callers")), given("strings"), given("incoming_data_refs", "incoming"),
    )


_PARTS = """p AS (SELECT p_partkey AS k, p_size AS z, 1073741824 + p_partkey * 64 AS descriptor, 3221225480 + p_partkey * 256 AS tab FROM part)"""


@query(
    "s10_discovered_headers",
    f"""SELECT * FROM (WITH {_PARTS}, held AS (SELECT * FROM p WHERE z % 5 <> 0)
        SELECT 'RTTI' AS space, 'inline constexpr auto n' || k || '{{ ' || CASE WHEN k % 3 = 0 THEN 'REL::ID(' || (descriptor + 1) || ')' ELSE 'REL::Offset(0x' || hex(descriptor) || ')' END || ' }};' AS line FROM held
        UNION ALL SELECT 'VTABLE', 'inline constexpr std::array<REL::' || CASE WHEN k % 2 = 0 THEN 'ID' ELSE 'Offset' END || ', 1> n' || k || '{{ ' || CASE WHEN k % 2 = 0 THEN 'REL::ID(' || (tab + 1) || ')' ELSE 'REL::Offset(0x' || hex(tab) || ')' END || ' }};' FROM held WHERE z % 7 <> 0 AND z % 4 > 0)""",
)
def s10_discovered(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    p = view(spark, d, "part")
    descriptor, at, table = 1073741824 + k * 64, 2147483648 + k * 256, 3221225472 + k * 256
    strings = p.select((descriptor + 16).alias("ea"), F.when(z % 5 == 0, "plain").otherwise(F.concat(F.lit(".?AVn"), k, F.lit("@@"))).alias("text"))
    words = lambda *pairs: F.explode(F.array(*(F.struct(a.cast("bigint").alias("ea"), v.cast("bigint").alias("v")) for a, v in pairs))).alias("w")
    dwords = p.select(words(
        (at, F.when(z % 10 == 0, 2).otherwise(z % 2)), (at + 12, descriptor), (at + 16, at + 64), (at + 64, F.lit(0)), (at + 72, F.when(z % 7 == 0, 0).otherwise(z)), (at + 76, at + 128), (at + 128, F.lit(0)),
    )).select("w.ea", F.col("w.v").alias("dword"))
    slots = p.select(words((table, at), *((table + 8 + 8 * i, F.when(z % 4 > i, 4096 + k * 16).otherwise(0)) for i in range(4)))).select("w.ea", F.col("w.v").alias("qword"))
    segments = spark.createDataFrame([(".text", 4096, 1 << 29), (".data", 1 << 30, 2 << 30), (".rdata", 2 << 30, 4 << 30)], "name string, start_ea bigint, end_ea bigint")
    library = p.where("p_partkey % 3 = 0").select(descriptor.alias("rva")).unionAll(p.where("p_partkey % 2 = 0").select((table + 8).alias("rva"))).select(F.lit(0).alias("pos"), (F.col("rva") + 1).alias("id"), "rva")
    found = discovery.discover_types(strings, dwords, slots, segments)
    nothing = spark.createDataFrame([], "row int, ae_rva bigint, ae_id bigint")
    out = discovery.headers(found, spark.createDataFrame([], "name string, rva bigint, source string"), library, nothing)
    lines = lambda space, tables: listings.header_lines(out[space], tables).select(F.lit(space).alias("space"), "line")
    return lines("RTTI", False).unionAll(lines("VTABLE", True))


@query(
    "w7_coreference_workload",
    """SELECT * FROM (WITH refs AS (SELECT DISTINCT func - func % 2 AS row_no, func, data_ref AS rva, data_ref % 3 AS name, data_ref % 2 AS class FROM instr), ae AS (SELECT *, count(*) OVER (PARTITION BY row_no) AS n_refs FROM refs WHERE func > row_no),
        targets AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey ELSE -s_suppkey END AS target, s_suppkey + 5000 AS og_id FROM supplier WHERE s_suppkey % 9 < 2), og AS (SELECT refs.*, target FROM refs JOIN targets ON target = rva WHERE func = row_no AND row_no IN (SELECT row_no FROM ae)),
        cast_ AS (SELECT og.row_no, og.target, ae.rva AS candidate, n_refs, 1.0 / n_refs + 0.35 + 2 * CASE WHEN og.name = ae.name THEN 1 ELSE 0.5 END AS weight FROM og JOIN ae USING (row_no) WHERE og.class = ae.class),
        totals AS (SELECT target, candidate, (2 * sum(CAST(round(weight * 1e9) AS BIGINT)) + 1000) // 2000 / 1e6 AS vote_score, count(DISTINCT row_no) AS unique_anchor_count, count(*) FILTER (n_refs = 1) AS single_candidate_anchors FROM cast_ GROUP BY 1, 2),
        anchors AS (SELECT target, count(DISTINCT row_no) AS anchor_count FROM og GROUP BY 1), named AS (SELECT *, CASE WHEN target % 3 = candidate % 3 THEN 1.0 ELSE 0.5 END AS name_score FROM totals),
        r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY vote_score DESC, unique_anchor_count DESC, name_score DESC, candidate DESC) AS rank FROM named),
        t AS (SELECT *, coalesce(lead(vote_score) OVER (PARTITION BY target ORDER BY rank), 0) AS second FROM r WHERE rank <= 10), x AS (SELECT *, round(vote_score - second, 6) AS m, CASE WHEN second > 0 THEN vote_score / second ELSE 999.0 END AS ratio FROM t JOIN anchors USING (target))
        SELECT og_id, g.target, candidate, CAST(rank AS INTEGER) AS rank, CASE WHEN rank IS NULL THEN 0 ELSE anchor_count END AS anchor_count, 'n' || (candidate % 3) AS ae_name, CASE candidate % 2 WHEN 0 THEN '.data' WHEN 1 THEN '.rdata' END AS ae_segment, CASE WHEN rank IS NOT NULL THEN 'n' || (g.target % 3) END AS og_name, vote_score, name_score,
            CASE WHEN rank IS NULL THEN 'unresolved' WHEN rank > 1 THEN 'alternative' WHEN name_score >= 0.85 AND unique_anchor_count >= 1 AND m > 0 THEN 'strong_name' WHEN unique_anchor_count >= 3 AND ratio >= 1.5 AND m >= 0.5 THEN 'strong_xrefs' WHEN unique_anchor_count >= 2 AND ratio >= 1.8 AND m >= 0.5 THEN 'likely_xrefs'
            WHEN anchor_count = 1 AND single_candidate_anchors = 1 THEN 'single_xref_unique' WHEN vote_score > 0 THEN 'review' ELSE 'unresolved' END AS confidence FROM targets g LEFT JOIN x ON x.target = g.target)""",
    "instr",
)
def w7_workload(spark, d):
    ref, k = F.col("data_ref"), F.col("func")
    refs = view(spark, d, "instr").select((k - k % 2).cast("int").alias("row"), (k % 2).alias("new"), F.struct(ref.alias("rva"), F.concat(F.lit("n"), ref % 3).alias("name"), F.when(ref % 2 == 0, ".data").otherwise(".rdata").alias("segment")).alias("r")).distinct()
    side = lambda n: refs.where(F.col("new") == n).groupBy("row").agg(F.struct(F.lit("ok").alias("status"), F.collect_list("r").alias("data_refs")).alias("function"))
    og, ae = checkpointed(side(0)), checkpointed(side(1))  # exports, which are read more than once
    s = F.col("s_suppkey")
    targets = view(spark, d, "supplier").where("s_suppkey % 9 < 2").select((s + 5000).alias("og_id"), F.when(s % 9 == 0, s).otherwise(-s).alias("rva"))
    both = og.select("row").join(ae.select("row"), "row")
    best = workloads.rank_coreferences(og.join(both, "row"), ae.join(both, "row"), targets)
    return best.select("og_id", "target", "candidate", "rank", "anchor_count", "ae_name", "ae_segment", "og_name", "vote_score", "name_score", "confidence")


@query(
    "s7_comparison_workload",
    """SELECT * FROM (WITH f AS (SELECT func, count(*) AS n, string_agg(sig, ',' ORDER BY idx) AS code FROM instr GROUP BY 1), og AS (SELECT * FROM f WHERE func % 7 <> 0), ae AS (SELECT * FROM f WHERE func % 11 <> 0),
        j AS (SELECT og.func IS NULL AS no_og, ae.func IS NULL AS no_ae, CASE WHEN og.func % 13 = 0 THEN 'unresolved' WHEN og.func % 5 <> 0 THEN 'exact_semantics' ELSE 'strong' END AS class, og.func % 13 <> 0 AND og.func % 5 = 0 AS changed FROM og FULL JOIN ae ON og.func = ae.func),
        b AS (SELECT * FROM j WHERE NOT no_og AND NOT no_ae)
        SELECT 'og_records' AS metric, count(*) FILTER (NOT no_og) AS value FROM j UNION ALL SELECT 'ae_records', count(*) FILTER (NOT no_ae) FROM j UNION ALL SELECT 'missing_side', count(*) FILTER (no_og OR no_ae) FROM j UNION ALL SELECT 'compared', count(*) FROM b
        UNION ALL SELECT c, count(*) FILTER (class = c) FROM b, (SELECT unnest(['exact_semantics', 'strong', 'likely', 'review', 'suspect', 'unresolved']) AS c) GROUP BY c UNION ALL SELECT 'offset_changes', count(*) FILTER (changed) FROM b
        UNION ALL SELECT 'comparison.csv', count(*) FROM b UNION ALL SELECT 'suspects.csv', count(*) FILTER (class = 'unresolved') FROM b UNION ALL SELECT 'members.csv', count(*) FILTER (changed) FROM b)""",
    "instr",
)
def s7_workload(spark, d):
    """Functions as their own new side: all equal but for a member offset and the hash of every fifth, and a missing function in every 13th."""
    f = view(spark, d, "instr").groupBy("func").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("sig"))), 256).alias("sha"))
    f = checkpointed(f)  # looked at for both sides
    k = F.col("func")

    def side(name: str, modulus: int):
        other = (k % 5 == 0) & F.lit(name == "ae")
        offsets = F.create_map(F.when(other, "16").otherwise("8"), F.lit(1).cast("bigint"))
        function = F.struct(
            F.when(k % 13 == 0, "no_function").otherwise("ok").alias("status"), (F.col("n") * 4).alias("size"), F.lit("n").alias("raw_name"), F.lit("Name").alias("demangled_name"), F.col("n").alias("instruction_count"),
            F.create_map(F.lit("mov"), F.col("n")).alias("mnemonics"), F.create_map(F.lit("mov:"), F.col("n")).alias("instruction_shapes"), F.when(other, "other").otherwise(F.col("sha")).alias("semantic_sha256"), offsets.alias("object_displacements"), F.lit(1).cast("bigint").alias("basic_block_count"), F.lit(1).cast("bigint").alias("cfg_edge_count"),
            *(F.array().cast(listings.REFERENCE).alias(c) for c in ("calls", "callers")), F.array().cast("array<struct<rva:bigint,text:string>>").alias("strings"),
        )
        return f.where(k % modulus != 0).select(k.cast("int").alias("row"), F.lit("c").alias("csv_name"), k.alias("og_rva"), k.alias("og_id"), k.alias("ae_rva"), k.alias("ae_id"), function.alias("function"))

    folder = new_folder(spark, "comparison")
    counts = workloads.compare_exports(side("og", 7), side("ae", 11), folder)
    told = spark.createDataFrame(sorted(counts.items()), "metric string, value bigint")
    for name in ("comparison.csv", "suspects.csv", "members.csv"):
        told = told.unionAll(listings.read_report(spark, f"{folder}/{name}", ["csv_row"]).agg(F.lit(name).alias("metric"), F.count("*").alias("value")))
    return told


@query("m9_decompile_comparison")
def m9_comparison(spark, d):
    """Turns of conversations as decompiled text: functions (even turns) with the next turn as their new side, and globals (odd ones) by the hex of their first bytes."""
    c = view(spark, d, "conversations").select("conv_id", "turn", "text").dropna()
    even, key = F.col("turn") % 2 == 0, F.col("conv_id") * 1000 + F.col("turn")
    of = lambda rows, side: rows.select(
        "og_id", (F.col("og_id") + 1).alias("official_ae_id"), F.lit("s").alias("symbol_name"), F.when(F.col("even"), "function").otherwise("data").alias("kind"), F.lit("review").alias("confidence_tier"), F.lit("e").alias("match_evidence"), F.lit(side).alias("side"),
        F.col("og_id").alias("target"), F.lit("n").alias("name"), F.length("text").cast("bigint").alias("size"), "text", F.split("text", "\n").alias("instructions"), F.split("text", ",").alias("calls"), F.split("text", " ").alias("strings"),
    ).select("*", F.col("text").alias("pseudocode"), F.lower(F.hex(F.substring("text", 1, 64))).alias("first_64_bytes")).drop("text")
    old = c.select(key.alias("og_id"), even.alias("even"), "text")
    new = c.select((key - 1).alias("og_id"), (~even).alias("even"), "text")
    both = old.select("og_id").join(new.select("og_id"), "og_id").distinct()
    out = workloads.compare_decompiles(of(old.dropDuplicates(["og_id"]).join(both, "og_id"), "og"), of(new.dropDuplicates(["og_id"]).join(both, "og_id"), "ae221"))
    return out.select("og_id", "kind", "pseudocode_ratio", "mnemonic_ratio", "size_ratio", "call_count_ratio", "string_jaccard", "combined_score")
