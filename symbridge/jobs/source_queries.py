"""Queries of the sources, sinks and scalar functions (S, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.functions import scalars as s
from symbridge.jobs.registry import query, view
from symbridge.operators import decisions, intervals
from symbridge.sources import address_library, listings
from symbridge.sources.folders import new_folder
from symbridge.sources.ordered_files import write_text, write_texts

_LIBS = "SELECT concat('1-10-', CAST(id % 3 AS VARCHAR), '-0') AS version, id, rva FROM lib"


def _libraries(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "lib").select(F.concat(F.lit("1-10-"), (F.col("id") % 3).cast("string"), F.lit("-0")).alias("version"), "id", "rva")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "library")
    address_library.write(_libraries(spark, d), folder)
    return address_library.read(spark, folder)


@query("s1_read_address_library", f"SELECT version, row_number() OVER (PARTITION BY version ORDER BY id, rva) - 1 AS pos, id, rva FROM ({_LIBS})", "lib")
def s1(spark, d):
    return _stored(spark, d)


@query("s2_write_address_library", f"SELECT version, count(*) AS entries, min(id) AS first_id, max(id) AS last_id, CAST(sum(rva) AS BIGINT) AS rvas FROM ({_LIBS}) GROUP BY version", "lib")
def s2(spark, d):
    return _stored(spark, d).groupBy("version").agg(F.count("*").alias("entries"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("rva").alias("rvas"))


@query(
    "s3_decode_library",
    f"""SELECT version, row_number() OVER (PARTITION BY version ORDER BY id, rva) - 1 AS pos,
        lpad(CAST(id AS VARCHAR), CAST(greatest(len(CAST(id AS VARCHAR)), max(len(CAST(id AS VARCHAR))) OVER (PARTITION BY version)) AS INTEGER), ' ') || chr(9) || lpad(hex(rva), greatest(7, CAST(len(hex(rva)) AS INTEGER)), '0') AS line FROM ({_LIBS})""",
    "lib",
)
def s3(spark, d):
    return address_library.decode(_stored(spark, d))


@query(
    "s4_match_files",
    """SELECT '1.10.' || (c_nationkey % 5) || '.0' AS lver, '1.11.' || (c_nationkey % 5) || '.0' AS rver, c_custkey * 16 AS lrva, c_custkey * 32 AS rrva FROM customer WHERE c_custkey % 11 <> 0""",
)
def s4(spark, d):
    c, folder = view(spark, d, "customer"), new_folder(spark, "matches")
    hexed = lambda k: F.hex(F.col("c_custkey") * k + listings.IMAGE_BASE)
    line = F.when(F.col("c_custkey") % 11 == 0, hexed(16)).otherwise(F.concat_ws("\t", hexed(16), hexed(32), F.lit("more")))
    n = F.col("c_nationkey") % 5
    write_texts(c.select(F.format_string("1.10.%d_1.11.%d.txt", n, n).alias("file"), line.alias("line"), "c_custkey"), "file", "line", folder, ["c_custkey"], head="header\n" * listings.HEADER_LINES)
    write_text(c.select("c_name"), "c_name", f"{folder}/notes.txt", [])
    return listings.match_files(spark, folder).select(*(F.concat_ws(".", *(F.col(f"{v}.{p}").cast("string") for p in ("major", "minor", "build", "sub"))).alias(v) for v in ("lver", "rver")), "lrva", "rrva")


@query(
    "s5_pair_table",
    """SELECT CAST(row_number() OVER (ORDER BY c_custkey) + 1 AS INTEGER) AS row, CASE WHEN c_custkey % 50 = 0 THEN c_name || chr(10) || chr(10) || 'two "words";' ELSE c_name END AS name, c_custkey * 16 AS og_rva, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS og_id,
        CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 32 END AS ae_rva, c_custkey + 1000 AS ae_id FROM customer""",
)
def s5(spark, d):
    path, k = f"{new_folder(spark, 'pairs')}/pairs.csv", F.col("c_custkey")
    name = F.when(k % 50 == 0, F.concat(F.lit(" "), "c_name", F.lit('\n\ntwo "words";'))).otherwise(F.col("c_name"))
    rows = view(spark, d, "customer").select(
        name.alias("Name"), F.concat(F.lit("0x"), F.hex(k * 16)).alias("OG_Addr"), F.when(k % 5 == 0, "").otherwise(k.cast("string")).alias("OG_REL_ID"), F.when(k % 7 == 0, "zz").otherwise(F.hex(k * 32)).alias("AE_221_Addr"), (k + 1000).cast("string").alias("AE_221_REL_ID"), "c_custkey"
    )
    listings.write_report(rows, rows.columns[:-1], path, ["c_custkey"])
    return listings.pair_table(spark, path)


@query("s6_function_records", "SELECT CAST(c_custkey AS INTEGER) AS row, c_name AS name, c_custkey * 3 AS size, CAST(c_custkey % 3 + 1 AS BIGINT) AS mnemonics FROM customer")
def s6(spark, d):
    folder, c = new_folder(spark, "records"), view(spark, d, "customer")
    counts = F.transform(F.sequence(F.lit(0), F.col("c_custkey") % 3), lambda i: F.struct(i.cast("string"), i))
    function = F.struct(F.lit("ok").alias("status"), (F.col("c_custkey") * 3).alias("size"), F.map_from_entries(counts).alias("mnemonics"))
    rows = c.select(F.lit("function").alias("kind"), F.col("c_custkey").cast("int").alias("row"), F.col("c_name").alias("csv_name"), function.alias("function"))
    listings.write_records(rows.unionByName(spark.createDataFrame([("metadata",)], "kind string"), allowMissingColumns=True), folder)
    return listings.read_records(spark, folder).select("row", F.col("csv_name").alias("name"), "function.size", F.size("function.mnemonics").cast("bigint").alias("mnemonics"))


@query("s7_report", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS positive, CASE WHEN c_nationkey <> 3 THEN '0x' || hex(c_custkey * 16) END AS rva FROM customer")
def s7(spark, d):
    folder = new_folder(spark, "report")
    rows = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("positive"), F.when(F.col("c_nationkey") != 3, s.render_rva(F.col("c_custkey") * 16)).alias("rva"), F.lit(1).alias("extra"))
    fields, parts = ["id", "name", "positive", "rva"], []
    for sep, mark, half in ((";", True, F.col("id") % 2 == 0), (",", False, F.col("id") % 2 == 1)):  # both forms of a report
        path = f"{folder}/report{len(parts)}.csv"
        listings.write_report(rows.where(half), fields, path, ["id"], sep, mark)
        parts.append(listings.read_report(spark, path, fields, sep))
    return parts[0].unionAll(parts[1])


@query(
    "s8_source_lines",
    """SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i AS INTEGER) AS line, parts[i] AS text FROM (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN substr(text, 1, len(text) - 1) ELSE text END, chr(10)) AS parts FROM documents),
        unnest(range(1, len(parts) + 1)) AS t(i)""",
)
def s8(spark, d):
    return listings.lines(view(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("value")))


def _header(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    body = F.when(k % 3 == 0, F.concat(F.lit("inline constexpr auto name"), k % 900, F.lit("{ REL::Offset(0x"), F.hex(k), F.lit("), REL::ID("), k, F.lit(") };"))).otherwise(
        F.concat(F.lit("inline constexpr REL::ID name"), k % 900, F.lit("{ "), k, F.lit(" };"))
    )
    return view(spark, d, "part").select(F.lit("ids.h").alias("file"), k.alias("line"), body.alias("text"))


_HEADER = """SELECT 'name' || (p_partkey % 900) AS name, max(p_partkey) AS k FROM part GROUP BY 1"""


@query("s9_parse_header", f"SELECT name, CASE WHEN k % 3 = 0 THEN 'id:' || k || ',offset:' || k ELSE 'id:' || k END AS shown FROM ({_HEADER})")
def s9(spark, d):
    shown = F.array_join(F.transform("values", lambda v: F.concat_ws(":", v["kind"], v["value"].cast("string"))), ",")
    return listings.parse_header(_header(spark, d)).select("name", shown.alias("shown"))


_EMITTED = """SELECT '{space}' AS space, CAST(number AS BIGINT) AS number, text FROM (SELECT row_number() OVER (ORDER BY part, name) - 1 AS number, text FROM (
    SELECT 0 AS part, CAST(i AS VARCHAR) AS name, ['#pragma once', '', 'namespace RE', '{{', chr(9) || 'namespace {space}', chr(9) || '{{'][i] AS text FROM unnest(range(1, 7)) AS t(i)
    UNION ALL SELECT 1, name, chr(9) || chr(9) || {line} FROM ({header}) UNION ALL SELECT 2, CAST(i AS VARCHAR), [chr(9) || '}}', '}}'][i] FROM unnest(range(1, 3)) AS t(i)))"""
_ONE = "'inline constexpr auto ' || name || '{ REL::ID(' || k || ') };'"
_TABLE = "CASE WHEN k % 3 = 0 THEN 'inline constexpr std::array<REL::Offset, 2> ' || name || '{ REL::ID(' || k || '), REL::Offset(0x' || hex(k) || ') };' ELSE 'inline constexpr std::array<REL::ID, 1> ' || name || '{ REL::ID(' || k || ') };' END"


@query("s10_emit_header", " UNION ALL ".join(_EMITTED.format(space=space, line=line, header=_HEADER) for space, line in (("RTTI", _ONE), ("VTABLE", _TABLE))))
def s10(spark, d):
    constants, out = listings.parse_header(_header(spark, d)), []
    for space in ("RTTI", "VTABLE"):
        path = f"{new_folder(spark, 'header')}/{space}_IDs.h"
        listings.write_header(constants, space, path, tables=space == "VTABLE")
        out.append(listings.read_header(spark, path).select(F.lit(space).alias("space"), "number", "text"))
    return out[0].unionAll(out[1])


@query("s11_overrides", "SELECT p_partkey AS og_id, p_partkey * 16 AS ae_rva, 'high' AS confidence_tier, p_type AS evidence, 'id_only' AS replacement_strategy, CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS allow_candidate_correction FROM part")
def s11(spark, d):
    folder, p = new_folder(spark, "overrides"), view(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("og_id"), s.render_rva(F.col("p_partkey") * 16).alias("ae_rva"), F.lit("high").alias("confidence_tier"), F.col("p_type").alias("evidence"), F.lit("id_only").alias("replacement_strategy"), F.when(F.col("p_size") > 25, "yes").otherwise("no").alias("allow_candidate_correction"))
    rows.write.csv(folder, sep=";", header=True)
    return listings.read_overrides(spark, folder)


@query("s12_summary", "SELECT classification AS metric, count(*) AS value FROM cmp GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM cmp", "cmp")
def s12(spark, d):
    return decisions.summary(view(spark, d, "cmp"), "classification")


@query(
    "p1_parse_integers",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 3 END AS as_hex, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN o_orderkey * 2 END AS as_decimal,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN o_orderkey * 2 END AS as_auto FROM orders""",
)
def p1(spark, d):
    k = F.col("o_orderkey")
    hexed = F.when(k % 5 == 0, "g1").otherwise(F.concat(F.when(k % 2 == 0, "0x").otherwise(" "), F.lower(F.hex(k * 3))))
    dec = F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("0x"), F.hex(k * 2))).otherwise("12z")
    return view(spark, d, "orders").select(k.alias("k"), s.parse_hex(hexed).alias("as_hex"), s.parse_decimal(dec).alias("as_decimal"), s.parse_auto(dec).alias("as_auto"))


@query("p2_render_rva", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '0x' || hex(o_orderkey * 977) END AS rva FROM orders")
def p2(spark, d):
    return view(spark, d, "orders").select(F.col("o_orderkey").alias("k"), s.render_rva(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") * 977)).alias("rva"))


@query(
    "p3_version",
    """SELECT o_orderkey AS k, '1-' || (o_orderkey % 12) || '-' || (o_orderkey % 1000) || '-0' AS shown, CAST((1 << 24) | ((o_orderkey % 12) << 16) | ((o_orderkey % 1000) << 4) AS BIGINT) AS packed,
        (o_orderkey % 12) > 10 OR ((o_orderkey % 12) = 10 AND o_orderkey % 1000 > 163) AS is_newer FROM orders""",
)
def p3(spark, d):
    v = s.parse_version(F.concat_ws(".", F.lit("1"), (F.col("o_orderkey") % 12).cast("string"), (F.col("o_orderkey") % 1000).cast("string")))
    return view(spark, d, "orders").select(F.col("o_orderkey").alias("k"), s.render_version(v).alias("shown"), s.pack_version(v).alias("packed"), (v > s.parse_version(F.lit("1.10.163"))).alias("is_newer"))


@query("p4_clean_text", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS text FROM orders")
def p4(spark, d):
    dirty = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("\0"), "o_orderpriority", F.lit("\0")))
    return view(spark, d, "orders").select(F.col("o_orderkey").alias("k"), s.clean_text(dirty).alias("text"))


_NAMES = """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'sub_' || hex(o_orderkey) WHEN 1 THEN 'Qword_' || hex(o_orderkey) WHEN 2 THEN 'Foo::Bar 0x' || hex(o_orderkey) WHEN 3 THEN o_orderpriority || ' 1234567' WHEN 4 THEN '' ELSE 'j_' || lower(hex(o_orderkey)) END AS name FROM orders"""


def _names(spark, d):
    k = F.col("o_orderkey")
    h = F.hex(k)
    name = F.when(k % 6 == 0, F.concat(F.lit("sub_"), h)).when(k % 6 == 1, F.concat(F.lit("Qword_"), h)).when(k % 6 == 2, F.concat(F.lit("Foo::Bar 0x"), h)).when(k % 6 == 3, F.concat("o_orderpriority", F.lit(" 1234567"))).when(k % 6 == 4, "").otherwise(F.concat(F.lit("j_"), F.lower(h)))
    return view(spark, d, "orders").select(k.alias("k"), name.alias("name"))


@query("p5_pair_name", f"SELECT k, regexp_replace(regexp_replace(regexp_replace(lower(name), '^(j_|nullsub_|sub_)[0-9a-f]+$', ''), '0x[0-9a-f]+|[0-9a-f]{{7,}}', '#', 'g'), '\\s+', '', 'g') AS name FROM ({_NAMES})")
def p5(spark, d):
    return _names(spark, d).select("k", s.pair_name(F.col("name")).alias("name"))


_GENERIC = "qword|dword|word|byte|unk|off|stru|asc|loc|sub"


@query("p6_reference_name", f"SELECT k, regexp_replace(regexp_replace(regexp_replace(lower(name), '^({_GENERIC})_[0-9a-f]+$', ''), '[0-9a-f]{{7,}}', '#', 'g'), '[^a-z0-9_]+', '', 'g') AS name FROM ({_NAMES})")
def p6(spark, d):
    return _names(spark, d).select("k", s.reference_name(F.col("name")).alias("name"))


@query("p7_generic_name", f"SELECT k, name = '' OR regexp_full_match(name, '({_GENERIC})_[0-9A-Fa-f]+') AS generic FROM ({_NAMES})")
def p7(spark, d):
    return _names(spark, d).select("k", s.is_generic(F.col("name")).alias("generic"))


@query(
    "p8_segment_class",
    """SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'code' WHEN 1 THEN 'import' WHEN 2 THEN 'readonly' WHEN 3 THEN 'data' WHEN 4 THEN 'import' WHEN 5 THEN 'data' ELSE lower(p_brand) END AS class FROM part""",
)
def p8(spark, d):
    seg = F.element_at(F.array(*map(F.lit, [".TEXT", ".idata", ".rdata", ".data", "extern", ".bss", ""])), (F.col("p_partkey") % 7 + 1).cast("int"))
    return view(spark, d, "part").select(F.col("p_partkey").alias("k"), s.segment_class(F.when(seg == "", F.col("p_brand")).otherwise(seg)).alias("class"))


@query("p9_sanitize", "SELECT p_partkey AS k, replace(p_name, ' ', '') || '_' || p_partkey || '__x' AS short, CASE WHEN p_partkey % 2 = 0 THEN '_' || p_partkey || '_' ELSE replace(p_name, ' ', '') || '_' END AS long FROM part")
def p9(spark, d):
    k = F.col("p_partkey").cast("string")
    return view(spark, d, "part").select(F.col("p_partkey").alias("k"), s.sanitize(F.concat("p_name", F.lit("<"), k, F.lit("`anonymous namespace'>,x")), extended=False).alias("short"), s.sanitize(F.when(F.col("p_partkey") % 2 == 0, F.concat(k, F.lit("$"))).otherwise(F.concat("p_name", F.lit("#")))).alias("long"))


@query("p10_type_string", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_type ELSE 'Outer::' || p_type END AS name FROM part")
def p10(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, "p_type").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(".?AV"), "p_type", F.lit("@@"))).otherwise(F.concat(F.lit(".?AV"), "p_type", F.lit("@Outer@@")))
    return view(spark, d, "part").select(F.col("p_partkey").alias("k"), s.decode_type_string(text).alias("name"))


@query("p11_pseudocode", "SELECT p_partkey AS k, 'var=symbol+number;' || lower(replace(p_name, ' ', '')) || '()' AS code FROM part")
def p11(spark, d):
    k = F.col("p_partkey")
    code = F.concat(F.lit("v1 = sub_"), F.hex(k + 4096), F.lit(" + 0x"), F.hex(k), F.lit("; // set it\n"), F.regexp_replace("p_name", " ", ""), F.lit("() /* then\ncall */"))
    return view(spark, d, "part").select(k.alias("k"), s.normalize_pseudocode(code).alias("code"))


@query("p12_mnemonics", "SELECT func, string_agg(mnemonic, ' ' ORDER BY idx) AS sequence FROM instr GROUP BY func", "instr")
def p12(spark, d):
    listed = view(spark, d, "instr").groupBy("func").agg(F.sort_array(F.collect_list(F.struct("idx", F.concat(F.lit("  "), F.upper("mnemonic"), F.lit(" eax, 1")).alias("i")))).alias("l"))
    return listed.select("func", s.mnemonic_sequence(F.col("l.i")).alias("sequence"))


@query(
    "p13_signature",
    """SELECT func, idx, mnemonic || ':' || CASE WHEN kind = 0 THEN '' WHEN (kind + 3) % 8 = 0 THEN kinds[kind + 1] ELSE kinds[kind + 1] || ',' || kinds[(kind + 3) % 8 + 1] END AS sig
        FROM (SELECT *, ['void', 'reg', 'mem', 'phrase', 'displ', 'imm', 'far', 'near'] AS kinds FROM instr)""",
    "instr",
)
def p13(spark, d):
    return view(spark, d, "instr").select("func", "idx", s.signature(F.col("mnemonic"), F.array(F.col("kind"), (F.col("kind") + 3) % 8, F.lit(0))).alias("sig"))


@query(
    "p14_displacement",
    """SELECT func, idx, CASE WHEN abs(disp) <= 65536 THEN CASE data_ref % 4 WHEN 0 THEN 'stack' WHEN 1 THEN 'stack' WHEN 2 THEN NULL ELSE 'object' END END AS class FROM instr""",
    "instr",
)
def p14(spark, d):
    text = F.element_at(F.array(*map(F.lit, ["[rsp+8]", "[RBP-8]", "[rip+1]", "[rax]"])), (F.col("data_ref") % 4 + 1).cast("int"))
    return view(spark, d, "instr").select("func", "idx", s.displacement_class(F.col("disp"), text).alias("class"))


@query("p15_use_kind", "SELECT line, CASE WHEN contains(text, 'func_t') THEN 'function' ELSE 'data_or_global' END AS kind FROM src", "src")
def p15(spark, d):
    return view(spark, d, "src").select("line", s.use_kind(F.col("text")).alias("kind"))


@query("p16_complete_pairs", "SELECT row_no AS row, og_id, ae_id FROM pairs WHERE og_id IS NOT NULL AND ae_id IS NOT NULL", "pairs")
def p16(spark, d):
    return s.complete_pairs(view(spark, d, "pairs").withColumnRenamed("row_no", "row")).select("row", "og_id", "ae_id")


@query(
    "p17_ranges", "SELECT f.func, r.label FROM func f JOIN (SELECT n_name AS label, CAST(n_nationkey * 500000 AS BIGINT) AS a, CAST(n_nationkey * 500000 + 300000 AS BIGINT) AS b FROM nation) r ON f.start_ea >= r.a AND f.start_ea < r.b", "func"
)
def p17(spark, d):
    ranges = view(spark, d, "nation").select(F.col("n_name").alias("label"), (F.col("n_nationkey") * F.lit(500000)).cast("bigint").alias("start"), (F.col("n_nationkey") * F.lit(500000) + 300000).cast("bigint").alias("end"))
    return intervals.in_ranges(view(spark, d, "func"), ranges).select("func", "label")


_PATTERNS = ["build_1", "MACHINERY_2", "Customer#00000001"]


@query("p18_search_names", f"SELECT ea, p AS pattern FROM names, (SELECT unnest({_PATTERNS}) AS p) WHERE contains(replace(lower(raw_name || ' ' || demangled), '_', ''), replace(lower(p), '_', ''))", "names")
def p18(spark, d):
    return s.search_names(view(spark, d, "names"), _PATTERNS).select("ea", "pattern")


@query("p19_name_patterns", "SELECT ea, array_to_string(list_filter(['_1', 'AUTO', 'ing_2'], lambda p: contains(lower(raw_name), lower(p))), ',') AS patterns FROM names WHERE contains(raw_name, '_1') OR contains(raw_name, 'auto') OR contains(raw_name, 'ing_2')", "names")
def p19(spark, d):
    return s.matching_patterns(view(spark, d, "names"), "raw_name", ["_1", "AUTO", "ing_2"]).select("ea", F.array_join("patterns", ",").alias("patterns"))
