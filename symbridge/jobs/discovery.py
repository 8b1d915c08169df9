"""Header discovery end to end: type strings to locators, tables and slots (J21, J22, W8), engine types (J23, J24), report (A12-A14) and headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbridge.functions.scalars import decode_type_string, sanitize
from symbridge.operators import lookups, metadata, profiles
from symbridge.operators.components import checkpointed

# Names of functions that return or fill an engine type's object, and how they are followed.
GETTER = "::GetRTTI(void)"
FILLER, FILLED = "_dynamic_initializer_for__", "::ms_RTTI__"
REACH, MOST_JUMPS = 0x40, 4
#: A program has some ten segments; they become a condition.
MOST_SEGMENTS = 1000


def inside(segments: DataFrame, *names: str):
    """A condition on an address: it lies in a segment of one of the names, or that begins with one and a dot, case aside."""
    low = F.lower("name")
    wanted = reduce(Column.__or__, [(low == n) | low.startswith(n + ".") for n in names])
    spans = segments.where(wanted).select("start_ea", "end_ea").limit(MOST_SEGMENTS + 1).collect()
    if len(spans) > MOST_SEGMENTS:
        raise ValueError(f"more than {MOST_SEGMENTS} segments")
    return lambda ea: reduce(Column.__or__, [(ea >= s["start_ea"]) & (ea < s["end_ea"]) for s in spans], F.lit(False))


def discover_types(strings: DataFrame, dwords: DataFrame, qwords: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """types (type, name, key, rva), their valid locators (.., locator) and tables (.., table, slots) from a program's memory.

    strings: ea, text; dwords: ea, dword; qwords: ea, qword; addresses are relative to the image. A table is one with a code address at least.
    """
    readonly, stored, code = inside(segments, ".rdata", "rdata"), inside(segments, ".rdata", "rdata", ".data", "data"), inside(segments, ".text", "text", ".code", "code")
    name = decode_type_string(F.col("text"))
    types = strings.select("ea", name.alias("name")).where(F.col("name").isNotNull() & stored(F.col("ea") - metadata.NAME_OFFSET))
    types = checkpointed(types.select("ea", "name", F.col("ea").alias("type"), sanitize(F.col("name")).alias("key"), (F.col("ea") - metadata.NAME_OFFSET).alias("rva")))
    aligned = dwords.where(F.col("ea") % 4 == 0)
    valid = metadata.valid_locators(metadata.locators(types.select("type", "ea"), aligned.where(readonly(F.col("ea")))), aligned, readonly(F.col("ea")))
    valid = metadata.unbroadcast(checkpointed(valid.select("type", "locator").distinct()))
    tables = metadata.tables_of(valid, qwords.where((F.col("ea") % 8 == 0) & stored(F.col("ea")))).select("type", "table").distinct()
    slots = profiles.slot_runs(tables.select(F.col("table").alias("start")), metadata.unbroadcast(qwords), code(F.col("qword"))).where("slots > 0").select(F.col("start").alias("table"), "slots")
    of = lambda df: types.drop("ea").join(df, "type")
    return {"types": types.drop("ea"), "locators": of(valid), "tables": metadata.unbroadcast(checkpointed(of(tables.join(metadata.unbroadcast(slots), "table"))))}


def returned_targets(starts: DataFrame, instructions: DataFrame, data) -> DataFrame:
    """(start, target): the first aligned data address that a small function refers to, through up to three jumps at its start.

    instructions: func, ea, idx, mnemonic, data_ref, callee; data: a condition on an address.
    """
    near = instructions.where((F.col("ea") - F.col("func") <= REACH) & (F.col("data_ref") % 8 == 0) & data(F.col("data_ref")))
    first = near.groupBy("func").agg(F.min_by("data_ref", F.struct("ea", "data_ref")).alias("target"))
    jumps = instructions.where("idx = 0 AND mnemonic = 'jmp' AND callee IS NOT NULL").groupBy("func").agg(F.min("callee").alias("next"))
    at, found = starts.select("start").distinct().withColumn("func", F.col("start")), []
    for _ in range(MOST_JUMPS):
        at = checkpointed(at.join(first, "func", "left"))
        found.append(at.where("target IS NOT NULL").select("start", "target"))
        at = at.where("target IS NULL").join(jumps, "func").select("start", F.col("next").alias("func"))
    return reduce(DataFrame.unionAll, found)


def filled_targets(starts: DataFrame, instructions: DataFrame, data) -> DataFrame:
    """(start, target): the object whose address an initialiser loads into rcx; instructions: func, ea, mnemonic, operand (its first, as text), data_ref."""
    load = instructions.where((F.col("mnemonic") == "lea") & (F.lower(F.trim("operand")) == "rcx") & (F.col("ea") - F.col("func") <= REACH) & (F.col("data_ref") % 8 == 0) & data(F.col("data_ref")))
    first = load.groupBy(F.col("func").alias("start")).agg(F.min_by("data_ref", F.struct("ea", "data_ref")).alias("target"))
    return starts.select("start").distinct().join(first, "start")


def discover_engine_types(pairs: DataFrame, instructions: DataFrame, qwords: DataFrame, tables: DataFrame, known: DataFrame, segments: DataFrame) -> DataFrame:
    """(name, rva, source) of the known engine types: by their getter, else by their initialiser, else by slot 2 of a table of the type; unresolved ones without rva.

    pairs: name, ae_rva; tables: discover_types(); known: name.
    """
    data = inside(segments, ".data", "data")
    names = lambda cond, cut: pairs.where(cond & F.col("ae_rva").isNotNull()).select(F.regexp_replace(cut, "`anonymous namespace'::", "").alias("class"), F.col("ae_rva").alias("start"))
    getters = names(F.col("name").endswith(GETTER), F.expr(f"substr(name, 1, length(name) - {len(GETTER)})"))
    begun = F.expr(f"substr(name, {len(FILLER) + 1})")
    fillers = names(F.col("name").startswith(FILLER) & (F.instr(begun, FILLED) > 0), F.substring_index(begun, FILLED, 1))

    def keyed(rows: DataFrame) -> DataFrame:
        """rows whose class, or its longest suffix of `::` parts, is a known name when sanitized."""
        parts = F.split("class", "::")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
        each = rows.select("class", "start", F.posexplode(suffixes).alias("cut", "suffix")).withColumn("name", sanitize(F.col("suffix")))
        return each.join(known.select("name").distinct(), "name").groupBy("class", "start").agg(F.min_by("name", "cut").alias("name"))

    of = lambda rows, targets, source: rows.join(targets, "start").select("name", F.col("target").alias("rva"), F.lit(source).alias("source"))
    got, filled = keyed(getters), keyed(fillers)
    sure = checkpointed(of(got, returned_targets(got, instructions, data), "getrtti_csv").unionAll(of(filled, filled_targets(filled, instructions, data), "dynamic_initializer")))
    rest = known.select("name").distinct().join(sure, "name", "left_anti")
    # a table's key is the name, or ends with `__` and it
    ends = F.split("key", "__")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda i: F.array_join(F.slice(ends, i, F.size(ends)), "__"))
    held = tables.where("slots > 2").select(F.explode(F.array_distinct(suffixes)).alias("name"), "rva", "table").join(rest, "name")
    third = held.join(qwords.select((F.col("ea") - 16).alias("table"), F.col("qword").alias("start")), "table")
    found = third.join(returned_targets(third, instructions, data), "start")
    slot2 = lookups.first_wins(found.select("name", F.col("rva").alias("_type"), "table", "target"), ["name"], ["_type", "table"])
    return metadata.merged_candidates(sure.unionAll(slot2.select("name", F.col("target").alias("rva"), F.lit("vtable_slot_2").alias("source"))), known)


def headers(found: dict[str, DataFrame], engine: DataFrame, library: DataFrame, pairs: DataFrame, mode: str = "auto") -> dict[str, DataFrame]:
    """Constants (name, values) of the RTTI, VTABLE and Ni_RTTI headers, and the report and missing entries of all types.

    library: pos, id, rva; pairs: row, ae_rva, ae_id, whose ids count where the library has none. mode: auto, id or offset.
    """
    types, tables = found["types"], found["tables"]
    engine = engine.where("rva IS NOT NULL")
    addresses = types.select("rva").unionAll(tables.select("table")).unionAll(engine.select("rva")).distinct()
    ids = metadata.unbroadcast(checkpointed(lookups.coalesced_ids(addresses, library, pairs).select("rva", "id")))
    with_id = lambda rows: rows.join(ids, "rva", "left").select("name", "slot", "rva", "id")
    constants = lambda parts: metadata.relocation_kinds(with_id(parts), mode).select("name", F.transform("values", lambda v: F.struct(F.col("kind").alias("kind"), v.alias("value"))).alias("values"))
    entries = tables.groupBy("type", F.col("key").alias("name"), "rva").agg(F.count("*").alias("tables"), F.sum("slots").alias("slots"))
    best = metadata.best_entry(entries).select("name", "rva")
    slots = tables.select(F.col("key").alias("name"), "rva", "table").join(best, ["name", "rva"]).select("name", F.col("table").alias("slot"), F.col("table").alias("rva"))
    one = lambda rows: rows.select("name", F.lit(0).alias("slot"), "rva")
    first = metadata.first_entry(types.select(F.col("key").alias("name"), "rva"), "rva")
    keyed = lambda rows, c: rows.select(F.col("key").alias("name"), c).distinct()
    return {
        "RTTI": constants(one(first)), "VTABLE": constants(slots), "Ni_RTTI": constants(one(engine)),
        "report": metadata.type_report(first, keyed(found["locators"], "locator"), keyed(tables, "table"), ids), "missing": metadata.missing_entries(first, keyed(tables, "table"), engine.select("name", "rva"), ids),
    }
