"""Type metadata by joins on a table of memory words, and what the ID headers need of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbridge.operators.lookups import first_wins

# Distances within the metadata structures, and the bounds of a valid hierarchy.
NAME_OFFSET, LOCATOR_FIELD, TABLE_AFTER = 0x10, 0x0C, 8
MOST_BASES = 512
# Ids that the dump variant leaves out (float, unsigned int).
DROPPED_IDS = (25921, 950502)


def unbroadcast(words: DataFrame) -> DataFrame:
    """words of a memory, or rows made of them, whose joins sort both sides: words that are unpacked from few rows look small enough to Spark to be broadcast through the driver."""
    return words.hint("merge")


def locators(types: DataFrame, dwords: DataFrame) -> DataFrame:
    """(type, descriptor, locator): the descriptor stands before its name string; a word that holds its address is a locator's field."""
    d = types.select("type", (F.col("ea") - NAME_OFFSET).alias("descriptor"))
    return d.join(unbroadcast(dwords).select(F.col("dword").alias("descriptor"), (F.col("ea") - LOCATOR_FIELD).alias("locator")), "descriptor")


def valid_locators(found: DataFrame, dwords: DataFrame, readonly: Column) -> DataFrame:
    """Locators whose fields hold: signature 0 or 1, hierarchy in read-only data with 1 to 512 bases and their array there.

    readonly is a condition on a column named ea.
    """
    rows = unbroadcast(dwords).withColumn("_readonly", readonly)
    field = lambda name, offset: rows.select((F.col("ea") - offset).alias("locator"), F.col("dword").alias(name))
    inside = rows.select(F.col("ea").alias("_ea"), "_readonly").where("_readonly").select("_ea")
    j = found.join(inside, F.col("locator") == F.col("_ea"), "left_semi")
    j = j.join(field("signature", 0), "locator").where("signature IN (0, 1)").join(field("hierarchy", 0x10), "locator").join(inside, F.col("hierarchy") == F.col("_ea"), "left_semi")
    j = j.join(rows.select((F.col("ea") - 8).alias("hierarchy"), F.col("dword").alias("bases")), "hierarchy").where(f"bases BETWEEN 1 AND {MOST_BASES}")
    j = j.join(rows.select((F.col("ea") - 12).alias("hierarchy"), F.col("dword").alias("base_array")), "hierarchy")
    return j.join(inside, F.col("base_array") == F.col("_ea"), "left_semi").select(*found.columns, "bases")


def locators_before_pointers(found: DataFrame, dwords: DataFrame, readonly: Column) -> DataFrame:
    """The other test of a locator: the word after the one that holds the descriptor points into read-only data (readonly: a condition on a column named ea)."""
    after = unbroadcast(dwords).select((F.col("ea") - LOCATOR_FIELD - 4).alias("locator"), F.col("dword").alias("ea")).where(readonly)
    return found.join(after.select("locator"), "locator", "left_semi").select(*found.columns)


def table_counts(found: DataFrame, qwords: DataFrame, strict: bool = True) -> DataFrame:
    """By type: how many locators and tables it has; strict: different numbers are an error."""
    tables = tables_of(found, qwords).groupBy("type").agg(F.count("*").alias("tables"))
    counts = found.groupBy("type").agg(F.count("*").alias("locators")).join(unbroadcast(tables), "type", "left").withColumn("tables", F.coalesce("tables", F.lit(0)))
    if strict:
        lost = F.raise_error(F.concat(F.lit("failed to find the tables of "), F.col("type").cast("string"))).cast("bigint")
        counts = counts.withColumn("tables", F.when(F.col("tables") != F.col("locators"), lost).otherwise(F.col("tables")))
    return counts


def tables_of(found: DataFrame, qwords: DataFrame) -> DataFrame:
    """Locators with the tables that follow the words pointing at them; null words are never joined."""
    return found.join(unbroadcast(qwords).where("qword <> 0").select(F.col("qword").alias("locator"), (F.col("ea") + TABLE_AFTER).alias("table")), "locator")


def suffix_keys(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, key): the full name if known, else its longest known suffix of `::` parts, else the full name."""
    parts = F.split("name", "::")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    each = names.select("name").distinct().select("name", F.posexplode(suffixes).alias("cut", "suffix"))
    hit = each.join(known.select(F.col("name").alias("suffix")).distinct(), "suffix").groupBy("name").agg(F.min_by("suffix", "cut").alias("key"))
    return names.join(hit, "name", "left").withColumn("key", F.coalesce("key", "name"))


def merged_candidates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """One candidate per name by the order of its source, and an `unresolved` row for each known name without."""
    order = {"getrtti_csv": 0, "dynamic_initializer": 1, "vtable_slot_2": 2}
    rank = F.coalesce(*(F.when(F.col("source") == s, n) for s, n in order.items()), F.lit(9))
    best = first_wins(candidates.withColumn("_rank", rank), ["name"], ["_rank", "rva"]).drop("_rank")
    lost = known.select("name").distinct().join(best, "name", "left_anti").select("name", F.lit(None).cast("bigint").alias("rva"), F.lit("unresolved").alias("source"))
    return best.select("name", "rva", "source").unionAll(lost)


def inspection_set(points: DataFrame, xrefs: DataFrame, ranges: DataFrame, named: DataFrame) -> DataFrame:
    """Distinct start_ea of functions that contain a target, that refer to one, or whose name matched."""
    from symbridge.operators.intervals import containing

    inside = containing(points.select("ea"), ranges, "ea", how="inner").select("start_ea")
    refer = containing(xrefs.join(points.select(F.col("ea").alias("to_ea")), "to_ea", "left_semi").select(F.col("from_ea").alias("ea")), ranges, "ea", how="inner").select("start_ea")
    return inside.unionAll(refer).unionAll(named.select("start_ea")).where("start_ea IS NOT NULL").distinct()


def best_entry(entries: DataFrame) -> DataFrame:
    """By name: the entry of the most tables, then slots, then the smallest rva; entries without a table are left out."""
    return entries.where("tables > 0").groupBy("name").agg(F.max_by(F.struct("tables", "slots", "rva"), F.struct(F.col("tables"), F.col("slots"), -F.col("rva"))).alias("b")).select("name", "b.*")


def first_entry(entries: DataFrame, order: str) -> DataFrame:
    """By name: the entry found first."""
    return first_wins(entries, ["name"], [order])


def dumped_entries(entries: DataFrame, dropped: tuple[int, ...] = DROPPED_IDS) -> DataFrame:
    """By name: the entry of the smallest id; names whose smallest id is one of dropped are left out."""
    return first_wins(entries, ["name"], ["id"]).where(~F.col("id").isin(list(dropped)))


def relocation_kinds(parts: DataFrame, mode: str = "auto") -> DataFrame:
    """(name, kind, values) of the parts (name, slot, rva, id) of each entry: ids if all parts have one (auto), only then (id), or never (offset)."""
    whole = parts.groupBy("name").agg(F.every(F.col("id").isNotNull()).alias("_all"), F.sort_array(F.collect_list(F.struct("slot", "rva", "id"))).alias("l"))
    if mode == "id":
        whole = whole.where("_all")
    use_id = F.lit(mode == "id") | (F.lit(mode == "auto") & F.col("_all"))
    return whole.select("name", F.when(use_id, "id").otherwise("offset").alias("kind"), F.when(use_id, F.col("l.id")).otherwise(F.col("l.rva")).alias("values"))


def _with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("rva", "id"), "rva", "left")


def _numbered(tables: DataFrame, ids: DataFrame) -> DataFrame:
    """(name, slot, rva, id) of each type's tables, numbered by address."""
    slot = F.row_number().over(W.partitionBy("name").orderBy("table")) - 1
    return _with_ids(tables.select("name", slot.alias("slot"), F.col("table").alias("rva")), ids)


def type_report(types: DataFrame, locators_: DataFrame, tables: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per type (name, rva): its id, col_count, vtable_count, the rvas of its tables by address, and those without an id; ids is (rva, id)."""
    slots = _numbered(tables, ids)
    shown = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("slot", "rva")))), lambda p: F.concat(F.lit("0x"), F.hex(p["rva"]))), ",")
    held = slots.groupBy("name").agg(F.count("*").alias("vtable_count"), shown(F.lit(True)).alias("vtable_rvas"), shown(F.col("id").isNull()).alias("missing_vtable_rvas"))
    columns = locators_.groupBy("name").agg(F.count_distinct("locator").alias("col_count"))
    j = _with_ids(types.select("name", "rva"), ids).join(columns, "name", "left").join(held, "name", "left")
    return j.select("name", "rva", "id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("col_count", "vtable_count")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("vtable_rvas", "missing_vtable_rvas")))


def missing_entries(types: DataFrame, tables: DataFrame, candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """(kind, name, slot, rva) of everything without an id: RTTI of types, VTABLE of their tables by slot, NiRTTI of candidates (name, rva) that have an address."""
    lost = lambda rows, kind, slot: rows.where("id IS NULL").select(F.lit(kind).alias("kind"), "name", slot.cast("int").alias("slot"), "rva")
    one = lambda rows, kind: lost(_with_ids(rows.where("rva IS NOT NULL").select("name", "rva"), ids), kind, F.lit(None))
    return one(types, "RTTI").unionAll(lost(_numbered(tables, ids), "VTABLE", F.col("slot"))).unionAll(one(candidates, "NiRTTI"))
