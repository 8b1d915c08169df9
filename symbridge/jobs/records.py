"""Function records from tables of a listing: A1-A6 for the functions of all complete pairs, nested as listings.FUNCTION_RECORD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbridge.functions.scalars import complete_pairs
from symbridge.operators import profiles
from symbridge.operators.components import checkpointed
from symbridge.operators.intervals import containing
from symbridge.operators.lookups import first_wins

MAPS = ("mnemonics", "instruction_shapes", "object_displacements", "stack_displacements")
LISTS = ("calls", "jumps", "data_refs", "callers", "incoming_data_refs")


def references(used: DataFrame, names: DataFrame, segments: DataFrame, pairs: DataFrame, rva: str) -> DataFrame:
    """(rva, reference) of the addresses used (rva): what a record tells of them, name, segment and the pair rows on them by row."""
    named = first_wins(names.select(F.col("ea").alias("rva"), "name"), ["rva"], ["name"])
    # an address stands in its segments' rows, or in one without, so they are also the list of addresses
    inside = containing(used.select("rva").distinct(), segments.select(F.col("name").alias("segment"), "start_ea", "end_ea"), "rva")
    inside = first_wins(inside.select("rva", "start_ea", "segment"), ["rva"], ["start_ea", "segment"]).select("rva", "segment")
    paired = pairs.where(F.col(rva).isNotNull()).select(F.col(rva).alias("rva"), F.struct("row", "og_id", "ae_id").alias("pair"))
    paired = paired.groupBy("rva").agg(F.sort_array(F.collect_list("pair")).alias("csv"))  # as many as name one address
    j = inside.join(named, "rva", "left").join(paired, "rva", "left")
    none = F.array().cast("array<struct<row:int,og_id:bigint,ae_id:bigint>>")
    return j.select("rva", F.struct("rva", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("segment", F.lit("")).alias("segment"), F.coalesce("csv", none).alias("csv")).alias("reference"))


def function_records(pairs: DataFrame, side: str, functions: DataFrame, instructions: DataFrame, blocks: DataFrame, chunks: DataFrame, strings: DataFrame, names: DataFrame, segments: DataFrame, shown: dict[str, Column] | None = None) -> DataFrame:
    """A record for each complete pair with what the function at its address on the side (og or ae) holds; status no_function where there is none.

    functions: start_ea, end_ea, raw_name, demangled_name, type; instructions: func (a start_ea), idx, ea, mnemonic, sig, object_disp and
    stack_disp (text, or null), callee, data_ref; blocks: func_ea, start_ea, successors; chunks: func_ea, start_ea, end_ea; strings: ea, text;
    names: ea, name; segments: name, start_ea, end_ea; pairs: row, name, og_rva, og_id, ae_rva, ae_id. Addresses are relative to the image.

    Instructions are clustered by function once; only those of asked functions are profiled. A list of a record is as long as its function
    has references; those to it are collected for the asked functions only. shown: other forms of LISTS, strings and the maps (by name,
    columns on these), made once for each function, not for each pair on it.
    """
    rva = "og_rva" if side == "og" else "ae_rva"
    asked = complete_pairs(pairs)
    placed = checkpointed(containing(asked, functions, rva))
    picked = placed.select(F.col("start_ea").alias("func")).where("func IS NOT NULL").distinct()
    i = profiles.clustered(instructions)
    own = i.join(picked, "func", "left_semi")
    p = profiles.count_maps(own, {"mnemonics": "mnemonic", "instruction_shapes": "sig", "object_displacements": "object_disp", "stack_displacements": "stack_disp"}).join(profiles.semantic_hash(own), "func")

    code = lambda kind, cond: F.when(F.col("callee").isNotNull() & cond, F.struct(F.lit(kind).alias("kind"), F.col("callee").alias("rva")))
    call = F.coalesce(F.col("mnemonic").startswith("call"), F.lit(False))
    data = F.when(F.col("data_ref").isNotNull(), F.struct(F.lit("data_refs").alias("kind"), F.col("data_ref").alias("rva")))
    out = own.select("func", F.explode(F.array_compact(F.array(code("calls", call), code("jumps", ~call), data))).alias("r")).select("func", "r.*")
    texts = strings.select(F.col("ea").alias("rva"), "text")
    held = out.where("kind = 'data_refs'").distinct().join(texts, "rva").groupBy("func").agg(F.sort_array(F.collect_list(F.struct("rva", "text"))).alias("strings"))
    out = out.where("kind <> 'data_refs'").unionAll(out.where("kind = 'data_refs'").join(texts.select("rva"), "rva", "left_anti").select("func", "kind", "rva"))
    callers = i.select(F.col("callee").alias("func"), F.lit("callers").alias("kind"), F.col("func").alias("rva")).join(picked, "func", "left_semi")
    incoming = i.select(F.col("data_ref").alias("func"), F.lit("incoming_data_refs").alias("kind"), F.col("ea").alias("rva")).join(picked, "func", "left_semi")
    every = checkpointed(out.unionAll(callers).unionAll(incoming).distinct())
    told = every.join(references(every, names, segments, pairs, rva), "rva")
    listed = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("reference")))).alias(kind)
    lists = told.groupBy("func").agg(*(listed(k) for k in LISTS))

    cfg = profiles.cfg_metrics(blocks.join(picked.withColumnRenamed("func", "func_ea"), "func_ea", "left_semi")).withColumnRenamed("func_ea", "func")
    size = profiles.chunk_sizes(chunks.join(picked.withColumnRenamed("func", "func_ea"), "func_ea", "left_semi")).withColumnRenamed("func_ea", "func")
    facts = picked
    for part in (p, held, lists, cfg, size):
        facts = facts.join(part, "func", "left")
    none = F.array().cast("array<struct<rva:bigint,name:string,segment:string,csv:array<struct<row:int,og_id:bigint,ae_id:bigint>>>>")
    empty, zero = F.create_map().cast("map<string,bigint>"), F.lit(0).cast("bigint")
    unless = {c: none for c in LISTS} | {c: empty for c in MAPS} | {"strings": F.array().cast("array<struct<rva:bigint,text:string>>")}
    facts = facts.withColumns({c: F.coalesce(c, v) for c, v in unless.items()}).withColumns(shown or {})
    j = placed.withColumnRenamed("start_ea", "func").join(facts, "func", "left")
    ok = F.struct(
        F.lit("ok").alias("status"), F.col(rva).alias("requested_rva"), F.col("func").alias("start_rva"), F.col("end_ea").alias("end_rva"), F.coalesce("size", F.col("end_ea") - F.col("func")).alias("size"),
        "raw_name", "demangled_name", "type", F.coalesce("instruction_count", zero).alias("instruction_count"), *MAPS[:2],
        F.coalesce("semantic_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("semantic_sha256"), *MAPS[2:], F.coalesce("chunk_count", F.lit(1)).cast("bigint").alias("chunk_count"),
        *(F.coalesce(c, zero).alias(c) for c in ("basic_block_count", "cfg_edge_count", "cfg_back_edge_count")), *LISTS, "strings", F.lit(None).cast("string").alias("message"),
    )
    lost = F.struct(F.lit("no_function").alias("status"), F.col(rva).alias("requested_rva"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in j.select(ok.alias("f")).schema["f"].dataType.fields[2:]))
    return j.select(F.lit("function").alias("kind"), "row", F.col("name").alias("csv_name"), "og_rva", "og_id", "ae_rva", "ae_id", F.lit(side).alias("side"), F.when(F.col("func").isNull(), lost).otherwise(ok).alias("function"))
