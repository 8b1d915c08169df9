"""Function profiles from instruction rows, instruction contexts, and voting pairs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbridge.operators.intervals import containing
from symbridge.sources.folders import new_folder

CONTEXT_RADIUS = 3
PRECEDING = 12
MOST_SLOTS = 512
BUCKETS_A_CORE = 8


def bucket_count(spark: SparkSession) -> int:
    """Buckets of clustered(): a bucket is a task, so as many as shuffle partitions, but no more than some for each core."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS_A_CORE * spark.sparkContext.defaultParallelism)


def clustered(instructions: DataFrame, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """instructions as a table of the shared folder that is bucketed by func and sorted by idx: what is grouped or windowed by func after it is not shuffled again.

    buckets: bucket_count() unless told. dealt: the rows are partitioned by func into as many parts already, so they are not shuffled here.
    """
    spark, name = instructions.sparkSession, f"instructions_{uuid.uuid4().hex}"
    n = buckets or bucket_count(spark)
    rows = (instructions if dealt else instructions.repartition(n, "func")).write.bucketBy(n, "func").sortBy("func", "idx")
    rows.option("path", new_folder(spark, "clustered")).saveAsTable(name)
    return spark.table(name)


def count_maps(instructions: DataFrame, columns: dict[str, str]) -> DataFrame:
    """By func: instruction_count, and for each (out, column) a map of the column's values to counts; empty values are left out.

    Instructions are read once: all columns are counted by (func, column, value) together before the maps are built.
    """
    each = F.array(F.struct(F.lit(0).alias("of"), F.lit("").alias("value")), *(F.struct(F.lit(i).alias("of"), F.col(c).alias("value")) for i, c in enumerate(columns.values(), 1)))
    counts = instructions.select("func", F.explode(each).alias("e")).select("func", "e.*").where("of = 0 OR value <> ''").groupBy("func", "of", "value").count()
    held = lambda i: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("of") == i, F.struct("value", "count")))))
    return counts.groupBy("func").agg(F.sum(F.when(F.col("of") == 0, F.col("count"))).alias("instruction_count"), *(held(i).alias(out) for i, out in enumerate(columns, 1)))


def semantic_hash(instructions: DataFrame) -> DataFrame:
    """By func: sha256 of its signatures in order, a line each."""
    listed = instructions.groupBy("func").agg(F.sort_array(F.collect_list(F.struct("idx", "sig"))).alias("l"))  # bounded by a function
    return listed.select("func", F.sha2(F.concat(F.array_join(F.col("l.sig"), "\n"), F.lit("\n")), 256).alias("semantic_sha256"))


def reference_sets(instructions: DataFrame, strings: DataFrame) -> DataFrame:
    """By func: distinct calls (code references of call instructions), jumps (all others), data_refs and strings, by address; a data reference to a string is no data reference."""
    refs = instructions.join(strings.select(F.col("ea").alias("data_ref"), F.lit(True).alias("is_string")), "data_ref", "left")
    call = F.coalesce(F.col("mnemonic").startswith("call"), F.lit(False))
    listed = lambda c, cond: F.array_sort(F.collect_set(F.when(cond, F.col(c))))
    return refs.groupBy("func").agg(
        listed("callee", call).alias("calls"), listed("callee", ~call).alias("jumps"), listed("data_ref", F.col("is_string").isNull()).alias("data_refs"), listed("data_ref", F.col("is_string")).alias("strings")
    )


def incoming(instructions: DataFrame) -> DataFrame:
    """By func: callers (distinct functions with any code reference to it) and incoming_data_refs (distinct addresses, ea, with a data reference to it), by address."""
    code = instructions.where("callee IS NOT NULL").groupBy(F.col("callee").alias("func")).agg(F.array_sort(F.collect_set("func")).alias("callers"))
    data = instructions.where("data_ref IS NOT NULL").groupBy(F.col("data_ref").alias("func")).agg(F.array_sort(F.collect_set("ea")).alias("incoming_data_refs"))
    none = F.array().cast("array<bigint>")
    return code.join(data, "func", "full").select("func", *(F.coalesce(c, none).alias(c) for c in ("callers", "incoming_data_refs")))


def cfg_metrics(blocks: DataFrame) -> DataFrame:
    """By func_ea: basic_block_count, cfg_edge_count, cfg_back_edge_count (successor not after the block)."""
    back = F.size(F.filter("successors", lambda s: s <= F.col("start_ea")))
    return blocks.groupBy("func_ea").agg(F.count("*").alias("basic_block_count"), F.sum(F.size("successors")).alias("cfg_edge_count"), F.sum(back).alias("cfg_back_edge_count"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("func_ea").agg(F.sum(F.col("end_ea") - F.col("start_ea")).alias("size"), F.count("*").alias("chunk_count"))


def contexts(instructions: DataFrame, radius: int = CONTEXT_RADIUS) -> DataFrame:
    """Instructions with window (signatures of radius neighbours each side, clipped), instruction_count and position in [0, 1]."""
    own = W.partitionBy("func")
    ordered = own.orderBy("idx")
    return instructions.withColumns({
        "window": F.collect_list("sig").over(ordered.rowsBetween(-radius, radius)), "instruction_count": F.count("*").over(own),
    }).withColumn("position", F.col("idx") / F.greatest(F.lit(1), F.col("instruction_count") - 1))


def preceding(instructions: DataFrame, n: int = PRECEDING) -> DataFrame:
    """Instructions with the signatures and data references of the n before, oldest first."""
    before = W.partitionBy("func").orderBy("idx").rowsBetween(-n, -1)
    return instructions.withColumns({"before": F.collect_list("sig").over(before), "before_refs": F.collect_list("data_ref").over(before)})


def anchors(xrefs: DataFrame, sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """References to targets at sites of paired functions: every complete pair row of the site's function is an anchor (fan-out is kept).

    xrefs (og_id, func, idx), sites = contexts(), pairs (row, og_rva, ae_rva, ..).
    """
    placed = xrefs.join(sites, ["func", "idx"])
    return placed.join(pairs.select(F.col("row").alias("pair_row"), F.col("og_rva").alias("func"), F.col("ae_rva").alias("ae_function_rva")), "func")


def anchor_counts(xrefs: DataFrame, found: DataFrame) -> DataFrame:
    """By og_id: raw_xref_count, paired_xref_count and no_anchor_count."""
    raw = xrefs.groupBy("og_id").agg(F.count("*").alias("raw_xref_count"))
    sites = found.select("og_id", "func", "idx").distinct().groupBy("og_id").agg(F.count("*").alias("_sites"))
    paired = found.groupBy("og_id").agg(F.count("*").alias("paired_xref_count"))
    out = raw.join(paired, "og_id", "left").join(sites, "og_id", "left")
    return out.select("og_id", "raw_xref_count", F.coalesce("paired_xref_count", F.lit(0)).alias("paired_xref_count"), (F.col("raw_xref_count") - F.coalesce("_sites", F.lit(0))).alias("no_anchor_count"))


def access_candidates(found: DataFrame, accesses: DataFrame) -> DataFrame:
    """Anchors with every access (func, idx, target, ..) of their paired new function; references of a function to itself are dropped."""
    new = accesses.where(F.col("target") != F.col("func")).select(F.col("func").alias("ae_function_rva"), *(F.col(c).alias(f"new_{c}") for c in accesses.columns if c != "func"))
    return found.join(new, "ae_function_rva")


def coreference_votes(og_refs: DataFrame, ae_refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Votes (target, candidate, row, weight): each pair whose old side refers to a target votes for the new side's references of its segment class.

    og_refs, ae_refs: (row, rva, name, segment_class); name_score is joined by the caller as column of ae_refs' names if names matter.
    The number of references that weighs a vote is counted before segments are compared.
    """
    total = ae_refs.groupBy("row").agg(F.count("*").alias("n_refs"))
    hits = og_refs.join(targets.select(F.col("rva")), "rva", "left_semi").select("row", F.col("rva").alias("target"), F.col("segment_class").alias("og_class"), F.col("name").alias("og_name"))
    more = [F.col("segment").alias("ae_segment")] if "segment" in ae_refs.columns else []
    each = hits.join(ae_refs.select("row", F.col("rva").alias("candidate"), F.col("segment_class").alias("ae_class"), F.col("name").alias("ae_name"), *more), "row").join(total, "row")
    kept = each.where((F.coalesce("og_class", F.lit("")) == "") | (F.col("og_class") == F.col("ae_class")))
    return kept.withColumn("base_weight", 1.0 / F.greatest(F.lit(1), F.col("n_refs")) + 0.35)


def _word_number(ea: Column) -> Column:
    """Numbers addresses so that those 8 bytes apart are neighbours, whatever their alignment."""
    rest = F.pmod(ea, F.lit(8))
    return F.shiftleft(rest - 4, 61).bitwiseOR(F.call_function("div", ea - rest, F.lit(8)) + (1 << 60))


def _address(n: Column) -> Column:
    """The address of a _word_number()."""
    return (n.bitwiseAND((1 << 61) - 1) - (1 << 60)) * 8 + F.shiftright(n, 61) + 4


#: Words of one mask.
MASK = 64


def _masks(numbers: DataFrame, count: int) -> DataFrame:
    """By _block of count * MASK numbers (_n): the masks of those there are."""
    n, width = F.col("_n"), F.lit(count * MASK)
    at = F.pmod(n, width)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(MASK)).cast("int"))
    each = numbers.where("_n IS NOT NULL").select(F.call_function("div", n - at, width).alias("_block"), F.call_function("div", at, F.lit(MASK)).alias("_at"), bit.alias("_bit"))
    return each.groupBy("_block").agg(*(F.bit_or(F.when(F.col("_at") == i, F.col("_bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"_m{i}") for i in range(count)))


def slot_runs(starts: DataFrame, words: DataFrame, is_code, most: int = MOST_SLOTS) -> DataFrame:
    """By start: how many consecutive 8-byte words from it are code addresses, at most `most`. words (ea, qword).

    Starts and code addresses are reduced to masks of blocks of at least `most` words, so a run ends in its block or the next one, and no
    start or word is shuffled or sorted by itself.
    """
    count = 1 << (-(-most // MASK) - 1).bit_length()  # a power of 2, so that no block passes 64 bits
    code = _masks(words.where(is_code).select(_word_number(F.col("ea")).alias("_n")), count)
    asked = _masks(starts.select(_word_number(F.col("start")).alias("_n")), count).select("_block", F.array(*(f"_m{i}" for i in range(count))).alias("_starts"))
    held = lambda name, shift: code.select((F.col("_block") - shift).alias("_block"), F.array(*(F.bitwise_not(f"_m{i}") for i in range(count))).alias(name))
    none = F.array(*[F.lit(-1).cast("bigint")] * count)
    j = asked.join(held("_here", 0).hint("merge"), "_block", "left").join(held("_next", 1).hint("merge"), "_block", "left")
    # few bytes become many rows, so blocks are dealt anew into a set number of tasks
    j = j.repartition(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_block"))
    j = j.select("_block", F.concat(F.coalesce("_here", none), F.coalesce("_next", none)).alias("_open"), F.posexplode("_starts").alias("_at", "_mask"))
    j = j.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(MASK - 1)), lambda b: F.call_function("getbit", F.col("_mask"), b) == 1)).alias("_bit"))
    # the lowest set bit of the words that are not code, from the start on: in its mask, else in those after it
    lowest = lambda m: F.when(m == -(1 << 63), MASK - 1).otherwise(F.bit_count(m.bitwiseAND(-m) - 1))
    first = F.call_function("shiftrightunsigned", F.get("_open", F.col("_at")), F.col("_bit"))
    later = F.array_position(F.transform(F.slice("_open", F.col("_at") + 2, F.lit(count)), lambda m: m != 0), True).cast("int")  # from 1; 0: none
    slots = F.when(first != 0, lowest(first)).when(later > 0, later * MASK - F.col("_bit") + lowest(F.get("_open", F.col("_at") + later))).otherwise(most)
    start = _address(F.col("_block") * (count * MASK) + F.col("_at") * MASK + F.col("_bit"))
    lost = starts.where("start IS NULL").select(F.col("start").cast("bigint").alias("start"), F.lit(0).alias("slots")).distinct()
    return j.select(start.alias("start"), F.least(F.lit(most), slots).cast("int").alias("slots")).unionAll(lost)


def slot_dump(tables: DataFrame, names: DataFrame, words: DataFrame, functions: DataFrame, slots: int = 32) -> DataFrame:
    """(name, slot, target, function, function_name) of the first slots of named tables; the address comes from names, else the table's fallback_rva.

    function is the start of the function (start_ea, end_ea) that holds the target, else the target; function_name the name there, or "".
    """
    placed = tables.join(names.select("name", F.col("ea").alias("named_ea")), "name", "left").withColumn("start", F.coalesce("named_ea", "fallback_rva"))
    each = placed.select("name", "start", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    held = each.join(words.select("ea", F.col("qword").alias("target")), F.col("ea") == F.col("start") + 8 * F.col("slot"), "left").select("name", "slot", "target")
    inside = containing(held, functions.select("start_ea", "end_ea"), "target").select("name", "slot", "target", F.coalesce("start_ea", "target").alias("function"))
    named = names.groupBy(F.col("ea").alias("function")).agg(F.min("name").alias("function_name"))
    return inside.join(named, "function", "left").select("name", "slot", "target", "function", F.coalesce("function_name", F.lit("")).alias("function_name"))
