"""Equi-joins by row, id and address, deduplication in file order, and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, that of the smallest order (unique within the key)."""
    return _one(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, that of the largest order (unique within the key)."""
    return _one(df, keys, order, F.max)


def _one(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    # an aggregate with partial results, so a key with very many rows does not meet in one task
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns))


def pair_exports(og: DataFrame, ae: DataFrame, key: str = "row", strict: bool = False) -> DataFrame:
    """Both sides of each pair as structs og and ae, and missing_side ("og", "ae" or NULL); strict: a missing side is an error."""
    a = og.select(F.col(key), F.struct(*og.columns).alias("og"))
    b = ae.select(F.col(key), F.struct(*ae.columns).alias("ae"))
    out = a.join(b, key, "full").withColumn("missing_side", F.when(F.col("og").isNull(), "og").when(F.col("ae").isNull(), "ae"))
    if strict:
        out = out.withColumn("missing_side", F.when(F.col("missing_side").isNotNull(), F.raise_error(F.concat(F.lit("export lacks row "), F.col(key).cast("string"))).cast("string")))
    return out


def compared_uses(uses: DataFrame, comparison: DataFrame) -> DataFrame:
    """Each use of an id with its comparison (the last by csv_row): mapped yes/no, ae_id, classification (unmapped without), score."""
    last = last_wins(comparison, ["og_id"], ["csv_row"])
    out = uses.join(last, "og_id", "left")
    return out.withColumn("mapped", F.when(F.col("csv_row").isNotNull(), "yes").otherwise("no")).withColumn("classification", F.coalesce("classification", F.lit("unmapped")))


def usage(uses: DataFrame) -> DataFrame:
    """By id: usage_count, the sorted distinct kinds and the `file:line` places, joined by commas; places are as many as a source tree names one id."""
    place = F.struct("file", "line")
    return uses.groupBy("og_id").agg(
        F.count("*").alias("usage_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda p: F.concat(p["file"], F.lit(":"), p["line"].cast("string"))), ",").alias("locations"),
    )


def unmapped_queue(uses: DataFrame, comparison: DataFrame) -> DataFrame:
    return usage(uses.join(comparison.select("og_id").distinct(), "og_id", "left_anti"))


def layout_evidence(changes: DataFrame, uses: DataFrame) -> DataFrame:
    """Member-offset changes of ids that are used."""
    return changes.join(uses.select("og_id"), "og_id", "left_semi")


def rva_of(ids: DataFrame, library: DataFrame) -> DataFrame:
    """ids with rva by exact id, the last entry of the library winning."""
    return ids.join(last_wins(library.select("id", "pos", "rva"), ["id"], ["pos"]).select("id", "rva"), "id", "left")


def aliases(library: DataFrame) -> DataFrame:
    """By rva: its ids in file order, and the first, which is the official one; entries without an rva are left out, so lists hold true aliases only."""
    listed = library.where("rva IS NOT NULL").groupBy("rva").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("l"))
    return listed.select("rva", F.col("l.id").alias("ids"), F.col("l")[0]["id"].alias("official_id"))


def coverage(uses: DataFrame, library: DataFrame) -> DataFrame:
    """By used id: usage, rva and resolved/missing."""
    found = rva_of(usage(uses).withColumnRenamed("og_id", "id"), library)
    return found.select(F.col("id").alias("og_id"), "usage_count", "locations", "rva", F.when(F.col("rva").isNull(), "missing").otherwise("resolved").alias("status"))


def unmapped_targets(queue: DataFrame, library: DataFrame, pairs: DataFrame) -> DataFrame:
    """Queue rows with the old library's rva and the pair row (the last by row); rva_differs flags a disagreement."""
    known = rva_of(queue.withColumnRenamed("og_id", "id"), library).withColumnRenamed("id", "og_id").withColumnRenamed("rva", "og_rva")
    listed = last_wins(pairs.select("og_id", "row", F.col("name").alias("csv_name"), F.col("og_rva").alias("csv_og_rva")), ["og_id"], ["row"]).withColumnRenamed("row", "csv_row")
    return known.join(listed, "og_id", "left").withColumn("rva_differs", F.coalesce(F.col("og_rva") != F.col("csv_og_rva"), F.lit(False)))


def coalesced_ids(addresses: DataFrame, library: DataFrame, pairs: DataFrame) -> DataFrame:
    """addresses (rva) with ids from the library, else from the pairs; the last entry of an rva wins in each."""
    a = last_wins(library.select("rva", "pos", "id"), ["rva"], ["pos"]).select("rva", F.col("id").alias("library_id"))
    b = last_wins(pairs.select(F.col("ae_rva").alias("rva"), "row", F.col("ae_id").alias("pair_id")), ["rva"], ["row"]).select("rva", "pair_id")
    return addresses.join(a, "rva", "left").join(b, "rva", "left").withColumn("id", F.coalesce("library_id", "pair_id"))


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Candidates with reviewed overrides: rva, tier, evidence and strategy replaced; where the override tells none, tier high and evidence targeted_override.

    An override of a candidate must have an address, and one that differs from the candidate's needs allow_candidate_correction = yes,
    in any case; else it is an error. resolution_source tells targeted_override or proposed_report.
    """
    o = overrides.select("og_id", F.lit(True).alias("_given"), *(F.col(c).alias(f"o_{c}") for c in ("ae_rva", "confidence_tier", "evidence", "replacement_strategy", "allow_candidate_correction")))
    j = rows.join(o, "og_id", "left")
    given, shown = F.coalesce("_given", F.lit(False)), F.col("og_id").cast("string")
    clash = F.col("ae_rva").isNotNull() & (F.col("ae_rva") != F.col("o_ae_rva")) & (F.coalesce(F.lower("o_allow_candidate_correction"), F.lit("no")) != "yes")
    fault = F.when(F.col("o_ae_rva").isNull(), F.concat(F.lit("override without an address: "), shown)).when(clash, F.concat(F.lit("override conflicts with the candidate of id "), shown))
    rva = F.when(given & fault.isNotNull(), F.raise_error(fault).cast("bigint")).when(given, F.col("o_ae_rva")).otherwise(F.col("ae_rva"))
    pick = lambda new, old: F.when(given, new).otherwise(old)
    return j.select(
        *(F.col(c) for c in rows.columns if c not in ("ae_rva", "confidence_tier", "evidence", "manual_review")), F.col("ae_rva").alias("original_ae_rva"), rva.alias("ae_rva"),
        pick(F.coalesce("o_confidence_tier", F.lit("high")), F.col("confidence_tier")).alias("confidence_tier"), pick(F.coalesce("o_evidence", F.lit("targeted_override")), F.col("evidence")).alias("evidence"),
        pick(F.lit("no"), F.col("manual_review")).alias("manual_review"), pick(F.lit("targeted_override"), F.lit("proposed_report")).alias("resolution_source"),
        F.coalesce("o_replacement_strategy", F.lit("id_only")).alias("replacement_strategy"),
    )


def header_diff(current: DataFrame, generated: DataFrame, library: DataFrame) -> DataFrame:
    """By name of either header (name, values array of {kind, value}): the migration status and both lists of rvas."""
    ids = last_wins(library.select("id", "pos", "rva"), ["id"], ["pos"]).select("id", "rva")

    def rvas(header: DataFrame, name: str) -> DataFrame:
        each = header.select("name", F.posexplode("values").alias("p", "v")).select("name", "p", F.col("v.kind").alias("kind"), F.col("v.value").alias("id"))
        known = each.join(ids, "id", "left").withColumn("rva", F.when(F.col("kind") == "offset", F.col("id")).otherwise(F.col("rva")))
        listed = known.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("p", "rva", "kind"))).alias("l"))
        return listed.select("name", F.col("l.rva").alias(f"{name}_rvas"), F.col("l.kind").alias(f"{name}_kinds"))

    j = rvas(current, "current").join(rvas(generated, "generated"), "name", "full")
    all_known = lambda c: F.forall(c, lambda v: v.isNotNull())
    status = (
        F.when(F.col("current_rvas").isNull(), "new_in_ae_export")
        .when(F.col("generated_rvas").isNull() & all_known("current_rvas"), "name_missing_but_old_ids_resolve")
        .when(F.col("generated_rvas").isNull(), "name_missing_and_old_id_absent")
        .when(all_known("current_rvas") & (F.col("current_rvas") == F.col("generated_rvas")), "current_ids_match_ae_rvas")
        .when(all_known("generated_rvas") & ~F.exists("generated_kinds", lambda k: k == "offset"), "replace_with_ae_ids")
        .otherwise("replace_with_ae_offsets")
    )
    return j.select("name", "current_rvas", "generated_rvas", status.alias("status"))


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that stand on one side only; a null key equals none.

    Both sides are reduced together by one aggregate, so neither is held by a join.
    """
    both = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    told = both.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    alone = lambda own, other, side: F.when((F.col(own) == 1) & ((F.col(other) == 0) | F.col(key).isNull()), side)
    return told.select(key, F.explode(F.array_compact(F.array(alone("_a", "_b", "left"), alone("_b", "_a", "right")))).alias("side"))


def equal_key_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both sides by key; a key on one side only is an error."""
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full")
    return j.where(F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.concat(F.lit("key on one side only: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_a", "_b")


def dense_numbers(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with 0, 1, .. in the order of unique keys: ranges are sorted, counted, and numbered within, so no task sees all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from symbridge.operators.components import checkpointed

    ranged = checkpointed(ranged)
    counts = ranged.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per partition
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_n", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")


def prioritised(candidates: DataFrame, key: str, priority: Column, order: list[str]) -> DataFrame:
    """One candidate per key, of the smallest priority, then order."""
    return first_wins(candidates.withColumn("_priority", priority), [key], ["_priority", *order]).drop("_priority")
