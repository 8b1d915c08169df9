"""The workloads end to end, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from symbridge.functions import scalars
from symbridge.functions import similarity as m
from symbridge.operators import components, decisions, lookups, matching, metadata, profiles
from symbridge.sources import address_library, listings, ordered_files


# The fields of the comparison and member reports and the lines of the summary, which other programs read.
COMPARISON_FIELDS = [
    "csv_row", "csv_name", "og_id", "ae_id", "og_rva", "ae_rva", "og_status", "ae_status", "classification", "score", "exact_semantic_hash", "og_name", "ae_name", "name_score", "size_score", "instruction_score", "cfg_score",
    "mnemonic_score", "shape_score", "calls_score", "callers_score", "strings_score", "member_offsets_score", "og_size", "ae_size", "og_instructions", "ae_instructions", "og_blocks", "ae_blocks", "og_calls", "ae_calls",
]
MEMBER_FIELDS = ["csv_row", "csv_name", "og_id", "ae_id", "score", "common_offsets", "og_only_offsets", "ae_only_offsets"]
SUMMARY_LINES = {
    "og_records": "OG records", "ae_records": "AE records", "compared": "Compared rows", "exact_semantics": "Exact semantic hash", "strong": "Strong matches", "likely": "Likely matches", "review": "Needs review",
    "suspect": "Suspect matches", "unresolved": "Unresolved functions", "missing_side": "Missing export side", "offset_changes": "Rows with object/member displacement changes",
}


def _scored_pairs(og: DataFrame, ae: DataFrame) -> DataFrame:
    """score_pairs() and, with missing_side, the rows of one side only."""
    j = lookups.pair_exports(og, ae)
    o, a = (lambda c: F.col(f"og.function.{c}")), (lambda c: F.col(f"ae.function.{c}"))
    name = lambda f: F.coalesce(f("demangled_name"), f("raw_name"), F.lit(""))
    j = m.name_similarity(j.withColumn("og_name", name(o)).withColumn("ae_name", name(a)), "og_name", "ae_name", "name_score", distinct=False)
    of = lambda f, c: f(o(c), a(c))
    parts = {
        "name": F.col("name_score"), "size": of(m.closeness, "size"), "instruction": of(m.closeness, "instruction_count"),
        "cfg": (of(m.closeness, "basic_block_count") + of(m.closeness, "cfg_edge_count")) / 2, "mnemonic": of(m.cosine, "mnemonics"), "shape": of(m.cosine, "instruction_shapes"),
        **{c: m.jaccard(m.pair_rows(o(c)).cast("array<string>"), m.pair_rows(a(c)).cast("array<string>")) for c in ("calls", "callers")},
        "strings": m.jaccard(m.string_values(o("strings")), m.string_values(a("strings"))),
        "member_offsets": m.jaccard(m.offset_values(o("object_displacements")).cast("array<string>"), m.offset_values(a("object_displacements")).cast("array<string>")),
    }
    ok = F.coalesce((o("status") == "ok") & (a("status") == "ok"), F.lit(False))
    exact = F.coalesce((o("semantic_sha256") != "") & (o("semantic_sha256") == a("semantic_sha256")), F.lit(False))
    # a column each, so that what is used often is worked out once
    j = j.withColumns({f"_{k}": F.when(ok, v).otherwise(0.0) for k, v in parts.items()})
    scores = {k: F.col(f"_{k}") for k in parts}
    j = j.withColumn("_score", m.weighted(scores, m.PAIR_WEIGHTS))
    score = F.col("_score")
    both = lambda short, c: [o(c).alias(f"og_{short}"), a(c).alias(f"ae_{short}")]
    return j.select(
        F.col("row").alias("csv_row"), F.col("og.csv_name").alias("csv_name"), F.col("og.og_id").alias("og_id"), F.col("og.ae_id").alias("ae_id"), F.col("og.og_rva").alias("og_rva"), F.col("og.ae_rva").alias("ae_rva"),
        m.classify(score, exact, ok).alias("classification"), F.round(score, 4).alias("score"), (exact & ok).alias("exact_semantic_hash"), *(F.round(v, 4).alias(f"{k}_score") for k, v in scores.items()),
        m.offset_values(o("object_displacements")).alias("og_offsets"), m.offset_values(a("object_displacements")).alias("ae_offsets"), *both("status", "status"), "og_name", "ae_name", *both("size", "size"),
        *both("instructions", "instruction_count"), *both("blocks", "basic_block_count"), *(F.coalesce(F.size(f("calls")), F.lit(0)).alias(f"{side}_calls") for side, f in (("og", o), ("ae", a))), "missing_side",
    )


def score_pairs(og: DataFrame, ae: DataFrame) -> DataFrame:
    """Comparison report of two exports of function records (schema of listings.FUNCTION_RECORD), a row a pair."""
    return _scored_pairs(og, ae).where("missing_side IS NULL").drop("missing_side")


def compare_exports(og: DataFrame, ae: DataFrame, folder: str) -> dict[str, int]:
    """Writes comparison.csv, suspects.csv and members.csv (by row) and summary.txt of two exports to the folder; the summary's counts.

    The pairs are scored in one pass, which also counts them (an observation), and written once; the reports are cut from that.
    """
    told, spark = Observation(), og.sparkSession
    kept, changed = F.col("missing_side").isNull(), (F.size(F.array_except("og_offsets", "ae_offsets")) > 0) | (F.size(F.array_except("ae_offsets", "og_offsets")) > 0)
    changed = changed & (F.col("og_status") == "ok") & (F.col("ae_status") == "ok")
    counts = {
        "og_records": ~F.col("missing_side").eqNullSafe("og"), "ae_records": ~F.col("missing_side").eqNullSafe("ae"), "compared": kept, **{c: kept & (F.col("classification") == c) for c in ("exact_semantics", "strong", "likely", "review", "suspect", "unresolved")},
        "missing_side": ~kept, "offset_changes": kept & F.coalesce(changed, F.lit(False)),
    }
    seen = _scored_pairs(og, ae).observe(told, *(F.count_if(c).alias(n) for n, c in counts.items()))
    rows = components.checkpointed(seen.where(kept).withColumn("_changed", F.coalesce(changed, F.lit(False))))
    digits = [F.format_string("%.4f", c).alias(c) if c == "score" or c.endswith("_score") else F.when(F.col(c), "yes").otherwise("no").alias(c) if c == "exact_semantic_hash" else scalars.render_rva(F.col(c)).alias(c) if c.endswith("_rva") else F.col(c) for c in COMPARISON_FIELDS]
    shown, in_order = rows.select(*digits), rows.repartitionByRange("csv_row").sortWithinPartitions("csv_row").select(*digits)  # text is made after sorting
    listings.write_report(in_order, COMPARISON_FIELDS, f"{folder}/comparison.csv")
    listings.write_report(decisions.split_suspects(in_order)[0], COMPARISON_FIELDS, f"{folder}/suspects.csv")
    members = decisions.offset_changes(rows.where("_changed").withColumnRenamed("csv_row", "row")).withColumnRenamed("row", "csv_row").join(shown.select("csv_row", "csv_name", "og_id", "ae_id", "score"), "csv_row")
    listings.write_report(members, MEMBER_FIELDS, f"{folder}/members.csv", ["csv_row"])
    out = {n: int(told.get[n]) for n in counts}
    lines = spark.createDataFrame([(i, f"{text}: {out[n]}") for i, (n, text) in enumerate(SUMMARY_LINES.items())], "at int, line string")
    ordered_files.write_text(lines, "line", f"{folder}/summary.txt", ["at"])
    return out


def audit_sources(source_lines: DataFrame, comparison: DataFrame, library: DataFrame) -> dict[str, DataFrame]:
    """uses, unmapped queue, suspect split, coverage and summaries of a source tree's ids."""
    uses = decisions.id_tokens(source_lines)
    compared = lookups.compared_uses(uses, comparison)
    suspects, _ = decisions.split_suspects(comparison)
    return {
        "uses": compared, "unmapped": lookups.unmapped_queue(uses, comparison), "suspects": suspects, "coverage": lookups.coverage(uses, library), "classes": decisions.unique_id_classes(compared),
        "changes": lookups.layout_evidence(decisions.offset_changes(comparison.withColumnRenamed("csv_row", "row")).join(comparison.select(F.col("csv_row").alias("row"), "og_id"), "row"), uses),
    }


def context_scores(xrefs: DataFrame, old: DataFrame, new: DataFrame, accesses: DataFrame, pairs: DataFrame, quality: DataFrame) -> DataFrame:
    """best_access()'s input from exports: every access of a paired new function, scored against every reference to a target in the old one.

    xrefs (og_id, func, idx) of the targets, old and new instructions (func, idx, sig, mnemonic), accesses (func, idx, target) of the new side
    (calls and jumps for functions, data references for globals), pairs (row, og_rva, ae_rva), quality (pair_row, pair_score, exact).
    Signatures and windows are short, so they are compared where they meet. Of globals, xrefs tell og_segment and accesses name and
    segment of their target; accesses of another class of segments are left out, and names and segments go along as ae_name, ae_segment.
    """
    columns = ["func", "idx", "sig", "window", "mnemonic", "position"]
    found = profiles.anchors(xrefs, profiles.contexts(old).select(columns), pairs)
    placed = accesses.join(profiles.contexts(new).select(columns), ["func", "idx"])
    each = profiles.access_candidates(found, placed).join(quality.select("pair_row", "exact"), "pair_row", "left")
    if "og_segment" in xrefs.columns:  # globals are looked for in the class of their segment
        wanted = scalars.segment_class(F.coalesce("og_segment", F.lit("")))
        each = each.where((wanted == "") | (wanted == scalars.segment_class(F.coalesce("new_segment", F.lit("")))))
    each = m.sequence_ratio(m.sequence_ratio(each, "sig", "new_sig", "_sig", distinct=False), "window", "new_window", "_window", distinct=False)
    same = F.coalesce("exact", F.lit(False)) & (F.col("idx") == F.col("new_idx"))
    score = m.context_score(F.col("_sig"), F.col("_window"), F.col("position"), F.col("new_position"), F.col("mnemonic") == F.col("new_mnemonic"), same)
    site = F.concat_ws(":", *(F.col(c).cast("string") for c in ("og_id", "func", "idx", "pair_row")))  # a function of several pairs is an anchor for each
    told = [F.col(f"new_{c}").alias(f"ae_{c}") for c in ("name", "segment") if c in accesses.columns]
    return each.select(site.alias("xref"), "og_id", "pair_row", F.col("new_target").alias("candidate"), score.alias("score"), *told)


def semantic_scores(targets: DataFrame, functions: DataFrame, mapped: DataFrame) -> DataFrame:
    """semantic_top()'s input from profiles: the candidates of each target among all functions, scored as pairs are.

    Both sides: rva, name, instruction_count, size, basic_block_count, cfg_edge_count, mnemonics and instruction_shapes (maps),
    semantic_sha256, and arrays of strings calls, callers, strings, member_offsets; targets also og_id. mapped (rva): functions taken by others.
    """
    j = m.name_similarity(matching.gated_candidates(targets, functions), "t_name", "f_name", "_name")
    of = lambda f, c: f(F.col(f"t_{c}"), F.col(f"f_{c}"))
    parts = {
        "name": F.col("_name"), "size": of(m.closeness, "size"), "instruction": of(m.closeness, "instruction_count"), "cfg": (of(m.closeness, "basic_block_count") + of(m.closeness, "cfg_edge_count")) / 2,
        "mnemonic": of(m.cosine, "mnemonics"), "shape": of(m.cosine, "instruction_shapes"), **{c: of(m.jaccard, c) for c in ("calls", "callers", "strings", "member_offsets")},
    }
    exact = F.coalesce((F.col("t_semantic_sha256") != "") & (F.col("t_semantic_sha256") == F.col("f_semantic_sha256")), F.lit(False))
    scored = j.select(F.col("t_og_id").alias("og_id"), F.col("f_rva").alias("candidate"), m.weighted(parts, m.PAIR_WEIGHTS).alias("score"), exact.alias("exact_hash"))
    taken = mapped.select(F.col("rva").alias("candidate"), F.lit(True).alias("_taken")).distinct()
    return scored.join(taken, "candidate", "left").withColumn("mapped_to_other", F.coalesce("_taken", F.lit(False))).drop("_taken")


def rank_candidates(targets: DataFrame, functions: DataFrame, mapped: DataFrame, calls: DataFrame, data: DataFrame, quality: DataFrame, globals_: DataFrame) -> dict[str, DataFrame]:
    """From exports to the ten best candidates: semantic (all targets against all functions), call (calls: context_scores() of functions) and data (of globals).

    globals_ (og_id, og_name): their names are compared with those of the candidates, which data tells as ae_name, ae_segment.
    """
    semantic = matching.semantic_top(semantic_scores(targets, functions, mapped))
    best = semantic.where("rank = 1").select("og_id", F.col("candidate").alias("semantic_rva"))
    called = matching.call_context_top(matching.votes(matching.best_access(calls, quality)), targets.select("og_id").join(best, "og_id", "left"))
    told = ("ae_name", "ae_segment")
    voted = matching.named_votes(matching.votes(matching.best_access(data, quality, told), told), globals_)
    return {"semantic": semantic, "call": called, "data": matching.global_context_top(voted)}


def rank_coreferences(og: DataFrame, ae: DataFrame, targets: DataFrame) -> DataFrame:
    """The ten best candidates of globals (targets: og_id, rva) by what paired functions refer to, and an unresolved row for a target without; from two exports of records.

    Each pair whose old function refers to a target votes for what its new one refers to in the same class of segments: a share, a bonus, and
    twice the similarity of names. Names and segments of a target are the most common ones of its references, the first seen on a tie.
    """
    pairs = lookups.pair_exports(og, ae, strict=True).where("og.function.status = 'ok' AND ae.function.status = 'ok'")
    refs = lambda side: pairs.select("row", F.explode(f"{side}.function.data_refs").alias("r")).select("row", "r.rva", F.coalesce("r.name", F.lit("")).alias("name"), F.coalesce("r.segment", F.lit("")).alias("segment"))
    one = lambda rows: lookups.last_wins(rows, ["row", "rva"], ["name", "segment"]).withColumn("segment_class", scalars.segment_class(F.col("segment")))
    old, new = components.checkpointed(one(refs("og"))), components.checkpointed(one(refs("ae")))
    hits = old.join(targets.select("rva").distinct(), "rva", "left_semi").select(F.col("rva").alias("target"), "row", F.col("name").alias("og_name"), F.col("segment").alias("og_segment"))
    cast = m.name_similarity(profiles.coreference_votes(old, new, targets), "og_name", "ae_name", "_name", form="reference").withColumn("weight", F.col("base_weight") + 2 * F.col("_name"))
    told = hits.groupBy("target").agg(F.count_distinct("row").alias("anchor_count"))
    for c in ("og_name", "og_segment"):
        told = told.join(matching.common_value(hits, "target", c, "row"), "target")
    totals = matching.coreference_totals(cast, ("ae_name", "ae_segment")).join(told, "target")
    named = m.name_similarity(totals, "og_name", "ae_name", "_name", form="reference").withColumn("name_score", F.round("_name", 4)).drop("_name")
    best = matching.coreference_top(named)
    out = targets.select("og_id", F.col("rva").alias("target")).join(best, "target", "left")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit("unresolved"))).withColumn("anchor_count", F.when(F.col("rank").isNull(), 0).otherwise(F.col("anchor_count")))


def compare_decompiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """A comparison of the evidence of both sides by og_id; a candidate on one side only is an error.

    Both: decisions.REVIEWED, name, size, pseudocode, instructions, calls, strings, first_64_bytes (null where they do not apply). Functions are scored by
    pseudocode, mnemonics, size, numbers of calls and strings; globals by their first bytes.
    """
    parts = ("target", "name", "size", "pseudocode", "instructions", "calls", "strings", "first_64_bytes")
    j = lookups.equal_key_join(old.select(*(c for c in decisions.REVIEWED if c not in ("target", "side")), F.struct(*parts).alias("o")), new.select("og_id", F.struct(*parts).alias("n")), "og_id")
    function, text = F.col("kind") == "function", lambda c: F.when(function, F.coalesce(c, F.lit(""))).otherwise("")
    j = j.withColumns({"_po": text(scalars.normalize_pseudocode(F.col("o.pseudocode"))), "_pn": text(scalars.normalize_pseudocode(F.col("n.pseudocode"))), "_mo": text(scalars.mnemonic_sequence(F.col("o.instructions"))), "_mn": text(scalars.mnemonic_sequence(F.col("n.instructions")))})
    j = j.withColumns({"_bo": F.when(function, "").otherwise(F.coalesce("o.first_64_bytes", F.lit(""))), "_bn": F.when(function, "").otherwise(F.coalesce("n.first_64_bytes", F.lit("")))})
    for a, b, name in (("_po", "_pn", "pseudocode_ratio"), ("_mo", "_mn", "mnemonic_ratio"), ("_bo", "_bn", "_bytes")):
        j = m.sequence_ratio(j, a, b, name, junk=False)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    only = lambda c: F.when(function, c)
    size, calls, strings = m.closeness(F.col("o.size"), F.col("n.size")), m.closeness(count("o.calls"), count("n.calls")), m.jaccard(F.col("o.strings"), F.col("n.strings"))
    score = F.when(function, m.decompile_score(F.col("pseudocode_ratio"), F.col("mnemonic_ratio"), size, calls, strings)).otherwise(F.col("_bytes"))
    return j.select(
        "og_id", "official_ae_id", "confidence_tier", "kind", "match_evidence", "symbol_name", F.col("o.target").alias("og_rva"), F.col("n.target").alias("ae_rva"), F.col("o.name").alias("og_name"), F.col("n.name").alias("ae_name"), F.col("o.size").alias("og_size"), F.col("n.size").alias("ae_size"),
        *(only(F.round(c, 6)).alias(n) for c, n in ((F.col("pseudocode_ratio"), "pseudocode_ratio"), (F.col("mnemonic_ratio"), "mnemonic_ratio"), (size, "size_ratio"), (calls, "call_count_ratio"), (strings, "string_jaccard"))), F.round(score, 6).alias("combined_score"),
    )


#: Counters of a decompile comparison, by bands of the functions' scores.
DECOMPILE_COUNTS = {
    "candidates_compared": "true", "functions_compared": "kind = 'function'", "at_least_085": "kind = 'function' AND combined_score >= 0.85", "at_least_070": "kind = 'function' AND combined_score >= 0.70",
    "under_050": "kind = 'function' AND combined_score < 0.50",
}


def report_decompiles(old: DataFrame, new: DataFrame, path: str) -> dict[str, int]:
    """Writes compare_decompiles() as one report by og_id and gives its counts, which the same pass observes."""
    told = Observation()
    compared = compare_decompiles(old, new).observe(told, *(F.count_if(F.expr(c)).alias(n) for n, c in DECOMPILE_COUNTS.items()))
    digits = [F.format_string("%.6f", c).alias(c) if c.endswith(("_ratio", "_jaccard", "_score")) else scalars.render_rva(F.col(c)).alias(c) if c.endswith("_rva") else F.col(c) for c in compared.columns]
    shown = components.checkpointed(compared.select(*(F.when(F.col(c).isNotNull(), d).alias(c) for c, d in zip(compared.columns, digits, strict=True))))
    listings.write_report(shown, shown.columns, path, ["og_id"])
    return {n: int(told.get[n]) for n in DECOMPILE_COUNTS}


def map_unmatched(scored: DataFrame, call_scored: DataFrame, data_scored: DataFrame, quality: DataFrame, used: DataFrame, confirmed: DataFrame, special: DataFrame, library: DataFrame, overrides: DataFrame) -> DataFrame:
    """From scored candidates to resolved ids: top lists, choices, consolidation, overrides, resolution.

    scored: semantic_top()'s input; call_scored and data_scored: best_access()'s input, data_scored with name_score.
    """
    semantic = matching.semantic_top(scored).where("rank = 1").select("og_id", F.col("candidate").alias("s_rva"), F.col("confidence").alias("s_confidence"))
    targets = used.select("og_id").join(semantic, "og_id", "left")
    calls = matching.call_context_top(matching.votes(matching.best_access(call_scored, quality)), targets.select("og_id", F.col("s_rva").alias("semantic_rva"))).where("rank = 1 OR rank IS NULL")
    f = targets.join(calls.select("og_id", F.col("candidate").alias("c_rva"), F.col("confidence").alias("c_confidence"), "exact_matched", "unique_pair_rows"), "og_id", "left")
    functions = f.select("og_id", decisions.function_choice(F.col("c_confidence"), F.col("c_rva"), F.col("exact_matched"), F.col("unique_pair_rows"), F.col("s_confidence"), F.col("s_rva")).alias("choice"))
    names = data_scored.groupBy("og_id", "candidate").agg(F.max("name_score").alias("name_score"))
    data = matching.global_context_top(matching.votes(matching.best_access(data_scored, quality)).join(names, ["og_id", "candidate"])).where("rank = 1")
    globals_ = data.select("og_id", decisions.global_choice(F.col("confidence"), F.col("candidate")).alias("choice"))
    rows = lookups.apply_overrides(decisions.consolidate(used, confirmed, special, functions, globals_), overrides)
    return decisions.resolve(rows.withColumn("existing_ae_id", F.lit(None).cast("string")), library)


def build_libraries(spark: SparkSession, matches: str, folder: str) -> DataFrame:
    """Links of the match files become groups, groups ids, and each version a library file in the folder; read back."""
    groups = components.linked_groups(listings.match_files(spark, matches))
    from symbridge.functions.scalars import render_version

    address_library.write(groups.select(render_version(F.col("version")).alias("version"), F.col("number").alias("id"), "rva"), folder)
    return address_library.read(spark, folder)


def migrate_headers(source_lines: DataFrame, parts: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of the new ID header, migration status by name) from discovered parts (name, slot, rva, id)."""
    kinds = metadata.relocation_kinds(parts)
    made = kinds.select("name", F.transform("values", lambda v: F.struct(F.col("kind").alias("kind"), v.alias("value"))).alias("values"))
    return listings.header_lines(made, tables=True), lookups.header_diff(listings.parse_header(source_lines), made, library)
