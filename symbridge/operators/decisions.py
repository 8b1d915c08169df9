"""Choose, consolidate, resolve and apply; summaries of tiers and statuses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbridge.operators.components import checkpointed
from symbridge.operators.intervals import containing, nearest
from symbridge.operators.lookups import aliases, first_wins, last_wins

# Fixed value: how far before an address its named owner may lie.
OWNER_DISTANCE = 0x2000

# Bytes of a conflict's text from which it is given a partition, and of different texts in a partition: with one more, under the 1 MB of a Parquet dictionary.
LONG, TEXTS = 1 << 13, 1 << 19


def _choice(rules: list[tuple[Column, Column, Column | str, Column | str]], tier: str, evidence: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    make = lambda rva, t, e: F.struct(rva.cast("bigint").alias("rva"), lit(t).alias("tier"), lit(e).alias("evidence"))
    out = None
    for condition, rva, t, e in rules:
        out = F.when(condition, make(rva, t, e)) if out is None else out.when(condition, make(rva, t, e))
    return out.otherwise(make(F.lit(None), tier, evidence))


def function_choice(c_confidence: Column, c_rva: Column, c_exact: Column, c_pair_rows: Column, s_confidence: Column, s_rva: Column) -> Column:
    """struct(rva, tier, evidence) from call-context (c) and semantic (s) evidence; the first rule that holds decides."""
    cc, sc = F.coalesce(c_confidence, F.lit("")), F.coalesce(s_confidence, F.lit(""))
    agrees = F.coalesce(c_rva == s_rva, F.lit(False))
    by = lambda a, b: F.when(agrees, a).otherwise(b)
    return _choice([
        (cc.isin("confirmed_agreement", "strong_agreement") & agrees, c_rva, "high", "semantic_and_call_context_agree"),
        ((cc == "strong_exact_context") & (c_exact >= 1), c_rva, "high", "exact_paired_callsite_context"),
        ((cc == "strong_context") & (c_pair_rows >= 3), c_rva, by("high", "medium"), by("strong_call_context_agrees", "strong_call_context_conflicts_semantic")),
        (cc.isin("likely_context", "likely_agreement"), c_rva, by("medium", "review"), by("likely_call_context_agrees", "likely_call_context_only")),
        ((cc == "review") & agrees, c_rva, "medium", "weak_call_context_agrees_with_semantic"),
        (sc == "exact_unique", s_rva, "high", "unique_exact_normalized_semantics"),
        (sc == "strong_unique", s_rva, "medium", "unique_strong_semantic_candidate"),
        (sc == "likely_unique", s_rva, "review", "unique_likely_semantic_candidate"),
        (s_rva.isNotNull(), s_rva, "review", "best_semantic_candidate_only"),
        (c_rva.isNotNull(), c_rva, "review", "best_call_context_candidate_only"),
    ], "unresolved", "no_function_candidate")


def global_choice(confidence: Column, rva: Column) -> Column:
    """struct(rva, tier, evidence) from data-context evidence; single_context is not used and stays unresolved."""
    c = F.coalesce(confidence, F.lit(""))
    return _choice([
        (c.isin("strong_name", "strong_exact_context"), rva, "high", c), (c == "strong_context", rva, "high", "strong_instruction_context"),
        (c == "likely_context", rva, "medium", "likely_instruction_context"), ((c == "review") & rva.isNotNull(), rva, "review", "ambiguous_instruction_context"),
    ], "unresolved", "no_paired_xref_candidate")


def demote_conflicts(rows: DataFrame) -> DataFrame:
    """Medium and review rows on the rva of another id's high row become review, the evidence naming those ids.

    Texts of all rows on a crowded rva grow with the square of its rows, different ones with its rows. So ids are put into text once for each
    rva and evidence, and rows of one text come out one after the other, in partitions of about TEXTS bytes of different ones: a column file's
    dictionary then holds each once. The ids are written to shared storage, and the bytes of texts counted, when this is called.
    """
    tier, named = F.col("confidence_tier"), F.lit("_rva_conflicts_with_high_id_")
    doubtful = tier.isin("medium", "review")
    joined = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    ids = lambda which: F.collect_set(F.when(which, F.col("og_id")))
    kind = F.coalesce("evidence", F.lit(""))
    at = rows.where("ae_rva IS NOT NULL").groupBy("ae_rva").agg(F.sort_array(ids(tier == "high")).alias("_high"), ids(doubtful).alias("_doubtful"), F.collect_set(F.when(doubtful, kind)).alias("_kinds"))
    own = F.array_intersect("_high", "_doubtful")  # an id with rows of both kinds does not name itself
    at = at.where((F.size("_high") > 0) & (F.size("_kinds") > 0)).select("ae_rva", "_kinds", joined(F.col("_high")).alias("_ids"), own.alias("_own"), F.when(F.size(own) > 0, F.col("_high")).alias("_high"))
    at = checkpointed(at).withColumn("_kind", F.explode("_kinds"))
    text = F.concat("_kind", named, "_ids")
    # a crowded rva's texts share partitions by their running total, which is of a row for LONG bytes at most; others are dealt by hash
    bytes_ = at.select("ae_rva", "_kind", F.octet_length(text).cast("bigint").alias("_bytes"))
    is_long = F.col("_bytes") >= LONG
    of_long, of_short = bytes_.agg(*(F.coalesce(F.sum(F.when(c, F.col("_bytes"))), F.lit(0)) for c in (is_long, ~is_long))).first()
    first = of_long // TEXTS + 1 if of_long else 0
    others = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), of_short // TEXTS + 1)
    if of_long:
        total = F.sum("_bytes").over(Window.orderBy("ae_rva", "_kind"))
        crowded = checkpointed(bytes_.where(is_long).select("ae_rva", "_kind", F.floor(total / TEXTS).cast("int").alias("_place")))

    def dealt(t: DataFrame) -> DataFrame:
        by_hash = F.lit(first) + F.pmod(F.hash("ae_rva", "_kind"), F.lit(others))
        t = t.join(crowded, ["ae_rva", "_kind"], "left").withColumn("_place", F.coalesce("_place", by_hash)) if of_long else t.withColumn("_place", by_hash)
        return t.repartitionById(first + others, F.col("_place"))

    # rows that can't be demoted meet no text and are dealt by their id
    asked = rows.withColumn("_kind", F.when(doubtful & F.col("ae_rva").isNotNull(), kind).otherwise(F.col("og_id").cast("string")))
    j = dealt(asked).join(dealt(at.select("ae_rva", "_kind", text.alias("_text"), "_own", "_high")).hint("merge"), ["_place", "ae_rva", "_kind"], "left")
    rest = F.filter("_high", lambda i: i != F.col("og_id"))
    names_itself = F.array_contains("_own", F.col("og_id"))
    hit = doubtful & F.col("_text").isNotNull() & (~names_itself | (F.size(rest) > 0))
    evidence = F.when(F.col("evidence").isNotNull(), F.when(names_itself, F.concat("evidence", named, joined(rest))).otherwise(F.col("_text")))
    return j.withColumn("evidence", F.when(hit, evidence).otherwise(F.col("evidence"))).withColumn("confidence_tier", F.when(hit, "review").otherwise(tier)).select(*rows.columns)


def consolidate(used: DataFrame, confirmed: DataFrame, special: DataFrame, functions: DataFrame, globals_: DataFrame) -> DataFrame:
    """One row per used id: a confirmed pair, else a special constant, else the function or global choice; conflicts demoted.

    used (og_id, kinds), confirmed (og_id, ae_rva, classification), special (og_id, ae_rva, evidence), functions and globals_ (og_id, choice).
    """
    j = (
        used.join(confirmed.select("og_id", F.col("ae_rva").alias("p_rva"), "classification"), "og_id", "left")
        .join(special.select("og_id", F.col("ae_rva").alias("x_rva"), F.col("evidence").alias("x_evidence")), "og_id", "left")
        .join(functions.select("og_id", F.col("choice").alias("f")), "og_id", "left").join(globals_.select("og_id", F.col("choice").alias("g")), "og_id", "left")
    )
    sure = F.col("classification").isin("exact_semantics", "strong")
    make = lambda rva, t, e, review: F.struct(rva.alias("rva"), t.alias("tier"), e.alias("evidence"), review.alias("review"))
    review = lambda t: F.when(t == "high", "no").otherwise("yes")
    f, g = F.coalesce(F.col("f"), function_choice(*[F.lit(None).cast(t) for t in ("string", "bigint", "int", "int", "string", "bigint")])), F.coalesce(F.col("g"), global_choice(F.lit(None).cast("string"), F.lit(None).cast("bigint")))
    tier = F.when(sure, "high").otherwise("medium")
    choice = (
        F.when(F.col("classification").isNotNull(), make(F.col("p_rva"), tier, F.concat(F.lit("confirmed_csv_pair_"), "classification"), review(tier)))
        .when(F.col("x_rva").isNotNull(), make(F.col("x_rva"), F.lit("high"), F.col("x_evidence"), F.lit("no")))
        .when(F.col("kinds") == "function", make(f["rva"], f["tier"], f["evidence"], review(f["tier"])))
        .otherwise(make(g["rva"], g["tier"], g["evidence"], review(g["tier"])))
    )
    rows = j.withColumn("c", choice).select("og_id", "kinds", F.col("c.rva").alias("ae_rva"), F.col("c.tier").alias("confidence_tier"), F.col("c.evidence").alias("evidence"), F.col("c.review").alias("manual_review"))
    return demote_conflicts(rows)


def resolve(rows: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates with the official id of their rva and statuses of the library, of the existing id and of the old id.

    rows: og_id, ae_rva, existing_ae_id (text; a list of ids counts as none).
    """
    known = rows.join(aliases(library).withColumnRenamed("rva", "ae_rva"), "ae_rva", "left")
    old = last_wins(library.select("id", "pos", "rva"), ["id"], ["pos"]).select(F.col("id").alias("og_id"), F.col("rva").alias("old_id_ae_rva"))
    known = known.join(old, "og_id", "left")
    existing = F.trim("existing_ae_id").try_cast("bigint")
    status = F.when(F.col("ae_rva").isNull(), "unresolved_candidate").when(F.col("ids").isNull(), "rva_missing_from_address_library").when(F.size("ids") == 1, "resolved_unique").otherwise("resolved_aliases")
    match = F.when(existing.isNull() | F.col("ids").isNull(), "not_comparable").when(F.array_contains("ids", existing), "match").otherwise("conflict")
    return known.select(
        *rows.columns, F.col("official_id").alias("official_ae_id"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("official_ae_ids"), status.alias("address_library_status"),
        match.alias("existing_ae_id_status"), "old_id_ae_rva", F.coalesce(F.col("old_id_ae_rva") == F.col("ae_rva"), F.lit(False)).alias("old_id_matches_candidate"),
    )


def library_stats(library: DataFrame, rows: DataFrame) -> DataFrame:
    """entries, distinct rvas, old ids present, old ids already equal to the candidate, in one long table (metric, value)."""
    own = library.agg(F.count("*").alias("entries"), F.count_distinct("rva").alias("distinct_rvas"))
    of = resolve(rows, library).agg(F.count("old_id_ae_rva").alias("old_ids_present"), F.count_if("old_id_matches_candidate").alias("old_ids_equal"))
    return long_metrics(own.crossJoin(of))  # one row each


def long_metrics(one_row: DataFrame) -> DataFrame:
    """(metric, value) of a one-row table of counts."""
    return one_row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in one_row.columns))).alias("m")).select("m.*")


def summary(rows: DataFrame, column: str) -> DataFrame:
    """total and one counter per value of a column."""
    each = rows.groupBy(F.coalesce(F.col(column), F.lit("none")).alias("metric")).agg(F.count("*").alias("value"))
    return each.unionAll(rows.groupBy(F.lit("total").alias("metric")).agg(F.count("*").alias("value")))


def unique_id_classes(uses: DataFrame) -> DataFrame:
    """Classes counted once per id, not per use."""
    return uses.groupBy("og_id").agg(F.min("classification").alias("classification")).groupBy("classification").agg(F.count("*").alias("ids"))


def score_bands(rows: DataFrame, score: str) -> DataFrame:
    return long_metrics(rows.agg(F.count_if(F.col(score) >= 0.85).alias("at_least_085"), F.count_if(F.col(score) >= 0.70).alias("at_least_070"), F.count_if(F.col(score) < 0.50).alias("under_050")))


def split_suspects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of class suspect, review or unresolved; the others)."""
    doubtful = F.col("classification").isin("suspect", "review", "unresolved")
    return rows.where(doubtful), rows.where(~doubtful)


def offset_changes(rows: DataFrame) -> DataFrame:
    """row, common, old-only and new-only member offsets (hex lists) of pairs whose offset sets (og_offsets, ae_offsets) differ."""
    shown = lambda a: F.array_join(F.transform(F.array_sort(a), lambda v: F.concat(F.lit("0x"), F.hex(v))), ",")
    a, b = F.array_distinct("og_offsets"), F.array_distinct("ae_offsets")
    differ = (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    return rows.where(differ).select("row", shown(F.array_intersect(a, b)).alias("common_offsets"), shown(F.array_except(a, b)).alias("og_only_offsets"), shown(F.array_except(b, a)).alias("ae_only_offsets"))


#: What review records tell of their candidate beside the evidence.
REVIEWED = ("og_id", "official_ae_id", "symbol_name", "kind", "confidence_tier", "match_evidence", "side", "target")


def review_selection(rows: DataFrame, side: str = "ae221") -> DataFrame:
    """Medium and review rows whose existing id is no match, as REVIEWED: target is their address on the side (og: og_rva, else ae_rva)."""
    picked = rows.where(F.col("confidence_tier").isin("medium", "review") & (F.coalesce("existing_ae_id_status", F.lit("")) != "match"))
    return picked.select("og_id", "official_ae_id", "symbol_name", "kind", "confidence_tier", F.col("evidence").alias("match_evidence"), F.lit(side).alias("side"), F.col("og_rva" if side == "og" else "ae_rva").alias("target"))


#: Lists of a function that its evidence tells.
EVIDENCE = ("instructions", "calls", "data_refs", "strings", "callers", "incoming_data_refs")


def function_evidence(rows: DataFrame, instructions: DataFrame, functions: DataFrame, strings: DataFrame, names: DataFrame, shown: dict[str, Column] | None = None) -> DataFrame:
    """review_selection() of functions with what the function at the target holds; status not_a_function where there is none.

    instructions: ea, func (a start_ea), text, callee and data_ref (addresses); functions: start_ea, end_ea, name and further columns
    (type, pseudocode); strings: ea, text; names: ea, name. References carry the name at their address, incoming ones their nearest
    owner. Lists are bounded by a function, those of references to it by the selection: only its functions are looked at. Rows of
    both sides may come together; a function is then looked at once. shown: other forms of the lists (by name, columns on EVIDENCE), made
    once for each function, not for each row on it.
    """
    placed = checkpointed(containing(rows.where("kind = 'function'"), functions, "target"))
    picked = placed.select(F.col("start_ea").alias("func")).where("func IS NOT NULL").distinct()
    called = first_wins(names.select("ea", "name"), ["ea"], ["name"])
    at = lambda c: called.select(F.col("ea").alias(c), F.col("name").alias(f"{c}_name"))
    own = instructions.join(picked, "func", "left_semi").join(strings.select(F.col("ea").alias("data_ref"), F.col("text").alias("string")), "data_ref", "left")
    own = own.join(at("callee"), "callee", "left").join(at("data_ref"), "data_ref", "left")
    listed = lambda target: F.sort_array(F.collect_list(F.when(F.col(target).isNotNull(), F.struct(F.col("ea").alias("from_rva"), F.col(target).alias("rva"), F.col(f"{target}_name").alias("name")))))
    held = own.groupBy("func").agg(F.sort_array(F.collect_list(F.struct("ea", "text"))).alias("i"), listed("callee").alias("calls"), listed("data_ref").alias("data_refs"), F.sort_array(F.collect_set("string")).alias("strings"))
    held = held.withColumn("instructions", F.col("i.text")).drop("i")
    callers = instructions.select(F.col("func").alias("caller"), F.col("callee").alias("func")).join(picked, "func", "left_semi").join(at("caller"), "caller", "left")
    callers = callers.groupBy("func").agg(F.sort_array(F.collect_list(F.struct(F.col("caller").alias("rva"), F.col("caller_name").alias("name")))).alias("callers"))
    to = checkpointed(instructions.select(F.col("ea").alias("from_rva"), F.col("data_ref").alias("func")).join(picked, "func", "left_semi"))  # nearest() looks at it thrice
    owned = nearest(to, called.select(F.col("ea").alias("owner_rva"), F.col("name").alias("owner_name")), "from_rva", "owner_rva", forward=False, within=OWNER_DISTANCE)
    slot = F.floor((F.col("from_rva") - F.col("owner_rva")) / 8).alias("slot")
    incoming = owned.groupBy("func").agg(F.sort_array(F.collect_list(F.struct("from_rva", "owner_rva", "owner_name", slot))).alias("incoming_data_refs"))
    lists = held.join(callers, "func", "full").join(incoming, "func", "full")
    lists = lists.select("func", *((shown or {}).get(c, F.col(c)).alias(c) for c in EVIDENCE))
    out = placed.withColumnRenamed("start_ea", "func").join(lists, "func", "left")
    more = [c for c in functions.columns if c not in ("start_ea", "end_ea")]
    return out.select(
        *REVIEWED, F.when(F.col("func").isNull(), "not_a_function").otherwise("ok").alias("status"), F.col("func").alias("start_rva"), F.col("end_ea").alias("end_rva"), (F.col("end_ea") - F.col("func")).alias("size"), *more, *EVIDENCE,
    )


def global_evidence(rows: DataFrame, words: DataFrame, instructions: DataFrame, functions: DataFrame, names: DataFrame, segments: DataFrame) -> DataFrame:
    """review_selection() of globals with the name and segment at the target, its first 64 bytes (hex, from 8-byte words; "" if one is unknown) and the references to it.

    names: ea, name; segments: name, start_ea, end_ea; functions: start_ea, name. A reference tells from_rva, function_rva, function_name and text.
    """
    picked = rows.where("kind <> 'function'")
    at = picked.select("target").distinct()
    swapped = lambda q: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(q), 16, "0"), F.lit("(..)"), F.lit(1))), "")
    each = at.select("target", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n")).join(words.select("ea", "qword"), F.col("ea") == F.col("target") + 8 * F.col("n"))
    held = each.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("n", F.lower(swapped(F.col("qword"))).alias("hex")))).alias("l"))
    held = held.where(F.size("l") == 8).select("target", F.array_join(F.col("l.hex"), "").alias("first_64_bytes"))
    refs = instructions.select(F.col("data_ref").alias("target"), F.col("ea").alias("from_rva"), F.col("func").alias("function_rva"), "text").join(at, "target", "left_semi")
    refs = refs.join(functions.select(F.col("start_ea").alias("function_rva"), F.col("name").alias("function_name")), "function_rva", "left")
    refs = refs.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("from_rva", "function_rva", "function_name", "text"))).alias("xrefs"))
    named = first_wins(names.select(F.col("ea").alias("target"), "name"), ["target"], ["name"]).join(at, "target", "left_semi")
    inside = first_wins(containing(at, segments.select(F.col("name").alias("segment"), "start_ea", "end_ea"), "target", how="inner").select("target", "start_ea", "segment"), ["target"], ["start_ea", "segment"]).select("target", "segment")
    out = picked.join(held, "target", "left").join(refs, "target", "left").join(named, "target", "left").join(inside, "target", "left")
    return out.select(*REVIEWED, F.lit("ok").alias("status"), "name", "segment", F.coalesce("first_64_bytes", F.lit("")).alias("first_64_bytes"), "xrefs")


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """og_id, side and line of evidence as JSON records: what REVIEWED tells, the address in hex, and all else as the record's evidence."""
    from symbridge.functions.scalars import render_rva

    rest = F.struct(*(c for c in evidence.columns if c not in REVIEWED))
    record = F.struct("kind", "side", "og_id", "official_ae_id", "symbol_name", "confidence_tier", "match_evidence", render_rva(F.col("target")).alias("target_rva"), rest.alias("evidence"))
    return evidence.select("og_id", "side", F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))


TOKEN = r"REL::ID\s*\(\s*(\d+)\s*\)"


def id_tokens(lines: DataFrame, spaces: bool = True) -> DataFrame:
    """Every id token of source lines (file, line, text): og_id, file, line, kind; spaces: white space before the parenthesis is allowed."""
    from symbridge.functions.scalars import use_kind

    pattern = "(?U)" + (TOKEN if spaces else TOKEN.replace(r"ID\s*", "ID"))
    return lines.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("id"), "file", "line", use_kind(F.col("text")).alias("kind")).select(F.col("id").try_cast("bigint").alias("og_id"), "file", "line", "kind")


def select_replacements(report: DataFrame, root: str, tiers: tuple[str, ...] = ("high",), include_existing: bool = False) -> DataFrame:
    """(og_id, new_id, file, place) of the rows of a resolved report that are to be applied, one for each file named in locations; a row's first has place 0.

    Rows of the tiers, or (include_existing) whose existing id matches; of these only resolved_unique ones to be replaced by id alone.
    A place is `root/include/..:line` or `root/src/..:line`; a selected row without one is an error.
    """
    chosen = F.col("confidence_tier").isin(list(tiers))
    if include_existing:
        chosen = F.coalesce(chosen, F.lit(False)) | F.coalesce(F.col("existing_ae_id_status") == "match", F.lit(False))
    rows = report.where(chosen & (F.col("address_library_status") == "resolved_unique") & (F.coalesce("replacement_strategy", F.lit("id_only")) == "id_only"))
    files = F.array_distinct(F.regexp_extract_all(F.coalesce("locations", F.lit("")), F.lit(f"({re.escape(root)}/(?:include|src)/[^,:]+):[0-9]+"), F.lit(1)))
    lost = F.raise_error(F.concat(F.lit("no source location for "), F.col("og_id").cast("string"))).cast("array<string>")
    return rows.select("og_id", F.col("official_ae_id").alias("new_id"), F.posexplode(F.when(F.size(files) == 0, lost).otherwise(files)).alias("place", "file")).select("og_id", "new_id", "file", "place")


def replacement_summary(selected: DataFrame, applied: DataFrame) -> DataFrame:
    """(metric, value): selected rows of the report, files affected, tokens replaced, mappings already applied; what a dry run reports."""
    return selected.agg(F.count_if(F.col("place") == 0).alias("value")).select(F.lit("selected_rows").alias("metric"), "value").unionAll(
        long_metrics(applied.agg(F.count_if("changed").alias("files_affected"), F.coalesce(F.sum("replaced"), F.lit(0)).alias("tokens_replaced"), F.coalesce(F.sum("already"), F.lit(0)).alias("already_applied")))
    )


def apply_ids(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """files (file, text and others) with id tokens replaced, all at once: file, text, replaced, already, changed and the others; conflicting new ids are an error.

    resolved: (og_id, new_id, file). A file that holds neither the old nor the new token of one of its rows is an error.
    """
    each = resolved.groupBy("file", "og_id").agg(F.min("new_id").alias("new_id"), F.max("new_id").alias("_other"))
    sure = each.withColumn("new_id", F.when(F.col("new_id") != F.col("_other"), F.raise_error(F.concat(F.lit("conflicting new ids for "), F.col("og_id").cast("string"))).cast("bigint")).otherwise(F.col("new_id")))
    maps = sure.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.col("og_id").cast("string"), F.col("new_id").cast("string")))).alias("ids"))
    j = files.join(maps, "file")
    token = lambda i: F.concat(F.lit(r"REL::ID\(\s*"), i, F.lit(r"\s*\)"))
    olds = F.map_keys("ids")
    there = lambda i: F.rlike("text", token(i))
    lost = F.exists(olds, lambda o: ~there(o) & ~there(F.element_at("ids", o)))
    # pieces between tokens, and the tokens' ids, zipped back together
    pieces, tokens = F.split("text", r"REL::ID\(\s*\d+\s*\)", -1), F.regexp_extract_all("text", F.lit(r"REL::ID\(\s*\d+\s*\)"), F.lit(0))
    ids = F.transform(tokens, lambda t: F.regexp_extract(t, r"\d+", 0))
    renewed = F.transform(tokens, lambda t: F.coalesce(F.concat(F.lit("REL::ID("), F.try_element_at("ids", F.regexp_extract(t, r"\d+", 0)), F.lit(")")), t))
    new = F.array_join(F.zip_with(pieces, renewed, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    text = F.when(lost, F.raise_error(F.concat(F.lit("a token stands in neither form in "), F.col("file"))).cast("string")).otherwise(new)
    others = [c for c in files.columns if c not in ("file", "text")]
    return j.select("file", *others, text.alias("_new"), (new != F.col("text")).alias("changed"), F.size(F.filter(ids, lambda i: F.map_contains_key("ids", i))).alias("replaced"), F.size(F.filter(olds, lambda o: ~there(o) & there(F.element_at("ids", o)))).alias("already")).select("file", F.col("_new").alias("text"), "replaced", "already", "changed", *others)
