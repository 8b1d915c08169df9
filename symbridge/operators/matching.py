"""Candidates for unmatched symbols, their votes, and the ten best with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbridge.functions.similarity import closeness, cosine, name_similarity, similar_names
from symbridge.operators.components import checkpointed

TOP = 10
# The gates of whole-database candidates and of context votes.
INSTRUCTION_GATE, SIZE_GATE, NAME_GATE, MNEMONIC_GATE = 0.25, 0.20, 0.72, 0.45
LEAST_CONTEXT, NEAR_TIE, UNKNOWN_QUALITY, EXACT_FACTOR, MAPPED_PENALTY = 0.58, 0.015, 0.5, 1.5, 0.025


def _class(side: str) -> Column:
    """A number for what the count branch looks at: functions of equal counts, sizes and mnemonics are one class (by a 64-bit hash)."""
    entries = F.sort_array(F.map_entries(F.coalesce(f"{side}_mnemonics", F.create_map().cast("map<string,bigint>"))))
    return F.xxhash64(F.coalesce(f"{side}_instruction_count", F.lit(0)), F.coalesce(f"{side}_size", F.lit(0)), entries)


def _sides(targets: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame, Column, Column]:
    t = targets.select(*(F.col(c).alias(f"t_{c}") for c in targets.columns)).withColumn("_t", _class("t"))
    f = functions.select(*(F.col(c).alias(f"f_{c}") for c in functions.columns)).withColumn("_f", _class("f"))
    close = (closeness(F.col("t_instruction_count"), F.col("f_instruction_count")) >= INSTRUCTION_GATE) & (closeness(F.col("t_size"), F.col("f_size")) >= SIZE_GATE)
    return t, f, close, F.coalesce(F.col("t_semantic_sha256") == F.col("f_semantic_sha256"), F.lit(False))


def near_classes(t: DataFrame, f: DataFrame, close: Column) -> DataFrame:
    """(_t, _f, cosine): the pairs of classes whose counts are close and whose mnemonics are similar; each pair of classes is judged once.

    Closeness of at least 1/4 and 1/5 keeps pairs within one step of the logarithms to base 4 and 5. Mnemonics are an inverted index:
    a posting for each mnemonic of a class, with its steps, so classes meet on a mnemonic and steps alone, and their products are summed
    (in integers, so in any order) as pairs of numbers. A pair without a common mnemonic has cosine 0, or 1 where both have none at all.
    """
    log = lambda c, base: F.when(F.coalesce(c, F.lit(0)) == 0, -1).otherwise(F.floor(F.log(float(base), F.abs(c).cast("double")) + 1e-9)).cast("int")
    step = lambda b: F.explode(F.when(b < 0, F.array(b)).otherwise(F.sequence(F.greatest(b - 1, F.lit(0)), b + 1)))
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("value"))

    def postings(rows: DataFrame, s: str) -> DataFrame:
        listed = F.map_entries(F.coalesce(f"{s}_mnemonics", F.create_map().cast("map<string,bigint>")))
        one = rows.groupBy(f"_{s}").agg(F.struct(F.first(f"{s}_instruction_count").alias("n"), F.first(f"{s}_size").alias("z"), F.first(listed).alias("m")).alias("x"))
        square = F.aggregate("x.m", F.lit(0).cast("bigint"), lambda a, e: a + e["value"] * e["value"])
        each = one.select(f"_{s}", F.col("x.n").alias(f"{s}_instruction_count"), F.col("x.z").alias(f"{s}_size"), square.alias(f"_{s}2"), F.explode(F.when(F.size("x.m") == 0, F.array(none)).otherwise(F.col("x.m"))).alias("e"))
        return each.select("*", F.col("e.key").alias(f"_{s}m"), F.col("e.value").alias(f"_{s}w")).drop("e")

    a = postings(t, "t").withColumn("_a", step(log(F.col("t_instruction_count"), 4))).withColumn("_b", step(log(F.col("t_size"), 5)))
    b = postings(f, "f").withColumns({"_a2": log(F.col("f_instruction_count"), 4), "_b2": log(F.col("f_size"), 5)})
    met = a.join(b, F.col("_tm").eqNullSafe(F.col("_fm")) & (F.col("_a") == F.col("_a2")) & (F.col("_b") == F.col("_b2")) & close)
    dots = met.groupBy("_t", "_f").agg(F.sum(F.col("_tw") * F.col("_fw")).alias("_dot"), F.first("_t2").alias("_t2"), F.first("_f2").alias("_f2"), F.bool_and(F.col("_tm").isNull()).alias("_none"))
    similar = F.when(F.col("_none"), 1.0).when((F.col("_t2") == 0) | (F.col("_f2") == 0), 0.0).otherwise(F.col("_dot") / (F.sqrt("_t2") * F.sqrt("_f2")))
    return dots.select("_t", "_f", similar.alias("cosine")).where(F.col("cosine") >= MNEMONIC_GATE)


#: Targets that are broadcast to the pairs with all their columns; beyond it pairs are shuffled to them.
MOST_TARGETS = 5000


def gated_candidates(targets: DataFrame, functions: DataFrame) -> DataFrame:
    """(target, candidate) pairs of functions that pass the gates, without comparing all pairs.

    Both sides have rva (unique among functions), name, instruction_count, size, mnemonics (map), semantic_sha256. A pair is eligible if
    the hashes are equal; or both counts are close enough and the mnemonics are similar (near_classes()); or they are not close and the
    names are similar (similar_names()). Pairs are found and shuffled as addresses; the columns of both sides join them at the end, those
    of up to MOST_TARGETS targets by broadcast.
    """
    t, f, close, same = _sides(targets, functions)
    ids = lambda df: df.select("t_rva", "f_rva")
    a, b = t.select("t_rva", "_t", "t_semantic_sha256"), f.select("f_rva", "_f", "f_semantic_sha256")
    equal = ids(a.join(b, F.col("t_semantic_sha256") == F.col("f_semantic_sha256")))
    near = ids(a.join(near_classes(t, f, close).drop("cosine"), "_t").join(b, "_f").where(~same))
    pairs = equal.unionAll(near).unionAll(ids(_by_name(t, f, close, same))).distinct()
    few = F.broadcast if targets.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS else lambda df: df
    return pairs.join(f.drop("_f"), "f_rva").join(few(t.drop("_t")), "t_rva").select(*(c for c in (*t.columns, *f.columns) if c not in ("_t", "_f")))


def ten_most_similar(targets: DataFrame, functions: DataFrame, top: int = TOP) -> DataFrame:
    """(t_rva, f_rva, cosine, rank): of the gated candidates of each target the ten of the most similar mnemonics, then of the highest address.

    Functions of one class are equal here, so only the highest ten addresses of a class can be among a target's ten, and only ten of the
    members of all classes that are near a target's class: what is written grows with the targets, not with the pairs.
    """
    t, f, close, same = _sides(targets, functions)
    best = lambda df, keys, by: df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col("_n") <= top).drop("_n")
    shown = F.round("cosine", 12).alias("cosine")  # equal cosines of different classes may differ in their last bits
    order = [F.desc("cosine"), F.desc("f_rva")]
    near = checkpointed(near_classes(t, f, close))
    members = best(f.select("_f", "f_rva"), ["_f"], [F.desc("f_rva")])
    # every class has a member, so the ten best are of the classes whose cosine is among the ten largest of a target's class
    nearest = near.select("_t", "_f", shown).withColumn("_n", F.rank().over(W.partitionBy("_t").orderBy(F.desc("cosine")))).where(F.col("_n") <= top).drop("_n")
    by_class = best(nearest.join(members, "_f").select("_t", "f_rva", "cosine"), ["_t"], order)
    # equal hashes whose classes are not near, a pair of classes once
    hashes = f.select(F.col("f_semantic_sha256").alias("t_semantic_sha256"), "_f").distinct()
    far = t.select("t_semantic_sha256", "_t").distinct().join(hashes, "t_semantic_sha256").join(near, ["_t", "_f"], "left_anti")
    empty = F.create_map().cast("map<string,bigint>")
    maps = lambda df, s: df.groupBy(f"_{s}").agg(F.first(F.map_entries(F.coalesce(f"{s}_mnemonics", empty))).alias(f"_{s}m"))
    classes = far.select("_t", "_f").distinct().join(maps(t, "t"), "_t").join(maps(f, "f"), "_f")
    judged = classes.select("_t", "_f", F.round(cosine(F.map_from_entries("_tm"), F.map_from_entries("_fm")), 12).alias("cosine"))
    held = best(f.select(F.col("f_semantic_sha256").alias("t_semantic_sha256"), "_f", "f_rva"), ["t_semantic_sha256", "_f"], [F.desc("f_rva")])
    by_hash = best(far.join(judged, ["_t", "_f"]).join(held, ["t_semantic_sha256", "_f"]).select("t_semantic_sha256", "_t", "f_rva", "cosine"), ["t_semantic_sha256", "_t"], order)
    named = _by_name(t, f, close, same).select("t_rva", "f_rva", F.round(cosine(F.col("t_mnemonics"), F.col("f_mnemonics")), 12).alias("cosine"))
    pick = ["t_rva", "f_rva", "cosine"]
    found = t.select("t_rva", "_t").join(by_class, "_t").select(pick).unionAll(t.select("t_rva", "t_semantic_sha256", "_t").join(by_hash, ["t_semantic_sha256", "_t"]).select(pick)).unionAll(named.select(pick))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("t_rva").orderBy(*order))).where(F.col("rank") <= top)


def gate_counts(targets: DataFrame, functions: DataFrame) -> DataFrame:
    """(t_rva, candidates, total): how many candidates gated_candidates() gives each target (0 if none), and the sum of their rvas, without writing the pairs out.

    Equal hashes and classes are counted as groups, so a function that very many others equal costs no more than any other.
    """
    t, f, close, same = _sides(targets, functions)
    near = checkpointed(near_classes(t, f, close).drop("cosine"))
    held = lambda keys: f.groupBy(*keys).agg(F.count("*").alias("candidates"), F.sum("f_rva").alias("total"))
    by_class = near.join(held(["_f"]), "_f").groupBy("_t").agg(F.sum("candidates").alias("candidates"), F.sum("total").alias("total"))
    far = t.select("t_semantic_sha256", "_t").distinct().join(held(["f_semantic_sha256", "_f"]), F.col("t_semantic_sha256") == F.col("f_semantic_sha256")).join(near, ["_t", "_f"], "left_anti")
    by_hash = far.groupBy("t_semantic_sha256", "_t").agg(F.sum("candidates").alias("candidates"), F.sum("total").alias("total"))
    named = _by_name(t, f, close, same).groupBy("t_rva").agg(F.count("*").alias("candidates"), F.sum("f_rva").alias("total"))
    found = t.join(by_class, "_t").select("t_rva", "candidates", "total").unionAll(t.join(by_hash, ["t_semantic_sha256", "_t"]).select("t_rva", "candidates", "total")).unionAll(named)
    found = found.unionAll(t.select("t_rva", F.lit(0).cast("bigint").alias("candidates"), F.lit(0).cast("bigint").alias("total")))
    return found.groupBy("t_rva").agg(F.sum("candidates").alias("candidates"), F.sum("total").alias("total"))


def _by_name(t: DataFrame, f: DataFrame, close: Column, same: Column) -> DataFrame:
    a, b = t.select(F.col("t_name").alias("left")).distinct(), f.select(F.col("f_name").alias("right")).distinct()
    named = similar_names(a, b, NAME_GATE).select(F.col("left").alias("t_name"), F.col("right").alias("f_name"))
    return t.join(named, "t_name").join(f, "f_name").where(~same & ~close).select(*t.columns, *f.columns)


def best_access(scored: DataFrame, quality: DataFrame, descriptor: tuple[str, ...] = ()) -> DataFrame:
    """The one access of each reference: xref, og_id, pair_row, candidate, top, weight, exact, and the descriptor columns of the best access.

    scored: (xref, og_id, pair_row, candidate, score, descriptor columns). A reference is dropped if its best score is under .58 or if accesses
    within .015 of the best lead to different candidates. quality: (pair_row, pair_score, exact); a pair without counts as (.5, not exact).
    """
    top = scored.withColumn("top", F.max("score").over(W.partitionBy("xref")))
    near = top.where((F.col("top") >= LEAST_CONTEXT) & (F.col("top") - F.col("score") <= NEAR_TIE))
    told = [F.max_by(F.struct(*descriptor), F.struct("score", *descriptor)).alias("_told")] if descriptor else []
    one = near.groupBy("xref", "og_id", "pair_row").agg(F.min("candidate").alias("candidate"), F.max("candidate").alias("_other"), F.max("top").alias("top"), *told).where("candidate = _other").drop("_other")
    judged = one.join(quality, "pair_row", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    factor = F.when(F.col("exact"), EXACT_FACTOR).otherwise(F.greatest(F.lit(UNKNOWN_QUALITY), F.coalesce("pair_score", F.lit(UNKNOWN_QUALITY))))
    judged = judged.withColumn("weight", F.col("top") * factor).drop("pair_score")
    return judged.select("*", "_told.*").drop("_told") if descriptor else judged


#: Scores are added as whole numbers of this part of 1, so that a sum does not depend on the order of its terms.
FIXED = 1_000_000_000


def fixed(score: Column) -> Column:
    return F.round(score * FIXED).cast("bigint")


def fixed_sum(score: Column, digits: int) -> Column:
    """The sum of scores, rounded half up to so many digits."""
    return _rounded(F.sum(fixed(score)), FIXED // 10**digits) / 10**digits


def fixed_mean(score: Column, digits: int) -> Column:
    """The mean of scores, rounded half up to so many digits."""
    return _rounded(F.sum(fixed(score)), F.count(score) * (FIXED // 10**digits)) / 10**digits


def _rounded(n: Column, unit: Column | int) -> Column:
    """n / unit to the nearest whole number; n is not negative."""
    unit = F.lit(unit).cast("bigint")
    return F.call_function("div", 2 * n + unit, 2 * unit)


def votes(best: DataFrame, descriptor: tuple[str, ...] = ()) -> DataFrame:
    """By (og_id, candidate): vote_score (6 digits), matched, exact, unique pair rows, mean_score (4 digits), and the descriptor columns of the last reference (xref)."""
    told = [F.max_by(F.struct(*descriptor), "xref").alias("_told")] if descriptor else []
    out = best.groupBy("og_id", "candidate").agg(
        fixed_sum(F.col("weight"), 6).alias("vote_score"), F.count("*").alias("matched"), F.count_if("exact").alias("exact_matched"),
        F.count_distinct("pair_row").alias("unique_pair_rows"), fixed_mean(F.col("top"), 4).alias("mean_score"), *told,
    )
    return out.select("*", "_told.*").drop("_told") if descriptor else out


def named_votes(voted: DataFrame, targets: DataFrame) -> DataFrame:
    """votes() with their descriptor ae_name, and name_score (4 digits): the strict similarity to the target's name; targets (og_id, og_name)."""
    both = voted.join(targets.select("og_id", "og_name"), "og_id", "left")
    return name_similarity(both, "og_name", "ae_name", "_score", form="strict").withColumn("name_score", F.round("_score", 4)).drop("_score")


def coreference_totals(cast: DataFrame, descriptor: tuple[str, ...] = ()) -> DataFrame:
    """By (target, candidate) of votes with weight and n_refs: vote_score, candidate anchors, single-candidate anchors, and the descriptor columns of the last anchor (row)."""
    told = [F.max_by(F.struct(*descriptor), "row").alias("_told")] if descriptor else []
    out = cast.groupBy("target", "candidate").agg(
        fixed_sum(F.col("weight"), 6).alias("vote_score"), F.count_distinct("row").alias("unique_anchor_count"), F.count_if(F.col("n_refs") == 1).alias("single_candidate_anchors"), *told
    )
    return out.select("*", "_told.*").drop("_told") if descriptor else out


def common_value(hits: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """By key: the most common value, the first seen on a tie."""
    counted = hits.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(value))


def ranked(candidates: DataFrame, key: str, by: list[Column], score: str, top: int = TOP) -> DataFrame:
    """The top candidates of each key with rank, margin and ratio (999 without a second) of the best over the second."""
    order = W.partitionBy(key).orderBy(*by)
    best = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    second = F.coalesce(F.lead(score).over(W.partitionBy(key).orderBy("rank")), F.lit(0.0))
    ratio = F.when(second > 0, F.col(score) / second).when(F.col(score) > 0, 999.0).otherwise(0.0)
    return best.withColumn("margin", F.col(score) - second).withColumn("ratio", ratio)


def _first(rank: Column, rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.when(rank > 1, "alternative")
    for condition, name in rules:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def semantic_top(candidates: DataFrame) -> DataFrame:
    """Whole-database candidates (og_id, candidate, score, exact_hash, mapped_to_other): ranking score, rank, margin, confidence."""
    c = F.col
    scored = candidates.withColumn("ranking_score", F.round("score", 4) - F.when(c("mapped_to_other"), MAPPED_PENALTY).otherwise(0.0))
    out = ranked(scored, "og_id", [F.desc("ranking_score"), F.desc("candidate")], "ranking_score")
    margin = F.round("margin", 6)
    rules = [(c("exact_hash") & (margin >= 0.03), "exact_unique"), ((F.round("score", 4) >= 0.88) & (margin >= 0.06), "strong_unique"), ((F.round("score", 4) >= 0.80) & (margin >= 0.08), "likely_unique")]
    return out.withColumn("confidence", _first(c("rank"), rules, "review")).drop("ratio")


def call_context_top(voted: DataFrame, semantic_best: DataFrame) -> DataFrame:
    """Call-context candidates of votes(); agrees: the candidate is the best semantic one (og_id, semantic_rva). All targets of semantic_best get a row."""
    c = F.col
    out = ranked(voted, "og_id", [F.desc("vote_score"), F.desc("unique_pair_rows"), F.desc("mean_score"), F.desc("candidate")], "vote_score")
    out = semantic_best.join(out, "og_id", "left").withColumn("agrees", F.coalesce(c("candidate") == c("semantic_rva"), F.lit(False)))
    m, r, n, e = F.round("margin", 6), c("ratio"), c("unique_pair_rows"), c("exact_matched")
    rules = [
        (c("candidate").isNull(), "unresolved"), (c("agrees") & (e >= 1) & (r >= 1.2), "confirmed_agreement"), ((e >= 1) & (r >= 1.4) & (m >= 0.5), "strong_exact_context"),
        (c("agrees") & (n >= 2) & (r >= 1.3), "strong_agreement"), ((n >= 3) & (r >= 1.5) & (m >= 1.0), "strong_context"), ((n >= 2) & (r >= 1.5) & (m >= 0.5), "likely_context"),
        (c("agrees") & (c("matched") >= 1) & (c("mean_score") >= 0.85), "likely_agreement"),
    ]
    return out.withColumn("confidence", _first(c("rank"), rules, "review"))


def global_context_top(voted: DataFrame) -> DataFrame:
    """Data-context candidates of votes() with name_score."""
    c = F.col
    out = ranked(voted, "og_id", [F.desc("vote_score"), F.desc("unique_pair_rows"), F.desc("mean_score"), F.desc("candidate")], "vote_score")
    m, r, n = F.round("margin", 6), c("ratio"), c("unique_pair_rows")
    rules = [
        ((c("name_score") >= 0.85) & (c("matched") >= 1), "strong_name"), ((c("exact_matched") >= 1) & (r >= 1.3) & (m >= 0.5), "strong_exact_context"),
        ((n >= 3) & (r >= 1.5) & (m >= 1.0), "strong_context"), ((n >= 2) & (r >= 1.5) & (m >= 0.5), "likely_context"),
        ((c("matched") == 1) & (c("mean_score") >= 0.90) & (r >= 1.5), "single_context"),
    ]
    return out.withColumn("confidence", _first(c("rank"), rules, "review"))


def coreference_top(totals: DataFrame) -> DataFrame:
    """Co-reference candidates of coreference_totals() with name_score and anchor_count of the target."""
    c = F.col
    out = ranked(totals, "target", [F.desc("vote_score"), F.desc("unique_anchor_count"), F.desc("name_score"), F.desc("candidate")], "vote_score")
    m, r, n = F.round("margin", 6), c("ratio"), c("unique_anchor_count")
    rules = [
        ((c("name_score") >= 0.85) & (n >= 1) & (m > 0), "strong_name"), ((n >= 3) & (r >= 1.5) & (m >= 0.5), "strong_xrefs"), ((n >= 2) & (r >= 1.8) & (m >= 0.5), "likely_xrefs"),
        ((c("anchor_count") == 1) & (c("single_candidate_anchors") == 1), "single_xref_unique"), (c("vote_score") > 0, "review"),
    ]
    return out.withColumn("confidence", _first(c("rank"), rules, "unresolved"))
