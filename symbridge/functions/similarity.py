"""Similarities of functions, names, contexts and decompiled text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbridge.functions.scalars import is_generic, pair_name, reference_name
from symbridge.functions.sequences import column_ratios

# The weights of the function-pair, context and decompile scores, and the class bounds.
PAIR_WEIGHTS = {"name": 0.08, "size": 0.08, "instruction": 0.10, "cfg": 0.10, "mnemonic": 0.14, "shape": 0.18, "calls": 0.14, "callers": 0.07, "strings": 0.06, "member_offsets": 0.05}
CONTEXT_WEIGHTS = {"signature": 0.40, "window": 0.35, "position": 0.20, "mnemonic": 0.05}
DECOMPILE_WEIGHTS = {"pseudocode": 0.35, "mnemonic": 0.30, "size": 0.15, "calls": 0.10, "strings": 0.10}
EXACT_BONUS = 0.15
CLASS_BOUNDS = (("strong", 0.88), ("likely", 0.72), ("review", 0.55))


def _times(part: Column, hundredths: int) -> Column:
    """A part times a weight in hundredths, exact where the part is a count; to be divided after it."""
    return part if hundredths == 100 else part * hundredths / 100


def closeness(a: Column, b: Column, hundredths: int = 100) -> Column:
    """min / max of the absolute values, NULL as 0; 1 if both are 0. hundredths, here and below: a weight, multiplied before the division, as decimal weights in SQL are."""
    a, b = F.abs(F.coalesce(a.cast("double"), F.lit(0.0))), F.abs(F.coalesce(b.cast("double"), F.lit(0.0)))
    return F.when((a == 0) & (b == 0), hundredths / 100).otherwise(_times(F.least(a, b), hundredths) / F.greatest(a, b))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v)


def norm(counts: Column) -> Column:
    return F.sqrt(_total(F.transform(F.map_values(counts), lambda v: v.cast("double") * v.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the keys of a that b has; a is best the smaller map."""
    return _total(F.transform(F.map_entries(a), lambda e: e["value"].cast("double") * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)).cast("double")))


def cosine(a: Column, b: Column, hundredths: int = 100) -> Column:
    """Cosine of two maps of counts; 1 if both are empty, 0 if one is or has norm 0."""
    empty = F.create_map().cast("map<string,bigint>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    x, y = norm(a), norm(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), hundredths / 100).when((x == 0) | (y == 0), 0.0).otherwise(_times(dot(a, b), hundredths) / (x * y))


def jaccard(a: Column, b: Column, hundredths: int = 100) -> Column:
    """Share of common elements of two arrays as sets; 1 if both are empty."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), hundredths / 100).otherwise(_times(F.size(F.array_intersect(a, b)).cast("double"), hundredths) / F.size(F.array_union(a, b)))


def _ratios(junk: bool):
    def run(sides: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in sides:
            yield column_ratios(a, b, junk)

    return F.arrow_udf(run, "double")


def sequence_ratio(pairs: DataFrame, left: str, right: str, out: str, junk: bool = True, distinct: bool = True) -> DataFrame:
    """pairs with the ratio of matching elements of two columns (strings, or arrays of strings), the order of the two mattering.

    Equal sides are 1 without a look. Other pairs are compared in Arrow batches: distinct ones, once, and joined back; or (distinct=False, for
    short sequences, whose comparison costs less than a shuffle) in their rows, strings of a batch once. junk: elements
    of a right side of 200 or more that make up over 1 % are not anchors.
    """
    rows = pairs.withColumn("_l", F.coalesce(left, F.lit(""))) if dict(pairs.dtypes)[left] == "string" else pairs.withColumn("_l", F.col(left))
    rows = rows.withColumn("_r", F.coalesce(right, F.lit("")) if dict(pairs.dtypes)[right] == "string" else F.col(right))
    same = F.col("_l") == F.col("_r")
    if not distinct:
        ask = lambda c: F.when(~same, F.col(c))
        return rows.withColumn(out, F.when(same, 1.0).otherwise(_ratios(junk)(ask("_l"), ask("_r")))).drop("_l", "_r")
    todo = rows.where(~same).select("_l", "_r").distinct()
    found = todo.withColumn("_ratio", _ratios(junk)("_l", "_r"))
    return rows.join(found, ["_l", "_r"], "left").withColumn(out, F.when(same, 1.0).otherwise(F.col("_ratio"))).drop("_l", "_r", "_ratio")


def name_similarity(pairs: DataFrame, left: str, right: str, out: str, form: str = "pair", distinct: bool = True) -> DataFrame:
    """Similarity of names. pair: .5 if both, .25 if one is generic or empty; reference: 0 then; strict: 0 if one is generic. distinct as in sequence_ratio()."""
    normal = pair_name if form == "pair" else reference_name
    rows = pairs.withColumn("_a", normal(F.col(left)) if form != "strict" else F.regexp_replace(F.lower(F.coalesce(left, F.lit(""))), "[^a-z0-9_]+", ""))
    rows = rows.withColumn("_b", normal(F.col(right)) if form != "strict" else F.regexp_replace(F.lower(F.coalesce(right, F.lit(""))), "[^a-z0-9_]+", ""))
    none = (F.col("_a") == "") | (F.col("_b") == "")
    if form == "strict":
        none = none | is_generic(F.col(left)) | is_generic(F.col(right))
    low = F.when((F.col("_a") == "") & (F.col("_b") == ""), 0.5).otherwise(0.25) if form == "pair" else F.lit(0.0)
    rows = rows.withColumn("_none", none).withColumn("_a", F.when(none, "").otherwise(F.col("_a"))).withColumn("_b", F.when(none, "").otherwise(F.col("_b")))
    return sequence_ratio(rows.withColumn("_low", low if form != "pair" else F.when(none, F.when((pair_name(F.col(left)) == "") & (pair_name(F.col(right)) == ""), 0.5).otherwise(0.25))), "_a", "_b", "_s", distinct=distinct).withColumn(
        out, F.when(F.col("_none"), F.col("_low")).otherwise(F.col("_s"))
    ).drop("_a", "_b", "_s", "_none", "_low")


def _letters(name: Column) -> Column:
    """The characters of a name, each with how many of it stand before in their sorted list: equal bags of characters are equal sets. The rarer (higher) first."""
    each = F.array_sort(F.filter(F.split(name, ""), lambda c: c != ""))
    number = F.transform(F.array(each), lambda l: F.transform(l, lambda c, i: F.concat(F.lpad((i + 1 - F.array_position(l, c)).cast("string"), 5, "0"), c)))[0]
    return F.sort_array(number, asc=False)


def name_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, _a, _b): the distinct names of two sides whose normal forms _a, _b may have a ratio of at least `least`, over 0.

    A ratio r of strings of lengths a and b has r (a + b) / 2 matched characters, so their bags of characters share as many, and b is within
    a factor of r / (2 - r) of a. Bags are sets of numbered characters in one order, rare ones first: a pair must share one of the
    first of each (prefix filter), and then as many as it needs, which is counted before any sequence is matched.
    """
    factor = least / (2 - least)

    def side(names: DataFrame, name: str, form: str) -> DataFrame:
        return names.select(name, pair_name(F.col(name)).alias(form)).where(F.col(form) != "").distinct()

    def letters(rows: DataFrame, form: str) -> DataFrame:
        own = rows.select(form).distinct().withColumn(f"{form}n", F.length(form)).withColumn(f"{form}s", _letters(F.col(form)))
        return own.select(form, f"{form}n", f"{form}s", F.explode(_prefix(form, least)).alias("_letter"))

    a, b = side(left, "left", "_a"), side(right, "right", "_b")
    x, y = letters(a, "_a"), letters(b, "_b")
    fits = (F.col("_bn") >= F.ceil(F.col("_an") * factor - 1e-9)) & (F.col("_bn") <= F.floor(F.col("_an") / factor + 1e-9))
    # a pair is taken at the first letter that both prefixes share, so it comes once
    first = F.array_max(F.array_intersect(_prefix("_a", least), _prefix("_b", least)))
    shared = F.size(F.array_intersect("_as", "_bs"))
    met = x.join(y, "_letter").where(fits & (F.col("_letter") == first) & (shared >= (F.col("_an") + F.col("_bn")) * (least / 2) - 1e-9)).select("_a", "_b")
    return a.select("left", "_a").join(met, "_a").join(b.select("right", "_b"), "_b").select("left", "right", "_a", "_b")


def _prefix(form: str, least: float) -> Column:
    """The first letters of a bag, of which a partner of any length must share one."""
    n = F.col(f"{form}n")
    need = F.ceil((n + F.ceil(n * (least / (2 - least)) - 1e-9)) * (least / 2) - 1e-9)
    return F.slice(f"{form}s", F.lit(1), F.greatest(n - need + 1, F.lit(1)).cast("int"))


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right): the pairs of distinct names of two sides whose pair similarity is at least `least` (over 0.5, so neither is generic)."""
    return sequence_ratio(name_candidates(left, right, least), "_a", "_b", "_ratio_", distinct=False).where(F.col("_ratio_") >= least).select("left", "right")


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.lit(weight) * parts[name]
    return out


def classify(score: Column, exact: Column, ok: Column | None = None) -> Column:
    """exact_semantics, strong, likely, review or suspect; unresolved where a side is not ok."""
    out = F.when(~ok, "unresolved") if ok is not None else F.when(F.lit(False), "")
    out = out.when(exact, "exact_semantics")
    for name, least in CLASS_BOUNDS:
        out = out.when(score >= least, name)
    return out.otherwise("suspect")


def pair_rows(references: Column) -> Column:
    """Row numbers of the complete pairs that references point to."""
    whole = F.flatten(F.transform(references, lambda r: F.coalesce(F.filter(r["csv"], lambda c: c["og_id"].isNotNull() & c["ae_id"].isNotNull()), F.array().cast("array<struct<row:int,og_id:bigint,ae_id:bigint>>"))))
    return F.array_distinct(F.transform(whole, lambda c: c["row"]))


def string_values(strings: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(strings, lambda s: F.lower(F.trim(s["text"]))), lambda t: t != ""))


def offset_values(displacements: Column) -> Column:
    return F.array_compact(F.transform(F.map_keys(displacements), lambda k: k.try_cast("bigint")))


def context_score(signature: Column, window: Column, old_position: Column, new_position: Column, same_mnemonic: Column, exact_same_index: Column) -> Column:
    """Score of two call or access sites from their signature and window ratios, places and mnemonics; a bonus up to 1 for exact pairs."""
    score = weighted({"signature": signature, "window": window, "position": F.greatest(F.lit(0.0), 1 - F.abs(old_position - new_position)), "mnemonic": same_mnemonic.cast("double")}, CONTEXT_WEIGHTS)
    return F.when(exact_same_index, F.least(F.lit(1.0), score + EXACT_BONUS)).otherwise(score)


def decompile_score(pseudocode: Column, mnemonic: Column, size: Column, calls: Column, strings: Column) -> Column:
    return weighted({"pseudocode": pseudocode, "mnemonic": mnemonic, "size": size, "calls": calls, "strings": strings}, DECOMPILE_WEIGHTS)
