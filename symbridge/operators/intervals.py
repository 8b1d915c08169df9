"""Containing ranges by page buckets, and nearest rows before or after without an equality key."""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = 4096
#: Pages of a level that a range may touch before it goes to the next, whose pages are STEP times as large.
MOST_PAGES = 64
STEP = (1, 1 << 12, 1 << 26, 1 << 40)
#: Ranges of addresses that nearest() deals keys and rows to, at most.
MOST_BUCKETS = 1024


def containing(points: DataFrame, ranges: DataFrame, at: str, start: str = "start_ea", end: str = "end_ea", page: int = PAGE, how: str = "left") -> DataFrame:
    """points with the columns of each range [start, end) that holds them (left: NULLs if none); ranges are dealt out by the pages they touch.

    Long ranges are dealt on larger pages, so a range is never more than some hundred rows, or 2,000 if it spans most of 64 bits. Which
    levels there are is asked of the ranges at once; as a rule it is one, which is one join. A null address lies in no range.
    """
    length = F.try_subtract(F.col(end), F.col(start))  # null where it passes 64 bits: the last level
    level = F.lit(len(STEP) - 1)
    for i in reversed(range(len(STEP) - 1)):
        level = F.when(length <= MOST_PAGES * page * STEP[i], i).otherwise(level)
    whole = ranges.where(F.col(start) < F.col(end)).withColumn("_level", level)
    levels = sorted(r[0] for r in whole.select("_level").distinct().collect())
    if not levels:
        none = points.select("*", *(F.lit(None).cast(t).alias(c) for c, t in ranges.dtypes))
        return none if how == "left" else none.limit(0)

    def joined(rows: DataFrame, i: int, how: str) -> DataFrame:
        size = F.lit(page * STEP[i])
        spot = lambda c: F.call_function("div", c - F.pmod(c, size), size)
        dealt = whole.where(F.col("_level") == i).drop("_level").withColumn("_range_page", F.explode(F.sequence(spot(F.col(start)), spot(F.col(end) - 1))))
        return rows.withColumn("_page", spot(F.col(at))).join(dealt, (F.col("_page") == F.col("_range_page")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)), how).drop("_page", "_range_page")

    if len(levels) == 1:
        return joined(points, levels[0], how)
    found = reduce(DataFrame.unionAll, [joined(points, i, "inner") for i in levels])
    if how == "left":
        rest = reduce(lambda rows, i: joined(rows, i, "left_anti"), levels, points)
        found = found.unionAll(rest.select("*", *(F.lit(None).cast(t).alias(c) for c, t in ranges.dtypes)))
    return found


def in_segments(points: DataFrame, segments: DataFrame, at: str, names: list[str]) -> DataFrame:
    """points with in_segment: inside a segment whose name is one of names, or begins with one and a dot, case aside.

    Segments are few and of any length; their list is broadcast after a check of its size.
    """
    low = F.lower("name")
    wanted = F.lit(False)
    for n in names:
        wanted = wanted | (low == n.lower()) | low.startswith(n.lower() + ".")
    kept = segments.where(wanted).select(F.col("start_ea").alias("_s"), F.col("end_ea").alias("_e"))
    if kept.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 segments")
    spans = kept.groupBy().agg(F.sort_array(F.collect_list(F.struct("_s", "_e"))).alias("_spans"))
    hit = F.exists("_spans", lambda s: (F.col(at) >= s["_s"]) & (F.col(at) < s["_e"]))
    return points.join(F.broadcast(spans)).withColumn("in_segment", hit).drop("_spans")


def _spot(cuts: list[int]):
    """The number of cuts that are not above a column: that of its range; found among every k-th cut first, then among k."""
    k = max(1, isqrt(len(cuts)))
    every = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    count = lambda conditions: reduce(Column.__add__, [F.when(x, 1).otherwise(0) for x in conditions])

    def spot(c: Column) -> Column:
        begin = F.greatest(count(F.lit(h) <= c for h in cuts[::k]) - 1, F.lit(0)) * k
        return (begin + count(F.get(every, begin + j) <= c for j in range(k))).cast("int")

    return spot if cuts else lambda c: F.lit(0)


def nearest(keys: DataFrame, rows: DataFrame, key: str, at: str, forward: bool, buckets: int | None = None, within: int | None = None) -> DataFrame:
    """keys with the columns of the row of the smallest `at` >= key (forward) or of the largest `at` <= key, at most `within` away.

    Distinct keys and addresses meet in ranges that hold about as many of them each (cut at percentiles, which are computed at once); each range also
    carries the nearest address of the ranges beyond it, so a window never spans more than a range. Keys and rows then join their
    addresses, by equality, so a key that very many have is looked up once and Spark may split its join. `at` is unique among rows. A
    null key has no nearest row.
    """
    spark = keys.sparkSession
    n = buckets or min(MOST_BUCKETS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = keys.select(F.col(key).cast("bigint").alias("_at")).where("_at IS NOT NULL").distinct().withColumn("_row", F.lit(None).cast("bigint"))
    mixed = asked.unionAll(rows.select(F.col(at).cast("bigint").alias("_at"), F.col(at).cast("bigint").alias("_row")))
    shares = F.array(*(F.lit(i / n) for i in range(1, n)))
    spread = mixed.agg(F.percentile_approx("_at", shares, 10_000)).first()[0] if n > 1 else []
    spot = _spot(sorted(set(spread or [])))
    mixed = mixed.withColumn("_bucket", spot(F.col("_at")))
    edge = mixed.where("_row IS NOT NULL").groupBy("_bucket").agg((F.min if forward else F.max)("_row").alias("_edge"))  # at most n rows
    # frames that only grow, so that each window is one pass: forward looks back along descending addresses
    turn = F.desc if forward else F.asc
    beyond = W.orderBy(turn("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    carry = spark.range(n).select(F.col("id").cast("int").alias("_bucket")).join(edge, "_bucket", "left").select("_bucket", F.last("_edge", True).over(beyond).alias("_carry"))
    window = W.partitionBy("_bucket").orderBy(turn("_at"), F.asc_nulls_last("_row")).rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = mixed.withColumn("_found", F.last("_row", True).over(window)).where("_row IS NULL").join(F.broadcast(carry), "_bucket", "left")
    found = hit.select("_at", F.coalesce("_found", "_carry").alias("_found")).where("_found IS NOT NULL")
    if within is not None:
        found = found.where(F.abs(F.col("_found") - F.col("_at")) <= within)
    whole = found.join(rows.select(F.struct(*rows.columns).alias("_whole"), F.col(at).cast("bigint").alias("_found")), "_found").select("_at", "_whole")
    asked_all = keys.select(F.struct(*keys.columns).alias("_key"), F.col(key).cast("bigint").alias("_at"))
    return asked_all.join(whole, "_at", "left").select("_key.*", *(F.col(f"_whole.{c}").alias(c) for c in rows.columns))


def in_ranges(functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Functions whose start lies in a labelled range [start, end) (label, start, end), once for each such range."""
    r = ranges.select("label", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return containing(functions, r, "start_ea", "_s", "_e", how="inner").drop("_s", "_e")
