"""Connected components of links, dense group numbers, and reverse pointer closure."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbridge.sources.folders import new_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage: written to the storage that driver and executors share, once, and read again."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b", cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(node, root) of every node of the undirected links: root is the smallest node that it is connected to.

    Each round a node takes the smallest label beside it, then the label of its label; rounds end when nothing changes. A hub's
    links are reduced by partial aggregation before they are shuffled. Labels are joined by sorting: each round's would pass the driver if broadcast.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("beside")).where("node IS NOT NULL AND beside IS NOT NULL")
    both = cut(both.unionAll(both.select(F.col("beside").alias("node"), F.col("node").alias("beside"))).distinct())
    label = cut(both.groupBy("node").agg(F.least(F.min("beside"), F.first("node")).alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("beside"), F.col("root").alias("near")).hint("merge"), "beside").groupBy("node").agg(F.min("near").alias("near"))
        step = label.join(near.hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.join(label.select(F.col("node").alias("root"), F.col("root").alias("further")).hint("merge"), "root", "left")
        new = cut(jump.select("node", "old", F.least("root", "further").alias("root")))
        label = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return label


def linked_groups(links: DataFrame) -> DataFrame:
    """(version, rva, number) of linked addresses: one number per connected group, 0, 1, .. by the group's smallest (version, address).

    links: lver, lrva, rver, rrva; versions are orderable.
    """
    from symbridge.operators.lookups import dense_numbers

    node = lambda side: F.struct(F.col(f"{side}ver").alias("version"), F.col(f"{side}rva").alias("rva"))
    roots = components(links.select(node("l").alias("a"), node("r").alias("b")))
    numbers = dense_numbers(roots.select(F.col("root.version").alias("_v"), F.col("root.rva").alias("_r")).distinct(), ["_v", "_r"])
    return roots.select("node.*", F.col("root.version").alias("_v"), F.col("root.rva").alias("_r")).join(numbers.hint("merge"), ["_v", "_r"]).select("version", "rva", "number")


#: Rounds of a pointer closure that are kept as tables of their own before they are put together.
MOST_ROUNDS = 16


def pointer_closure(starts: DataFrame, words: DataFrame, slot: int = 8) -> DataFrame:
    """All addresses that lead to the start set: ea - slot of every word whose value is in the set, until it grows no more.

    starts (ea), words (ea, qword).
    """
    found = [checkpointed(starts.select("ea").distinct())]
    while not found[-1].isEmpty():
        more = words.join(found[-1].select(F.col("ea").alias("qword")), "qword", "left_semi").select((F.col("ea") - slot).alias("ea")).distinct()
        for known in found:  # each round writes its own addresses alone
            more = more.join(known, "ea", "left_anti")
        found.append(checkpointed(more))
        if len(found) > MOST_ROUNDS:
            found = [checkpointed(reduce(DataFrame.unionAll, found[:-1])), found[-1]]
    return reduce(DataFrame.unionAll, found)
