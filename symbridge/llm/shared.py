"""Shared-folder tables and column helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator, so that ids stay orderable and joinable.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir; where that is unset, in a local temporary folder, with a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_dir, "local", None)
        if base is None:
            base = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it again: lineage ends there, on storage that every executor sees."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_in(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_out(column: Column) -> Column:
    return F.nullif(column, F.lit(NULL_ID))


#: Rows of a looked-up table that may be broadcast: all of them where there are no more, else those of its most frequent keys.
MOST_LOOKED_UP = 50_000
MOST_HOT = 4096


def looked_up(rows: DataFrame, keyed: DataFrame, keys: list[str], values: list[str], count: str = "n", held: bool = False) -> DataFrame:
    """rows with the values (null where there are none) of keyed, which has a row a key and tells in `count` how many rows have it; held: keyed is a written table.

    A small keyed table is broadcast. Of a larger one only the MOST_HOT most frequent keys are, so no other key has more than that share
    of the rows; rows of hot keys are dealt out by all their columns in the join with the rest.
    """
    keyed = keyed.select(*keys, F.struct(*values).alias("_found"), F.col(count).alias("_n"))
    keyed = keyed if held else materialise(keyed, "keys")
    told = lambda df: df.select("*", *(F.col("_found")[v].alias(v) for v in values)).drop("_found", "_spread", "_hot", "_n")
    if keyed.count() <= MOST_LOOKED_UP:
        return told(rows.join(F.broadcast(keyed.drop("_n")), keys, "left"))
    hot = keyed.orderBy(F.desc("_n"), *keys).limit(MOST_HOT).select(*keys, F.col("_found").alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    # the hash of the keys, or for rows of hot keys one of all their columns, is a key of its own, so that these are dealt out evenly
    marked = marked.withColumn("_spread", F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*keys)))
    both = marked.join(keyed.drop("_n").withColumn("_spread", F.xxhash64(*keys)), [*keys, "_spread"], "left")
    return told(both.withColumn("_found", F.coalesce("_hot", "_found")))
