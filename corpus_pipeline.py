"""The corpus pipeline over documents: quality rules, near duplicates, benchmark decontamination, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written to shared storage and read again as the next one's docs.
All but the last return the columns of documents: rejected documents go, one document of each class of near duplicates stays,
contaminated documents go, personal data is replaced by its kind. The last returns the packed pieces.

Defined results: null or empty texts fail the quality rules and go; null ids, repeated rows and empty tables pass through as each
operator states; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symbridge.llm import decontamination, near_duplicates, packing, pii, quality
from symbridge.llm.shared import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_join),
    ("decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: The stages hold trained models, hashing and a tokenizer, which SQL cannot express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
