"""From raw documents to packed sequences: every stage works on all that its predecessor kept.

Language identification and the quality rules drop rows, near-duplicate removal keeps one row of
each group, mixing puts all rows in the mixture's order and stores it, packing cuts them into sequences
and numbers those of each length in that order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import fertility, langid, mixing, packing, simhash
from docweave.llm.common import shared_folder, table

#: The column in which the mixture stage stores its order.
POSITION = "mixture_position"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(langid.training_rows(docs)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.drop(POSITION), position=POSITION)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs, position=POSITION)


STAGES = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packed),
]

#: SQL can express neither the mixture inference nor the fertility bands; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
