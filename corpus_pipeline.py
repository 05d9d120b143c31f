"""The training-data pipeline: documents to packed windows.

Each stage takes (spark, docs, sf_dir) and gives a frame, which is written as Parquet and read again as the next one's docs.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from sourcemart.llm.common import shared_folder
from sourcemart.llm.exact_dedup import drop_exact_duplicates
from sourcemart.llm.jaccard_join import drop_near_duplicates
from sourcemart.llm.mixing import mix_positions, mixed
from sourcemart.llm.packing import pack_in_order
from sourcemart.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents don't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which sources keep their target weights."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 ids, filled from stretches of the mixed order, which the rows give again."""
    return pack_in_order(docs, mix_positions(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# The classifier, the schedule and the tokenizer can't be said in SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
