"""A training corpus from ``documents``: five stages, each written and read again.

An empty table stays empty through all stages; further columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialgrid.llm.decontaminate import decontaminate
from trialgrid.llm.jaccard_join import drop_near_copies
from trialgrid.llm.mixing import mix_documents
from trialgrid.llm.secret_scan import redact
from trialgrid.llm.store import keep
from trialgrid.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; rows are judged one by one, null and empty texts stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of least id; rows with null or repeated ids are compared by their texts."""
    return drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, row by row; null texts stay, as do all if there are no items."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark where they lie; all documents stay, null texts as they are."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies and of words; each row by itself, whatever its id."""
    return mix_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: The first stage is a trained classifier, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{name}")
    return docs
