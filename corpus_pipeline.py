"""The cleaning pipeline over documents: five stages, each written as Parquet and read again.

Every stage works on what its predecessor kept. The first four return the columns of documents,
the last one places of pieces in training batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchlight.llm import decontaminate, packing, secrets, simhash, toxicity
from matchlight.session import scratch_path, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted anew for those."""
    return secrets.mask(docs)


def place_in_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a batch for every piece of every document."""
    return packing.pack(stored(packing.pieces(docs), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", place_in_batches),
]

# Several stages fit models or search fingerprints, which SQL does not express; the tests compare
# them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
