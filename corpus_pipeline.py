"""Corpus pipeline: documents to packed training sequences in five stages, each by one operator of tessera.llm.

Every stage works on all rows that its predecessor kept. Repeated rows, null ids and texts, empty tables and extra
columns get the results that the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, mixing, packing, quality, secrets
from tessera.llm.shared import drop_path, fresh_path, materialize, side_files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own rules and their host's verdict keep; the host is the source."""
    return quality.judge(docs).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each class of near copies. Rows without an id stay; rows that share one go only as copies or by links."""
    return jaccard.firsts(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced and n_chars recounted."""
    return secrets.redact(docs, chars_col="n_chars")


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the rates that meet the target weights say."""
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing to target weights", target_mix),
    ("best-fit packing", packed),
]
#: Three of the stages cannot be written in SQL; tests/llm compares the whole with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written to the shared folder and read again, and then its predecessor deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = fresh_path(spark, f"stage{i}")
        with side_files(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage{i}", path=path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
