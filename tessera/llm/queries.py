"""The ten training-data queries, each one operator applied to its whole table, in the form their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, jaccard, mixing, ngram_lm, packing, quality, secrets, sharding, suffix_dedup, wavelet
from tessera.llm.shared import text_bytes

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_forest_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate secret of every document, with the forest's score and verdict; values as digests."""
    found = secrets.findings(_table(spark, d, "documents"))
    return found.select("doc_id", "finding", "start", "length", F.sha2(F.col("value"), 256).alias("value_sha256"), "score", "secret")


def op2_swap_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(_table(spark, d, "documents"), capacity=1024, end_id=2).drop("ids")


def op3_parity_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Shingle count and class of every document, links from a Jaccard similarity of 0.8 on."""
    return jaccard.classes(_table(spark, d, "documents"))


def op4_soft_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Posteriors, fitted rate and copies of every document."""
    docs = _table(spark, d, "documents")
    return mixing.mix(docs, mixing.labelled_texts(docs, _table(spark, d, "labels")), carry=["doc_id"])


def op5_kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    """Base and model scores of every document, learnt from those that are not held out."""
    return ngram_lm.train_and_score(_table(spark, d, "documents"))


def op6_run_length_dedup(spark: SparkSession, d: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that an earlier one holds."""
    cut = suffix_dedup.remove_repeats(_table(spark, d, "documents"), with_kept=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_block_matrix_ann(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest by cosine for every vec_id divisible by 50."""
    return ann.nearest(_table(spark, d, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op8_host_rules(spark: SparkSession, d: str) -> DataFrame:
    """Measures and verdict of every document; the host is its source."""
    judged = quality.judge(_table(spark, d, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_wavelet_shards(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of all documents from the wavelet files just written."""
    return wavelet.encode_and_read(_table(spark, d, "documents"), with_ids=False, end_id=0).drop("ids")


def op10_hypergeometric_shards(spark: SparkSession, d: str) -> DataFrame:
    """16 shards, law "rows": a uniform shuffle whose shards differ by one row at most."""
    docs = sharding.uniform_shards(_table(spark, d, "documents"), "doc_id", 16)
    return docs.select(
        "doc_id",
        (text_bytes() + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES: dict[str, Query] = {
    "op1_forest_secrets": op1_forest_secrets,
    "op2_swap_packing": op2_swap_packing,
    "op3_parity_jaccard": op3_parity_jaccard,
    "op4_soft_mixing": op4_soft_mixing,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_run_length_dedup": op6_run_length_dedup,
    "op7_block_matrix_ann": op7_block_matrix_ann,
    "op8_host_rules": op8_host_rules,
    "op9_wavelet_shards": op9_wavelet_shards,
    "op10_hypergeometric_shards": op10_hypergeometric_shards,
}

#: DuckDB SQL where it can express an operator on whole tables in reasonable time.
ORACLES: dict[str, str] = {"op8_host_rules": quality.ORACLE}
