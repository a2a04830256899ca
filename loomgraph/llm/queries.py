"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import fingerprints, licenses, lm, middle, mixing, neardup, neighbours, oracles, packing, periodic, quality, substrings, suffixes, tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.METRICS
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), packing.WEIGHTS)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(_documents(spark, sf_dir))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(_documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(_documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summaries(_documents(spark, sf_dir), planted=True)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_lm_scoring, op4_token_counts, op5_minhash_near_dedup, op6_packing, op7_substring_dedup, op8_suffix_array_dedup, op9_source_mixing, op10_fingerprints, op11_fill_in_middle, op12_periodic_runs, op13_nearest_neighbours)}
#: The other operators rest on sketches, sampling, random projections, tokenizers or trained models, which SQL cannot express, or are too slow in SQL
#: on whole tables (op8, op12); tests/llm holds them against brute-force versions.
ORACLE_SQL = {
    "op5_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op7_substring_dedup": oracles.REPEATED_WORDS,
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
