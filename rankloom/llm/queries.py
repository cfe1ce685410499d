"""The queries opN_<name>, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import bpe_codec, byte_bpe, centroids, decontaminate, ngram_join, privacy, quality, secrets, spelling, suffix_arrays, suffix_trees, token_counts, toxicity

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.digests(suffix_trees.dedup(_docs(spark, sf_dir)))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.encode(_docs(spark, sf_dir), public_tokenizers.path(TOKENIZER)))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_docs(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.digests(suffix_arrays.dedup(_docs(spark, sf_dir)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_docs(spark, sf_dir)).drop("rejected_by")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir))


def op10_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.scan(_docs(spark, sf_dir))


def op11_annulus_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summed(*centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode(_docs(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spellings(_docs(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_tree_dedup": op2_suffix_tree_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_privacy": op10_privacy,
    "op11_annulus_clustering": op11_annulus_clustering,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_tree_dedup": suffix_trees.SQL,
    "op3_decontamination": decontaminate.SQL,
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op7_suffix_array_dedup": suffix_arrays.SQL,
    "op8_quality_rules": quality.SQL,
    "op11_annulus_clustering": centroids.SQL,
    "op13_spelling_variants": spelling.SQL,
}
