"""Registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, filter_audit, lm_scoring, mixing, neighbours, pii, quality, simhash, substring, token_output, whitening
from .base import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_index(token_output.write_codes(read(spark, sf_dir, "documents"), tokenizer_path()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "group_size")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), mixing.production_plan())


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(read(spark, sf_dir, "conversations"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(read(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_exact_dedup, op3_token_output, op4_simhash, op5_quality, op6_mixing, op7_chat, op8_substring, op9_lm_scoring, op10_pii, op11_filter_audit, op12_whitening, op13_neighbours)}
SQL = {"op2_exact_dedup": exact_dedup.SQL, "op7_chat": chat.SQL, "op8_substring": substring.SQL, "op11_filter_audit": filter_audit.SQL}
