"""The corpus pipeline: documents through five operators, each stage written
as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm import decontaminate, mixing, quality, simhash, token_output
from cairnspark.llm.base import read, stored
from cairnspark.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled
    documents of all of ``sf_dir``."""
    model = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at the production weights; a document of a second epoch
    stands twice."""
    return mixing.mixed(docs, mixing.production_plan())


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the written token files: doc_id, start, n_tokens and
    ids_crc32."""
    return token_output.read_index(token_output.write_codes(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("token-ID output", token_ids),
]

#: A trained classifier and a tokenizer are beyond SQL. The tests hold the
#: classifier's scores, the near-duplicate groups, the matches of benchmark
#: items, the mixture and the token ids each against a brute-force version,
#: and the decisions of the first four stages against these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
