"""Five stages from raw documents to tokens; each is written as Parquet and read again by the next.

Every stage takes all rows of the one before. Null texts are empty texts, null and repeated ids are rows
like any other, columns of any name pass through, and an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veristrata.llm import bpe, mixing, pu_quality, simhash, suffix_dedup
from veristrata.llm.common import scratch_path, staged, table


@staged
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject. Without trusted positives it
    rejects none; texts without a word are scored like any other."""
    return pu_quality.keep_good(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")))


@staged
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id (none comes last), of one id's texts the
    least digest. Texts without a word are one group."""
    return simhash.keep_first(docs)


@staged
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier elsewhere. What has no word left goes, and so
    do texts that had none."""
    return suffix_dedup.keep_unrepeated(docs)


@staged
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what it does not take goes. A null source is a source."""
    return mixing.repeat_by_mix(docs)


@staged
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of their decoding."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Two stages (a trained classifier, XXH64 fingerprints) are beyond SQL; ``tests/llm/test_pipeline_rows.py``
#: holds the rows against a brute-force version of all stages instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
