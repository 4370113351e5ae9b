"""From raw documents to a training mix, in five stages that each call one operator.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; it is written as Parquet and read again for the next.

    quality        importance resampling keeps the documents drawn
    near_dups      SimHash groups at 0.8 similarity of five-word shingles; one row of each group stays, that with the smallest id
    decontaminate  documents that hold a passage of the benchmark go
    pii            personal data get pseudonyms
    mix            each document gets the number of times the mix repeats it

Defined results for odd rows are those of the operators; an empty table passes all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from undula.llm import decontaminate, mixing, pii, quality, simhash
from undula.llm.common import ensure_checkpoint_dir, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select_quality(docs, read(spark, sf_dir, "labels"))


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_row(docs, words=5, similarity=0.8)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(docs, key=pii.DEMO_KEY)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dups", near_dups_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
]

#: SQL has no hashes, tries or networks like those of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
