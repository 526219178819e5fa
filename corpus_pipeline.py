"""Corpus pipeline: each stage applies one operator of ``contrail.llm`` to all that the stage before kept.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. Rows with a null id are
kept by the filters, which know documents by their id. SQL cannot express the learned and tokenizing stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.decontaminate import decontaminate
from contrail.llm.minhash import near_duplicates
from contrail.llm.secrets import masked
from contrail.llm.sentence_pieces import round_trip
from contrail.llm.toxicity import learn_by_fold, toxicity
from contrail.sources.sinks import materialize


#: Rows that go to Python at a time, at most. Each task's batch of texts stands outside the heap and in the worker.
BATCH = 1_000


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` in a session whose Arrow batches hold ``BATCH`` rows at most; a smaller setting stays."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:  # 0 and less: no bound
            spark.conf.set(name, BATCH)
        return stage(spark, docs, sf_dir)
    return run


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the documents in ``rejected(doc_id)``."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the score is learned from the labelled documents outside the held-out fold."""
    model = learn_by_fold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, toxicity(docs, model).where("predicted = 1"))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays."""
    return without(docs, near_duplicates(docs).where("not kept"))


@in_small_batches
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; ``n_chars`` is that of the new text."""
    return masked(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@in_small_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return round_trip(docs, with_ids=True, room=250_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` in order; every stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
