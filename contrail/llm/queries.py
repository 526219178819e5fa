"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.line_quality import line_quality_sql
from contrail.llm.secrets_sql import secrets_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.common import crc_fold
    from contrail.llm.toxicity import learn_by_fold, toxicity
    docs = table(spark, sf_dir, "documents")
    model = learn_by_fold(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted",
                                        "hits", "words")


@register("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.decontaminate import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op6_secrets", oracle=secrets_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.secrets import secrets
    return secrets(table(spark, sf_dir, "documents"))


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


@register("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.sentence_pieces import round_trip
    return round_trip(table(spark, sf_dir, "documents"))


@register("op9_line_quality", oracle=line_quality_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.line_quality import line_quality
    return line_quality(table(spark, sf_dir, "documents"))


@register("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.common import crc_fold
    from contrail.llm.language import languages, learn_by_fold
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, learn_by_fold(docs))
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@register("op10_lm_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.common import crc_fold
    from contrail.llm.neural_lm import learn_by_fold, scores
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, learn_by_fold(docs))
    return found.withColumn("held_out", crc_fold(F.col("doc_id"), 10) == 0)


@register("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.substrings import substring_duplicates
    return substring_duplicates(table(spark, sf_dir, "documents")).drop("removed")


@register("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.turn_repair import conversation_repairs
    return conversation_repairs(table(spark, sf_dir, "conversations"))


@register("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.alignment import tokenizer_alignment
    return tokenizer_alignment(table(spark, sf_dir, "documents"))


@register("op12_embedding_near_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.llm.rp_forest import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))
