"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import decontam, gru, kernel, langid, mixing, passages, quality, simhash, tokens, toxicity, urlfilter
from ragloom.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.context_limits(tokens.length_histogram(read(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.select(
        F.nullif("key", F.lit(kernel.NO_ID)).alias("doc_id"), F.nullif("group_id", F.lit(kernel.NO_ID)).alias("group_id"),
        "group_size", "links", "keep",
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.removed_passages(read(spark, sf_dir, "documents")).drop("th")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.train_and_score(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urlfilter.evaluate(urlfilter.dated_captures(pages), urlfilter.dated_list(pages))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxic_passages(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_mixing": op3_mixing,
        "op4_simhash": op4_simhash,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_quality_rules": op6_quality_rules,
        "op7_language_id": op7_language_id,
        "op8_url_filters": op8_url_filters,
        "op9_toxicity": op9_toxicity,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality.SQL, "op8_url_filters": urlfilter.SQL}
