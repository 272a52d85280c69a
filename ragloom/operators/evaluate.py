"""Retrieval and answer metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.session import checkpointed

RELEVANT = 0.5


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """Share of keywords that text contains, without case; 1 without keywords."""
    hits = T.let(T.match_form(text), lambda hay: F.size(F.filter(keywords, lambda k: F.contains(hay, F.lower(k)))))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, F.lit(1.0)).otherwise(hits / F.size(keywords))


def is_relevant(slug: Column, text: Column, expected: Column, keywords: Column) -> Column:
    """Right slug, and at least half of the keywords."""
    return slug.eqNullSafe(expected) & (keyword_coverage(text, keywords) >= RELEVANT)


def relevance_flags(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, flags): relevance of each query's hits in order of rank; a query without hits has no flags.

    hits: (query_id, rank, procedure_slug, raw_text), gold: (query_id, expected_procedure, gold_keywords).
    """
    judged = hits.join(gold, "query_id").select(
        "query_id", "rank", is_relevant(F.col("procedure_slug"), F.col("raw_text"), F.col("expected_procedure"), F.col("gold_keywords")).alias("ok")
    )
    flags = judged.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ok"))), lambda x: x["ok"]).alias("flags"))
    return gold.select("query_id").join(flags, "query_id", "left").select("query_id", F.coalesce("flags", F.array().cast("array<boolean>")).alias("flags"))


def _mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def nearest_rank(df: DataFrame, value: str, by: Sequence[str] = (), share: float = 0.95, name: str = "p95") -> DataFrame:
    """(by, name): the value at place share * (n - 1) of each group's sorted values, halves rounded to even; groups without values have no row.

    Equal values are counted where they are read. The counts are range-partitioned, so a running sum within a partition and the sums of those
    before give each value's places; no group is ever in one row or one task.
    """
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    parted = checkpointed(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    sizes = parted.groupBy(*keys, "_p").agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy(*keys)
    before = F.sum("_m").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_m").over(group)}).drop("_m")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    at = F.bround(F.lit(share) * (F.col("_all") - 1))
    placed = _joined(parted, sizes, [*keys, "_p"], "inner").withColumn("_upto", upto)
    return placed.where((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_n"))).select(*keys, F.col("_v").alias(name))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """left with the other columns of right, where keys are equal; null is a key like others, and no keys join all."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same, how).drop(*(f"_r_{k}" for k in keys))


def reciprocal_rank(flags: Column, k: int = 5) -> Column:
    first = F.array_position(F.slice(flags, 1, k), True)
    return F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0))


def found_within(flags: Column, k: int) -> Column:
    return F.when(F.array_contains(F.slice(flags, 1, k), True), F.lit(1.0)).otherwise(F.lit(0.0))


def retrieval_metrics(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over queries. results: (by, flags, predicted, expected, latency_ms); a missing prediction is right where none is expected."""
    flags = F.col("flags")
    means = results.groupBy(*by).agg(
        _mean(found_within(flags, 1)).alias("hit_at_1"),
        _mean(found_within(flags, 3)).alias("recall_at_3"),
        _mean(found_within(flags, 5)).alias("recall_at_5"),
        _mean(reciprocal_rank(flags)).alias("mrr_at_5"),
        _mean(F.col("predicted").eqNullSafe(F.col("expected")).cast("double")).alias("procedure_accuracy"),
        _mean(F.col("latency_ms")).alias("mean_retrieval_latency_ms"),
    )
    # A row a group on either side.
    both = _joined(means, nearest_rank(results, "latency_ms", by), by, "left")
    return both.select(*means.columns, F.coalesce("p95", F.lit(0.0)).alias("p95_retrieval_latency_ms"))


def answer_metrics(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """answers: (by, coverage, citations, unsupported, latency_ms, refusal_correct, null where it was not asked)."""
    return answers.groupBy(*by).agg(
        _mean(F.col("coverage")).alias("mean_gold_keyword_coverage"),
        _mean((F.col("citations") > 0).cast("double")).alias("citation_present_rate"),
        F.coalesce(F.sum("unsupported"), F.lit(0)).alias("total_unsupported_citations"),
        _mean(F.col("latency_ms")).alias("mean_generation_latency_ms"),
        _mean(F.col("refusal_correct").cast("double")).alias("diagnostic_refusal_correct_rate"),
    )


def filter_effect(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Queries whose metadata filter was applied, and of those with and without a relevant hit. results: (by, flags, filter_applied)."""
    hit = F.array_contains("flags", True)
    return results.groupBy(*by).agg(
        F.count_if("filter_applied").alias("applied"),
        F.count_if(F.col("filter_applied") & hit).alias("helped"),
        F.count_if(F.col("filter_applied") & ~hit).alias("hurt"),
    )
