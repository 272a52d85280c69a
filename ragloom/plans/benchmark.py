"""A benchmark of presets: gold and diagnostic queries, each preset with its own chunker, answers and a judge where a model is given."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import providers
from ragloom.operators import evaluate as E
from ragloom.operators import hybrid as H
from ragloom.operators import prompts as PR
from ragloom.plans.pipeline import RagPipeline
from ragloom.session import checkpointed

TOP_K = 5


@dataclass
class Run:
    """What one preset gave. queries: a row a gold query; hits: a row a chunk found; diagnostics: a row a diagnostic query."""

    strategy: str
    config: dict
    build_ms: float
    chunks: int
    queries: DataFrame
    hits: DataFrame
    diagnostics: DataFrame
    retrieval: dict
    answers: dict = field(default_factory=dict)
    skipped: str | None = None


def outside(queries: DataFrame) -> DataFrame:
    """The diagnostic queries whose answer is not in the corpus."""
    return queries.where(~F.coalesce("in_corpus", F.lit(True)))


def judge_prompt(question, keywords, answer):
    """Column: asks a model for a score from 1 to 5."""
    return F.concat(
        F.lit("Rate the answer from 1 (poor) to 5 (excellent) by how far it covers the points required and cites its sources. Reply with the number alone.\n\nQuestion: "),
        question, F.lit("\nPoints required: "), F.array_join(keywords, ", "), F.lit("\nAnswer: "), answer,
    )


def judged(answers: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """answers (query_id, question, gold_keywords, answer, …) with judge_score and judge_error; a judge that fails leaves a null score."""
    asked = answers.withColumn("_j", F.when(F.col("answer").isNotNull(), providers.generated(judge_prompt(F.col("question"), F.col("gold_keywords"), F.col("answer")), judge)))
    return asked.select(*answers.columns, PR.judge_score(F.col("_j.answer")).alias("judge_score"), F.col("_j.error").alias("judge_error"))


def run_strategy(
    pipeline: RagPipeline, name: str, gold: DataFrame, diagnostic: DataFrame, build: Callable[[RagPipeline], DataFrame],
    generate: Callable[[str], str] | None = None, judge: Callable[[str], str] | None = None, source: str = "documents", top_k: int = TOP_K,
) -> Run:
    """gold: (id, question, expected_procedure, gold_keywords), diagnostic: (id, question, in_corpus, …). Queries are answered as one batch, so a query's
    latency is its share of the batch's time."""
    began = time.perf_counter()
    size = build(pipeline).count()
    build_ms = (time.perf_counter() - began) * 1000
    chunks = pipeline.built().chunks

    def retrieved(queries: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        began = time.perf_counter()
        found = pipeline.retrieve_detailed(queries.select(F.col("id").alias("query_id"), F.col("question").alias("query")), top_k)
        hits = checkpointed(found.primary.select("query_id", "chunk_id", "score", "rank"))
        about = checkpointed(found.queries)
        return hits, about, (time.perf_counter() - began) * 1000 / max(1, about.count())

    hits, about, ms = retrieved(gold)
    wanted = gold.select(F.col("id").alias("query_id"), "question", "expected_procedure", "gold_keywords")
    shown = hits.join(chunks.select("chunk_id", "procedure_slug", "raw_text"), "chunk_id")
    each = E.relevance_flags(shown, wanted).join(wanted, "query_id").join(about, "query_id").select(
        "query_id", "question", "expected_procedure", "gold_keywords", "flags", F.col("slug").alias("predicted"), F.col("expected_procedure").alias("expected"),
        "confidence", F.col("should_filter").alias("filter_applied"), F.lit(ms).alias("latency_ms"),
    )
    relevant = shown.join(wanted, "query_id").select(
        "query_id", "rank", "chunk_id", "procedure_slug", "score",
        E.is_relevant(F.col("procedure_slug"), F.col("raw_text"), F.col("expected_procedure"), F.col("gold_keywords")).alias("relevant"),
        F.substring(F.translate("raw_text", "\n", " "), 1, 220).alias("preview"),
    )
    asked, told, diagnostic_ms = retrieved(diagnostic)
    scores = asked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("top_scores"))
    probes = diagnostic.select(F.col("id").alias("query_id"), "question", F.coalesce("in_corpus", F.lit(True)).alias("in_corpus")).join(told, "query_id").join(scores, "query_id", "left").select(
        "query_id", "question", "in_corpus", F.col("slug").alias("predicted"), "confidence", "top_scores", F.lit(diagnostic_ms).alias("latency_ms")
    )
    answers: dict = {}
    if generate is not None:
        said = checkpointed(pipeline.answer(wanted.select("query_id", F.col("question").alias("query")), generate, top_k, source).select(
            "query_id", "answer", F.col("error").alias("generation_error"), F.col("generation_ms"), F.size("citations").alias("citations"), F.size("unsupported").alias("unsupported")
        ))
        each = each.join(said, "query_id", "left").withColumn("coverage", F.when(F.col("answer").isNotNull(), E.keyword_coverage(F.col("answer"), F.col("gold_keywords"))))
        if judge is not None:
            each = judged(each, judge)
        refused = checkpointed(pipeline.answer(probes.select("query_id", F.col("question").alias("query")), generate, top_k, source).select("query_id", "answer", "refused"))
        # An answer that must not be given is a refusal; of queries inside the corpus a refusal says nothing.
        probes = probes.join(refused, "query_id", "left").withColumn("refusal_correct", F.when(~F.col("in_corpus") & F.col("answer").isNotNull(), F.col("refused")))
    each, probes = checkpointed(each), checkpointed(probes)
    if generate is not None:
        of_gold = each.where("answer is not null").select("coverage", "citations", "unsupported", F.col("generation_ms").alias("latency_ms"), F.lit(None).cast("boolean").alias("refusal_correct"))
        of_probes = probes.where("refusal_correct is not null")
        answers = E.answer_metrics(of_gold).first().asDict()
        answers["diagnostic_refusal_correct_rate"] = of_probes.agg(F.coalesce(F.avg(F.col("refusal_correct").cast("double")), F.lit(0.0))).first()[0]
        if judge is not None:
            answers["mean_judge_score"] = each.agg(F.avg("judge_score")).first()[0]
    return Run(
        name, {**asdict(pipeline.how), "embedding": pipeline.embedding, "top_k": top_k}, build_ms, size, each, relevant, probes,
        E.retrieval_metrics(each).first().asDict(), answers, None if generate is not None else "no model was given",
    )


def compare(
    spark: SparkSession, source_path: str, boundaries_path: str, gold: DataFrame, diagnostic: DataFrame, strategies: tuple[str, ...] = tuple(H.STRATEGIES),
    embedding: str = "mock", use_reranker: bool = False, generate: Callable[[str], str] | None = None, judge: Callable[[str], str] | None = None, source: str = "documents",
) -> list[Run]:
    """A run of each preset over one document."""
    if judge is not None and generate is None:
        raise ValueError("a judge needs answers: give a model too")
    return [
        run_strategy(
            RagPipeline.for_strategy(spark, name, embedding, use_reranker and name == "high_accuracy"), name, gold, diagnostic,
            lambda p: p.build_index(source_path, boundaries_path), generate, judge, source,
        )
        for name in strategies
    ]
