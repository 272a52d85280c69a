"""Queries of metrics and of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import evaluate as E
from ragloom.operators import hybrid as H
from ragloom.operators import prompts as PR
from ragloom.operators import ranking as R
from ragloom.operators.bm25 import BM25Index
from ragloom.plans.registry import query, table
from ragloom.plans.retrieval import DIVERSIFIED, HYBRID_STRUCTURED, SCORE, UNFILTERED, bm25_sql, classified_sql, embedded_chunks, keywords
from ragloom.plans.stores import DIGITS, asked
from ragloom.plans.texts import TOKENS

REFUSAL = "I cannot find that."
#: Gold keywords of a passage: its first eight distinct tokens in order of the alphabet.
_GOLD = f"list_sort(list_distinct({TOKENS.format('text')}))[1:8]"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, expected_procedure, gold_keywords): passages are English."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("query_id"), F.lit("en").alias("expected_procedure"), F.slice(F.array_sort(F.array_distinct(T.tokenize(F.col("text")))), 1, 8).alias("gold_keywords"))


_FLAGS = f"""
{bm25_sql('documents', 'doc_id', 'text', 5)},
gold AS (SELECT item_id::VARCHAR AS query_id, text AS q, {_GOLD} AS kw FROM benchmark),
judged AS (SELECT g.query_id, r.rank, d.lang = 'en' AND len(list_filter(kw, lambda k: contains(lower(d.text), k))) / len(kw) >= 0.5 AS ok FROM gold g JOIN ranked r USING (query_id) JOIN documents d ON d.doc_id = r.id),
flags AS (SELECT g.query_id, any_value(q) AS q, coalesce(list(ok ORDER BY rank) FILTER (WHERE rank IS NOT NULL), []) AS flags FROM gold g LEFT JOIN judged USING (query_id) GROUP BY g.query_id)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = table(spark, sf_dir, "documents"), asked(spark, sf_dir)
    about = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("procedure_slug"), F.col("text").alias("raw_text"))
    hits = BM25Index.build(docs, "doc_id", "text").search(queries, 5, SCORE).join(about, "id")
    return E.relevance_flags(hits, gold(spark, sf_dir))


@query(f"WITH {_FLAGS} SELECT query_id, flags FROM flags")
def relevance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


@query(f"""
WITH {classified_sql('benchmark', 'item_id::VARCHAR', 'text')}, {_FLAGS},
x AS (SELECT f.*, c.slug, length(q)::DOUBLE AS ms, list_position(flags, true) AS p FROM flags f JOIN classified c USING (query_id)),
l AS (SELECT list(ms ORDER BY ms) AS v FROM x)
SELECT round(avg((coalesce(flags[1], false))::INT), 9) AS hit_at_1, round(avg((p BETWEEN 1 AND 3)::INT), 9) AS recall_at_3, round(avg((p BETWEEN 1 AND 5)::INT), 9) AS recall_at_5,
  round(avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1.0 / p ELSE 0 END), 9) AS mrr_at_5, round(avg((slug IS NOT DISTINCT FROM 'en')::INT), 9) AS procedure_accuracy,
  round(avg(ms), 9) AS mean_retrieval_latency_ms, (SELECT v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] FROM l) AS p95_retrieval_latency_ms
FROM (SELECT * REPLACE (coalesce(p, 0) AS p) FROM x)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of BM25 over all passages; lengths stand in for latencies, so the result can be repeated."""
    queries = asked(spark, sf_dir)
    predicted = R.classify_keywords(queries, keywords(spark)).select("query_id", F.col("slug").alias("predicted"))
    results = _results(spark, sf_dir).join(predicted, "query_id").join(queries, "query_id")
    results = results.select("flags", "predicted", F.lit("en").alias("expected"), F.length("query").cast("double").alias("latency_ms"))
    m = E.retrieval_metrics(results)
    return m.select(*(F.round(c, 9).alias(c) for c in m.columns))


@query(f"""
WITH {classified_sql('benchmark', 'item_id::VARCHAR', 'text')}, {_FLAGS},
x AS (SELECT list_contains(flags, true) AS hit, slug IS NOT NULL AND confidence >= 0.6 AS applied FROM flags JOIN classified USING (query_id))
SELECT count_if(applied)::BIGINT AS applied, count_if(applied AND hit)::BIGINT AS helped, count_if(applied AND NOT hit)::BIGINT AS hurt FROM x""")
def filter_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = R.classify_keywords(asked(spark, sf_dir), keywords(spark)).select("query_id", F.col("should_filter").alias("filter_applied"))
    return E.filter_effect(_results(spark, sf_dir).join(applied, "query_id"))


@query("""
WITH v AS (SELECT lang, list(n_chars::DOUBLE ORDER BY n_chars) AS v FROM documents GROUP BY lang)
SELECT lang, round(list_avg(v), 9) AS mean_ms, v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95_ms FROM v""")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("n_chars").cast("double")
    docs = table(spark, sf_dir, "documents").select("lang", ms.alias("ms"))
    means = docs.groupBy("lang").agg(F.round(F.avg("ms"), 9).alias("mean_ms"))
    return means.join(E.nearest_rank(docs, "ms", ["lang"], name="p95_ms"), "lang")


@query("SELECT doc_id, round(len(list_filter(['the', 'que', 'der', 'les'], lambda k: contains(lower(text), k))) / 4, 9) AS coverage, CASE lang WHEN 'en' THEN contains(lower(text), 'the') WHEN 'es' THEN true ELSE false END AS relevant FROM documents")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    four = F.array(*map(F.lit, ("the", "que", "der", "les")))
    wanted = F.when(F.col("lang") == "en", F.array(F.lit("The"))).otherwise(F.array().cast("array<string>"))
    expected = F.when(F.col("lang") == "es", "es").otherwise("en")
    return docs.select("doc_id", F.round(E.keyword_coverage(F.col("text"), four), 9).alias("coverage"), E.is_relevant(F.col("lang"), F.col("text"), expected, wanted).alias("relevant"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant and other turns as answers: some cite, some cite what was not retrieved, some refuse."""
    c = table(spark, sf_dir, "conversations")
    cited = F.concat("text", F.lit(" [kb/"), "role", F.lit("/c"), F.col("turn").cast("string"), F.lit("] and [kb/"), "role", F.lit("/x"), (F.col("turn") % 3).cast("string"), F.lit("] [other/a/b]"))
    answer = F.when(F.col("role") == "assistant", cited).when(F.col("role") == "system", F.concat(F.lit(REFUSAL + " "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", answer.alias("answer"), F.array(F.concat(F.lit("c"), F.col("turn").cast("string")), F.lit("x1")).alias("retrieved_ids"))


_ANSWERS = f"""
answers AS (SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN text || ' [kb/' || role || '/c' || turn || '] and [kb/' || role || '/x' || turn % 3 || '] [other/a/b]' WHEN 'system' THEN '{REFUSAL} ' || text ELSE text END AS answer,
  ['c' || turn, 'x1'] AS ids FROM conversations),
cited AS (SELECT *, regexp_extract_all(answer, '\\[kb/[^/\\]]+/([^\\]]+)\\]', 1) AS cites FROM answers)"""


@query(f"WITH {_ANSWERS} SELECT conv_id, turn, cites AS citations, list_filter(cites, lambda x: NOT list_contains(ids, x)) AS unsupported, contains(answer, '{REFUSAL}') AS refused, nullif(regexp_extract(answer, '[1-5]', 0), '')::INT AS judged FROM cited")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).withColumn("c", PR.citations(F.col("answer"), "kb"))
    ids = lambda c: F.transform(c, lambda x: x["chunk_id"])
    return a.select(
        "conv_id", "turn", ids(F.col("c")).alias("citations"), ids(PR.unsupported(F.col("c"), F.col("retrieved_ids"))).alias("unsupported"),
        PR.refused(F.col("answer"), REFUSAL).alias("refused"), PR.judge_score(F.col("answer")).alias("judged"),
    )


@query(f"""
WITH {_ANSWERS}, x AS (SELECT *, len(list_filter(['the', 'que'], lambda k: contains(lower(answer), k))) / 2 AS coverage, len(list_filter(cites, lambda c: NOT list_contains(ids, c))) AS bad FROM cited)
SELECT role, round(avg(coverage), 9) AS mean_gold_keyword_coverage, avg((len(cites) > 0)::INT) AS citation_present_rate, sum(bad)::BIGINT AS total_unsupported_citations,
  round(avg(length(answer)), 9) AS mean_generation_latency_ms, coalesce(avg(CASE WHEN role = 'system' THEN contains(answer, '{REFUSAL}')::INT END), 0.0) AS diagnostic_refusal_correct_rate
FROM x GROUP BY role""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).withColumn("c", PR.citations(F.col("answer"), "kb"))
    m = E.answer_metrics(
        a.select(
            "role", E.keyword_coverage(F.col("answer"), F.array(F.lit("the"), F.lit("que"))).alias("coverage"), F.size("c").alias("citations"),
            F.size(PR.unsupported(F.col("c"), F.col("retrieved_ids"))).alias("unsupported"), F.length("answer").cast("double").alias("latency_ms"),
            F.when(F.col("role") == "system", PR.refused(F.col("answer"), REFUSAL)).alias("refusal_correct"),
        ),
        ["role"],
    )
    return m.withColumns({c: F.round(c, 9) for c in ("mean_gold_keyword_coverage", "mean_generation_latency_ms")})


@query("SELECT doc_id, printf('%.1f%%', n_chars / 1000.0 * 100.0) AS share, CASE WHEN lang = 'en' THEN 'n/a' ELSE printf('%.1f ms', n_chars * 1.0) END AS time FROM documents")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.percent(F.col("n_chars") / 1000.0).alias("share"), T.milliseconds(F.when(F.col("lang") != "en", F.col("n_chars") * F.lit(1.0))).alias("time"))


_METRICS = """round(avg((coalesce(flags[1], false))::INT), 9) AS hit_at_1, round(avg((p BETWEEN 1 AND 3)::INT), 9) AS recall_at_3, round(avg((p BETWEEN 1 AND 5)::INT), 9) AS recall_at_5,
  round(avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1.0 / p ELSE 0 END), 9) AS mrr_at_5, round(avg((slug IS NOT DISTINCT FROM 'en')::INT), 9) AS procedure_accuracy"""


def _compared(name: str, ctes: str, predicted: str) -> str:
    """One preset's row, from CTEs up to chunks, classified and picked."""
    return f"""SELECT * FROM (WITH RECURSIVE {ctes},
  gold AS (SELECT item_id::VARCHAR AS query_id, {_GOLD} AS kw FROM benchmark),
  judged AS (SELECT g.query_id, h.rank, c.procedure_slug = 'en' AND len(list_filter(kw, lambda k: contains(lower(c.raw_text), k))) / len(kw) >= 0.5 AS ok FROM gold g JOIN picked h USING (query_id) JOIN chunks c USING (chunk_id)),
  flags AS (SELECT g.query_id, coalesce(list(ok ORDER BY rank) FILTER (WHERE rank IS NOT NULL), []) AS flags FROM gold g LEFT JOIN judged USING (query_id) GROUP BY g.query_id),
  x AS (SELECT f.*, {predicted} AS slug, coalesce(list_position(flags, true), 0) AS p FROM flags f JOIN classified c USING (query_id))
SELECT '{name}' AS strategy, {_METRICS} FROM x)"""


_DENSE_ONLY = """
alone AS (SELECT query_id, chunk_id, score FROM dense JOIN chunks USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, sha256(raw_text)[1:16] ORDER BY score DESC, chunk_id) = 1),
picked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM alone QUALIFY rank <= 5)"""


@query(_compared("baseline", f"{UNFILTERED}, {_DENSE_ONLY}", "NULL::VARCHAR") + " UNION ALL " + _compared("high_accuracy", f"{HYBRID_STRUCTURED}, {DIVERSIFIED}", "c.slug"))
def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval metrics of both presets, each over the chunks of its own chunker, for all passages."""
    queries, wanted = asked(spark, sf_dir), gold(spark, sf_dir)
    out = None
    for name, how in H.STRATEGIES.items():
        chunks = embedded_chunks(spark, sf_dir, how.chunker)
        found = H.HybridRetriever(chunks, keywords(spark), how, digits=DIGITS).retrieve(queries)
        hits = found.primary.join(chunks.select("chunk_id", "procedure_slug", "raw_text"), "chunk_id")
        results = E.relevance_flags(hits, wanted).join(found.queries, "query_id").select(
            F.lit(name).alias("strategy"), "flags", F.col("slug").alias("predicted"), F.lit("en").alias("expected"), F.lit(0.0).alias("latency_ms")
        )
        part = E.retrieval_metrics(results, ["strategy"]).drop("mean_retrieval_latency_ms", "p95_retrieval_latency_ms")
        out = part if out is None else out.unionByName(part)
    return out.select("strategy", *(F.round(c, 9).alias(c) for c in out.columns if c != "strategy"))
