"""Queries of ranked retrieval: BM25, fusion, classification, hybrid search, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.functions.vectors import mock_embedding
from ragloom.operators import hybrid as H
from ragloom.operators import prompts as PR
from ragloom.operators import ranking as R
from ragloom.operators.bm25 import BM25Index
from ragloom.operators.bm25 import idf as idf_of
from ragloom.operators.dense import dense_topk
from ragloom.plans.chunks import BASELINE, STRUCTURED, preset_chunks
from ragloom.plans.registry import query, table
from ragloom.plans.stores import DIGITS, asked, mock_sql, unit_sql
from ragloom.plans.texts import ESTIMATE, TOKENS
from ragloom.session import written

SCORE = 6
KEYWORDS = [
    ("de", "und"), ("de", "nicht"), ("de", "der"), ("en", "the"), ("en", "that"), ("en", "with"), ("es", "que"), ("es", "los"), ("es", "para"), ("fr", "les"), ("fr", "dans"), ("fr", "que"),
]
KEYWORDS_SQL = "kw(slug, keyword) AS (VALUES " + ", ".join(f"('{s}', '{k}')" for s, k in KEYWORDS) + ")"


def bm25_sql(docs: str, id_: str, text: str, k: int) -> str:
    """CTEs up to ranked (query_id, id, score, rank) of the benchmark against a table."""
    return f"""
post AS (SELECT id, token, count(*) AS tf FROM (SELECT {id_} AS id, unnest({TOKENS.format(text)}) AS token FROM {docs}) GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id),
n AS (SELECT count(*) AS n FROM {docs}),
st AS (SELECT n, (SELECT sum(dl) FROM dl) / n AS avgdl FROM n),
terms AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, n GROUP BY token),
av AS (SELECT avg(idf) AS a FROM terms),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id::VARCHAR AS query_id, unnest({TOKENS.format('text')}) AS token FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, id, round(sum(qtf * (CASE WHEN idf < 0 THEN 0.25 * a ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), {SCORE}) AS score
  FROM qt JOIN terms USING (token) JOIN post USING (token) JOIN dl USING (id), av, st GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM bm) WHERE rank <= {k} AND score > 0)"""


@query(f"WITH {bm25_sql('documents', 'doc_id', 'text', 20)} SELECT token, df, round(idf, 9) AS idf FROM terms")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = BM25Index.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.terms.crossJoin(F.broadcast(index.stats)).select("token", "df", F.round(idf_of(F.col("df"), F.col("n")), 9).alias("idf"))


@query(f"WITH {bm25_sql('documents', 'doc_id', 'text', 20)} SELECT query_id, id, score, rank FROM ranked")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = BM25Index.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.search(asked(spark, sf_dir), 20, SCORE).select("query_id", "id", "score", "rank")


_DENSE = f"""
ru AS (SELECT doc_id AS id, {unit_sql('v')} AS v FROM (SELECT doc_id, {mock_sql('text')} AS v FROM documents)),
qu AS (SELECT query_id, {unit_sql('v')} AS v FROM (SELECT item_id::VARCHAR AS query_id, {mock_sql('text')} AS v FROM benchmark)),
dense AS (SELECT query_id, id, round(list_inner_product(qu.v, ru.v), {DIGITS}) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(qu.v, ru.v), {DIGITS}) DESC, id) AS rank FROM qu, ru QUALIFY rank <= 20)"""


@query(f"""
WITH {bm25_sql('documents', 'doc_id', 'text', 20)}, {_DENSE},
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM ranked) GROUP BY ALL)
SELECT query_id, id AS chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM f""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = table(spark, sf_dir, "documents"), asked(spark, sf_dir)
    lexical = BM25Index.build(docs, "doc_id", "text").search(queries, 20, SCORE).withColumnRenamed("id", "chunk_id")
    vectors = docs.select("doc_id", mock_embedding(F.col("text")).alias("embedding"))
    dense = dense_topk(queries.select("query_id", mock_embedding(F.col("query")).alias("embedding")), vectors, 20, "doc_id", "doc_id", digits=DIGITS)
    return R.reciprocal_rank_fusion([dense.withColumnRenamed("id", "chunk_id"), lexical], digits=DIGITS)


@query("""
WITH r AS (SELECT lang AS query_id, doc_id AS chunk_id, sha256(text)[1:16] AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY n) AS i FROM r)
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY n))::INT AS rank FROM f WHERE i = 1""")
def dedup_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language as one list: of equal texts the first stays, ranks close up."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), T.content_hash(F.col("text")).alias("content_hash"))
    ranked = R.rank_in(docs, ["query_id"], [F.col("chunk_id")])
    return R.deduplicate(ranked).select("query_id", "chunk_id", "rank")


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "slug string, keyword string")


def classified_sql(docs: str, id_: str, text: str) -> str:
    return f"""
{KEYWORDS_SQL},
kh AS (SELECT {id_} AS query_id, slug, count(*) AS hits FROM {docs} JOIN kw ON contains(lower({text}), keyword) GROUP BY ALL),
kb AS (SELECT query_id, max_by(slug, (hits, slug)) AS slug, max(hits) AS best, sum(hits) AS total FROM kh GROUP BY query_id),
classified AS (SELECT {id_} AS query_id, slug, coalesce(round_even(0.5 * best / total + 0.5 * least(1.0, best / 2), 4), 0.0) AS confidence FROM {docs} LEFT JOIN kb ON kb.query_id = {id_})"""


@query(f"WITH {classified_sql('documents', 'doc_id', 'text')} SELECT query_id, slug, confidence, slug IS NOT NULL AND confidence >= 0.6 AS should_filter FROM classified")
def classify_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return R.classify_keywords(docs, keywords(spark))


def embedded_chunks(spark: SparkSession, sf_dir: str, chunker: str = "fixed_size") -> DataFrame:
    """The index: what retrieval and prompts read of the chunks, and their embeddings, written once."""
    cut = preset_chunks(spark, sf_dir, chunker).select("chunk_id", "raw_text", "procedure_slug", "procedure_title", "previous_chunk_id", "next_chunk_id", "content_hash")
    return written(cut.withColumn("embedding", mock_embedding(F.col("raw_text"))))


def retriever(spark: SparkSession, sf_dir: str, **how) -> H.HybridRetriever:
    return H.HybridRetriever(embedded_chunks(spark, sf_dir), keywords(spark), H.Strategy(**how), digits=DIGITS)


_LISTS = f"""
{bm25_sql('chunks', 'chunk_id', 'raw_text', 20)},
{classified_sql('benchmark', 'item_id::VARCHAR', 'text')},
wanted AS (SELECT query_id, CASE WHEN confidence >= 0.6 THEN slug END AS wanted FROM classified),
cu AS (SELECT chunk_id, procedure_slug, {unit_sql('v')} AS v FROM (SELECT chunk_id, procedure_slug, {mock_sql('raw_text')} AS v FROM chunks)),
qu AS (SELECT query_id, {unit_sql('v')} AS v FROM (SELECT item_id::VARCHAR AS query_id, {mock_sql('text')} AS v FROM benchmark)),
pair AS (SELECT query_id, chunk_id, round(list_inner_product(qu.v, cu.v), {DIGITS}) AS score FROM qu JOIN wanted USING (query_id) JOIN cu ON wanted IS NULL OR wanted = procedure_slug),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pair QUALIFY rank <= 20),
lex AS (SELECT query_id, id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ranked JOIN wanted USING (query_id) JOIN chunks ON chunks.chunk_id = id WHERE wanted IS NULL OR wanted = procedure_slug),
both_lists AS (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM lex),
rrf AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), {DIGITS}) AS score FROM both_lists GROUP BY ALL),
fused AS (SELECT * FROM rrf WHERE query_id IN (SELECT query_id FROM lex) UNION ALL SELECT query_id, chunk_id, score FROM dense WHERE query_id NOT IN (SELECT query_id FROM lex)),
uniq AS (SELECT query_id, chunk_id, score, raw_text, procedure_slug FROM fused JOIN chunks USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, sha256(raw_text)[1:16] ORDER BY score DESC, chunk_id) = 1),
hybrid AS (SELECT query_id, chunk_id, score, raw_text, procedure_slug, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM uniq)"""


HYBRID, HYBRID_STRUCTURED = f"{BASELINE},{_LISTS}", f"{STRUCTURED},{_LISTS}"
#: The same without the filter by slug.
UNFILTERED = HYBRID.replace("CASE WHEN confidence >= 0.6 THEN slug END AS wanted", "NULL::VARCHAR AS wanted")

#: CTEs from hybrid up to picked (query_id, chunk_id, score, rank): five of each query, a slug not yet taken going first within 0.02 of the best left.
DIVERSIFIED = """
items AS (SELECT query_id, list({'rank': rank, 'score': score, 'slug': coalesce(procedure_slug, chr(0)), 'chunk_id': chunk_id} ORDER BY rank) AS items FROM hybrid GROUP BY query_id),
walk(query_id, n, taken, rest) AS (
  SELECT query_id, 1, items[1:1], items[2:] FROM items
  UNION ALL
  SELECT query_id, n + 1, list_append(taken, c), list_filter(rest, lambda x: x.rank <> c.rank) FROM (
    SELECT *, coalesce(list_filter(rest, lambda x: rest[1].score - x.score <= 0.02 AND NOT list_contains(list_transform(taken, lambda p: p.slug), x.slug))[1], rest[1]) AS c
    FROM walk WHERE n < 5 AND len(rest) > 0)),
picked AS (SELECT query_id, taken[i].chunk_id AS chunk_id, taken[i].score AS score, i::INT AS rank
  FROM (SELECT query_id, taken, unnest(range(1, len(taken) + 1)) AS i FROM (SELECT * FROM walk QUALIFY n = max(n) OVER (PARTITION BY query_id))))"""


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, score, rank FROM hybrid WHERE rank <= 5")
def hybrid_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of every benchmark passage, without diversity and neighbours."""
    r = retriever(spark, sf_dir, enable_diversity=False, use_adjacent_expansion=False)
    return r.retrieve(asked(spark, sf_dir)).primary.select("query_id", "chunk_id", "score", "rank")


_LEXICAL = f"len(list_intersect(list_distinct({TOKENS.format('b.text')}), {TOKENS.format('h.raw_text')}))::DOUBLE / len(list_distinct({TOKENS.format('b.text')}))"


@query(f"""
WITH {HYBRID}, s AS (SELECT h.query_id, h.chunk_id, {_LEXICAL} AS score FROM hybrid h JOIN benchmark b ON b.item_id::VARCHAR = h.query_id WHERE rank <= 10)
SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM s QUALIFY rank <= 5""")
def hybrid_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retriever(spark, sf_dir, use_reranker=True, use_adjacent_expansion=False)
    return r.retrieve(asked(spark, sf_dir)).primary.select("query_id", "chunk_id", "score", "rank")


@query(f"WITH RECURSIVE {UNFILTERED}, {DIVERSIFIED} SELECT query_id, chunk_id, score, rank FROM picked")
def hybrid_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retriever(spark, sf_dir, use_adjacent_expansion=False, use_metadata_filter=False)
    return r.retrieve(asked(spark, sf_dir)).primary.select("query_id", "chunk_id", "score", "rank")


@query(f"""
WITH RECURSIVE {HYBRID}, {DIVERSIFIED},
known AS (SELECT chunk_id, procedure_slug, previous_chunk_id, next_chunk_id, {ESTIMATE.format('raw_text')} AS tokens FROM chunks),
tries AS (SELECT p.query_id, p.rank, side, n.chunk_id AS near_id, n.tokens FROM picked p JOIN known k USING (chunk_id) CROSS JOIN (VALUES (0), (1)) s(side)
  JOIN known n ON n.chunk_id = CASE side WHEN 0 THEN k.previous_chunk_id ELSE k.next_chunk_id END AND n.procedure_slug IS NOT DISTINCT FROM k.procedure_slug),
lists AS (SELECT query_id, list({{'rank': rank, 'side': side, 'id': near_id, 'tokens': tokens}} ORDER BY rank, side) AS t FROM tries GROUP BY query_id),
grow(query_id, i, used, total, added) AS (
  SELECT query_id, 0, list(chunk_id), sum(tokens)::BIGINT, []::BIGINT[] FROM picked JOIN known USING (chunk_id) GROUP BY query_id
  UNION ALL
  SELECT query_id, i + 1, CASE WHEN fits THEN list_append(used, t[i + 1].id) ELSE used END, total + CASE WHEN fits THEN t[i + 1].tokens ELSE 0 END, CASE WHEN fits THEN list_append(added, i + 1) ELSE added END
  FROM (SELECT g.*, t, NOT list_contains(used, t[i + 1].id) AND total + t[i + 1].tokens <= 1600 AS fits FROM grow g JOIN lists USING (query_id) WHERE i < len(t))),
ended AS (SELECT query_id, t, unnest(added) AS a FROM (SELECT query_id, i, added, t FROM grow JOIN lists USING (query_id) QUALIFY i = max(i) OVER (PARTITION BY query_id))),
every AS (SELECT query_id, rank AS parent, -1 AS side, chunk_id, score, 'primary' AS source FROM picked
  UNION ALL SELECT e.query_id, t[a].rank, t[a].side, t[a].id, score, 'adjacent' FROM ended e JOIN picked p ON p.query_id = e.query_id AND p.rank = t[a].rank)
SELECT query_id, chunk_id, score, source, (row_number() OVER (PARTITION BY query_id ORDER BY parent, side))::INT AS rank FROM every""")
def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything: filter, fusion, diversity and neighbours within the token budget."""
    return retriever(spark, sf_dir).retrieve(asked(spark, sf_dir)).context.select("query_id", "chunk_id", "score", "source", "rank")


@query(f"""
WITH {HYBRID}, c AS (SELECT query_id, string_agg('### Quy trình: ' || upper(procedure_slug) || ' (citation: [kb/' || procedure_slug || '/' || chunk_id || '])' || chr(10) || raw_text, chr(10) || chr(10) ORDER BY rank) AS context FROM hybrid WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Câu hỏi: ' || text || chr(10) || chr(10) || 'Hãy trả lời theo đúng các quy tắc bắt buộc ở trên.' AS prompt FROM c JOIN benchmark ON item_id::VARCHAR = query_id""")
def grounded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every query from its five chunks."""
    r = retriever(spark, sf_dir, enable_diversity=False, use_adjacent_expansion=False)
    queries = asked(spark, sf_dir)
    hits = r.retrieve(queries).primary.join(r.chunks.select("chunk_id", "procedure_slug", "procedure_title", "raw_text"), "chunk_id")
    block = PR.cited_block("kb", F.col("procedure_title"), F.col("procedure_slug"), F.col("chunk_id"), F.col("raw_text"))
    context = PR.joined_context(hits, block)
    return queries.join(context, "query_id").select("query_id", PR.grounded_prompt(F.col("query"), F.col("context")).alias("prompt"))


@query(f"""
WITH {bm25_sql('documents', 'doc_id', 'text', 3)}, c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN documents ON doc_id = id GROUP BY query_id)
SELECT item_id::VARCHAR AS query_id, md5('Use the context below to answer the question. If the context does not contain the answer, say so.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:') AS digest
FROM benchmark LEFT JOIN c ON query_id = item_id::VARCHAR""")
def agent_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = table(spark, sf_dir, "documents"), asked(spark, sf_dir)
    hits = BM25Index.build(docs, "doc_id", "text").search(queries, 3, SCORE).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    context = PR.joined_context(hits, F.col("text"))
    prompts = queries.join(context, "query_id", "left").select("query_id", PR.answer_prompt(F.col("query"), F.col("context")).alias("p"))
    return prompts.select("query_id", F.md5(F.col("p").cast("binary")).alias("digest"))
