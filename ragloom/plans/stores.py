"""Queries over vectors and the vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import vectors as V
from ragloom.operators import store as S
from ragloom.operators.chunking import FixedSizeChunker, chunk_documents
from ragloom.operators.dense import dense_topk, metadata_matches
from ragloom.plans.chunks import FIXED
from ragloom.plans.registry import query, table

DIGITS = 9
_STEPS = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'c': {c}::BIGINT}}" for a, c in V.steps(64)) + "]"
_SEED = "('0x' || md5({})[25:32])::BIGINT"


def mock_sql(text: str) -> str:
    """The mock embedding of a text, not yet of length one."""
    return f"list_transform({_STEPS}, lambda s: ((s.a::HUGEINT * {_SEED.format(text)} + s.c) % 4294967296)::DOUBLE / 4294967295.0 * 2.0 - 1.0)"


def unit_sql(vector: str) -> str:
    return f"list_transform({vector}, lambda x: x / sqrt(list_inner_product({vector}, {vector})))"


@query(f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_inner_product(q.v, r.v), {DIGITS}) AS score FROM e q, e r)
SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= 5""")
def dense_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector."""
    e = table(spark, sf_dir, "embeddings")
    return dense_topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 5, "vec_id", "vec_id", digits=DIGITS)


@query(f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_inner_product(q.v, r.v), {DIGITS}) AS score FROM e q JOIN e r ON q.label % 10 = r.label)
SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= 3""")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of every vector among those of its label."""
    e = table(spark, sf_dir, "embeddings")
    return dense_topk(e.select(F.col("vec_id").alias("query_id"), "embedding", "label"), e, 3, "vec_id", "vec_id", scope="label", digits=DIGITS)


@query(f"""
SELECT a.vec_id, b.vec_id AS other_id, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), {DIGITS}) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", "other_id", F.round(V.cosine(F.col("embedding"), F.col("other")), DIGITS).alias("similarity"))


@query(f"WITH m AS (SELECT doc_id, {mock_sql('text')} AS v FROM documents) SELECT doc_id, list_transform({unit_sql('v')}, lambda x: round(x, {DIGITS})) AS embedding FROM m")
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", V.mock_embedding(F.col("text")).alias("v"))
    return docs.select("doc_id", F.transform("v", lambda x: F.round(x, DIGITS)).alias("embedding"))


def as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content, metadata) of all documents."""
    docs = table(spark, sf_dir, "documents")
    meta = F.create_map(F.lit("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), F.col("text").alias("content"), meta.alias("metadata"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


_HITS = f"""
r AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, text AS content, lang, {mock_sql('text')} AS v FROM documents),
ru AS (SELECT id, content, lang, {unit_sql('v')} AS v FROM r),
q AS (SELECT item_id::VARCHAR AS query_id, {mock_sql('text')} AS v FROM benchmark),
qu AS (SELECT query_id, {unit_sql('v')} AS v FROM q)"""


def _hits(where: str, k: int) -> str:
    return f"""WITH {_HITS}, s AS (SELECT query_id, id, content, lang, round(list_inner_product(qu.v, ru.v), 9) AS score FROM qu, ru {where})
SELECT query_id, id, md5(content) AS digest, lang, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= {k}"""


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.md5(F.col("content").cast("binary")).alias("digest"), F.col("metadata")["lang"].alias("lang"), "score", "rank")


@query(_hits("", 5))
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into a store, then searched for every benchmark passage."""
    store = S.EmbeddingStore(spark)
    store.add_documents(as_records(spark, sf_dir))
    return _shown(S.search_records(store.records, asked(spark, sf_dir), 5, digits=DIGITS))


@query(_hits("WHERE lang = 'fr'", 3))
def store_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = S.EmbeddingStore(spark)
    store.add_documents(as_records(spark, sf_dir))
    return _shown(S.search_records(store.records, asked(spark, sf_dir), 3, {"lang": "fr", "team": None}, digits=DIGITS))


@query(f"""
WITH c AS (SELECT doc_id || '::chunk_' || chunk_index AS id, doc_id, substring(text, chunk_index * 450 + 1, 500) AS content FROM (SELECT doc_id, text, {FIXED} FROM documents WHERE length(text) > 0)),
r AS (SELECT id, content, {mock_sql('content')} AS v FROM c), ru AS (SELECT id, {unit_sql('v')} AS v FROM r),
q AS (SELECT item_id::VARCHAR AS query_id, {mock_sql('text')} AS v FROM benchmark), qu AS (SELECT query_id, {unit_sql('v')} AS v FROM q),
s AS (SELECT query_id, id, round(list_inner_product(qu.v, ru.v), {DIGITS}) AS score FROM qu, ru)
SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= 5""")
def knowledge_base_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document embedded and searched for every benchmark passage."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    cut = S.embedded(chunk_documents(docs, FixedSizeChunker()))
    queries = S.embedded(asked(spark, sf_dir), text="query")
    return dense_topk(queries, cut, 5, "chunk_id", "chunk_id", digits=DIGITS)


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IS NOT NULL")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wanted null matches the key that is missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    return docs.where(metadata_matches(F.col("metadata"), {"lang": "en", "team": None})).select("doc_id")


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, i AS seq FROM o UNION ALL SELECT lpad(doc_id::VARCHAR, 9, '0'), i + n FROM o, n""")
def append_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents added twice: ids repeat, the order of insertion goes on."""
    store = S.EmbeddingStore(spark)
    for _ in range(2):
        store.add_documents(as_records(spark, sf_dir))
    return store.records.select("id", "seq")


@query("SELECT lpad(doc_id::VARCHAR, 9, '0') AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("quality = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"))
    return S.delete_documents(as_records(spark, sf_dir), gone).select("id")


@query("SELECT lang, count(*) AS size FROM documents GROUP BY lang")
def collection_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_records(spark, sf_dir).groupBy(F.col("metadata")["lang"].alias("lang")).agg(F.count("*").alias("size"))


@query(f"""
WITH t AS (SELECT DISTINCT text FROM documents), e AS (SELECT text, sha256(text) AS text_hash, {mock_sql('text')} AS v FROM t), u AS (SELECT text, text_hash, {unit_sql('v')} AS v FROM e)
SELECT doc_id, text_hash, round(v[1], {DIGITS}) AS first FROM documents JOIN u USING (text)""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text is embedded once, those in the cache not at all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = S.cache_entries(docs.where(F.length("text") >= 1000), "text")
    return S.embedded_once(docs, cache, "text").select("doc_id", "text_hash", F.round(F.get("embedding", F.lit(0)), DIGITS).alias("first"))
