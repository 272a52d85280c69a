"""Build, save, load and ask an index: the operators in one object, and the plain agent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import providers
from ragloom.functions import text as T
from ragloom.operators import chunking as C
from ragloom.operators import hybrid as H
from ragloom.operators import prompts as PR
from ragloom.operators.bm25 import BM25Index
from ragloom.operators.sections import detect_sections
from ragloom.operators.store import EmbeddingStore
from ragloom.session import checkpointed, written
from ragloom.sources import documents as D
from ragloom.sources.index import load_index, save_index

REFUSAL = "I cannot find that in the documents."


class NotBuilt(RuntimeError):
    """The pipeline has no index yet."""


def preprocess(docs: DataFrame, source: dict, procedures: list[dict]) -> DataFrame:
    """Sections of documents (text): normalised, cut at the anchors, with the source's fields."""
    clean = docs.select(T.normalize_text(F.col("text")).alias("text"))
    found = detect_sections(clean, procedures)
    return found.select(F.lit(source.get("source_id")).alias("source_id"), "procedure_slug", "procedure_title", "section_index", "text")


class RagPipeline:
    """A strategy, and once built or loaded an index that answers batches of queries (query_id, query)."""

    def __init__(self, spark: SparkSession, how: H.Strategy = H.HIGH_ACCURACY, embedding: str = "mock", digits: int | None = None) -> None:
        if how.chunker not in ("fixed_size", "structure"):
            raise ValueError(f"unknown chunker {how.chunker!r}")
        self.spark, self.how, self.digits = spark, how, digits
        self.embedding, self.embed = providers.embedder(embedding)
        self.retriever: H.HybridRetriever | None = None
        self.keywords: DataFrame | None = None

    @classmethod
    def for_strategy(cls, spark: SparkSession, name: str, embedding: str = "mock", use_reranker: bool = False) -> "RagPipeline":
        return cls(spark, H.strategy(name, use_reranker), embedding)

    def build_index(self, source_path: str, boundaries_path: str) -> DataFrame:
        source, procedures = D.load_boundaries(self.spark, boundaries_path)
        sections = preprocess(D.read_text(self.spark, source_path), source, procedures)
        return self.build_from_sections(sections, D.boundary_keywords(self.spark, procedures), source.get("source_title") or "documents")

    def build_from_sections(self, sections: DataFrame, keywords: DataFrame, label: str = "documents") -> DataFrame:
        """The chunks, written once with their embeddings."""
        cut = C.baseline_chunk_sections(sections) if self.how.chunker == "fixed_size" else C.chunk_sections(sections, label=label)
        chunks = written(cut.withColumn("embedding", self.embed(F.col("text"))))
        self.keywords = keywords
        self.retriever = H.HybridRetriever(chunks, keywords, self.how, embed=self.embed, digits=self.digits)
        return chunks

    def built(self) -> H.HybridRetriever:
        if self.retriever is None:
            raise NotBuilt("build or load an index first")
        return self.retriever

    def retrieve_detailed(self, queries: DataFrame, top_k: int = 5) -> H.Retrieved:
        clean = queries.select("query_id", T.normalize_query(F.col("query")).alias("query"))
        return self.built().retrieve(clean, top_k)

    def retrieve(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """Hits with their chunks, neighbours included."""
        return self.retrieve_detailed(queries, top_k).context.join(self.built().chunks.drop("embedding"), "chunk_id")

    def answer(self, queries: DataFrame, generate: Callable[[str], str], top_k: int = 5, source: str = "documents") -> DataFrame:
        """(query_id, answer, error, generation_ms, citations, unsupported, retrieved_ids, refused, procedure_slug, procedure_confidence,
        metadata_filter_applied, reranker_used, embedding_model) of every query."""
        clean = queries.select("query_id", T.normalize_query(F.col("query")).alias("query"))
        found = self.built().retrieve(clean, top_k)
        hits = found.context.join(self.built().chunks.select("chunk_id", "procedure_title", "procedure_slug", "raw_text"), "chunk_id")
        block = PR.cited_block(source, F.col("procedure_title"), F.col("procedure_slug"), F.col("chunk_id"), F.col("raw_text"))
        context = PR.joined_context(hits, block).join(hits.groupBy("query_id").agg(F.collect_set("chunk_id").alias("retrieved_ids")), "query_id")
        asked = clean.join(context, "query_id", "left").withColumn("retrieved_ids", F.coalesce("retrieved_ids", F.array().cast("array<string>")))
        said = checkpointed(asked.select("query_id", "retrieved_ids", providers.generated(PR.grounded_prompt(F.col("query"), F.col("context")), generate).alias("g")))
        cited = said.select("query_id", "retrieved_ids", "g.answer", "g.error", F.col("g.ms").alias("generation_ms"), PR.citations(F.col("g.answer"), source).alias("citations"))
        about = found.queries.select(
            "query_id", F.col("slug").alias("procedure_slug"), F.col("confidence").alias("procedure_confidence"), F.col("should_filter").alias("metadata_filter_applied"),
            F.lit(self.how.use_reranker).alias("reranker_used"), F.lit(self.embedding).alias("embedding_model"),
        )
        return cited.select("*", PR.unsupported(F.col("citations"), F.col("retrieved_ids")).alias("unsupported"), PR.refused(F.col("answer"), REFUSAL).alias("refused")).join(about, "query_id")

    def save_index(self, folder: str) -> None:
        r = self.built()
        save_index(folder, r.chunks, self.keywords, self.how, r.index, {"embedding": self.embedding})

    @classmethod
    def load_index(cls, spark: SparkSession, folder: str) -> "RagPipeline":
        """Nothing is embedded or counted again."""
        chunks, keywords, how, index, config = load_index(spark, folder)
        self = cls(spark, how, config.get("embedding", "mock"))
        self.keywords = keywords
        self.retriever = H.HybridRetriever(chunks, keywords, how, index, self.embed)
        return self


class KnowledgeBaseAgent:
    """Prompts from a store's best hits, and what the model says to them."""

    def __init__(self, store: EmbeddingStore, generate: Callable[[str], str]) -> None:
        self.store, self.generate = store, generate

    def answer(self, questions: DataFrame, top_k: int = 3) -> DataFrame:
        """(query_id, answer, error). questions: (query_id, query)."""
        context = PR.joined_context(self.store.search(questions, top_k), F.col("content"))
        prompts = questions.join(context, "query_id", "left").select("query_id", PR.answer_prompt(F.col("query"), F.col("context")).alias("p"))
        return prompts.select("query_id", providers.generated(F.col("p"), self.generate).alias("g")).select("query_id", "g.*")


def build_knowledge_base(spark: SparkSession, folder: str, chunker=None, embed: providers.Embedder | None = None) -> EmbeddingStore:
    """Text files below folder, front matter read, cut to chunks and put into a store."""
    docs = D.load_documents(spark, folder)
    cut = C.chunk_documents(docs, chunker or C.FixedSizeChunker())
    metadata = F.map_concat(
        F.map_filter("metadata", lambda k, _: ~k.isin("doc_id", "chunk_index")),
        F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("chunk_index"), F.col("chunk_index").cast("string")),
    )
    store = EmbeddingStore(spark, embed or providers.embedder()[1])
    store.add_documents(cut.select(F.col("chunk_id").alias("id"), "content", metadata.alias("metadata")))
    return store
