"""A vector store: a relation of records (id, content, metadata, embedding, seq)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom import schema
from ragloom.functions.vectors import mock_embedding
from ragloom.operators.dense import dense_topk, metadata_matches


def embedded(docs: DataFrame, embed: Callable[[Column], Column] = mock_embedding, text: str = "content") -> DataFrame:
    return docs.withColumn("embedding", embed(F.col(text)))


def append_records(records: DataFrame, docs: DataFrame, embed: Callable[[Column], Column] = mock_embedding, order: str = "id") -> DataFrame:
    """records and docs after them; seq goes on from the largest. Ids need not be unique.

    seq is a global order, so it is given by sorted partitions and their offsets, not one window over all.
    """
    new = numbered(docs.select("id", "content", "metadata"), order, records.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0])
    return records.unionByName(embedded(new, embed).select(records.columns))


def numbered(df: DataFrame, order: str, first: int = 0, name: str = "seq") -> DataFrame:
    """df with consecutive numbers from first in order of a column.

    Rows are range-partitioned; each partition numbers its own, and the partitions' sizes, one number each, give the offsets.
    """
    from ragloom.session import checkpointed

    parted = checkpointed(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_low"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_p", "_low", F.coalesce(before, F.lit(0)).alias("_before"))
    out = parted.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_m") - F.col("_low") + F.lit(first))
    return out.drop("_p", "_m", "_low", "_before")


def search_records(
    records: DataFrame, queries: DataFrame, top_k: int = 5, metadata_filter: dict[str, str | None] | None = None,
    embed: Callable[[Column], Column] = mock_embedding, digits: int | None = None,
) -> DataFrame:
    """Hits (query_id, rank, id, content, metadata, score): largest dot products, ties in order of insertion.

    The filter comes before the ranking. Texts are joined to the few hits at the end.
    """
    asked = queries if "embedding" in queries.columns else embedded(queries, embed, "query")
    inside = records.where(metadata_matches(F.col("metadata"), metadata_filter))
    hits = dense_topk(asked, inside, top_k, "seq", "seq", digits=digits).withColumnRenamed("id", "seq")
    return hits.join(records.select("seq", "id", "content", "metadata"), "seq").select("query_id", "rank", "id", "content", "metadata", "score")


def belongs_to(doc_id: Column) -> Column:
    """Is a record of that document: its metadata's doc_id, or its id where there is none."""
    return F.coalesce(F.try_element_at("metadata", F.lit("doc_id")), F.col("id")).eqNullSafe(doc_id)


def delete_documents(records: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """records without those of the documents in doc_ids (doc_id)."""
    owner = F.coalesce(F.try_element_at("metadata", F.lit("doc_id")), F.col("id"))
    return records.withColumn("_owner", owner).join(doc_ids.select(F.col("doc_id").alias("_owner")).distinct(), "_owner", "left_anti").drop("_owner")


class EmbeddingStore:
    """A store of documents with search, filter and delete; its relation is ``records``."""

    def __init__(self, spark, embed: Callable[[Column], Column] = mock_embedding, records: DataFrame | None = None) -> None:
        self.spark, self.embed = spark, embed
        self.records = records if records is not None else spark.createDataFrame([], schema.RECORD)

    def add_documents(self, docs: DataFrame, order: str = "id") -> None:
        self.records = append_records(self.records, docs, self.embed, order)

    def search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        return search_records(self.records, queries, top_k, embed=self.embed)

    def search_with_filter(self, queries: DataFrame, top_k: int = 3, metadata_filter: dict[str, str | None] | None = None) -> DataFrame:
        return search_records(self.records, queries, top_k, metadata_filter, self.embed)

    def get_collection_size(self) -> int:
        return self.records.count()

    def delete_document(self, doc_id: str) -> bool:
        """Whether anything was removed."""
        gone = belongs_to(F.lit(doc_id))
        found = not self.records.where(gone).isEmpty()
        if found:
            self.records = self.records.where(~gone)
        return found


def cache_entries(docs: DataFrame, text: str = "content", model: str = "mock", embed: Callable[[Column], Column] = mock_embedding) -> DataFrame:
    """(model, text_hash, embedding) of the distinct texts of docs."""
    distinct = docs.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("_t")).dropDuplicates(["text_hash"])
    return distinct.select(F.lit(model).alias("model"), "text_hash", embed(F.col("_t")).alias("embedding"))


def embedded_once(docs: DataFrame, cache: DataFrame, text: str = "content", model: str = "mock", embed: Callable[[Column], Column] = mock_embedding) -> DataFrame:
    """docs with text_hash and embedding: from the cache (model, text_hash, embedding) where it has the text, else each distinct text is embedded once.

    A null text has neither. What was computed anew can be appended to the cache (``cache_entries`` of ``cache_misses``).
    """
    hashed = docs.withColumn("text_hash", F.sha2(text, 256))
    known = cache.where(F.col("model") == model).select("text_hash", "embedding")
    new = cache_entries(cache_misses(docs, cache, text, model), text, model, embed).select("text_hash", "embedding")
    return hashed.join(known.unionByName(new), "text_hash", "left")


def cache_misses(docs: DataFrame, cache: DataFrame, text: str = "content", model: str = "mock") -> DataFrame:
    known = cache.where(F.col("model") == model).select(F.col("text_hash").alias("_h"))
    return docs.join(known, F.sha2(text, 256) == F.col("_h"), "left_anti")
