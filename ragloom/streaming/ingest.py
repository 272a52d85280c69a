"""Incremental ingest: documents that arrive become chunks with embeddings, each text embedded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragloom.functions.vectors import mock_embedding
from ragloom.operators.chunking import FixedSizeChunker, chunk_documents

DOCUMENTS = "id string, content string, arrived timestamp"


def read_arrivals(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Stream of JSON files of documents (id, content, arrived)."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_at_once).json(folder)


def ingest(arrivals: DataFrame, target: str, checkpoint: str, chunker=None, embed: Callable[[Column], Column] = mock_embedding, late: str = "1 day") -> StreamingQuery:
    """Chunks of new documents appended to target. A document that comes again with the same content within ``late`` is not ingested again;
    the state that this takes is dropped behind the watermark. Each batch writes a folder of its own number, so one that is run again replaces itself."""
    new = arrivals.withColumn("text_hash", F.sha2("content", 256)).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["id", "text_hash"])
    cut = chunk_documents(new, chunker or FixedSizeChunker()).withColumn("embedding", embed(F.col("content")))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return cut.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_by_window(arrivals: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, documents, characters) of each window of arrival; windows close behind the watermark."""
    by = arrivals.withWatermark("arrived", late).groupBy(F.window("arrived", window).alias("w"))
    return by.agg(F.count("*").alias("documents"), F.sum(F.length("content")).alias("characters")).select("w.start", "documents", "characters")
