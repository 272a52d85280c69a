"""The index of chunks as a folder of Parquet tables and a JSON configuration."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ragloom.operators.bm25 import BM25Index
from ragloom.operators.hybrid import Strategy


class IndexMissing(FileNotFoundError):
    """No index in that folder."""


def save_index(folder: str, chunks: DataFrame, keywords: DataFrame, how: Strategy, index: BM25Index | None, config: dict | None = None) -> None:
    """Tables chunks, keywords, tokens (of each chunk), terms and stats, and config."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    keywords.write.mode("overwrite").parquet(f"{folder}/keywords")
    if index is not None:
        index.documents.write.mode("overwrite").parquet(f"{folder}/tokens")
        index.terms.write.mode("overwrite").parquet(f"{folder}/terms")
        index.stats.write.mode("overwrite").parquet(f"{folder}/stats")
    text = json.dumps({"strategy": asdict(how), **(config or {})}, ensure_ascii=False)
    chunks.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Strategy, BM25Index | None, dict]:
    if "://" not in folder and not Path(folder, "config").exists():
        raise IndexMissing(f"no index in {folder}: build it first")
    config = json.loads(spark.read.text(f"{folder}/config", wholetext=True).first()[0])
    how = Strategy(**config.pop("strategy"))
    table = lambda name: spark.read.parquet(f"{folder}/{name}")
    index = BM25Index(table("tokens"), table("terms"), table("stats")) if how.use_bm25 else None
    return table("chunks"), table("keywords"), how, index, config
