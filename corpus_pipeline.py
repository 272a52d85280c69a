"""The corpus pipeline: STAGES in order, each over all that the one before it kept, written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and, but for the last, returns its columns. In each of them extra columns are
carried whatever their names, very long texts are worked on whole, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import decontam, langid, mixing, passages, simhash
from ragloom.llm.common import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is recognised; lang is what was found.

    Null texts and texts without letters are rejected; repeated rows are judged alike; of equally near languages the first by name is taken.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id, nulls last, and of equal ids of the least text hash.

    Texts without words all stay; of rows equal in id and text one stays.
    """
    return simhash.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; all rows stay, a null text stays null, a text that is a repeated passage becomes empty.

    Earlier is by id, nulls last, and then by text hash. n_chars is counted again.
    """
    return passages.drop_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark; all rows stay, a null text stays null. n_chars is counted again.

    Without a benchmark, or where its texts are null or too short, nothing is cut.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents at their slots of the training order: slot, place, block and epoch before the columns of docs.

    Every document has a slot of epoch 0; a null source is the source ''; ties of id are in the order of a hash of the row.
    """
    return mixing.mix_texts(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]
#: No SQL has the classifier, the hashes or the suffix arrays; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
