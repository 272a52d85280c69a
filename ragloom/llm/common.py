"""Session helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    The folder is the one the cluster names in spark.checkpoint.dir; only where
    that is unset, no folder is set and all runs in one process, as in tests, a temporary one is taken.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def named(names: list[str]) -> list[Column]:
    """Columns by name, whatever signs a name has."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def doc_key(id_column: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells documents apart: the id (nulls last) and a hash of the text, as many rows may bear one id or none."""
    from ragloom.llm.kernel import NO_ID

    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("key"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
    ]
