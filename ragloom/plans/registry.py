"""Registry of queries: a name, a function of (spark, sf_dir), and the same in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A table of fewer bytes is not worth the exchange.
MIN_SPREAD = 1 << 20
#: Bytes of a table for each core below which its rows are spread.
SPREAD_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The row groups of a file are its least parts, and a small table has one: where it is read by fewer tasks than there are cores,
    its rows, in the columns that the query reads, are first spread over all. Larger tables are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if MIN_SPREAD <= size < SPREAD_BYTES * cores else df
