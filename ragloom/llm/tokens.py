"""Operator 1: exact histogram of encoded document lengths.

Documents are encoded whole; each task keeps one counter per length, so what is
shuffled is a few thousand (length, documents) rows however large the corpus.
Suffix sums over the distinct lengths then answer, for every context limit,
how many documents and tokens fit, how many tokens a truncation keeps, and any
quantile.

Defined results: a null or empty text has length 0 and is counted; a very long text is encoded whole; strings of
special tokens are ordinary text; repeated rows count each time; an empty
table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The tokenizer of a rank file, made once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary, pattern).encode_ordinary, Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                seen[len(encode(text)) if text else 0] += 1
        yield pa.RecordBatch.from_pydict(
            {"n_tokens": pa.array(list(seen), pa.int64()), "part": pa.array(list(seen.values()), pa.int64())}
        )

    parts = docs.select("text").mapInArrow(count, "n_tokens long, part long")
    return parts.groupBy("n_tokens").agg(F.sum("part").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """Suffix sums of a histogram, a row for every length L that occurs.

    docs, docs_up_to, docs_at_least: documents of length = L, <= L, >= L;
    tokens_at_least: tokens of those >= L; truncated_tokens: tokens left when every
    document is cut to L; fraction_up_to: the quantile that L is. Between two rows
    truncated_tokens grows by docs_at_least of the later row a token, so the rows
    answer every limit (see ``at_limits``). The windows run over distinct lengths,
    not documents.
    """
    down = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    n, tokens = F.col("docs"), F.col("docs") * F.col("n_tokens")
    whole = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = histogram.select(
        "n_tokens",
        "docs",
        F.sum(n).over(down).alias("docs_at_least"),
        F.sum(tokens).over(down).alias("tokens_at_least"),
        F.sum(n).over(whole).alias("all_docs"),
        F.sum(tokens).over(whole).alias("all_tokens"),
    )
    up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("docs")
    return sums.select(
        "n_tokens",
        "docs",
        up_to.alias("docs_up_to"),
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias(
            "truncated_tokens"
        ),
        (up_to / F.col("all_docs")).alias("fraction_up_to"),
    )


def at_limits(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """(limit_tokens, docs_fit, truncated_tokens) for any context limits, from ``context_limits``."""
    spark = limits.sparkSession
    ask = spark.createDataFrame([(int(x),) for x in wanted], "limit_tokens long")
    total = F.sum(F.when(F.col("n_tokens") <= F.col("limit_tokens"), F.col("docs") * F.col("n_tokens")).otherwise(
        F.col("docs") * F.col("limit_tokens")
    ))
    fit = F.sum(F.when(F.col("n_tokens") <= F.col("limit_tokens"), F.col("docs")))
    return (
        limits.select("n_tokens", "docs")
        .crossJoin(F.broadcast(ask))
        .groupBy("limit_tokens")
        .agg(F.coalesce(fit, F.lit(0)).alias("docs_fit"), total.alias("truncated_tokens"))
    )


def quantiles(limits: DataFrame, wanted: list[float]) -> DataFrame:
    """(quantile, n_tokens): the least length that at least that share of documents does not exceed."""
    spark = limits.sparkSession
    ask = spark.createDataFrame([(float(x),) for x in wanted], "quantile double")
    return (
        limits.select("n_tokens", "fraction_up_to")
        .join(F.broadcast(ask), F.col("fraction_up_to") >= F.col("quantile"))
        .groupBy("quantile")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
