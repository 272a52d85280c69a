"""Okapi BM25 over an index of each text's distinct tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators.chunking import rank_in
from ragloom.session import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: (query, token) rows that go to every task at once; more are joined by shuffle.
TOKENS_AT_ONCE = 200_000
_QUERIES = 64
#: Bytes of the texts that are counted at once, distinct tokens of the texts that are scored at once, and scores of tokens that are added up at once.
BYTES_OF_A_PIECE, TOKENS_AT_A_TIME, SCORES_AT_ONCE = 2_000_000, 500_000, 1_000_000
#: What stands between tokens.
_BETWEEN = T.WORD.replace("[", "[^", 1)


def _pieces(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose sizes add up to about so much, a row at least, so that what is worked out of them has a bound that no size of the table changes."""
    upto = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The tokens of texts in match form, as ``functions.text.tokenize`` has them, and the row of each. None of them is a Python object."""
    parts = pc.split_pattern_regex(texts, _BETWEEN)
    row = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # a text may begin or end between tokens
    return row[some.to_numpy(zero_copy_only=False)], flat.filter(some)


def counted_tokens(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, tokens, tf, dl): the distinct tokens of each text, how often each occurs, and all occurrences.

    A text is one row, so its tokens are counted where it is read and nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, pc.binary_length(whole.column(1)), BYTES_OF_A_PIECE):
                row, found = words_of(batch.column(1))
                words = found.dictionary_encode()
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                rows, kinds = np.arange(batch.num_rows + 1), max(1, len(words.dictionary))
                pair, tf = np.unique(row * kinds + code, return_counts=True)
                offsets = pa.array(np.searchsorted(pair, rows * kinds).astype(np.int32))
                distinct = words.dictionary.take(pa.array(pair % kinds))
                size = np.bincount(row, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(offsets, distinct), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))), pa.array(size)],
                    ["id", "tokens", "tf", "dl"],
                )

    texts = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), T.match_form(F.col(text_column)).alias("text"))
    return texts.mapInArrow(count, f"id {dict(docs.dtypes)[id_column]}, tokens array<string>, tf array<int>, dl long")


def idf(df: Column, n: Column) -> Column:
    return F.ln(n - df + F.lit(0.5)) - F.ln(df + F.lit(0.5))


@dataclass
class BM25Index:
    """documents (id, tokens, tf, dl), terms (token, df), stats (n, avgdl, average_idf: one row)."""

    documents: DataFrame
    terms: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, id_column: str = "chunk_id", text_column: str = "raw_text") -> "BM25Index":
        """Index of docs; its tables are written once. Texts without tokens count in n, as null texts do."""
        found = written(counted_tokens(docs, id_column, text_column))
        terms = written(found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")))
        n = docs.count()
        tokens = found.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        mean = terms.agg(F.avg(idf(F.col("df"), F.lit(n)))).first()[0]
        row = [(n, tokens / n if n else None, mean)]
        return cls(found, terms, docs.sparkSession.createDataFrame(row, "n long, avgdl double, average_idf double"))

    @property
    def postings(self) -> DataFrame:
        """(id, token, tf, dl)."""
        return self.documents.select("id", "dl", F.explode(F.arrays_zip("tokens", "tf")).alias("p")).select("id", F.col("p.tokens").alias("token"), F.col("p.tf").alias("tf"), "dl")

    def weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, token, weight): inverse document frequency of each token of each query, times its occurrences there."""
        asked = queries.select("query_id", F.explode(T.tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
        n, _, average = self.stats.first()
        own = idf(F.col("df"), F.lit(n))
        rare = F.when(own < 0, F.lit(average) * EPSILON).otherwise(own)
        return asked.join(self.terms, "token").select("query_id", "token", (F.col("qtf") * rare).alias("weight"))

    def search(self, queries: DataFrame, top_k: int = 20, digits: int | None = None, at_once: int = TOKENS_AT_ONCE) -> DataFrame:
        """(query_id, id, score, rank), scores above 0 only, ties by id. queries: (query_id, query).

        Queries of at_once tokens in all go to every task, which scores its documents for all of them and hands on the top_k of a batch and
        those tied; more queries are joined to the postings by token.
        """
        weights = self.weights(queries)
        avgdl = self.stats.first().avgdl
        few = weights.limit(at_once + 1).toArrow()
        if few.num_rows <= at_once:
            scored = self._scored(few, dict(queries.dtypes)["query_id"], avgdl, top_k, digits)
        else:
            one = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
            scored = self.postings.join(weights, "token").groupBy("query_id", "id").agg(F.sum(one).alias("score"))
            if digits is not None:
                scored = scored.withColumn("score", F.round("score", digits))
        return rank_in(scored, ["query_id"], [F.desc("score"), F.col("id")], top_k).where("score > 0")

    def _scored(self, weights: pa.Table, query_type: str, avgdl: float | None, top_k: int, digits: int | None) -> DataFrame:
        """(query_id, id, score) of the best documents of each batch."""
        asked = weights.column("query_id").combine_chunks().dictionary_encode()
        token = weights.column("token").combine_chunks().dictionary_encode()
        query, code = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (asked, token))
        by = np.argsort(query, kind="stable")
        shared = self.documents.sparkSession.sparkContext.broadcast(
            (asked.dictionary, token.dictionary, query[by], code[by], weights.column("weight").to_numpy()[by])
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, tokens, query, code, weight = shared.value
            edges = np.searchsorted(query, np.arange(0, len(ids) + _QUERIES, _QUERIES))
            floor = np.full(len(ids), -np.inf)  # top_k of the texts so far have as much; what has less is not handed on
            for batch in (piece for whole in batches for piece in _pieces(whole, whole.column(1).value_lengths(), TOKENS_AT_A_TIME)):
                known = pc.index_in(batch.column(1).flatten(), value_set=tokens)
                row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
                hit = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
                row, found = row[hit], known.take(pa.array(hit)).to_numpy(zero_copy_only=False)
                tf = batch.column(2).flatten().to_numpy(zero_copy_only=False)[hit].astype(np.float64)
                dl = batch.column(3).to_numpy(zero_copy_only=False)[row]
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)) if len(hit) else tf
                for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):  # some queries at a time, and the tokens that they have
                    own, local = np.unique(code[lo:hi], return_inverse=True)
                    value = np.zeros((len(own), min(_QUERIES, len(ids) - k * _QUERIES)))
                    value[local, query[lo:hi] - k * _QUERIES] = weight[lo:hi]
                    place = np.full(len(tokens), -1)
                    place[own] = np.arange(len(own))
                    at = place[found]
                    mine = np.flatnonzero(at >= 0)
                    if not len(mine):
                        continue
                    start = np.concatenate([[0], np.flatnonzero(np.diff(row[mine])) + 1])
                    score = np.empty((value.shape[1], len(start)))
                    first = 0
                    while first < len(start):  # the scores of some rows at a time
                        last = max(first + 1, int(np.searchsorted(start, start[first] + SCORES_AT_ONCE // value.shape[1], "right")) - 1)
                        some = mine[start[first] : start[last] if last < len(start) else len(mine)]
                        score[:, first:last] = np.add.reduceat(value[at[some]] * part[some, None], start[first:last] - start[first], axis=0).T
                        first = last
                    if digits is not None:
                        score = np.round(score, digits)
                    score[score <= 0] = -np.inf
                    least = floor[k * _QUERIES : k * _QUERIES + len(score)]
                    if top_k <= score.shape[1]:
                        np.maximum(least, np.partition(score, -top_k, axis=1)[:, -top_k], out=least)
                    q, r = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(q + k * _QUERIES)), batch.column(0).take(pa.array(row[mine][start][r])), pa.array(score[q, r])],
                        ["query_id", "id", "score"],
                    )

        return self.documents.mapInArrow(run, f"query_id {query_type}, id {dict(self.documents.dtypes)['id']}, score double")
