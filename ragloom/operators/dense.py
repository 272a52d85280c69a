"""Exact vector search: every query against every record, in batches of matrix products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.operators.chunking import rank_in
from ragloom.session import checkpointed

#: Queries whose vectors go to every task at once.
QUERIES_AT_ONCE = 20_000
_BLOCK = 256
#: Rows of a block, where blocks of queries and of records are joined.
_PACKED = 4096


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of dim numbers: shorter ones end in zeros, longer ones are cut, as a dot product sees them."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    at = 0
    for i, n in enumerate(size.tolist()):
        out[i, : min(n, dim)] = flat[at : at + min(n, dim)]
        at += n
    return out


def best_of_batch(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row and those tied with the last; -inf is never one."""
    least = np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else np.full(len(score), -np.inf)
    return np.nonzero((score >= least[:, None]) & (score > -np.inf))


def _scores(asked: pa.Table | pa.RecordBatch, batch: pa.RecordBatch, vectors: np.ndarray, k: int, digits: int | None) -> Iterator[pa.RecordBatch]:
    """The best of a batch of records (id, tie, scope, embedding) for each of asked (query_id, scope), whose vectors are given."""
    ids, scopes = asked.column("query_id"), asked.column("scope").to_numpy(zero_copy_only=False)
    m = _matrix(batch.column(3), vectors.shape[1])
    theirs = batch.column(2).to_numpy(zero_copy_only=False)
    for mine, those in _meeting(scopes, theirs):
        records = m if those is None else m[those]
        for lo in range(0, len(mine), _BLOCK):
            part = mine[lo : lo + _BLOCK]
            score = vectors[part] @ records.T
            if digits is not None:
                score = np.round(score, digits) + 0.0
            q, r = best_of_batch(score, k)
            best, r = score[q, r], pa.array(r if those is None else those[r])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(part[q])), batch.column(0).take(r), batch.column(1).take(r), pa.array(best)],
                ["query_id", "id", "tie", "score"],
            )


def _meeting(scopes: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(places of queries, places of the records that they are held against): those of a scope meet the records of it alone, those without one all, which None says."""
    if (every := np.flatnonzero([s is None for s in scopes])).size:
        yield every, None
    records: dict[str, list[int]] = {}
    for i, s in enumerate(theirs):
        records.setdefault(s, []).append(i)
    queries: dict[str, list[int]] = {}
    for i, s in enumerate(scopes):
        if s is not None and s in records:
            queries.setdefault(s, []).append(i)
    for s, mine in queries.items():
        yield np.array(mine), np.array(records[s])


def _dimension(vectors: pa.Array) -> int:
    return max(vectors.value_lengths().to_pylist(), default=1) or 1


def _packed(df: DataFrame, rows: int, name: str, spread: int = 0) -> DataFrame:
    """(scope, name): rows of df of one scope, up to so many in one binary value. With spread, the rows of a scope are first brought together in so many parts."""
    if spread:
        df = df.repartition("scope", F.pmod(F.xxhash64(df.columns[0]), F.lit(spread))).sortWithinPartitions("scope")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scope = batch.column("scope")
            code = scope.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                for lo in range(first, last, rows):
                    part = batch.slice(lo, min(rows, last - lo))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([scope.slice(lo, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["scope", name])

    return df.mapInArrow(pack, f"scope string, {name} binary")


def _unpacked(value: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def dense_topk(
    queries: DataFrame,
    records: DataFrame,
    k: int,
    tie: str,
    id_column: str = "id",
    scope: str | None = None,
    digits: int | None = None,
    at_once: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """(query_id, id, score, rank) of the k records with the largest dot products of each query.

    queries: (query_id, embedding), records: (id, tie, embedding); records with equal scores are in order of tie.
    scope: a column of both that must be equal where the query's is not null. digits: scores are rounded to so many.
    Each task keeps k records a query and batch (and those tied), so little is shuffled. Up to at_once queries go to every task; more are
    packed in blocks, as the records are, and the blocks are joined.
    """
    scoped = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    ask = queries.where("embedding is not null").select("query_id", "embedding", scoped.alias("scope"))
    types = dict(records.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {types[id_column]}, tie {types[tie]}, score double"
    have = records.where("embedding is not null").select(F.col(id_column).alias("id"), F.col(tie).alias("tie"), scoped.alias("scope"), "embedding")
    few = ask.limit(at_once + 1).toArrow().combine_chunks()
    if few.num_rows <= at_once:
        dim = _dimension(few.column("embedding").combine_chunks()) if few.num_rows else 1
        vectors = _matrix(few.column("embedding"), dim) if few.num_rows else np.zeros((0, 1))
        shared = queries.sparkSession.sparkContext.broadcast((few.drop_columns(["embedding"]).combine_chunks(), vectors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, vectors = shared.value
            asked = asked.to_batches()[0] if asked.num_rows else asked
            for batch in batches:
                if batch.num_rows and asked.num_rows:
                    yield from _scores(asked, batch, vectors, k, digits)

        found = have.mapInArrow(run, schema)
    else:

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pairs in batches:
                for i in range(pairs.num_rows):
                    asked, batch = _unpacked(pairs.column(0)[i]), _unpacked(pairs.column(1)[i])
                    yield from _scores(asked, batch, _matrix(asked.column(1), _dimension(asked.column(1))), k, digits)

        # Blocks of one scope meet those of the same alone; there are some for each core, and the fewer they are the less often a record is sent.
        total, scopes = ask.agg(F.count("*"), F.count_distinct("scope")).first()
        rows = max(_PACKED // 8, min(2 * _PACKED, total // (4 * queries.sparkSession.sparkContext.defaultParallelism)))
        parts = math.ceil(total / (rows * scopes)) if scopes else 0
        asked = checkpointed(_packed(ask, rows, "asked", parts).withColumn("block", F.monotonically_increasing_id()))
        blocks = F.broadcast(asked.select(F.col("scope").alias("_scope"), "block"))
        own = F.lit(True) if not scopes else F.col("_scope").isNull() | (F.col("_scope") == F.col("scope"))
        spread = _packed(have, _PACKED, "records", parts).join(blocks, own).select("records", "block")
        found = spread.join(asked, "block").select("asked", "records").mapInArrow(meet, schema)
    return rank_in(found, ["query_id"], [F.desc("score"), F.col("tie")], k).drop("tie")


def metadata_matches(metadata: Column, wanted: dict[str, str | None] | None) -> Column:
    """All of wanted are equal; a wanted null is equal to a missing key. Nothing wanted matches all."""
    ok = F.lit(True)
    for key, value in (wanted or {}).items():
        ok = ok & F.try_element_at(metadata, F.lit(key)).eqNullSafe(F.lit(value))
    return ok
