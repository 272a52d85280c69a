"""Hybrid retrieval of a batch of queries: classify, dense and BM25 search, fusion, dedup, diversity or reranking, neighbours."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.vectors import mock_embedding
from ragloom.operators import ranking as R
from ragloom.operators.bm25 import BM25Index
from ragloom.operators.chunking import rank_in
from ragloom.operators.dense import dense_topk
from ragloom.session import broadcast_if_small, checkpointed


@dataclass(frozen=True)
class Strategy:
    chunker: str = "structure"
    use_bm25: bool = True
    use_metadata_filter: bool = True
    use_reranker: bool = False
    use_adjacent_expansion: bool = True
    enable_diversity: bool = True
    dense_top_k: int = 20
    bm25_top_k: int = 20
    confidence: float = R.CONFIDENCE


HIGH_ACCURACY = Strategy()
BASELINE = Strategy("fixed_size", use_bm25=False, use_metadata_filter=False, use_adjacent_expansion=False, enable_diversity=False)
STRATEGIES = {"baseline": BASELINE, "high_accuracy": HIGH_ACCURACY}


def strategy(name: str, use_reranker: bool = False) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}")
    return replace(STRATEGIES[name], use_reranker=use_reranker)


@dataclass
class Retrieved:
    """queries: (query_id, slug, confidence, should_filter); primary: ranking before neighbours; context: with them."""

    queries: DataFrame
    primary: DataFrame
    context: DataFrame


def few(hits: DataFrame) -> DataFrame:
    """Hits written, and sent to all tasks if they are few, so that a join passes the chunks where they are and none of them is shuffled."""
    return broadcast_if_small(checkpointed(hits))


class HybridRetriever:
    """chunks: (chunk_id, raw_text, procedure_slug, content_hash, previous_chunk_id, next_chunk_id, embedding)."""

    def __init__(
        self, chunks: DataFrame, keywords: DataFrame | None = None, how: Strategy = HIGH_ACCURACY, index: BM25Index | None = None,
        embed: Callable[[Column], Column] = mock_embedding, rerank_score: Callable[[Column, Column], Column] = R.lexical_score, digits: int | None = None,
    ) -> None:
        self.chunks, self.keywords, self.how, self.embed, self.rerank_score, self.digits = chunks, keywords, how, embed, rerank_score, digits
        self.index = index or (BM25Index.build(chunks, "chunk_id", "raw_text") if how.use_bm25 else None)

    def classify(self, queries: DataFrame) -> DataFrame:
        if self.how.use_metadata_filter and self.keywords is not None:
            return R.classify_keywords(queries, self.keywords, self.how.confidence)
        return queries.select("query_id", F.lit(None).cast("string").alias("slug"), F.lit(0.0).alias("confidence"), F.lit(False).alias("should_filter"))

    def fused(self, queries: DataFrame, classified: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score, rank, procedure_slug): dense and BM25 lists fused; where BM25 finds nothing the dense list as it is. Without repeats."""
        wanted = classified.select("query_id", F.when(F.col("should_filter"), F.col("slug")).alias("procedure_slug"))
        asked = queries.select("query_id", self.embed(F.col("query")).alias("embedding")).join(wanted, "query_id")
        dense = dense_topk(asked, self.chunks, self.how.dense_top_k, "chunk_id", "chunk_id", scope="procedure_slug", digits=self.digits)
        dense = dense.withColumnRenamed("id", "chunk_id")
        about = self.chunks.select("chunk_id", "procedure_slug", "content_hash")
        fused = dense.select("query_id", "chunk_id", "score", "rank")
        if self.index is not None:
            # The slug filter comes after the ranking here, so fewer may be left.
            found = few(self.index.search(queries, self.how.bm25_top_k, self.digits).withColumnRenamed("id", "chunk_id"))
            found = found.join(about.select("chunk_id", "procedure_slug"), "chunk_id").join(wanted.withColumnRenamed("procedure_slug", "wanted"), "query_id")
            found = found.where(F.col("wanted").isNull() | (F.col("wanted") == F.col("procedure_slug"))).select("query_id", "chunk_id", "score", "rank")
            # The lexical list is ranked anew once filtered, as its order is what counts.
            found = rank_in(found.withColumnRenamed("rank", "_r"), ["query_id"], [F.col("_r")]).drop("_r")
            fused = self._fuse(fused, found)
        return R.deduplicate(few(fused).join(about, "chunk_id")).drop("content_hash")

    def _fuse(self, dense: DataFrame, lexical: DataFrame) -> DataFrame:
        """Reciprocal ranks of both lists; the dense scores as they are for queries without lexical hits. One aggregate and one window."""
        part = 1.0 / (F.lit(R.RRF_K) + F.col("rank"))
        none = F.lit(None).cast("double")
        both = dense.select("query_id", "chunk_id", part.alias("part"), F.col("score").alias("own"), F.lit(0).alias("lexical")).unionByName(
            lexical.select("query_id", "chunk_id", part.alias("part"), none.alias("own"), F.lit(1).alias("lexical"))
        )
        summed = F.sum("part")
        each = both.groupBy("query_id", "chunk_id").agg(
            (F.round(summed, self.digits) if self.digits is not None else summed).alias("fused"), F.max("own").alias("own"), F.max("lexical").alias("lexical")
        )
        some = F.max("lexical").over(Window.partitionBy("query_id")) > 0
        scored = each.select("query_id", "chunk_id", F.when(some, F.col("fused")).otherwise(F.col("own")).alias("score"))
        return rank_in(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")])

    def retrieve(self, queries: DataFrame, top_k: int = 5) -> Retrieved:
        """queries: (query_id, query), the query normalised (see functions.text.normalize_query)."""
        classified = self.classify(queries)
        fused = self.fused(queries, classified)
        if self.how.use_reranker:
            primary = R.rerank(fused, queries, self.chunks, top_k, self.rerank_score)
        elif self.how.enable_diversity:
            primary = R.diversify(fused, top_k)
        else:
            primary = fused.where(F.col("rank") <= top_k).drop("procedure_slug")
        if not self.how.use_adjacent_expansion:
            return Retrieved(classified, primary, primary.withColumn("source", F.lit("primary")))
        primary = checkpointed(primary)  # top_k rows a query, needed by either side of the joins that follow
        context = R.expand_adjacent(primary, self.chunks)
        return Retrieved(classified, primary, context)
