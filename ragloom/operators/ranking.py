"""Operators on ranked lists: fusion, dedup, diversity, neighbours, reranking, query classification.

A ranked list has (query_id, chunk_id, score, rank).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators.chunking import rank_in
from ragloom.session import SMALL_ROWS, broadcast_if_small, checkpointed

RRF_K, SCORE_EPSILON, CONTEXT_TOKENS, CONFIDENCE, RERANK_POOL = 60, 0.02, 1600, 0.6, 10


def reciprocal_rank_fusion(lists: Sequence[DataFrame], k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): sums of 1 / (k + rank) over lists, ties by chunk_id."""
    every = None
    for ranked in lists:
        part = ranked.select("query_id", "chunk_id", (1.0 / (F.lit(k) + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    score = F.sum("part")
    fused = every.groupBy("query_id", "chunk_id").agg((F.round(score, digits) if digits is not None else score).alias("score"))
    return rank_in(fused, ["query_id"], [F.desc("score"), F.col("chunk_id")])


def deduplicate(ranked: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """The first of the chunks of a query with one hash (or id, where the hash is missing or empty), ranked anew."""
    key = F.coalesce(F.nullif(F.col(content_hash), F.lit("")), F.col("chunk_id").cast("string"))
    first = rank_in(ranked.withColumn("_key", key), ["query_id", "_key"], [F.col("rank")], 1, "_n").drop("_key", "_n")
    return rank_in(first.withColumnRenamed("rank", "_rank"), ["query_id"], [F.col("_rank")]).drop("_rank")


def _contained(asked: DataFrame, keywords: DataFrame, size: int = 3) -> DataFrame:
    """asked (query_id, q) with each of keywords (slug, keyword) that q contains, as an equi-join: a keyword's first size letters are among the runs of
    letters of any text that contains it. An empty keyword is in every text."""
    first = keywords.select("slug", "keyword", F.substring("keyword", 1, size).alias("gram"))
    lengths = F.array(*(F.lit(k) for k in range(size + 1)))
    runs = F.flatten(F.transform(lengths, lambda n: F.when(n == 0, F.array(F.lit(""))).when(
        F.length("q") >= n, F.transform(F.sequence(F.lit(1), F.length("q") - n + 1), lambda i: F.substring(F.col("q"), i, n))
    ).otherwise(F.array().cast("array<string>"))))
    grams = asked.select("query_id", F.explode(F.array_distinct(runs)).alias("gram"))
    # Keywords that share a gram with a query, then the texts of the queries for the final word.
    near = grams.join(first, "gram").drop("gram")
    return near.join(asked, "query_id").where(F.contains("q", "keyword"))


def classify_keywords(queries: DataFrame, keywords: DataFrame, threshold: float = CONFIDENCE, small: int = SMALL_ROWS) -> DataFrame:
    """(query_id, slug, confidence, should_filter) of every query.

    keywords: (slug, keyword). A keyword hits a query that contains it. The slug with most hits wins, of
    equals the last by name; half of the confidence is its share of all hits, half grows with two hits. Without hits the slug is null and
    the confidence 0. Up to small keywords go to every task; more meet the queries by their first letters.
    """
    kw = keywords.select("slug", F.lower("keyword").alias("keyword"))
    asked = queries.select("query_id", T.match_form(F.col("query")).alias("q"))
    if kw.limit(small + 1).count() <= small:
        found = asked.join(F.broadcast(kw), F.contains("q", "keyword"))
    else:
        found = _contained(asked, kw)
    hits = found.groupBy("query_id", "slug").agg(F.count("*").alias("hits"))
    best = hits.groupBy("query_id").agg(F.max_by("slug", F.struct("hits", "slug")).alias("slug"), F.max("hits").alias("best"), F.sum("hits").alias("total"))
    confidence = F.bround(0.5 * F.col("best") / F.col("total") + 0.5 * F.least(F.lit(1.0), F.col("best") / 2), 4)
    scored = best.select("query_id", "slug", confidence.alias("confidence"))
    out = queries.select("query_id").join(scored, "query_id", "left").select("query_id", "slug", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return out.withColumn("should_filter", F.col("slug").isNotNull() & (F.col("confidence") >= threshold))


def diversify(ranked: DataFrame, top_k: int, slug: str = "procedure_slug", epsilon: float = SCORE_EPSILON) -> DataFrame:
    """(query_id, chunk_id, score, rank): top_k of each query. After the first, of those within epsilon of the best left the first with a slug
    not yet taken, else the best. Lists are short (what fusion returns), so a list is one array, walked in the JVM."""
    item = F.struct("rank", "score", F.coalesce(F.col(slug).cast("string"), F.lit("\x00")).alias("slug"), "chunk_id")
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    walk = f"""
      aggregate(sequence(2, greatest(2, {int(top_k)})),
        named_struct('picked', slice(items, 1, 1), 'left', slice(items, 2, size(items))),
        (s, i) -> CASE WHEN i > {int(top_k)} OR size(s.left) = 0 THEN s ELSE
          transform(array(coalesce(
              get(filter(s.left, x -> s.left[0].score - x.score <= {float(epsilon)}D AND NOT exists(s.picked, p -> p.slug = x.slug)), 0),
              s.left[0])),
            c -> named_struct('picked', concat(s.picked, array(c)), 'left', filter(s.left, x -> x.rank <> c.rank)))[0] END,
        s -> s.picked)"""
    picked = lists.select("query_id", F.posexplode(F.expr(walk)).alias("n", "item")).where(F.col("n") < top_k)
    return picked.select("query_id", "item.chunk_id", "item.score", (F.col("n") + 1).alias("rank"))


def expand_adjacent(primary: DataFrame, chunks: DataFrame, max_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """(query_id, chunk_id, score, source, rank): primary chunks, each followed by its neighbours of the same slug that still fit.

    The budget holds the primaries themselves. Neighbours are tried in order, the one before first; one that is taken, unknown, of another slug or
    too long is passed over. source is 'primary' or 'adjacent'; a neighbour has its parent's score.
    """
    # Tokens are counted of the texts that are asked for, not of all: the hits are few, so both joins pass the chunks once, where they are.
    own = broadcast_if_small(primary.select("query_id", "chunk_id", "score", "rank"))
    about = chunks.select("chunk_id", "procedure_slug", "previous_chunk_id", "next_chunk_id", "raw_text")
    mine = own.join(about, "chunk_id").withColumn("tokens", T.token_estimate(F.col("raw_text"))).drop("raw_text")
    mine = checkpointed(mine)
    near = mine.select("query_id", "rank", "procedure_slug", F.posexplode(F.array("previous_chunk_id", "next_chunk_id")).alias("side", "near_id")).where("near_id is not null and near_id <> ''")
    other = chunks.select(F.col("chunk_id").alias("near_id"), F.col("procedure_slug").alias("near_slug"), F.col("raw_text").alias("near_text"))
    near = broadcast_if_small(near).join(other, "near_id").where(F.col("procedure_slug").eqNullSafe(F.col("near_slug")))
    near = near.withColumn("near_tokens", T.token_estimate(F.col("near_text"))).drop("near_text")
    tries = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "side", "near_id", "near_tokens"))).alias("tries"))
    base = mine.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("own"), F.sum("tokens").cast("long").alias("total"))
    walk = f"""
      aggregate(coalesce(tries, cast(array() AS array<struct<rank:int,side:int,near_id:string,near_tokens:int>>)),
        named_struct('used', transform(own, x -> x.chunk_id), 'total', total, 'out', cast(array() AS array<struct<rank:int,side:int,near_id:string,near_tokens:int>>)),
        (s, t) -> CASE WHEN array_contains(s.used, t.near_id) OR s.total + t.near_tokens > {int(max_tokens)} THEN s
          ELSE named_struct('used', concat(s.used, array(t.near_id)), 'total', s.total + t.near_tokens, 'out', concat(s.out, array(t))) END,
        s -> s.out)"""
    both = base.join(tries, "query_id", "left").select("query_id", "own", F.expr(walk).alias("added"))
    rows = both.select("query_id", F.explode(F.expr("""
      concat(
        transform(own, x -> named_struct('parent', x.rank, 'side', -1, 'chunk_id', x.chunk_id, 'score', x.score)),
        transform(added, t -> named_struct('parent', t.rank, 'side', t.side, 'chunk_id', t.near_id, 'score', filter(own, x -> x.rank = t.rank)[0].score)))
    """)).alias("r"))
    out = rows.select("query_id", "r.*").withColumn("source", F.when(F.col("side") < 0, "primary").otherwise("adjacent"))
    return rank_in(out, ["query_id"], [F.col("parent"), F.col("side")]).drop("parent", "side")


def lexical_score(query: Column, text: Column) -> Column:
    """Share of a query's distinct tokens that a text has: a reranking score that needs no model."""
    asked = F.array_distinct(T.tokenize(query))
    both = F.size(F.array_intersect(asked, T.tokenize(text)))
    return F.when(F.size(asked) > 0, both / F.size(asked)).otherwise(F.lit(0.0))


def rerank(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 5, score: Callable[[Column, Column], Column] = lexical_score, pool: int = RERANK_POOL) -> DataFrame:
    """(query_id, chunk_id, score, rank): the first pool chunks of each query ordered by score(query, raw_text), ties by chunk_id."""
    few = ranked.where(F.col("rank") <= pool).select("query_id", "chunk_id")
    asked = broadcast_if_small(checkpointed(few.join(queries.select("query_id", "query"), "query_id")))
    text = asked.join(chunks.select("chunk_id", "raw_text"), "chunk_id")
    scored = text.select("query_id", "chunk_id", score(F.col("query"), F.col("raw_text")).alias("score"))
    return rank_in(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], top_k)
