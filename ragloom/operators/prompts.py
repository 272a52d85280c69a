"""Contexts, prompts and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_context(hits: DataFrame, block: Column, separator: str = "\n\n") -> DataFrame:
    """(query_id, context): the blocks of each query's hits in order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), separator).alias("context"))


def answer_prompt(question: Column, context: Column) -> Column:
    """Prompt of the plain agent."""
    return F.concat(
        F.lit("Use the context below to answer the question. If the context does not contain the answer, say so.\n\nContext:\n"),
        F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"),
    )


def citation_tag(source: str, slug: Column, chunk_id: Column) -> Column:
    return F.concat(F.lit(f"[{source}/"), slug, F.lit("/"), chunk_id, F.lit("]"))


def cited_block(source: str, title: Column, slug: Column, chunk_id: Column, raw_text: Column) -> Column:
    return F.concat(F.lit("### Quy trình: "), title, F.lit(" (citation: "), citation_tag(source, slug, chunk_id), F.lit(")\n"), raw_text)


def grounded_prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nCâu hỏi: "), question,
        F.lit("\n\nHãy trả lời theo đúng các quy tắc bắt buộc ở trên."),
    )


def citations(answer: Column, source: str) -> Column:
    """ARRAY<STRUCT<slug, chunk_id>> of the citations of a source in an answer, in order."""
    pattern = rf"\[\Q{source}\E/([^/\]]+)/([^\]]+)\]"
    slug, chunk = (F.regexp_extract_all(answer, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(slug, chunk, lambda s, c: F.struct(s.alias("slug"), c.alias("chunk_id")))


def unsupported(cited: Column, retrieved_ids: Column) -> Column:
    """Citations of chunks that were not retrieved, repeats included."""
    return F.filter(cited, lambda c: ~F.array_contains(retrieved_ids, c["chunk_id"]))


def refused(answer: Column, message: str) -> Column:
    return F.contains(answer, F.lit(message.strip()))


def judge_score(reply: Column) -> Column:
    """First digit from 1 to 5 of a judge's reply, or null."""
    return F.nullif(F.regexp_extract(reply, "[1-5]", 0), F.lit("")).cast("int")
