"""Text files with front matter, JSON configurations, and the Markdown sink."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom import schema
from ragloom.functions import text as T
from ragloom.operators.sections import SectionBoundaryError

_BLOCK = r"(?s)\A---[^\n]*\n(.*?)(?:\A|(?<=\n))[ \t]*---[ \t]*(?:\n|\z)(.*)\z"


def front_matter_block(text: Column) -> Column:
    """What is between the first line '---' and the next, or null where the text has no front matter."""
    return F.when(text.rlike(_BLOCK), F.regexp_extract(text, _BLOCK, 1))


def front_matter_body(text: Column) -> Column:
    """The rest, without newlines before it; the whole text where there is no front matter."""
    return F.when(text.rlike(_BLOCK), F.regexp_replace(F.regexp_extract(text, _BLOCK, 2), r"\A\n+", "")).otherwise(text)


def flat_yaml(block: Column) -> Column:
    """MAP of 'key: value' lines. Blank lines, comments and lines without colon are passed over, a value ends before ' #', quotes around it go, of
    equal keys the last counts."""
    lines = F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), T.strip), lambda x: (x != "") & ~x.startswith("#") & F.contains(x, F.lit(":")))

    def value(line: Column) -> Column:
        raw = F.regexp_replace(T.strip(F.regexp_replace(line, r"\A[^:]*:", "")), r"(?s) #.*\z", "")
        return F.regexp_replace(T.strip(raw), "\\A[\"']+|[\"']+\\z", "")

    pairs = F.transform(lines, lambda x: F.struct(T.strip(F.regexp_extract(x, r"\A([^:]*):", 1)).alias("key"), value(x).alias("value")))
    # An earlier pair with the key of a later one goes, so keys are unique.
    return F.map_from_entries(T.let(pairs, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda q: q["key"] == p["key"]))))


def with_front_matter(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(id, content, metadata) of files; doc_id and source are set from the path where the front matter has none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    given = flat_yaml(front_matter_block(F.col(text)))
    doc_id = F.coalesce(F.nullif(F.try_element_at(given, F.lit("doc_id")), F.lit("")), stem)
    extra = F.map_filter(F.create_map(F.lit("doc_id"), doc_id, F.lit("source"), F.col(path)), lambda k, _: ~F.map_contains_key(given, k))
    return files.select(doc_id.alias("id"), front_matter_body(F.col(text)).alias("content"), F.map_concat(given, extra).alias("metadata"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the Markdown and text files below folder."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[mMtT][dDxX]*")
    files = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(F.lower("path").rlike(r"\.(md|txt)$"))


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    return with_front_matter(read_files(spark, folder))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _read_json(spark: SparkSession, path: str, of: str) -> DataFrame:
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return spark.read.option("multiLine", True).schema(of).json(path)


def load_boundaries(spark: SparkSession, path: str) -> tuple[dict, list[dict]]:
    """(source document, procedures) of a boundary file, which is a small configuration."""
    row = _read_json(spark, path, schema.BOUNDARIES).first()
    if row is None or not row.procedures:
        raise SectionBoundaryError(f"{path} defines no procedures")
    return (row.source_document.asDict() if row.source_document else {}), [p.asDict() for p in row.procedures]


def boundary_keywords(spark: SparkSession, procedures: list[dict]) -> DataFrame:
    """(slug, keyword)."""
    return spark.createDataFrame([(p["slug"], k) for p in procedures for k in p.get("query_keywords") or []], "slug string, keyword string")


def load_gold_queries(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, f"queries array<struct<{_fields(schema.GOLD_QUERY)}>>").selectExpr("inline(queries)")


def load_diagnostic_queries(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, f"queries array<struct<{_fields(schema.DIAGNOSTIC_QUERY)}>>").selectExpr("inline(queries)")


def _fields(ddl: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def markdown_document(metadata: Column, title: Column, content: Column) -> Column:
    """One string: quoted front matter in the order of the map, a heading, the content."""
    lines = F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), T.yaml_value(e["value"])))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n# "), title, F.lit("\n\n"), content, F.lit("\n"))


def write_markdown(docs: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """A folder doc_id=... with one text each. docs: (doc_id, document)."""
    docs.select("doc_id", F.col("document").alias("value")).repartition("doc_id").write.mode(mode).partitionBy("doc_id").option("lineSep", "\n").text(folder)


def missing_metadata(docs: DataFrame, required: tuple[str, ...] = ("audience", "source_url", "retrieved_at", "document_version")) -> DataFrame:
    """(id, missing) of documents that lack required metadata."""
    lacks = F.filter(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.try_element_at("metadata", k), F.lit("")) == "")
    return docs.select("id", lacks.alias("missing")).where(F.size("missing") > 0)
