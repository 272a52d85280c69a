"""Sections of a document between anchor phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T


class SectionBoundaryError(ValueError):
    """An anchor phrase is missing, or the configuration has no procedures."""


def detect_sections(docs: DataFrame, procedures: list[dict], text_column: str = "text", strict: bool = True) -> DataFrame:
    """(the other columns of docs, procedure_slug, procedure_title, section_index, start, text), a row a section.

    Anchors are looked for in the order given, each after the one before; a section runs to the next anchor, without white space at its ends. What
    comes before the first anchor is in no section. A missing anchor fails the query if strict, else the document has no sections.
    """
    if not procedures:
        raise SectionBoundaryError("no procedures are defined")
    names = [c for c in docs.columns if c != text_column]
    text = F.col(text_column)
    wanted = F.array(*(
        F.struct(F.lit(p["slug"]).alias("slug"), F.lit(p.get("title") or p["slug"]).alias("title"), F.lit(p["anchor"]).alias("anchor")) for p in procedures
    ))
    # Each anchor's place depends on the one before, so the array of anchors is folded.
    start = F.expr(
        "aggregate(wanted, cast(array() AS array<int>), (found, w) -> concat(found, array(CASE WHEN size(found) > 0 AND element_at(found, -1) = 0 THEN 0"
        f" ELSE locate(w.anchor, `{text_column}`, CASE WHEN size(found) > 0 THEN element_at(found, -1) + 1 ELSE 1 END) END)))"
    )
    placed = docs.withColumn("wanted", wanted).withColumn("starts", start)
    missing = F.expr("exists(starts, s -> s = 0)")
    if strict:
        first = F.expr("wanted[array_position(starts, 0) - 1].slug")
        checked = F.when(missing, F.raise_error(F.concat(F.lit("anchor not found for section "), first)).cast("array<int>")).otherwise(F.col("starts"))
        placed = placed.withColumn("starts", checked)
    else:
        placed = placed.where(~missing)
    each = placed.select(*names, text.alias("_text"), "starts", "wanted", F.posexplode("starts").alias("section_index", "start"))
    end = F.coalesce(F.get("starts", F.col("section_index") + 1), F.length("_text") + 1)
    body = T.strip(F.expr("substring(_text, start, _end - start)"))
    return each.withColumn("_end", end).select(
        *names, F.get("wanted", F.col("section_index"))["slug"].alias("procedure_slug"), F.get("wanted", F.col("section_index"))["title"].alias("procedure_title"),
        "section_index", "start", body.alias("text"),
    )
