"""Text expressions. All but NFC are JVM built-ins."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])\s+"
#: White space as Python's str.strip and \s of a Unicode regex know it.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BULLETS = "•◦‣▪●○∙·"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row: what a lambda refers to is otherwise worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@F.arrow_udf(types.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize is of no use here: pyarrow 23.0.1 gives the decomposed form for "NFC" too.
    return pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


#: Characters that are in normal form C whatever stands beside them: Latin, Cyrillic, Vietnamese, general punctuation, Han, Hangul.
COMPOSED = r"\x00-\u02ff\u0400-\u0482\u1e00-\u1eff\u2002-\u206f\u4e00-\u9fff\uac00-\ud7a3"


def nfc(text: Column) -> Column:
    """Unicode normal form C (Spark has no built-in for it). Only texts with a character that may have to change go to Python."""
    # What has a byte a character is ASCII. A run of the class is some twenty times as fast as a search for what is not in it.
    other = (F.length(text) != F.octet_length(text)) & ~text.rlike(rf"\A[{COMPOSED}]*+\z")
    return F.coalesce(_nfc(F.when(other, text)), text)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_text(raw: Column) -> Column:
    """One newline style, NFC, plain spaces, '- ' for bullet glyphs, no trailing white space, at most one blank line."""
    text = nfc(F.regexp_replace(F.coalesce(raw, F.lit("")), "\r\n?", "\n"))
    text = F.translate(text, "\u00a0\u2007\u2009\u202f\ufeff", "    ")
    text = F.regexp_replace(text, f"[{SPACE}&&[^\n]]+(?=\n|$)", "")
    text = F.regexp_replace(text, rf"(?m)^([{SPACE}&&[^\n]]*)[{BULLETS}][{SPACE}&&[^\n]]*", "$1- ")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def normalize_query(query: Column) -> Column:
    text = F.translate(nfc(strip(F.coalesce(query, F.lit("")))), "\u00a0\ufeff", " ")
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def tokenize(text: Column) -> Column:
    """Lower-case NFC words: letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(nfc(text)), F.lit(WORD), F.lit(0))


def match_form(text: Column) -> Column:
    return F.lower(nfc(text))


def split_words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """1.5 tokens a word, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.size(split_words(text)) * F.lit(1.5)).cast("int"))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(strip(text), SENTENCE_END), strip)
    return F.filter(parts, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, rf"\n[{SPACE}]*\n"), strip)
    return F.filter(parts, lambda p: p != "")


def slugify(value: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("document"))


def yaml_value(value: Column) -> Column:
    """One quoted scalar."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def preview(text: Column, length: int = 200) -> Column:
    return F.translate(F.substring(text, 1, length), "\n", " ")


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f%%", value * 100.0))


def milliseconds(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f ms", value))
