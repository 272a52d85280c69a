"""Queries over chunkers and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import chunking as C
from ragloom.operators.sections import detect_sections
from ragloom.plans.registry import query, table
from ragloom.plans.texts import ESTIMATE, EXTRACTED, WORDS, page_texts

#: (…, chunk_index, content) of windows of 500 characters that share 50; FROM has the table.
FIXED = "unnest(range(0, greatest(0, ceil((length(text) - 500) / 450.0))::BIGINT + 1)) AS chunk_index"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(text, E' \n\t'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \n\t')), lambda s: s <> '')"


def recursive_sql(size: int, docs: str = "documents", keep: str = "doc_id", text: str = "text") -> str:
    """CTEs up to leaves (keep, path, piece): the recursive chunks, in order of path. Parts of a level are put together again by one fold."""
    held = "CASE WHEN a.held <> '' THEN a.held || sep || x.held ELSE x.held END"
    so_far = "CASE WHEN a.held <> '' THEN list_append(a.out, a.held) ELSE a.out END"
    return f"""
cuts({keep}, path, piece, level) AS (
  SELECT {keep}, [0::BIGINT], {text}, 1 FROM {docs} WHERE {text} IS NOT NULL
  UNION ALL
  SELECT {keep}, list_append(path, i), parts[i], level + 1 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT {keep}, path, level, CASE WHEN level = 5 THEN list_transform(range(0, ceil(length(piece) / {size}.0)::BIGINT), lambda k: substring(piece, k * {size} + 1, {size}))
      WHEN fold.held <> '' THEN list_append(fold.out, fold.held) ELSE fold.out END AS parts
    FROM (SELECT *, list_reduce(
        list_prepend({{'held': '', 'out': []::VARCHAR[]}}, list_transform(string_split(piece, sep), lambda p: {{'held': p, 'out': []::VARCHAR[]}})),
        lambda a, x: CASE WHEN length({held}) <= {size} THEN {{'held': {held}, 'out': a.out}}
          WHEN length(x.held) <= {size} THEN {{'held': x.held, 'out': {so_far}}}
          ELSE {{'held': '', 'out': list_append({so_far}, x.held)}} END) AS fold
      FROM (SELECT *, CASE level WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN chr(10) WHEN 3 THEN '. ' ELSE ' ' END AS sep FROM cuts WHERE length(piece) > {size}))))),
leaves AS (SELECT {keep}, path, piece FROM cuts WHERE length(piece) BETWEEN 1 AND {size})"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _chunked(spark: SparkSession, sf_dir: str, chunker) -> DataFrame:
    return C.chunk_documents(_documents(spark, sf_dir), chunker, "doc_id", "text").select("chunk_id", "doc_id", "chunk_index", "content")


@query(f"SELECT doc_id || '::chunk_' || chunk_index AS chunk_id, doc_id::VARCHAR AS doc_id, chunk_index::INT AS chunk_index, substring(text, chunk_index * 450 + 1, 500) AS content FROM (SELECT doc_id, text, {FIXED} FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, C.FixedSizeChunker())


@query(f"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
g AS (SELECT doc_id, s, unnest(range(0, ceil(len(s) / 3.0)::BIGINT)) AS i FROM s WHERE len(s) > 0)
SELECT doc_id || '::chunk_' || i AS chunk_id, doc_id::VARCHAR AS doc_id, i::INT AS chunk_index, array_to_string(s[i * 3 + 1 : i * 3 + 3], ' ') AS content FROM g""")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, C.SentenceChunker())


@query(f"""
WITH RECURSIVE {recursive_sql(500)},
n AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS i FROM leaves)
SELECT doc_id || '::chunk_' || i AS chunk_id, doc_id::VARCHAR AS doc_id, i::INT AS chunk_index, piece AS content FROM n""")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, C.RecursiveChunker())


_STATS = f"""
f AS (SELECT lang, length(substring(text, i * 150 + 1, 200)) AS n FROM (SELECT lang, text, unnest(range(0, greatest(0, ceil((length(text) - 200) / 150.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)),
s AS (SELECT lang, {_SENTENCES} AS s FROM documents),
g AS (SELECT lang, s, unnest(range(0, ceil(len(s) / 3.0)::BIGINT)) AS i FROM s WHERE len(s) > 0),
x AS (SELECT lang, 'fixed_size' AS strategy, n FROM f UNION ALL SELECT lang, 'by_sentences', length(array_to_string(s[i * 3 + 1 : i * 3 + 3], ' ')) FROM g)"""


@query(f"WITH {_STATS} SELECT lang, strategy, count(*) AS count, round(avg(n), 6) AS avg_length FROM x GROUP BY ALL")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    found = C.compare_strategies(docs, 200, "text", ["lang"], strategies=("fixed_size", "by_sentences"))
    return found.select("lang", "strategy", "count", F.round("avg_length", 6).alias("avg_length"))


@query(f"""
WITH RECURSIVE {_STATS}, {recursive_sql(200, keep="lang")}, y AS (SELECT * FROM x UNION ALL SELECT lang, 'recursive', length(piece) FROM leaves)
SELECT lang, strategy, count(*) AS count, round(avg(n), 6) AS avg_length FROM y GROUP BY ALL""")
def chunk_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.compare_strategies(table(spark, sf_dir, "documents").select("lang", "text"), 200, "text", ["lang"])
    return found.select("lang", "strategy", "count", F.round("avg_length", 6).alias("avg_length"))


@query(rf"""
WITH {EXTRACTED}, p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, E' \n\t')), lambda x: x <> '') AS p FROM extracted)
SELECT page_id, (i - 1)::INT AS paragraph, p[i] AS text FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)""")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(spark, sf_dir).select("page_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph", "text"))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one section of its source, its language the slug."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("source_id"), F.col("lang").alias("procedure_slug"),
        F.upper("lang").alias("procedure_title"), F.lit(0).alias("section_index"), "text",
    )


def baseline_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.baseline_chunk_sections(document_sections(spark, sf_dir))


def preset_chunks(spark: SparkSession, sf_dir: str, chunker: str) -> DataFrame:
    """Chunks of the documents as a preset's chunker cuts them."""
    if chunker == "fixed_size":
        return baseline_chunks(spark, sf_dir)
    return C.chunk_sections(document_sections(spark, sf_dir), C.make_chunker(chunker))


_ID = "source || '-' || doc_id || '::' || lang || '::baseline_' || CASE WHEN {0} < 1000 THEN lpad(({0})::VARCHAR, 3, '0') ELSE ({0})::VARCHAR END"
BASELINE = f"""
cut AS (SELECT *, ceil(greatest(0, length(text) - 500) / 450.0)::BIGINT AS last, {FIXED} FROM documents WHERE length(text) > 0),
chunks AS (SELECT {_ID.format('chunk_index')} AS chunk_id, substring(text, chunk_index * 450 + 1, 500) AS raw_text, source || '-' || doc_id AS source_id, lang AS procedure_slug,
  chunk_index::INT AS chunk_index, CASE WHEN chunk_index > 0 THEN {_ID.format('chunk_index - 1')} END AS previous_chunk_id, CASE WHEN chunk_index < last THEN {_ID.format('chunk_index + 1')} END AS next_chunk_id FROM cut)"""


@query(f"WITH {BASELINE} SELECT chunk_id, raw_text, source_id, procedure_slug, upper(procedure_slug) AS procedure_title, chunk_index, previous_chunk_id, next_chunk_id, sha256(raw_text)[1:16] AS content_hash FROM chunks")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_chunks(spark, sf_dir).select(
        "chunk_id", "raw_text", "source_id", "procedure_slug", "procedure_title", "chunk_index", "previous_chunk_id", "next_chunk_id", "content_hash"
    )


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_texts(spark, sf_dir)
    return pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source_id"), F.regexp_extract("url", "^[^:]+://[^/]*/([a-z]+)/", 1).alias("procedure_slug"),
        F.col("title").alias("procedure_title"), F.lit(0).alias("section_index"), "text",
    )


def structured_sql(source: str, target: int, most: int, overlap: int) -> str:
    """CTEs from source (source_id, procedure_slug, procedure_title, text) up to packed (…, units VARCHAR[][]): one fold packs the units of a text,
    another takes the overlap of each chunk from the one before. Of the kinds of units 0 is packed, 1 is a chunk alone, 2 only ends a chunk."""
    words = 1
    while max(1, round(words * 1.5)) < most:
        words += 1
    state = "'chunks': {}, 'held': {}, 'tokens': {}"

    def unit(u: str, n: str, kind: int) -> str:
        return f"{{'u': {u}, 'n': {n}, 'kind': {kind}, " + state.format("[]::VARCHAR[][]", "[]::VARCHAR[]", "0") + "}"

    def after(chunks: str, held: str, tokens: str) -> str:
        return "{'u': '', 'n': 0, 'kind': 0, " + state.format(chunks, held, tokens) + "}"

    def alone(u: str) -> str:
        w = WORDS.format(u)
        return f"list_transform(range(0, ceil(len({w}) / {words}.0)::BIGINT), lambda k: {unit(f"array_to_string(({w})[k * {words} + 1 : k * {words} + {words}], ' ')", '0', 1)})"

    def sentences(u: str) -> str:
        return _SENTENCES.replace("trim(text,", f"trim({u},")

    full = f"len(a.held) > 0 AND (x.kind > 0 OR a.tokens + x.n > {most})"
    chunks, held, tokens = f"CASE WHEN {full} THEN list_append(a.chunks, a.held) ELSE a.chunks END", f"list_append(CASE WHEN {full} THEN [] ELSE a.held END, x.u)", f"CASE WHEN {full} THEN 0 ELSE a.tokens END + x.n"
    size = ESTIMATE.format("u")
    by_sentence = f"""list_concat([{unit("''", "0", 2)}], list_concat(flatten(list_transform(s, lambda u: CASE WHEN {size} <= {most} THEN [{unit('u', size, 0)}] ELSE {alone('u')} END)), [{unit("''", "0", 2)}]))"""
    return rf"""
paragraphs AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, E' \n\t')), lambda x: x <> '') AS p FROM {source}),
each_p AS (SELECT source_id, unnest(range(1, len(p) + 1)) AS i, p FROM paragraphs),
cut_p AS (SELECT source_id, i, u, {sentences('u')} AS s FROM (SELECT source_id, i, p[i] AS u FROM each_p)),
units_p AS (SELECT source_id, i, CASE WHEN {size} <= {most} THEN [{unit('u', size, 0)}] WHEN len(s) > 1 THEN {by_sentence} ELSE {alone('u')} END AS units FROM cut_p),
all_units AS (SELECT source_id, flatten(list(units ORDER BY i)) AS units FROM units_p GROUP BY source_id),
folded AS (SELECT source_id, list_reduce(list_prepend({unit("''", "0", 2)}, units), lambda a, x:
    CASE x.kind WHEN 2 THEN {after(chunks, "[]::VARCHAR[]", "0")} WHEN 1 THEN {after(f"list_append({chunks}, [x.u])", "[]::VARCHAR[]", "0")}
      ELSE CASE WHEN {tokens} >= {target} THEN {after(f"list_append({chunks}, {held})", "[]::VARCHAR[]", "0")} ELSE {after(chunks, held, tokens)} END END) AS f FROM all_units),
whole AS (SELECT source_id, CASE WHEN len(f.held) > 0 THEN list_append(f.chunks, f.held) ELSE f.chunks END AS c FROM folded),
taken AS (SELECT source_id, c, list_transform(c, lambda own: list_reduce(
    list_prepend({{'n': 0, 'at': 0, 'total': 0, 'done': false}}, list_reverse(list_transform(own, lambda u: {{'n': {size}, 'at': 0, 'total': 0, 'done': false}}))),
    lambda a, x: CASE WHEN a.done OR a.total >= {overlap} OR (a.at > 0 AND a.total + x.n > {overlap}) THEN {{'n': 0, 'at': a.at, 'total': a.total, 'done': true}}
      ELSE {{'n': 0, 'at': a.at + 1, 'total': a.total + x.n, 'done': false}} END).at) AS k FROM whole),
packed AS (SELECT s.*, list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i = 1 THEN c[1] ELSE list_concat(c[i - 1][len(c[i - 1]) - k[i - 1] + 1 :], c[i]) END) AS units
  FROM taken JOIN {source} s USING (source_id))"""


_CHUNK = "source_id || '::' || procedure_slug || '::chunk_' || CASE WHEN {0} < 1000 THEN lpad(({0})::VARCHAR, 3, '0') ELSE ({0})::VARCHAR END"


def structured_chunks_sql(source: str, target: int, most: int, overlap: int, name: str = "chunks") -> str:
    """CTEs up to chunks, the linked structure-aware chunks of source."""
    return f"""{structured_sql(source, target, most, overlap)},
{name} AS (SELECT {_CHUNK.format('i')} AS chunk_id, array_to_string(units[i + 1], chr(10) || chr(10)) AS raw_text, source_id, procedure_slug, procedure_title, i::INT AS chunk_index,
  CASE WHEN i > 0 THEN {_CHUNK.format('i - 1')} END AS previous_chunk_id, CASE WHEN i + 1 < len(units) THEN {_CHUNK.format('i + 1')} END AS next_chunk_id
  FROM (SELECT *, unnest(range(0, len(units))) AS i FROM packed))"""


@query(f"""
WITH {EXTRACTED},
src AS (SELECT 'page-' || page_id AS source_id, regexp_extract(url, '^[^:]+://[^/]*/([a-z]+)/', 1) AS procedure_slug, title AS procedure_title, text FROM extracted),
{structured_chunks_sql('src', 60, 90, 15)}
SELECT chunk_id, 'Tài liệu: pages' || chr(10) || 'Quy trình: ' || procedure_title || chr(10) || chr(10) || raw_text AS text, raw_text, source_id, procedure_slug, procedure_title,
  0 AS section_index, chunk_index, previous_chunk_id, next_chunk_id, sha256(raw_text)[1:16] AS content_hash, {ESTIMATE.format('raw_text')} AS token_count FROM chunks""")
def chunk_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure-aware chunks of all pages, bounds low enough for long paragraphs to be cut."""
    return C.chunk_sections(page_sections(spark, sf_dir), C.StructureChunker(60, 90, 15), "pages")


@query(f"WITH {EXTRACTED} SELECT page_id, len({WORDS.format('text')}) AS n_words, md5(array_to_string({WORDS.format('text')}, ' ')) AS digest, {ESTIMATE.format('text')} AS tokens FROM extracted")
def chunk_structured_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks without overlap, put together again, have the words of the page in order."""
    pages = page_texts(spark, sf_dir)
    units = C.StructureChunker(60, 90, 15).units(F.col("text"), overlap=False)
    whole = pages.select("page_id", T.split_words(F.array_join(F.flatten(units), " ")).alias("w"))
    return whole.select(
        "page_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"),
        T.token_estimate(F.array_join("w", " ")).alias("tokens"),
    )


#: The documents cut by the structure-aware chunker as it is by default.
STRUCTURED = f"""
src AS (SELECT source || '-' || doc_id AS source_id, lang AS procedure_slug, upper(lang) AS procedure_title, text FROM documents),
{structured_chunks_sql('src', 450, 650, 80)}"""

ANCHORS = [{"slug": "name", "title": "Name", "anchor": "<title>"}, {"slug": "body", "title": "Body", "anchor": "<body>"}, {"slug": "article", "anchor": "<article>"}]


@query(r"""
WITH a AS (SELECT page_id, html, strpos(html, '<title>') AS s1 FROM pages),
b AS (SELECT *, s1 + strpos(substring(html, s1 + 1), '<body>') AS s2 FROM a),
c AS (SELECT *, s2 + strpos(substring(html, s2 + 1), '<article>') AS s3 FROM b),
x AS (SELECT page_id, 'name' AS procedure_slug, 'Name' AS procedure_title, 0 AS section_index, s1 AS start, substring(html, s1, s2 - s1) AS t FROM c
  UNION ALL SELECT page_id, 'body', 'Body', 1, s2, substring(html, s2, s3 - s2) FROM c
  UNION ALL SELECT page_id, 'article', 'article', 2, s3, substring(html, s3) FROM c)
SELECT page_id, procedure_slug, procedure_title, section_index::INT AS section_index, start::INT AS start, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM x""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_sections(table(spark, sf_dir, "pages").select("page_id", "html"), ANCHORS, "html")
