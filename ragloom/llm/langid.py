"""Operator 7: language identification by nearest centroid.

A text is the hashed counts of its letter 3-grams (bytes of folded text, runs of
other characters as one space), weighted by inverse document frequency over all
documents and scaled to length one. Each language has several centroids, found by
spherical k-means on at most ``PER_LANGUAGE`` labelled documents, of each at most ``SAMPLE_CHARS`` characters from its middle (the one bounded
sample here; it is drawn by hash from all sources). Documents to be classified are read whole. The nearest centroid by cosine
gives the language. A text is rejected if its cosine is lower than all but a share
``REJECT`` of those that pieces of its length, cut from the sample, have; a length with
fewer than ``ENOUGH`` pieces takes those of the next shorter lengths in as well.

Defined results: a text without letters (null, empty, only signs or digits) has
language null, similarity 0 and is rejected; ties go to the first language in order
of name; without labelled rows every text is rejected; repeated rows get the same answer; a very long text is counted whole; an empty
table gives no rows; other columns are ignored by ``identify`` and carried by ``keep_identified``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm import kernel as K

SIZE = 4096
PER_LANGUAGE, CENTROIDS, REJECT, ENOUGH = 600, 3, 0.005, 20
SAMPLE_CHARS = 262_144
_ROWS = 256


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    least: np.ndarray


def gram_codes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every letter 3-gram; a text begins and ends with a space."""
    b, off = K.raw(arr)
    low = K.fold(b)
    letter = K.word_mask(low) & ~((low >= 48) & (low <= 57))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a word stands for all up to the next
    at = np.flatnonzero(keep)
    row = np.searchsorted(off, at, side="right") - 1
    seq = np.where(letter[at], low[at], 32)
    # A space before and after each text.
    first = np.searchsorted(row, np.arange(len(arr)))
    where = np.repeat(first, 2)
    seq = np.insert(seq, where, 32)
    row = np.insert(row, where, np.repeat(np.arange(len(arr)), 2) - np.tile([1, 0], len(arr)))
    if len(seq) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = seq[:-2].astype(np.uint64) | (seq[1:-1].astype(np.uint64) << np.uint64(8)) | (seq[2:].astype(np.uint64) << np.uint64(16))
    inside = (row[:-2] == row[2:]) & (seq[1:-1] != 32)
    feature = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
    return row[:-2][inside], feature[inside]


def counts(arr: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of each feature by row) of some rows at a time."""
    for at, part in K.chunks(arr):
        for lo in range(0, len(part), _ROWS):
            few = part.slice(lo, _ROWS)
            row, feature = gram_codes(few)
            yield at + lo, np.bincount(row * SIZE + feature, minlength=len(few) * SIZE).reshape(len(few), SIZE).astype(np.float32)


def gram_document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and all documents; each task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            total[SIZE] += batch.num_rows
            for _, c in counts(K.strings(batch.column(0))):
                total[:SIZE] += (c > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(total)], ["feature", "part"])

    rows = docs.select("text").mapInArrow(count, "feature long, part long").groupBy("feature").agg(F.sum("part")).collect()
    df = np.zeros(SIZE + 1, np.int64)
    for feature, n in rows:
        df[feature] = n
    return df[:SIZE], int(df[SIZE])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from the mean's nearest row and then the rows furthest from those chosen."""
    chosen = [int(np.argmax(x @ _unit(x.mean(0))))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = _unit(np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def sample_labelled(docs: DataFrame, per_language: int, lang: str = "lang") -> list[tuple[str, str]]:
    """The per_language distinct labelled texts of every language that have the least hashes, all if there are fewer; of longer texts the middle."""
    named = docs.where(F.col(lang).isNotNull() & (F.length("text") > 0)).select(F.col(lang).alias("lang"), F.xxhash64("text").alias("h"), "text")
    total = {r[0]: r[1] for r in named.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect()}
    if not total:
        return []
    # Hashes up to a bound that leaves twice as many as needed; a window then takes the least ones exactly.
    bound = F.lit((1 << 63) - 1)
    for name, n in total.items():
        if n > 2 * per_language + 100:
            bound = F.when(F.col("lang") == name, F.lit(int((2 * per_language + 100) / n * 2**64) - 2**63)).otherwise(bound)
    least = named.where(F.col("h") <= bound).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    middle = F.substring("text", F.greatest(F.lit(1), ((F.length("text") - SAMPLE_CHARS) / 2).cast("int")), F.lit(SAMPLE_CHARS))
    rows = least.withColumn("place", place).where(F.col("place") <= per_language).select("h", "lang", middle.alias("text")).collect()
    return [(r.lang, r.text) for r in sorted(rows)]


def fit(labelled: list[tuple[str, str]], df: np.ndarray, n_docs: int, k: int = CENTROIDS, reject: float = REJECT) -> Model:
    idf = (np.log((1 + n_docs) / (1 + df)) + 1e-3).astype(np.float32)
    names = sorted({name for name, _ in labelled})

    def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [c for _, c in counts(K.strings(pa.array(texts, pa.string())))]
        x = np.concatenate(parts) if parts else np.zeros((0, SIZE), np.float32)
        return _unit(x * idf), x.sum(1)

    x, n = vectors([t for _, t in labelled])
    own = np.array([names.index(name) for name, _ in labelled], np.int64)
    centroids, language_of = [], []
    for j in range(len(names)):
        mine = x[(own == j) & (n > 0)]
        if len(mine):
            c = k_means(mine, k)
            centroids.append(c)
            language_of += [j] * len(c)
    centroids = np.concatenate(centroids) if centroids else np.zeros((0, SIZE), np.float32)
    # The cosine that pieces of each length have, 2 letters and up; short texts are far from any centroid.
    least = np.zeros(64)
    pieces = [t[(len(t) * 7) // 13 % max(1, len(t) - size) :][:size] for _, t in labelled for size in (2 << s for s in range(14)) if size <= len(t)]
    if pieces and len(centroids):
        best, size = [], []
        for lo in range(0, len(pieces), 2000):
            px, pn = vectors(pieces[lo : lo + 2000])
            best.append((px @ centroids.T).max(1))
            size.append(_length_class(pn))
        best, size = np.concatenate(best), np.concatenate(size)
        for c in range(64):
            near = np.where(size > c, 64 + size, c - size)  # own length, then shorter ones, then longer ones
            reach = np.sort(near)[min(ENOUGH, len(near)) - 1]
            least[c] = np.quantile(best[near <= reach], reject, method="lower") - 1e-5  # sums differ by batch
    return Model(names, idf, centroids, np.array(language_of, np.int64), least)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS, reject: float = REJECT) -> Model:
    df, n = gram_document_frequency(docs)
    return fit(sample_labelled(docs, per_language), df, n, k, reject)


def classify(text: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of language or -1, cosine, accepted) of each text."""
    n = len(text)
    which, cosine, accepted = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n, bool)
    if not len(model.centroids):
        return which, cosine, accepted
    for at, c in counts(text):
        size = c.sum(1)
        x = c * model.idf
        near = (x @ model.centroids.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        j = np.argmax(near, 1)
        rows = slice(at, at + len(c))
        cosine[rows] = np.where(size > 0, near[np.arange(len(c)), j], 0)
        which[rows] = np.where(size > 0, model.language_of[j], -1)
        accepted[rows] = (size > 0) & (cosine[rows] >= model.least[_length_class(size)])
    return which, cosine, accepted


def _answers(text: pa.Array, model: Model) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    which, cosine, accepted = classify(text, model)
    names = pa.array([*model.languages, None], pa.string())
    return names.take(pa.array(np.where(which < 0, len(model.languages), which))), cosine, accepted


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, similarity, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, cosine, accepted = _answers(K.strings(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), name, pa.array(np.round(cosine, 6)), pa.array(accepted)],
                ["doc_id", "language", "similarity", "accepted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, language string, similarity double, accepted boolean"
    )


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without those that are rejected; lang becomes the language found. The columns are those of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    @F.arrow_udf("string")
    def language(text: pa.Array) -> pa.Array:
        name, _, accepted = _answers(K.strings(text), shared.value)
        return pa.array([x if ok else None for x, ok in zip(name.to_pylist(), accepted.tolist(), strict=True)], pa.string())

    return docs.withColumn("lang", language.asNondeterministic()("text")).where(F.col("lang").isNotNull())
