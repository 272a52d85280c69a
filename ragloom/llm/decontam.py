"""Operator 10: benchmark decontamination with an FM-index per training shard.

Test phrases are the runs of ``PHRASE`` words of each benchmark item (a shorter item
of at least ``LEAST`` words is one phrase). A shard is an Arrow batch of documents. Words
that no phrase holds cannot be in a match, so only runs of phrase words that are
as long as the shortest phrase are indexed; the rest of the text is read, and
that loses no match. The index is the Burrows-Wheeler transform in a wavelet
matrix, searched backward for all phrases at once by ranks; occurrences are located by
stepping to the next sampled suffix position. Occurrences that overlap or lie within
``GAP`` words of each other merge into one removal span. Nothing is shuffled.

Words are compared without case and punctuation (see ``kernel``, also for scripts without spaces).

Defined results: null and empty texts and items have no spans, and a null text stays null; an item of fewer than ``LEAST`` words
has no phrase, as such words stand in clean texts too; equal items count once;
repeated rows have the same spans each; a very long text is a shard of its own and searched whole; without phrases nothing is found; an empty
table gives no rows; other columns are ignored by ``contaminated_spans`` and carried by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import kernel as K

PHRASE, LEAST, GAP, SAMPLE = 13, 8, 13, 8
#: Phrases broadcast at once (some 100 bytes each); more are searched in several passes.
PHRASES_AT_ONCE = 500_000


class Phrases(NamedTuple):
    """Distinct phrases: words by hash in order, and a padded matrix of symbols from 2 on, last word in the last column."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    maybe: np.ndarray


def phrases(texts: list[str], size: int = PHRASE, least: int = LEAST) -> Phrases:
    w = K.words(K.strings(pa.array(texts, pa.string())))
    seen: dict[tuple[int, ...], None] = {}
    for i in range(len(texts)):
        h = w.hash[w.offsets[i] : w.offsets[i + 1]].tolist()
        if len(h) < size:
            if len(h) >= least:
                seen[tuple(h)] = None
        else:
            for k in range(len(h) - size + 1):
                seen[tuple(h[k : k + size])] = None
    return _packed(list(seen), size)


def _packed(found: list[tuple[int, ...]], size: int) -> Phrases:
    vocabulary = np.unique(np.array([x for p in found for x in p], np.uint64))
    symbols = np.zeros((len(found), size), np.int64)
    for i, p in enumerate(found):
        symbols[i, size - len(p) :] = np.searchsorted(vocabulary, np.array(p, np.uint64)) + 2
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    return Phrases(vocabulary, symbols, np.array([len(p) for p in found], np.int64), maybe)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: ranks of 1, 2, 4, ... symbols until all differ."""
    n = len(t)
    _, rank = np.unique(t, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)]))
        rank, step = new, step * 2
        if rank.max() == n - 1:
            return order


class FMIndex:
    """Index of a text of symbols 1.. (1 separates documents); 0 is put at its end."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        t = np.append(text, 0)
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.n, sigma = len(t), int(t.max()) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        self.levels = []  # bit, ones before each place, zeros in all
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            b = (bwt >> bit) & 1
            ones = np.concatenate([[0], np.cumsum(b)])
            self.levels.append((bit, b, ones, self.n - int(ones[-1])))
            bwt = np.concatenate([bwt[b == 0], bwt[b == 1]])
        marked = sa % sample == 0
        self.marked, self.before, self.samples = marked, np.concatenate([[0], np.cumsum(marked)]), sa[marked]

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """less(c) + rank(c, i): where suffixes from c on begin, of those that have i rows before."""
        lo, hi = np.zeros_like(i), i
        for bit, _, ones, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return self.less[c] + hi - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for bit, b, ones, zeros in self.levels:
            one = b[i]
            c |= one << bit
            i = np.where(one == 1, zeros + ones[i], i - ones[i])
        return c

    def find(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place in the text) of every occurrence of every phrase."""
        width = symbols.shape[1]
        which = np.arange(len(symbols))
        lo, hi = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.n, np.int64)
        done_which, done_lo, done_hi = [], [], []
        for k in range(width - 1, -2, -1):
            ended = lengths[which] == width - 1 - k
            done_which.append(which[ended])
            done_lo.append(lo[ended])
            done_hi.append(hi[ended])
            if k < 0:
                break
            which, lo, hi = which[~ended], lo[~ended], hi[~ended]
            c = symbols[which, k]
            known = c < len(self.less) - 1
            which, lo, hi, c = which[known], lo[known], hi[known], c[known]
            lo, hi = self.step(c, lo), self.step(c, hi)
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
        which, lo, hi = np.concatenate(done_which), np.concatenate(done_lo), np.concatenate(done_hi)
        n = hi - lo
        which = np.repeat(which, n)
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        steps, place = np.zeros(len(row), np.int64), np.full(len(row), -1, np.int64)
        walk = np.arange(len(row))
        while len(walk):
            at = row[walk]
            hit = self.marked[at]
            place[walk[hit]] = self.samples[self.before[at[hit]]] + steps[walk[hit]]
            walk = walk[~hit]
            row[walk] = self.step(self.symbol(row[walk]), row[walk])
            steps[walk] += 1
        return which, place


def occurrences(w: K.Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of every occurrence of a phrase in the texts of a shard."""
    none = np.zeros(0, np.int64)
    if not len(p.lengths) or not len(w.hash):
        return none, none
    likely = np.flatnonzero(p.maybe[(w.hash >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(p.vocabulary, w.hash[likely]), len(p.vocabulary) - 1)
    exact = p.vocabulary[at] == w.hash[likely]
    where, symbol = likely[exact], at[exact] + 2
    if not len(where):
        return none, none
    new = np.concatenate([[True], (np.diff(where) != 1) | (np.diff(w.doc[where]) != 0)])
    run = np.cumsum(new) - 1
    long_run = np.bincount(run) >= p.lengths.min()
    kept = long_run[run]
    where, symbol, run = where[kept], symbol[kept], run[kept]
    if not len(where):
        return none, none
    place = np.arange(len(where)) + np.concatenate([[0], np.cumsum(np.diff(run) != 0)])  # a separator between runs
    text = np.ones(place[-1] + 1, np.int64)
    text[place] = symbol
    origin = np.zeros(len(text), np.int64)
    origin[place] = where
    which, found = FMIndex(text).find(p.symbols, p.lengths)
    return origin[found], p.lengths[which]


def merged(w: K.Words, start: np.ndarray, size: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end word) of the merged spans of a shard; none crosses from text to text."""
    if not len(start):
        return start, start
    shift = w.doc[start] * (gap + 1)  # texts are put further apart than what merges
    s, e = K.merge(start + shift, start + size + shift, gap)
    shift = np.sort(shift)[np.searchsorted(np.sort(start + shift), s)]
    return s - shift, e - shift


def _passes(docs: DataFrame, benchmark: DataFrame, at_once: int) -> list[Broadcast]:
    """The phrases, in broadcast parts of checked size."""
    texts = [r[0] for r in benchmark.select("text").where("text is not null").toLocalIterator()]
    p = phrases(texts)
    words = [tuple(p.vocabulary[s[PHRASE - n :] - 2].tolist()) for s, n in zip(p.symbols, p.lengths, strict=True)] if len(p.lengths) > at_once else []
    parts = [_packed(words[i : i + at_once], PHRASE) for i in range(0, len(words), at_once)] or [p]
    return [docs.sparkSession.sparkContext.broadcast(x) for x in parts]


def _found(text: pa.Array, shared: list[Broadcast]) -> Iterator[tuple[int, K.Words, np.ndarray, np.ndarray]]:
    """By chunk of a shard: first row, words, spans."""
    for at, part in K.chunks(text):
        w = K.words(part)
        each = [occurrences(w, x.value) for x in shared]
        start, size = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
        yield at, w, *merged(w, start, size)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, at_once: int = PHRASES_AT_ONCE) -> DataFrame:
    """(doc_id, first_word, n_words) of every merged removal span; words count from 0."""
    shared = _passes(docs, benchmark, at_once)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w, s, e in _found(K.strings(batch.column(1)), shared):
                if len(s):
                    row = w.doc[s]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row + at)), pa.array(s - w.offsets[row]), pa.array(e - s)],
                        ["doc_id", "first_word", "n_words"],
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        search, "doc_id long, first_word long, n_words long"
    )


def cut_spans(text: pa.Array, at: int, w: K.Words, s: np.ndarray, e: np.ndarray, out: list) -> None:
    """Writes to out the texts of the chunk from row ``at`` that have word spans [s, e), without them. A span is cut up to the word after it."""
    row = w.doc[s]
    for lo, hi in K.runs(row):
        i = int(row[lo])
        data = text[at + i].as_py().encode()
        base = _text_start(text, at, i)
        begin = w.start[s[lo:hi]] - base
        last = w.offsets[i + 1]
        end = np.where(e[lo:hi] < last, w.start[np.minimum(e[lo:hi], len(w.start) - 1)] - base, len(data))
        out[at + i] = K.cut(data, begin, end)


def _text_start(text: pa.Array, at: int, i: int) -> int:
    off = np.frombuffer(text.buffers()[1], np.int64)
    return int(off[text.offset + at + i] - off[text.offset + at])


def decontaminate(docs: DataFrame, benchmark: DataFrame, at_once: int = PHRASES_AT_ONCE) -> DataFrame:
    """docs with the spans cut from text (and n_chars, where docs has it, counted again); all rows and columns stay."""
    shared = _passes(docs, benchmark, at_once)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        text = K.strings(column)
        out: dict[int, str] = {}
        for at, w, s, e in _found(text, shared):
            if len(s):
                cut_spans(text, at, w, s, e, out)
        if not out:
            return column
        return pa.array([out.get(i, x) for i, x in enumerate(column.to_pylist())], pa.string())

    cleaned = docs.withColumn("text", clean("text"))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
