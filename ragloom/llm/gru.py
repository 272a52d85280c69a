"""Operator 5: log-likelihood of whole documents under a gated recurrent language model.

The vocabulary grows with the corpus: every word that occurs ``MIN_COUNT`` times in all documents, the
``VOCABULARY`` most frequent ones if there are more. The ``LEARNED`` most frequent are symbols of their own; the others
fall into ``BANDS`` by frequency, a symbol each, and their probability is that of the band times their share of its
occurrences. Any other word is spelled: its probability is that of the symbol ``unknown`` times those of its
bytes (case folded), each given the one before, and of its end, counted over every such word
of the corpus. So every word of a text bears on its likelihood. Symbols fall into classes of about equal frequency (frequent ones alone), and
P(symbol) = P(class) P(symbol | class), so a step costs some dozens of outputs instead of all. The model is a
gated recurrent unit in numpy, trained by backpropagation truncated to windows of ``WINDOW``
words over every document of the corpus: in each of ``ROUNDS`` every task starts from the
shared weights, learns from its part of the round's documents and hands its weights back; they are averaged in proportion
to words, in a tree, so neither driver nor task ever holds more than a few dozen sets. The rounds
part the documents by a hash of the text, and together cover all of them once.

A document runs in one lane of a batch from its first word to its last, the state going from
window to window and starting anew with each document, so its log-likelihood is that of the whole text. Lanes
are read window by window from one run of symbols, so a very long text takes the memory of its own symbols and no more.

Texts are read twice, for the counts and for the symbols; what follows reads the written symbols.

Defined results: a null or empty text has 0 words, log-likelihood 0 and no mean; repeated rows get
equal scores; words of equal count are in order of their hash; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import kernel as K
from ragloom.llm.common import checkpointed

VOCABULARY, MIN_COUNT, LEARNED, BANDS = 1_000_000, 2, 2048, 12
CLASSES, HIDDEN, WINDOW, LANES = 48, 32, 32, 256
#: Shares of the documents in each round of training; averaging early keeps the tasks' later steps alike.
ROUNDS = (0.15, 0.35, 0.5)
RATE = 0.1
#: Words that a step of learning sees at least; where few lanes are left, windows add up their gradients.
STEP_WORDS = 2048
#: Words that are packed into lanes together (a longer text is a batch of its own).
BATCH_WORDS = 2_000_000
FAN_IN = 32
#: Bound of a score before the exponential; weights of a trained model stay far below it.
_MOST = np.float32(60)
_END = 255  # ends a spelled word; no byte of UTF-8
_ENCODED = "doc_id long, share int, n_words long, ids binary, extra double, rest binary"


class Vocabulary(NamedTuple):
    """Words by hash (sorted), the symbol and the log-share of its symbol of each, and for each symbol its class and the symbols of classes (end of each).

    Symbols are in order of class. Symbol ``unknown`` stands for words outside; len(class_of) begins a document. slots: where the words of each
    leading 20 bits begin.
    """

    words: np.ndarray
    symbols: np.ndarray
    extra: np.ndarray
    unknown: int
    class_of: np.ndarray
    class_end: np.ndarray
    slots: np.ndarray

    @property
    def size(self) -> int:
        return len(self.class_of)


def unknown_bytes(text: pa.Array, w: K.Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of words ``rows``, each with ``_END`` after it, and how many of each text."""
    low = K.fold(K.raw(text)[0])
    size = w.end[rows] - w.start[rows] + 1
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(w.start[rows] - first, size)
    byte = low[np.minimum(at, max(0, len(low) - 1))] if len(low) else np.zeros(0, np.uint8)
    byte[first + size - 1] = _END
    return byte, np.bincount(w.doc[rows], size, len(text)).astype(np.int64)


def byte_pairs(rest: np.ndarray) -> np.ndarray:
    """Each byte and the one before, as 257 * before + byte; 256 stands before the first byte of a word and after the last."""
    code = rest.astype(np.int64)
    code[code == _END] = 256
    return np.concatenate([[256], code[:-1]])[: len(code)] * 257 + code


def spelling_counts(encoded: DataFrame) -> np.ndarray:
    """How often each pair of bytes occurs in the words outside the vocabulary, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257 * 257, np.int64)
        for batch in batches:
            total += np.bincount(byte_pairs(_flat(batch.column(0), np.uint8)[0]), minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "part"])

    out = np.zeros(257 * 257, np.int64)
    for pair, n in encoded.select("rest").mapInArrow(count, "pair long, part long").groupBy("pair").agg(F.sum("part")).collect():
        out[pair] = n
    return out


def spelling(pairs: np.ndarray) -> np.ndarray:
    """Log-probability of each byte after each other: counts smoothed by those of the byte alone, and these by one."""
    n = pairs.reshape(257, 257).astype(float)
    alone = (n.sum(0) + 1) / (n.sum() + 257)
    return np.log((n + alone) / (n.sum(1, keepdims=True) + 1)).astype(np.float32).reshape(-1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def settle() -> None:
            nonlocal words, n, total
            new, times = np.unique(np.concatenate(held), return_counts=True)
            words, where = np.unique(np.concatenate([words, new]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, times]), len(words)).astype(np.int64)
            held.clear()
            total = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "part"])

        for batch in batches:
            for _, part in K.chunks(K.strings(batch.column(0))):
                h = K.words(part).hash
                held.append(h)
                total += len(h)
                if total > 1_500_000:
                    settle()
                    if len(words) > 1_000_000:
                        yield out()
                        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if held:
            settle()
        yield out()

    return docs.select("text").mapInArrow(count, "word long, part long").groupBy("word").agg(F.sum("part").alias("n"))


def make_vocabulary(
    words: np.ndarray, n: np.ndarray, all_words: int, classes: int = CLASSES, learned: int = LEARNED, bands: int = BANDS
) -> Vocabulary:
    """words: hashes of the words kept, n: how often each occurs. Classes are runs of symbols in order of frequency with about equal sums."""
    words = words.astype(np.int64).view(np.uint64)
    order = np.lexsort((words, -n))
    words, n = words[order], n[order].astype(float)
    rest = n[learned:]
    band = np.minimum(bands - 1, ((np.cumsum(rest) - rest / 2) / max(1.0, rest.sum()) * bands)).astype(np.int64)
    _, band = np.unique(band, return_inverse=True)
    in_band = np.bincount(band, rest) if len(rest) else np.zeros(0)
    each = np.concatenate([n[:learned], in_band, [max(1.0, all_words - n.sum())]])
    place_of = np.argsort(-each, kind="stable")
    target = each.sum() / classes
    class_of_place, now, left, todo = [], 0, 0.0, each.sum()
    for i, place in enumerate(place_of):
        if left and left + each[place] / 2 > target and now < classes - 1:
            now, left = now + 1, 0.0
            target = todo / (classes - now)
        class_of_place.append(now)
        left += each[place]
        todo -= each[place]
    class_of = np.array(class_of_place, np.int64)
    symbol = np.empty(len(each), np.int16)
    symbol[place_of] = np.arange(len(each))
    head = min(learned, len(n))
    own = np.concatenate([symbol[:head], symbol[head + band]])
    extra = np.concatenate([np.zeros(head), np.log(rest / in_band[band])]).astype(np.float32)
    by = np.argsort(words)
    end = np.searchsorted(class_of, np.arange(class_of[-1] + 1), side="right")
    slots = np.searchsorted(words[by] >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
    return Vocabulary(words[by], own[by], extra[by], int(symbol[-1]), class_of, end, slots)


def symbols_of(h: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each word, and the logarithm of its share of the symbol."""
    out, extra = np.full(len(h), v.unknown, np.int16), np.zeros(len(h), np.float32)
    slot = (h >> np.uint64(44)).astype(np.int64)
    at, end = v.slots[slot], v.slots[slot + 1]
    left = np.flatnonzero(at < end)
    at, end = at[left], end[left]
    while len(left):  # some words share their leading bits
        hit = v.words[at] == h[left]
        out[left[hit]] = v.symbols[at[hit]]
        extra[left[hit]] = v.extra[at[hit]]
        at = at + 1
        on = ~hit & (at < end)
        left, at, end = left[on], at[on], end[on]
    return out, extra


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of size bytes each, from their bytes in a row."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def _flat(arr: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and where each begins."""
    n, size = len(arr), np.dtype(kind).itemsize
    _, offsets, data = arr.buffers()
    if not n or data is None:
        return np.zeros(0, kind), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind), (off - off[0]) // size


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, share, n_words, ids, extra, rest) of every row: its symbols, the log-shares of its words in all, and the bytes of those to be spelled;
    share parts documents by a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for at, part in K.chunks(K.strings(batch.column(2))):
                w = K.words(part)
                n = np.diff(w.offsets)
                ids, extra = symbols_of(w.hash, v)
                rest, size = unknown_bytes(part, w, np.flatnonzero(ids == v.unknown))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(n.astype(np.int64)), _binary(ids, 2 * n),
                        pa.array(np.bincount(w.doc, extra, len(part)).astype(np.float64)), _binary(rest, size),
                    ],
                    ["doc_id", "share", "n_words", "ids", "extra", "rest"],
                )

    share = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 20)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), share.alias("share"), "text").mapInArrow(run, _ENCODED)


class Model:
    """Weights, as views of one flat vector."""

    def __init__(self, v: Vocabulary, hidden: int = HIDDEN, flat: np.ndarray | None = None, spelled: np.ndarray | None = None) -> None:
        self.v, self.h = v, hidden
        self.spelled = spelling(np.zeros(257 * 257)) if spelled is None else spelled
        classes = len(v.class_end)
        shapes = [(v.size + 1, 3 * hidden), (hidden, 3 * hidden), (hidden, classes), (classes,), (hidden, v.size), (v.size,)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            rng = np.random.default_rng(11)
            flat = np.concatenate([
                rng.normal(0, 0.1, sizes[0]), rng.normal(0, hidden**-0.5, sizes[1]), rng.normal(0, 0.1, sizes[2]),
                np.zeros(sizes[3]), rng.normal(0, 0.1, sizes[4]), np.zeros(sizes[5]),
            ]).astype(np.float32)
        self.flat = flat
        at = np.cumsum([0, *sizes])
        self.parts = [flat[a:b].reshape(s) for a, b, s in zip(at[:-1], at[1:], shapes, strict=True)]

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple:
        """States of a window: x, fresh (steps, lanes) are the words read and where documents begin."""
        e, u = self.parts[:2]
        size, steps = self.h, len(x)
        kind = self.flat.dtype
        before = np.empty((steps, *h.shape), kind)
        gates = np.empty((steps, len(h), 2 * size), kind)
        new = np.empty_like(before)
        after = np.empty_like(before)
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * size]), np.ascontiguousarray(u[:, 2 * size :])
        some = fresh.any(1).tolist()
        held = np.empty(h.shape, kind)
        for t in range(steps):
            read = e[x[t]]
            b, g, n, a = before[t], gates[t], new[t], after[t]
            b[:] = h
            if some[t]:
                b[fresh[t]] = 0
            np.matmul(b, u_gates, out=g)
            g += read[:, : 2 * size]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[:, size:], b, out=held)
            np.matmul(held, u_new, out=n)
            n += read[:, 2 * size :]
            n *= -2  # the hyperbolic tangent by way of the exponential, which is the faster
            np.exp(n, out=n)
            n += 1
            np.reciprocal(n, out=n)
            n *= 2
            n -= 1
            np.subtract(n, b, out=a)
            a *= g[:, :size]
            a += b
            h = a
        return before, gates, new, after, h.copy() if steps else h

    def output(self, states: np.ndarray, y: np.ndarray, grad: "Model | None" = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each word y after its state; with grad the gradient of their sum by the states too."""
        _, _, wc, bc, ww, bw = self.parts
        n = len(y)
        rows = np.arange(n)
        order = np.argsort(self.v.class_of[y].astype(np.uint8 if len(self.v.class_end) < 256 else np.int32), kind="stable")  # words of a class lie together
        states, y = states[order], y[order]
        c = self.v.class_of[y]
        logits = states @ wc
        logits += bc
        np.minimum(logits, _MOST, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        log_p = np.log(logits[rows, c])
        back = None
        if grad is not None:
            np.negative(logits, out=logits)
            logits[rows, c] += 1
            grad.parts[2] += states.T @ logits
            grad.parts[3] += logits.sum(0)
            back = logits @ wc.T
        edge = np.searchsorted(c, np.arange(len(self.v.class_end) + 1)).tolist()
        start = 0
        for k, end in enumerate(self.v.class_end.tolist()):
            lo, hi = edge[k], edge[k + 1]
            if end - start > 1 and hi > lo:
                s, w = states[lo:hi], np.ascontiguousarray(ww[:, start:end])
                p = s @ w
                p += bw[start:end]
                np.minimum(p, _MOST, out=p)
                np.exp(p, out=p)
                p /= p.sum(1, keepdims=True)
                own, which = rows[: hi - lo], y[lo:hi] - start
                log_p[lo:hi] += np.log(p[own, which])
                if grad is not None:
                    np.negative(p, out=p)
                    p[own, which] += 1
                    grad.parts[4][:, start:end] += s.T @ p
                    grad.parts[5][start:end] += p.sum(0)
                    back[lo:hi] += p @ w.T
            start = end
        out = np.empty_like(log_p)
        out[order] = log_p
        if back is None:
            return out, None
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return out, unsorted

    def backward(self, x: np.ndarray, fresh: np.ndarray, seen: tuple, d_after: np.ndarray, grad: "Model") -> None:
        """Adds the gradient of a window; d_after: by the states after each step. Nothing flows into the window before."""
        before, gates, new, _, _ = seen
        u = self.parts[1]
        size = self.h
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * size].T), np.ascontiguousarray(u[:, 2 * size :].T)
        # What a step needs that does not depend on the step after it.
        z, r = gates[:, :, :size], gates[:, :, size:]
        keep = 1 - z
        by_update = new - before
        by_update *= z
        by_update *= keep
        by_new = new * new
        np.subtract(1, by_new, out=by_new)
        by_new *= z
        by_reset = 1 - r
        by_reset *= r
        by_reset *= before
        d_in = np.empty((*x.shape, 3 * size), self.flat.dtype)
        flow = np.zeros_like(before[0])
        reset, through = np.empty_like(flow), np.empty_like(flow)
        some = fresh.any(1).tolist()
        for t in range(len(x) - 1, -1, -1):
            flow += d_after[t]
            d = d_in[t]
            dn = d[:, 2 * size :]
            np.multiply(flow, by_new[t], out=dn)
            np.matmul(dn, u_new, out=reset)
            np.multiply(flow, by_update[t], out=d[:, :size])
            np.multiply(reset, by_reset[t], out=d[:, size : 2 * size])
            flow *= keep[t]
            reset *= r[t]
            flow += reset
            np.matmul(d[:, : 2 * size], u_gates, out=through)
            flow += through
            if some[t]:
                flow[fresh[t]] = 0
        flat_in = d_in.reshape(-1, 3 * size)
        h = before.reshape(-1, size)
        grad.parts[1][:, : 2 * size] += h.T @ flat_in[:, : 2 * size]
        grad.parts[1][:, 2 * size :] += (r * before).reshape(-1, size).T @ flat_in[:, 2 * size :]
        ids = x.reshape(-1)
        order = np.argsort(ids.astype(np.int16), kind="stable")
        start = K.run_starts(ids[order])
        grad.parts[0][ids[order][start]] += _run_sums(flat_in[order], start)


def _run_sums(rows: np.ndarray, start: np.ndarray, short: int = 24) -> np.ndarray:
    """Sums of runs of rows: long runs one by one, of the short ones all first rows, all second ones and so on (``np.add.reduceat`` is slow along this axis)."""
    size = np.diff(np.append(start, len(rows)))
    out = rows[start]
    for i in np.flatnonzero(size >= short).tolist():
        out[i] = rows[start[i] : start[i] + size[i]].sum(0)
    few = np.flatnonzero((size < short) & (size > 1))
    few = few[np.argsort(-size[few], kind="stable")]
    at, left = start[few], size[few]
    for k in range(1, int(left.max(initial=1))):
        n = int(np.searchsorted(-left, -k))  # runs longer than k
        out[few[:n]] += rows[at[:n] + k]
    return out


class Lanes(NamedTuple):
    """Documents laid end to end in lanes, longest lane first, and the lanes end to end: words, document, and where it begins; begin: the word before a first one."""

    ids: np.ndarray
    doc: np.ndarray
    fresh: np.ndarray
    start: np.ndarray
    length: np.ndarray
    begin: int

    def window(self, at: int, to: int, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words read, words to come (-1 beyond the end of a lane), beginnings and documents of steps at to to, (steps, lanes) each."""
        step = np.arange(at, to)[:, None]
        inside = step < self.length[None, :lanes]
        where = self.start[None, :lanes] + np.minimum(step, self.length[None, :lanes] - 1)
        y, fresh = self.ids[where], self.fresh[where]
        x = self.ids[np.maximum(where - 1, 0)].astype(np.int64)
        x[fresh] = self.begin
        fresh = fresh & inside
        return x, np.where(inside, y, np.int16(-1)), fresh, self.doc[where]


def pack(ids: np.ndarray, offsets: np.ndarray, begin: int, lanes: int = LANES) -> Lanes:
    """Longest documents first, each to the lane that is shortest by then. Documents without words are left out."""
    size = np.diff(offsets)
    docs = np.argsort(-size, kind="stable")
    docs = docs[size[docs] > 0]
    heap = [(0, k) for k in range(min(lanes, len(docs)))]
    lane = np.zeros(len(docs), np.int64)
    for i, n in enumerate(size[docs].tolist()):
        have, k = heap[0]
        lane[i] = k
        heapq.heapreplace(heap, (have + n, k))
    length = np.bincount(lane, size[docs], len(heap)).astype(np.int64)
    by_length = np.argsort(-length, kind="stable")
    place = np.empty(len(heap), np.int64)
    place[by_length] = np.arange(len(heap))
    docs = docs[np.argsort(place[lane], kind="stable")]
    n = size[docs]
    first = np.cumsum(n) - n
    total = int(n.sum())
    at = np.arange(total) + np.repeat(offsets[:-1][docs] - first, n)
    fresh = np.zeros(total, bool)
    fresh[first] = True
    length = length[by_length]
    return Lanes(ids[at], np.repeat(docs.astype(np.int32), n), fresh, np.cumsum(length) - length, length, begin)


def windows(lanes: Lanes, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(first step, end step, lanes still going). Where fewer than ``window`` lanes are left, at the end of very long texts, windows are eight times as long."""
    steps, at = int(lanes.length[0]) if len(lanes.length) else 0, 0
    while at < steps:
        n = int((lanes.length > at).sum())
        to = min(at + (window if n >= window else 8 * window), steps)
        yield at, to, n
        at = to


def score_lanes(model: Model, lanes: Lanes, docs: int) -> np.ndarray:
    """Log-likelihood of each document."""
    total = np.zeros(docs)
    h = np.zeros((len(lanes.length), model.h), np.float32)
    for at, to, n in windows(lanes):
        x, y, fresh, doc = lanes.window(at, to, n)
        *_, after, last = model.forward(x, fresh, h[:n])
        h[:n] = last
        real = y >= 0
        log_p, _ = model.output(after[real], y[real].astype(np.int64))
        doc = doc[real]
        low = int(doc.min())
        part = np.bincount(doc - low, log_p)
        total[low : low + len(part)] += part
    return total


def learn_lanes(model: Model, lanes: Lanes, squares: np.ndarray, rate: float = RATE) -> int:
    """One pass of truncated backpropagation with a step (Adagrad) a window, or a few windows at the end of long lanes. Words seen."""
    h = np.zeros((len(lanes.length), model.h), np.float32)
    seen_words = pending = 0
    grad = Model(model.v, model.h, np.zeros_like(model.flat))
    for at, to, n in windows(lanes):
        x, y, fresh, _ = lanes.window(at, to, n)
        seen = model.forward(x, fresh, h[:n])
        h[:n] = seen[-1]
        real = y >= 0
        words = int(real.sum())
        if words == y.size:
            _, back = model.output(seen[3].reshape(-1, model.h), y.reshape(-1).astype(np.int64), grad)
            d = back.reshape(seen[3].shape)
        else:
            _, back = model.output(seen[3][real], y[real].astype(np.int64), grad)
            d = np.zeros_like(seen[3])
            d[real] = back
        model.backward(x, fresh, seen, d, grad)
        seen_words += words
        pending += words
        if pending >= STEP_WORDS or to == lanes.length[0]:
            g = grad.flat
            g *= np.float32(1 / pending)
            squares += g * g
            g /= np.sqrt(squares) + np.float32(1e-6)
            g *= np.float32(rate)
            model.flat += g
            g[:] = 0
            pending = 0
    return seen_words


def _batched(batches: Iterator[pa.RecordBatch], words: int = BATCH_WORDS) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, symbols, offsets) of encoded documents, some millions of words at a time."""
    rows, total = [], 0

    def out() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        flat = [_flat(b.column("ids"), np.int16) for b in rows]
        sizes = np.concatenate([np.diff(o) for _, o in flat])
        return pa.Table.from_batches(rows), np.concatenate([x for x, _ in flat]), np.concatenate([[0], np.cumsum(sizes)])

    for batch in batches:
        first, n = 0, _flat(batch.column("ids"), np.int16)[1][1:]
        while first < batch.num_rows:
            done = int(n[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(n, done + words - total, side="right")))
            rows.append(batch.slice(first, end - first))
            total += int(n[end - 1]) - done
            first = end
            if total >= words or first < batch.num_rows:
                yield out()
                rows, total = [], 0
    if rows:
        yield out()


def averaged(parts: DataFrame) -> np.ndarray | None:
    """Mean weights of (n, weights) rows by words, in a tree of FAN_IN; None without words."""

    def mean(tables: list[pa.RecordBatch]) -> tuple[float, np.ndarray | None]:
        total, weights = 0.0, None
        for b in tables:
            for n, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if n > 0:
                    x = np.frombuffer(w.as_py(), np.float32).astype(np.float64) * n
                    total, weights = total + n, x if weights is None else weights + x
        return total, None if weights is None else weights / total

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weights = mean(list(batches))
        if weights is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["n", "weights"])

    tasks = parts.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(fold, "n double, weights binary")
    return mean(parts.toArrow().to_batches())[1]


def count_words(docs: DataFrame, vocabulary: int = VOCABULARY, min_count: int = MIN_COUNT, learned: int = LEARNED) -> Vocabulary:
    """The vocabulary of docs: words that occur at least min_count times, and as often as leaves no more than vocabulary of them."""
    counts = checkpointed(word_counts(docs))
    often = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # a row a number of occurrences
    least, kept = None, 0
    for n, words in often:
        kept += words
        if n < min_count or kept > vocabulary:
            break
        least = n
    top = counts.where(F.col("n") >= F.lit(least)) if least is not None else counts.limit(0)
    t = top.toArrow()
    all_words = sum(n * words for n, words in often)
    return make_vocabulary(t.column("word").to_numpy(), t.column("n").to_numpy(), all_words, learned=learned)


def fit(encoded: DataFrame, v: Vocabulary, rounds: tuple[float, ...] = ROUNDS, hidden: int = HIDDEN) -> Model:
    """A model of encoded documents."""
    model = Model(v, hidden, spelled=spelling(spelling_counts(encoded)))
    spark, edges = encoded.sparkSession, np.round(np.concatenate([[0.0], np.cumsum(rounds)]) / sum(rounds) * (1 << 20)).astype(int).tolist()
    shapes = Vocabulary(*(x if k in (3, 4, 5) else None for k, x in enumerate(v)))  # a task needs no words to learn
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        inside = encoded.where((F.col("share") >= lo) & (F.col("share") < hi)).select("ids")
        shared = spark.sparkContext.broadcast((shapes, model.h, model.flat))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, hidden, flat = shared.value
            own = Model(v, hidden, flat.copy())
            squares, n = np.zeros_like(own.flat), 0
            for _, ids, offsets in _batched(batches):
                n += learn_lanes(own, pack(ids, offsets, v.size), squares)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([own.flat.tobytes()], pa.binary())], ["n", "weights"])

        flat = averaged(inside.mapInArrow(learn, "n double, weights binary"))
        if flat is not None:
            model = Model(model.v, hidden, flat.astype(np.float32), model.spelled)
    return model


def train(docs: DataFrame, vocabulary: int = VOCABULARY, rounds: tuple[float, ...] = ROUNDS, hidden: int = HIDDEN, learned: int = LEARNED) -> Model:
    v = count_words(docs, vocabulary, learned=learned)
    return fit(checkpointed(encode(docs, v)), v, rounds, hidden)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row."""
    return score_encoded(encode(docs, model.v), model)


def score_encoded(encoded: DataFrame, model: Model) -> DataFrame:
    shapes = Vocabulary(*(x if k in (3, 4, 5) else None for k, x in enumerate(model.v)))
    shared = encoded.sparkSession.sparkContext.broadcast((shapes, model.h, model.flat, model.spelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hidden, flat, spelled = shared.value
        own = Model(v, hidden, flat, spelled)
        for rows, ids, offsets in _batched(batches):
            n = np.diff(offsets)
            total = score_lanes(own, pack(ids, offsets, v.size), len(n)) + rows.column("extra").to_numpy()
            spelt = []
            for b in rows.column("rest").chunks:
                rest, off = _flat(b, np.uint8)
                c = np.concatenate([[0.0], np.cumsum(spelled[byte_pairs(rest)], dtype=np.float64)])
                spelt.append(c[off[1:]] - c[off[:-1]])
            total += np.concatenate(spelt)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(rows.column("doc_id").chunks), pa.array(n), pa.array(total), mean],
                ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"],
            )

    return encoded.select("doc_id", "ids", "extra", "rest").mapInArrow(
        run, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double"
    )


def train_and_score(docs: DataFrame) -> DataFrame:
    """``score`` of docs under a model of docs, which are encoded once."""
    v = count_words(docs)
    encoded = checkpointed(encode(docs, v))
    return score_encoded(encoded, fit(encoded, v))
