"""Vectorised text kernel shared by the training-data operators.

A *word* is a maximal run of ASCII letters or digits and of non-ASCII letters;
ASCII punctuation, the Latin-1 signs U+0080..U+00BF, the general
punctuation blocks U+2000..U+207F and U+3000..U+303F and full-width signs separate words.
In scripts that put no spaces between words (Han, kana, Thai, Lao, Myanmar, Khmer) each
character is a word of its own. Case is folded for letters of every script up to U+FFFF whose
folded form takes as many bytes, so byte offsets are those of the original
text (a few dozen letters, such as the Turkish capital dotted I, stay as they are). Texts are compared
as they are composed: a letter with a combining accent is not the letter that has it built in.
Words are known by a 64-bit polynomial hash: two different words are
taken for one with a chance of about 2**-64 a pair.

Everything works on whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; it bounds a Python worker's memory. A longer
#: text is a chunk of its own.
CHUNK = 1 << 20
#: Key of a document without an id: it sorts after all others.
NO_ID = (1 << 63) - 1

_M = 0x9E3779B97F4A7C15 | 1
_MI = pow(_M, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the result depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        _POWERS[:] = [
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)]), dtype=np.uint64)
            for m in (_M, _MI)
        ]
    return _POWERS[0], _POWERS[1]


def strings(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string())
    return arr.fill_null("") if arr.null_count else arr


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of large strings."""
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + n + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _folded(code: int) -> int:
    """The folded form of a code point, where it is one that takes as many bytes."""
    for form in (chr(code).casefold(), chr(code).lower()):
        if len(form) == 1 and len(form.encode("utf-8", "surrogatepass")) == len(chr(code).encode("utf-8", "surrogatepass")):
            return ord(form)
    return code


def _blocks(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


_LOWER = np.array([_folded(c) for c in range(1 << 16)], np.int32)
_SIGN = _blocks((0x2000, 0x207F), (0x3000, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
#: Characters of scripts without spaces. Beyond U+FFFF all from U+20000 on are.
_ALONE = _blocks((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))


def _three(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters of three bytes begin, and their code points."""
    at = np.flatnonzero((b >= 0xE0) & (b < 0xF0))
    if not len(at):
        return at, at
    code = ((b[at] & 0x0F).astype(np.int64) << 12) | ((b[at + 1] & 0x3F).astype(np.int64) << 6) | (b[at + 2] & 0x3F)
    return at, code


def fold(b: np.ndarray) -> np.ndarray:
    """Case folded, byte for byte."""
    out = _FOLD[b]
    two = np.flatnonzero((b >= 0xC3) & (b < 0xE0)) if len(b) else np.zeros(0, np.int64)
    if len(two):
        code = ((b[two] & 0x1F).astype(np.int64) << 6) | (b[two + 1] & 0x3F)
        new = _LOWER[code]
        up = new != code
        two, new = two[up], new[up]
        out[two] = 0xC0 | (new >> 6)
        out[two + 1] = 0x80 | (new & 0x3F)
    at, code = _three(b)
    if len(at):
        new = _LOWER[code]
        up = new != code
        at, new = at[up], new[up]
        out[at] = 0xE0 | (new >> 12)
        out[at + 1] = 0x80 | ((new >> 6) & 0x3F)
        out[at + 2] = 0x80 | (new & 0x3F)
    return out


def word_mask(low: np.ndarray, letters: bool = False) -> np.ndarray:
    """Which bytes of folded text belong to words (letters: digits do not)."""
    is_word = (_LETTER if letters else _WORD)[low]
    at, code = _three(low)
    if len(at):
        at = at[_SIGN[code]]
        for k in range(3):
            is_word[at + k] = False
    if len(low) > 1:
        two = np.flatnonzero(low[:-1] == 0xC2)
        c = low[two + 1]
        two = two[(c != 0xAA) & (c != 0xB5) & (c != 0xBA)]
        is_word[two] = is_word[two + 1] = False
    return is_word


def _word_edges(low: np.ndarray, edge: np.ndarray) -> None:
    """Marks in edge where a character that is a word of its own begins, and where it ends."""
    at, code = _three(low)
    if len(at):
        at = at[_ALONE[code]]
        edge[at] = edge[at + 3] = True
    four = np.flatnonzero(low >= 0xF0)
    if len(four):
        four = four[(low[four] > 0xF0) | (low[four + 1] >= 0xA0)]
        edge[four] = edge[four + 4] = True


class Words(NamedTuple):
    """The words of several texts: hash, first byte and end byte in the chunk, and where each text's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray


def words(arr: pa.Array) -> Words:
    """Words of every text of arr (large strings, see ``strings``)."""
    b, off = raw(arr)
    n, docs = len(b), len(arr)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(docs + 1, np.int64), none)
    low = fold(b)
    is_word = word_mask(low)
    first = np.zeros(n + 1, bool)
    first[off] = True
    _word_edges(low, first)
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | first[1:n]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | first[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start])
    offsets = np.searchsorted(start, off)
    return Words(h, start, end, offsets, np.repeat(np.arange(docs), np.diff(offsets)))


def chunks(arr: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of at most CHUNK bytes of text (or of one longer text), with the index of their first row."""
    _, off = raw(arr)
    at, n = 0, len(arr)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, side="right")) - 1)
        yield at, arr.slice(at, to - at)
        at = to


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (len(h) - k + 1 of them; they may cross texts)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(h) + 1)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: len(h) - k + 1])


def text_hashes(w: Words, docs: int) -> np.ndarray:
    """A hash of each text's sequence of words."""
    power, _ = _powers(len(w.hash) + 1)
    local = np.arange(len(w.hash)) - w.offsets[:-1][w.doc] if len(w.hash) else np.zeros(0, np.int64)
    out = np.zeros(docs, np.uint64)
    np.add.at(out, w.doc, w.hash * power[local])
    return mix(out + np.diff(w.offsets).astype(np.uint64))


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of every run of equal keys."""
    start = run_starts(sorted_keys).tolist()
    return list(zip(start, [*start[1:], len(sorted_keys)], strict=True)) if start else []


def merge(start: np.ndarray, end: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; those at most gap apart become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1] + gap])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return start[new], reach[last]


def cut(text: bytes, start: np.ndarray, end: np.ndarray) -> str:
    """Text without the byte ranges given (disjoint, in order)."""
    out, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out).decode("utf-8", "replace")
