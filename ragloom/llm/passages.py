"""Operator 2: exact passage dedup with suffix arrays built by induced sorting.

A passage of at least ``WORDS`` words that an earlier document also has is removed from
the later ones; order is by (id, text hash), so the first document keeps its text.

1. Every window of WORDS words picks the least hash among its ``GRAM``-word grams.
   Neighbouring windows with the same pick form a fragment; equal windows of any two
   documents pick equal grams, so sending fragments to the shard of their gram
   brings all copies of a window together and no window is in two fragments.
2. Of equal fragments in one batch of documents only the first, the head, goes to the shard of the gram;
   the others are known to be repeated and are spread over all tasks, so a passage that a third of all documents have
   is a few rows there. Sorted by gram, heads that nobody shares a gram with drop out, and
   whole copies of a fragment are settled at once; the task holds one block of rows, however many a gram has.
3. Only distinct fragments with a common gram go on, and their words are fetched. Each shard is one text with separators,
   whose suffix array is made by induced sorting and whose permuted common prefixes give all windows that occur
   twice (see ``suffix``). A gram with more than ``GRAM_BODIES`` distinct fragments, such as a line that stands
   between other words in each document, is too much for one shard: its windows are brought together by
   their hashes instead, in an aggregate that combines before the shuffle, with the same result.
4. Windows found are brought back to every occurrence and merged to spans.

Texts move once to fetch fragments, spans once to be merged. Words are compared without case and
punctuation (see ``kernel`` for scripts without spaces).

Defined results: null, empty or short texts have no spans; a very long text is cut up whole; rows equal in id and text are one
document, whose repeats within itself are left; of rows without an id the one of the
least text hash counts as the first; an empty table gives no rows; other columns are ignored, or carried by
``drop_passages``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import kernel as K
from ragloom.llm import suffix
from ragloom.llm.common import checkpointed, doc_key, named

WORDS, GRAM = 50, 25
#: Words that a shard's suffix array takes at once (a gram's fragments stay together, however many).
SHARD_WORDS = 150_000
#: Distinct fragments of a gram, of some 75 words at most, that one suffix array takes.
GRAM_BODIES = 2_000
#: Tasks over which repeats of a fragment within a batch are spread.
SPREAD = 256

_FRAGMENT = "gram long, body long, key long, th long, pos int, size int"
_NAMES = ["gram", "body", "key", "th", "pos", "size"]


def fragments(w: K.Words, words: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, content hash, row, first word in the chunk, words) of the fragments of a chunk of texts."""
    g = K.grams(w.hash, gram)
    wide = words - gram + 1
    n = len(w.hash) - words + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    pick = np.arange(len(g))
    span = 1
    while span * 2 <= wide:
        a, b = pick[:-span], pick[span:]
        pick = np.where(g[a] <= g[b], a, b)
        span *= 2
    if span < wide:
        a, b = pick[: len(pick) - (wide - span)], pick[wide - span :]
        pick = np.where(g[a] <= g[b], a, b)
    inside = np.flatnonzero(w.doc[:n] == w.doc[words - 1 :])
    pick = pick[inside]
    if not len(inside):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (np.diff(inside) != 1) | (np.diff(w.doc[inside]) != 0)])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(inside)) - 1
    start, end = inside[lo], inside[hi] + words
    power, inverse = K._powers(len(w.hash) + 1)
    total = np.empty(len(w.hash) + 1, np.uint64)
    total[0] = 0
    np.cumsum(w.hash * power[: len(w.hash)], out=total[1:])
    size = end - start
    body = K.mix((total[end] - total[start]) * inverse[start] + size.astype(np.uint64))
    return g[pick[lo]], body, w.doc[start], start, size


def _cut_up(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """Fragments of all documents; lot is 0 for the first of equal ones in a batch, for the others a number from 1 to SPREAD; many: it has others in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = []
            for at, part in K.chunks(K.strings(batch.column(2))):
                w = K.words(part)
                g, body, row, start, size = fragments(w, words, gram)
                parts.append((g.view(np.int64), body.view(np.int64), row + at, (start - w.offsets[row]).astype(np.int32), size.astype(np.int32)))
            if not parts:
                continue
            g, body, row, pos, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            mine, own = key[row], th[row]
            by = np.lexsort((pos, own, mine, body, g))
            repeat = np.zeros(len(g), bool)
            repeat[1:] = (g[by][1:] == g[by][:-1]) & (body[by][1:] == body[by][:-1])
            lot = np.zeros(len(g), np.int32)
            lot[by[repeat]] = 1 + (K.mix(own[by[repeat]].view(np.uint64)) % np.uint64(SPREAD)).astype(np.int32)
            many = np.zeros(len(g), bool)  # the next in order is a repeat
            many[by[:-1][repeat[1:]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, body, mine, own, pos, size, lot, many)], [*_NAMES, "lot", "many"])

    return docs.select(*doc_key(), "text").mapInArrow(run, _FRAGMENT + ", lot int, many boolean")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch], by: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least rows rows (but the last) that split no run of equal values of a sorted column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(by).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield t.slice(0, last)
            t = t.slice(last)
            held, size = t.to_batches(), t.num_rows
            rows_needed = 2 * size
            rows = max(rows, rows_needed)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _shared(cut: DataFrame) -> DataFrame:
    """Heads whose gram occurs again or that have repeats, with the first document of each content, and all repeats (lot > 0), whose first document
    is yet to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # gram, body and first document of the row before, and whether its gram has occurred twice
        for t in _with_next(batches):
            gram, body, key, th, lot = (t.column(n).to_numpy() for n in ("gram", "body", "key", "th", "lot"))
            n = t.num_rows - 1 if t.num_rows > 1 and t.column("more")[0].as_py() else t.num_rows  # the last row comes again first
            same_gram = np.zeros(t.num_rows, bool)
            same_gram[1:] = (gram[1:] == gram[:-1]) & (lot[1:] == lot[:-1])
            same_body = np.zeros(t.num_rows, bool)
            same_body[1:] = same_gram[1:] & (body[1:] == body[:-1])
            if before is not None and before[:2] == (gram[0], lot[0]):
                same_gram[0] = True
                same_body[0] = before[2] == body[0]
            again = same_gram.copy()
            again[:-1] |= same_gram[1:]
            start = np.maximum.accumulate(np.where(same_body, 0, np.arange(t.num_rows)))
            first_key, first_th = key[start], th[start]
            if same_body[0]:  # the content began in a block before
                head = np.flatnonzero(~same_body)
                upto = head[0] if len(head) else t.num_rows
                first_key[:upto], first_th[:upto] = before[3], before[4]
            repeat = lot > 0
            keep = (again | repeat | t.column("many").to_numpy())[:n]
            out = t.select([*_NAMES, "lot"]).slice(0, n)
            out = out.append_column("first_key", pa.array(first_key[:n], mask=repeat[:n]))
            out = out.append_column("first_th", pa.array(first_th[:n], mask=repeat[:n]))
            out = out.append_column("is_first", pa.array((~same_body & ~repeat)[:n]))
            before = (gram[n - 1], lot[n - 1], body[n - 1], first_key[n - 1], first_th[n - 1])
            yield from out.filter(pa.array(keep)).combine_chunks().to_batches()

    together = cut.repartition("gram", "lot").sortWithinPartitions("lot", "gram", "body", "key", "th", "pos")
    return together.mapInArrow(run, _FRAGMENT + ", lot int, first_key long, first_th long, is_first boolean")


def _with_next(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about rows rows; each but the last (more is true) ends in a row that the next one begins with."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            t = pa.Table.from_batches([*held, batch.slice(0, 1)])
            yield t.append_column("more", pa.array(np.ones(t.num_rows, bool))).combine_chunks()
            held, size = [], 0
        held.append(batch)
        size += batch.num_rows
    if held:
        t = pa.Table.from_batches(held)
        yield t.append_column("more", pa.array(np.zeros(t.num_rows, bool))).combine_chunks()


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words (64-bit hashes) of the fragments wanted (gram, body, key, th, pos, size, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for at, part in K.chunks(K.strings(batch.column(2))):
                w = K.words(part)
                out = [[], [], [], [], [], []]
                for i in range(len(part)):
                    key, th = batch.column(0)[at + i].as_py(), batch.column(1)[at + i].as_py()
                    for f in lists[at + i].as_py():
                        lo = w.offsets[i] + f["pos"]
                        for column, value in zip(out, (f["gram"], f["body"], key, th, f["hot"], w.hash[lo : lo + f["size"]].tobytes()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.bool_()), pa.array(out[5], pa.binary())],
                    ["gram", "body", "key", "th", "hot", "words"],
                )

    by_doc = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("gram", "body", "pos", "size", "hot")).alias("parts"))
    texts = docs.select(*doc_key(), "text").join(by_doc, ["key", "th"])
    return texts.mapInArrow(run, "gram long, body long, key long, th long, hot boolean, words binary")


def repeated_windows(bodies: list[np.ndarray], order: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, offset) of every window that a fragment of lower order also has, by suffix array."""
    size = np.array([len(b) for b in bodies])
    flat = np.concatenate(bodies)
    distinct, symbol = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(bodies)), size + 1)
    start = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(start[-1] + 1, np.int64)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(bodies)), size)
    text[at] = symbol + 1
    text[start[1:] - 1] = len(distinct) + 1 + np.arange(len(bodies))  # a separator of its own after each
    sa = suffix.suffix_array(text)
    common = suffix.permuted_common_prefixes(text, sa, len(distinct) + 1)[sa]
    group = np.cumsum(common < words) - 1
    many = np.bincount(group)[group] > 1
    sa, group = sa[many], group[many]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = order[owner[sa]]
    lo = K.run_starts(group)
    least = np.repeat(np.minimum.reduceat(rank, lo), np.diff(np.append(lo, len(group))))
    later = sa[rank > least]
    return owner[later], later - start[owner[later]]


def _found(contents: DataFrame, words: int, shard_words: int) -> DataFrame:
    """(gram, body, start, end): word ranges of fragments that an earlier document has."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, body = t.column("gram").to_numpy(), t.column("body").to_numpy()
        key, th = t.column("key").to_numpy(), t.column("th").to_numpy()
        bodies = [np.frombuffer(b.as_py(), np.uint64) for b in t.column("words")]
        by = np.lexsort((th, key))
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(np.concatenate([[0], (np.diff(key[by]) != 0) | (np.diff(th[by]) != 0)]))
        edge, total = 0, 0
        edges = K.run_starts(gram).tolist() + [len(gram)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            total += sum(len(b) for b in bodies[lo:hi])
            if total < shard_words and hi < len(gram):
                continue
            which, offset = repeated_windows(bodies[edge:hi], order[edge:hi], words)
            if len(which):
                wide = 1 << 32
                s, e = K.merge(which * wide + offset, which * wide + offset + words)
                f = s // wide + edge
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[f]), pa.array(body[f]), pa.array((s % wide).astype(np.int32)), pa.array((e % wide).astype(np.int32))],
                    ["gram", "body", "start", "end"],
                )
            edge, total = hi, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "gram", 10_000):
            yield from solve(t)

    together = contents.repartition("gram").sortWithinPartitions("gram", "body", "key", "th")
    return together.mapInArrow(run, "gram long, body long, start int, end int")


def _found_by_hash(contents: DataFrame, words: int) -> DataFrame:
    """What ``_found`` gives, for grams with very many fragments: windows meet by their hashes, not in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g = K.grams(np.frombuffer(batch.column(4)[i].as_py(), np.uint64), words)
                same = pa.array(np.full(len(g), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), *(batch.column(k).take(same) for k in range(4)), pa.array(np.arange(len(g), dtype=np.int32))],
                    ["window", "gram", "body", "key", "th", "at"],
                )

    every = contents.select("gram", "body", "key", "th", "words").mapInArrow(run, "window long, gram long, body long, key long, th long, at int")
    first = every.groupBy("gram", "window").agg(F.min(F.struct("key", "th")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = every.join(first, ["gram", "window"]).where(F.struct("key", "th") > F.col("first"))
    return later.select("gram", "body", F.col("at").alias("start"), (F.col("at") + F.lit(words)).cast("int").alias("end"))


def repeated_spans(
    docs: DataFrame, words: int = WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS, gram_bodies: int = GRAM_BODIES
) -> DataFrame:
    """(key, th, starts, ends): by document, the word ranges that earlier documents have, not yet merged."""
    shared = checkpointed(_shared(_cut_up(docs, words, gram)))
    heads = shared.where("lot = 0").drop("lot")
    # A batch's repeats are copies of a head, which was compared with those of all other batches.
    firsts = heads.where("is_first").select("gram", "body", "first_key", "first_th", "pos", "size")
    repeats = shared.where("lot > 0").drop("lot", "first_key", "first_th", "is_first")
    repeats = repeats.join(firsts.select("gram", "body", "first_key", "first_th"), ["gram", "body"])
    own = (F.col("key") == F.col("first_key")) & (F.col("th") == F.col("first_th"))
    every = heads.select(*_NAMES, "first_key", "first_th").unionByName(repeats)
    copies = every.where(~own).select("key", "th", F.col("pos").alias("s"), (F.col("pos") + F.col("size")).alias("e"))
    several = firsts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > gram_bodies).alias("hot"))
    wanted = firsts.join(several, "gram").select("gram", "body", F.col("first_key").alias("key"), F.col("first_th").alias("th"), "pos", "size", "hot")
    contents = checkpointed(_contents(docs, wanted))
    found = _found(contents.where("not hot").drop("hot"), words, shard_words).unionByName(_found_by_hash(contents.where("hot"), words))
    partly = every.where(own).join(found, ["gram", "body"]).select(
        "key", "th", (F.col("pos") + F.col("start")).alias("s"), (F.col("pos") + F.col("end")).alias("e")
    )
    return copies.unionByName(partly).groupBy("key", "th").agg(
        F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends")
    )


def removed_passages(docs: DataFrame, words: int = WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS, gram_bodies: int = GRAM_BODIES) -> DataFrame:
    """(doc_id, th, first_word, n_words) of every span to be removed; words count from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for key, th, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, e = K.merge(np.array(starts, np.int64), np.array(ends, np.int64))
                out[0] += [None if key == K.NO_ID else key] * len(s)
                out[1] += [th] * len(s)
                out[2] += s.tolist()
                out[3] += (e - s).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "th", "first_word", "n_words"])

    spans = repeated_spans(docs, words, gram, shard_words, gram_bodies)
    return spans.mapInArrow(run, "doc_id long, th long, first_word long, n_words long")


def drop_passages(docs: DataFrame, words: int = WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS, gram_bodies: int = GRAM_BODIES) -> DataFrame:
    """docs with the spans cut from text (n_chars counted again where docs has it); all rows and columns stay."""

    @F.arrow_udf("string")
    def clean(column: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        text = K.strings(column)
        out = column.to_pylist()
        for at, part in K.chunks(text):
            touched = [i for i in range(len(part)) if starts[at + i].is_valid]
            if not touched:
                continue
            w = K.words(part)
            for i in touched:
                s, e = K.merge(np.array(starts[at + i].as_py(), np.int64), np.array(ends[at + i].as_py(), np.int64))
                data = part[i].as_py().encode()
                mine = slice(w.offsets[i], w.offsets[i + 1])
                base = int(np.frombuffer(part.buffers()[1], np.int64)[part.offset + i] - np.frombuffer(part.buffers()[1], np.int64)[part.offset])
                begin = np.append(w.start[mine] - base, len(data))
                out[at + i] = K.cut(data, begin[s], begin[e])
        return pa.array(out, pa.string())

    names = docs.columns
    spans = repeated_spans(docs, words, gram, shard_words, gram_bodies)
    rows = docs.select(F.struct(*named(names)).alias("row"), *doc_key()).join(spans, ["key", "th"], "left")
    cleaned = rows.select("row", clean(F.col("row.text"), "starts", "ends").alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*(new.get(n, F.col("row").getField(n)).alias(n) for n in names))
