"""Operator 9: toxic passages by maximum-scoring segments.

Every word of a labelled document gets its log-odds of occurring in toxic against clean documents, of either sign. Its
two rates have a Dirichlet prior that weighs as much as ``PRIOR`` occurrences, centred at its share of all words in the whole corpus or in the labelled
documents, whichever is less (copies, which count once among these, make a word frequent in the corpus). The log-odds are drawn towards 0 by
``DEVIATIONS`` of the posterior, so words seen a few times, as those of a passage that stands in two or three documents, weigh little and what
labels don't tell apart is near 0. A word of no labelled document has log-odds 0. Each word of a text
scores its log-odds less ``DRIFT``, the price of a word in a passage. A linear-time scan finds all maximal
scoring segments; it is run on the texts whose best segment, the largest rise of their running sum, is significant. The
score of the best segment of n random words has an extreme-value distribution,
P(S >= x) = 1 - exp(-k n exp(-rate x)): rate solves the equation of the score distribution of clean text, k is
counted from segments of a long random sequence. A segment that significant is a passage, and a
document with one is toxic.

Toxic words may stand close together or apart, a few in a hundred: at a price of ``DRIFT`` those don't pay for the words between them. So a text without a passage
at that price is scanned again at the lower ones of ``WIDER``, each with a calibration of its own, whose passages are longer. As every price is a chance of its own to be
found, p-values are multiplied by their number. A passage is thus one of the highest price at which its text has any, and scores are at that price. A price
at which random words would gain on average is left out.

The word scores are a classifier fitted on at most ``LABELLED`` labelled documents of
either class, those near by SimHash counting once, and at most ``WORDS`` words, those of largest log-odds. Words are counted
by a distributed aggregate; only signatures and the finished scores come to the driver.

Defined results: null and empty texts have no passages; a very long text is scanned whole; label rows with null
values are ignored, one toxic label is enough; repeated rows each have their passages; without labels of both classes
nothing is found; equal scores keep the earlier and shorter segment; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm import kernel as K
from ragloom.llm.common import checkpointed
from ragloom.llm.simhash import DISTANCE, document_frequency, features, sketch

LABELLED, WORDS, PRIOR, DEVIATIONS = 5_000, 2_000_000, 4.0, 2.0
DRIFT, SIGNIFICANT = 0.5, 0.001
WIDER = (0.1, 0.02)
_SIGNATURE = ["s0", "s1", "s2", "s3"]


class Scores(NamedTuple):
    """Words (44 bits of the hash, sorted), their log-odds, and the calibration, at DRIFT and (drift, rate, k) at lower ones."""

    words: np.ndarray
    odds: np.ndarray
    rate: float
    k: float
    wider: tuple[tuple[float, float, float], ...] = ()


def labelled_documents(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(toxic, s0..s3, words): SimHash and distinct words of labelled documents, at most bound labels of each class."""
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # bound rows of each class at most, so the broadcast has a fixed size.
    some = [clean.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for c in (0, 1)]
    some = some[0].unionByName(some[1])
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    chosen = chosen.select(F.col("toxic").cast("int").alias("toxic"), "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, row, word in features(K.strings(batch.column(1))):
                start = K.run_starts(row)
                sig = sketch(word, start).view(np.int64) if len(start) else np.zeros((0, 4), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(word.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[start] + at)), *(pa.array(np.ascontiguousarray(sig[:, k])) for k in range(4)), lists],
                    ["toxic", "s0", "s1", "s2", "s3", "words"],
                )

    return chosen.mapInArrow(words, "toxic int, s0 long, s1 long, s2 long, s3 long, words array<long>")


def one_of_each(sig: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Rows whose signature is not near that of an earlier row; all pairs, in blocks."""
    keep = np.ones(len(sig), bool)
    for lo in range(0, len(sig), 64):
        block = sig[lo : lo + 64]
        d = np.bitwise_count(block[:, None, :] ^ sig[None, : lo + len(block), :]).sum(2)
        for i in range(len(block)):
            keep[lo + i] = not (d[i, : lo + i] <= distance).any()
    return keep


def log_odds(toxic: Column, clean: Column, n_toxic: float, n_clean: float, share: Column, prior: float = PRIOR) -> tuple[Column, Column]:
    """(log-odds, rate in clean documents) of words counted so in n_toxic and n_clean occurrences of words, share being theirs of all in the corpus."""
    share = F.least(share, (toxic + clean) / F.lit(float(n_toxic + n_clean)))
    up = (toxic + F.lit(prior)) / (F.lit(float(n_toxic)) * share + F.lit(prior))
    down = (clean + F.lit(prior)) / (F.lit(float(n_clean)) * share + F.lit(prior))
    odds = F.ln(up) - F.ln(down)
    deviation = F.sqrt(1 / (toxic + F.lit(prior)) + 1 / (clean + F.lit(prior)))
    return F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - F.lit(DEVIATIONS) * deviation), share * down


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of a text whose words score so.

    One pass in linear time: a candidate knows the last one before it that begins at a lower total, so a search
    skips what lies between; where none begins lower, all candidates so far are final.
    """
    place = np.flatnonzero(score > 0)
    total = np.concatenate([[0.0], np.cumsum(score)])
    out: list[list[float]] = []
    found: list[list[float]] = []  # first word, end, total before, total after, the candidate that begins lower
    for p, before, after in zip(place.tolist(), total[place].tolist(), total[place + 1].tolist(), strict=True):
        new = [p, p + 1, before, after, -1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0:
                out += found
                found = [new]
                break
            if found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            j, keep = found[j][4], j
            del found[keep:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi, _ in out + found]


def best_of_each(score: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of the best segment of each text, 0 where no word scores above 0; text i has the words offsets[i] to offsets[i + 1]."""
    size = np.diff(offsets)
    best = np.zeros(len(size))
    if not len(score):
        return best
    row = np.repeat(np.arange(len(size)), size)
    total = np.cumsum(score)
    before = total - score
    # Each text lies lower than all of the one before, so the least total so far is of the text itself.
    apart = row * (total.max() - total.min() + np.abs(score).max() + 1.0)
    rise = total - apart - np.minimum.accumulate(before - apart)
    some = size > 0
    best[some] = np.maximum.reduceat(rise, offsets[:-1][some])
    return np.maximum(best, 0.0)


def calibrate(score: np.ndarray, share: np.ndarray, drift: float = DRIFT, events: int = 20_000) -> tuple[float, float]:
    """(rate, k) of random words that score so with the chances share, else -drift."""
    up = score > 0
    if not up.any():
        return 1.0, 0.0
    share = share / max(1.0, share.sum())
    rest = 1 - share.sum()

    def excess(rate: float) -> float:
        return float((share * np.exp(rate * score)).sum() + rest * math.exp(-rate * drift) - 1)

    lo, hi = 1e-6, 1e-6
    while excess(hi) <= 0:
        lo, hi = hi, hi * 2 + 1e-3
        if hi > 1e3:
            break
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) <= 0 else (lo, mid)
    rate = hi
    # Segments of a long random sequence: the share per word beyond x is k exp(-rate x). Only words that score above 0 and the gaps between them are drawn.
    rng = np.random.default_rng(7)
    often = share[up].sum()
    gap = rng.geometric(often, events) - 1
    fall = np.concatenate([score[~up], [-drift]])
    chance = np.concatenate([share[~up], [rest]]) / (1 - often)
    mean = (fall * chance).sum()
    spread = math.sqrt(max(0.0, (fall * fall * chance).sum() - mean * mean))
    between = np.minimum(0.0, gap * mean + np.sqrt(gap) * spread * rng.standard_normal(events))
    drawn = score[up][rng.choice(int(up.sum()), events, p=share[up] / often)]
    best = np.array([s for _, _, s in segments(np.stack([between, drawn], 1).reshape(-1))])
    x = np.median(best)
    return rate, float((best >= x).sum() / (gap.sum() + events) * math.exp(rate * x))


def counted_words(each: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(word, toxic, clean): in how many labelled documents of either class each word is, those near by SimHash counting once."""
    spark = each.sparkSession
    some = [
        each.where(F.col("toxic") == c).select("toxic", *_SIGNATURE).distinct().orderBy(F.xxhash64(*_SIGNATURE), *_SIGNATURE).limit(bound) for c in (0, 1)
    ]
    t = some[0].unionByName(some[1]).toArrow()
    sig = np.stack([t.column(s).to_numpy() for s in _SIGNATURE], 1).view(np.uint64)
    is_toxic = t.column("toxic").to_numpy() > 0
    order = np.lexsort((sig[:, 3], sig[:, 2], sig[:, 1], sig[:, 0], is_toxic))  # the order of rows must not matter
    kept = t.take(pa.array(order[one_of_each(sig[order])]))
    chosen = each.join(F.broadcast(spark.createDataFrame(kept)), ["toxic", *_SIGNATURE])
    one = chosen.groupBy("toxic", *_SIGNATURE).agg(F.min("words").alias("words"))
    words = one.select("toxic", F.explode("words").alias("word"))
    return words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, words: int = WORDS) -> Scores:
    none = Scores(np.zeros(0, np.uint64), np.zeros(0), 1.0, 0.0)
    counted = checkpointed(counted_words(checkpointed(labelled_documents(docs, labels, bound)), bound))
    size, n_toxic, n_clean = counted.agg(F.count("*"), F.sum("toxic"), F.sum("clean")).first()
    if not n_toxic or not n_clean:
        return none
    frequency = checkpointed(document_frequency(docs))
    total = frequency.agg(F.sum("df")).first()[0]
    odds, rate = log_odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean, F.col("df") / F.lit(float(total)))
    scored = counted.join(frequency, "word").select("word", odds.alias("odds"), rate.alias("rate"))
    if size > words:
        scored = scored.orderBy(F.desc(F.abs("odds")), "word").limit(words)
    t = scored.toArrow()
    word = t.column("word").to_numpy()
    order = np.argsort(word)
    value = t.column("odds").to_numpy()[order]
    share = t.column("rate").to_numpy()[order]
    gain = (share * value).sum() / max(1.0, share.sum())
    wider = tuple((drift, *calibrate(value - drift, share, drift)) for drift in WIDER if gain < drift)
    return Scores(word[order].astype(np.uint64), value, *calibrate(value - DRIFT, share), wider)


def chance(score: float, words: int, scores: Scores) -> float:
    """P that the best of that many random words scores so."""
    return -math.expm1(-scores.k * words * math.exp(-scores.rate * score))


def word_scores(h: np.ndarray, scores: Scores, drift: float = DRIFT) -> np.ndarray:
    """The log-odds of words by hash less the drift."""
    short = h >> np.uint64(20)
    where = np.minimum(np.searchsorted(scores.words, short), len(scores.words) - 1)
    return np.where(scores.words[where] == short, scores.odds[where], 0.0) - drift


def passages(text: pa.Array, scores: Scores, significant: float = SIGNIFICANT) -> list[tuple[int, int, int, float, float]]:
    """(row, first word, words, score, chance) of every significant segment of every text, at the highest drift at which it has any."""
    out: list[tuple[int, int, int, float, float]] = []
    if not len(scores.words):
        return out
    prices = [(DRIFT, scores), *((drift, scores._replace(rate=rate, k=k)) for drift, rate, k in scores.wider)]
    for at, part in K.chunks(text):
        w = K.words(part)
        odds = word_scores(w.hash, scores, 0.0)
        size = np.diff(w.offsets)
        left = size > 0
        for drift, s in prices:
            if not s.k:
                continue
            value = odds - drift
            least = -len(prices) * np.expm1(-s.k * size * np.exp(-s.rate * (best_of_each(value, w.offsets) + 1e-6)))
            for i in np.flatnonzero((least <= significant) & left).tolist():
                n = int(size[i])
                for a, e, score in segments(value[w.offsets[i] : w.offsets[i + 1]]):
                    p = len(prices) * chance(score, n, s)
                    if p <= significant:
                        out.append((at + i, a, e - a, score, p))
                        left[i] = False
    return sorted(out)


def toxic_passages(docs: DataFrame, scores: Scores, significant: float = SIGNIFICANT) -> DataFrame:
    """(doc_id, first_word, n_words, score, p_value, doc_score, doc_p_value) of every toxic passage; doc_*: its document's best."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = passages(K.strings(batch.column(1)), shared.value, significant)
            row = [f[0] for f in found]
            best: dict[int, tuple[float, float]] = {}
            for r, _, _, s, p in found:
                best[r] = max(best.get(r, (s, p)), (s, p), key=lambda x: x[0])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                    pa.array([round(f[3], 9) for f in found], pa.float64()), pa.array([f[4] for f in found], pa.float64()),
                    pa.array([round(best[r][0], 9) for r in row], pa.float64()), pa.array([best[r][1] for r in row], pa.float64()),
                ],
                ["doc_id", "first_word", "n_words", "score", "p_value", "doc_score", "doc_p_value"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, first_word long, n_words long, score double, p_value double, doc_score double, doc_p_value double"
    )
