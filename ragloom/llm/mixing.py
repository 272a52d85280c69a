"""Operator 3: mixing sources to target weights by Pfair scheduling.

A source's documents, in a pseudo-random order, form blocks. Weights are whole
numbers a_i of ``resolution`` parts. Block r of source i (from 0) has release time
floor(r * D / a_i) and deadline ceil((r + 1) * D / a_i); earliest deadline first
gives each slot to one block. All weights fill D slots exactly, so the schedule
repeats every D slots: one period is scheduled on the driver (its length is the
parameter D, not the data), and the slot of any block is found by arithmetic.
At any slot every source is less than one block from its target.

The mixture is as long as it takes for each source to be used whole: scarcer
sources repeat (``epoch``), none is lost and the weights hold throughout.

Defined results: a null source counts as the source ''; a null id is ordered as
the id 0; rows of equal id are in the order of a hash of what they carry, and those equal in all can
change places unseen; repeated rows are documents of their own; a source without a given
weight is an error, a weight without documents is ignored; more sources than ``resolution`` / ``PARTS``
make the period longer, so each has some parts; an empty table gives
an empty mixture; null, empty and very long texts are carried as they are; other columns are ignored by ``mix``
and carried by ``mix_texts``.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import named

RESOLUTION, BLOCK_DOCS, ALPHA = 1000, 64, 0.7
#: Parts a source has at least on average; with more sources than that allows the period grows.
PARTS = 8
#: Sources whose slots are broadcast (``PARTS`` longs each); the slots of more are joined by shuffle.
SOURCES_AT_ONCE = 20_000
#: Rows that one task numbers; a larger source is numbered by several.
ROWS_PER_TASK = 200_000
_MOD = 1 << 32


def whole_weights(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Parts of resolution by largest remainder, ties by name; at least one each."""
    if not weights:
        return {}
    if len(weights) > resolution or min(weights.values()) <= 0:
        raise ValueError("weights must be positive, and resolution at least their number")
    total = sum(weights.values())
    spare = resolution - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    parts = {s: int(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (-(exact[s] - parts[s]), s))
    for s in order[: spare - sum(parts.values())]:
        parts[s] += 1
    return {s: p + 1 for s, p in parts.items()}


def tempered(counts: dict[str, int], alpha: float = ALPHA) -> dict[str, float]:
    """Target weights that grow as the alpha-th power of a source's size."""
    return {s: n**alpha for s, n in counts.items()}


def schedule(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, r, slot): one period under earliest deadline first, ties by source."""
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, r = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(r + 1) * period // parts[s]), s, r))
        deadline, s, r = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, r, slot))
        if r + 1 < parts[s]:
            heapq.heappush(waiting, ((r + 1) * period // parts[s], s, r + 1))
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_docs: int = BLOCK_DOCS,
    resolution: int = RESOLUTION,
    alpha: float = ALPHA,
    rows_per_task: int = ROWS_PER_TASK,
    carry: list[Column] | None = None,
) -> DataFrame:
    """(slot, place, source, block, epoch, doc_id): every document at its slots, place being its order in the block.

    carry: columns of docs to bring along.

    weights: target of each source (a null source is ''); None takes ``tempered`` of the sources' documents.
    """
    spark = docs.sparkSession
    named = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(*carry or [F.lit(0).alias("none")]).alias("carried"),
    )
    n_docs = {r[0]: r[1] for r in named.groupBy("source").count().collect()}
    if weights is not None and set(n_docs) - set(weights):
        raise ValueError(f"no weight for sources {sorted(set(n_docs) - set(weights))[:5]}")
    wanted = {s: weights[s] for s in n_docs} if weights is not None else tempered(n_docs, alpha)
    resolution = max(resolution, PARTS * len(wanted)) if len(wanted) > resolution / PARTS else resolution
    parts = whole_weights(wanted, resolution)
    near = F.broadcast if len(parts) <= SOURCES_AT_ONCE else lambda df: df
    n_blocks = {s: -(-n // block_docs) for s, n in n_docs.items()}
    # Slots until every block has come once, and how many blocks each source has by then.
    period = sum(parts.values())
    slots_in = {s: [] for s in parts}
    for s, _, slot in schedule(parts):
        slots_in[s].append(slot)

    def slot_of(s: str, g: int) -> int:
        return g // parts[s] * period + slots_in[s][g % parts[s]]

    length = max((slot_of(s, n - 1) + 1 for s, n in n_blocks.items()), default=0)
    used = {
        s: length // period * parts[s] + sum(x < length % period for x in slots_in[s]) for s in parts
    }
    info = spark.createDataFrame(
        [(s, max(1, n_docs[s] // rows_per_task), parts[s], n_blocks[s], used[s], slots_in[s]) for s in parts],
        "source string, pieces long, parts long, blocks long, used long, slots array<long>",
    )
    # A piece is a range of the shuffled order, so pieces number their rows apart from each other.
    h = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(_MOD)) * F.lit(1_103_515_245), F.lit(_MOD))
    spread = named.join(near(info.select("source", "pieces")), "source").select(
        "source", "doc_id", "carried", h.alias("h"), F.floor(h * F.col("pieces") / F.lit(_MOD)).alias("piece")
    )
    sizes = spread.groupBy("source", "piece").count()
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("source", "piece").orderBy("h", F.col("doc_id").asc_nulls_first(), *([_content_hash(docs, carry)] if carry else []))
    numbered = spread.withColumn("n", F.row_number().over(own) - 1).join(sizes, ["source", "piece"])
    at = numbered.withColumn("n", F.col("n") + F.col("before"))
    at = at.withColumn("block", F.expr(f"n div {int(block_docs)}")).withColumn("place", F.expr(f"n % {int(block_docs)}"))
    each = at.join(near(info), "source").where("block < used")
    each = each.withColumn("epoch", F.explode(F.expr("sequence(0L, (used - 1 - block) div blocks)")))
    g = F.col("epoch") * F.col("blocks") + F.col("block")
    in_period = F.get("slots", F.pmod(g, F.col("parts")).cast("int"))
    return each.select(
        (F.floor(g / F.col("parts")) * F.lit(period) + in_period).alias("slot"),
        F.col("place").cast("long").alias("place"),
        "source",
        "block",
        "epoch",
        "doc_id",
        *(["carried"] if carry else []),
    )


def _content_hash(docs: DataFrame, carry: list[Column]) -> Column:
    """A hash of what a row carries, without maps, which have no order."""
    kinds = docs.select(F.struct(*carry).alias("c")).schema["c"].dataType
    plain = [f.name for f in kinds.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*(F.col("carried").getField(n) for n in plain))


def mix_texts(docs: DataFrame, rows_per_task: int = 10_000, **how) -> DataFrame:
    """(slot, place, block, epoch) and the columns of docs, at every slot of a document. A column of docs that is named so comes as given_slot and so on."""
    own = ["slot", "place", "block", "epoch"]
    names = docs.columns
    shown = {n: n for n in names if n not in own}
    for n in own:
        if n in names:
            name = f"given_{n}"
            while name in shown.values():
                name = f"given_{name}"
            shown[n] = name
    mixed = mix(docs, rows_per_task=rows_per_task, carry=named(names), **how)
    return mixed.select(*own, *(F.col("carried").getField(n).alias(shown[n]) for n in names))


def achieved(mixture: DataFrame, parts: dict[str, int]) -> DataFrame:
    """(source, blocks, target, deviation) at the end of a mixture, in blocks."""
    spark = mixture.sparkSession
    length = mixture.agg((F.max("slot") + 1).alias("length"))
    target = spark.createDataFrame(
        [(s, float(Fraction(p, sum(parts.values())))) for s, p in parts.items()], "source string, weight double"
    )
    have = mixture.groupBy("source").agg(F.countDistinct("slot").alias("blocks"))
    both = have.join(F.broadcast(target), "source").crossJoin(F.broadcast(length))
    return both.select(
        "source", "blocks", (F.col("weight") * F.col("length")).alias("target"),
        (F.col("blocks") - F.col("weight") * F.col("length")).alias("deviation"),
    )
