"""Operator 4: near duplicates by SimHash with pigeonring filtering.

1. Features of a document are all its distinct words, of equal weight, so a SimHash
   depends on its text alone and a group of copies is found whatever its share of the
   table. The 256-bit SimHash is the majority of their hash bits.
2. Documents of one SimHash become one node, however many copies there are; all that follows is between nodes.
3. No pair of nodes is passed over: nodes are spread over blocks, and every pair of blocks is work of its own. Up to ``DENSE`` nodes a matrix product of
   the first ``FIRST`` bits, as signs, gives the distance in these of all pairs of a tile; a pair that exceeds the distance there exceeds it on the whole.
   Of more nodes the ``SEGMENTS`` segments are searched: a pair within distance differs in at most 2 bits in one of them, so only nodes whose values in a
   segment are that near meet, and of these only those go on whose chain of segments is near. Shares of this search are spread over tasks.
4. What a product leaves must pass the pigeonring test before its full Hamming distance: among the
   segments on the ring some chain has every prefix of l segments differ in at
   most l * distance / m bits. It is necessary for a total within distance. In a tile of which many pairs are left a product of the other bits gives their distances.
5. Of the links of two blocks those go on that join what no other has joined, with the number of links of each node, so that a group of n near copies makes no n * n rows.
   Links are closed to groups by connected components.

Time still grows with the square of the number of nodes, at about a tenth of a product's time a pair: a sixth of all pairs of strangers meet in some segment.

Defined results: documents without words (null, empty or only signs) are never
grouped; repeated
rows are copies of each other; a null id sorts last. The first of a group by
(id, text hash) is kept, of rows equal in both all are marked alike but for one; very long texts are hashed whole; an empty
table gives no rows; other columns are ignored, or carried by ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm import kernel as K
from ragloom.llm.common import checkpointed, doc_key, named
from ragloom.llm.components import components

BITS = 256
DISTANCE = 52
#: Nodes of a block, of which a task holds two; nodes of a side of a tile; bits that all pairs are compared in; links that are held before they are joined.
BLOCK, TILE, FIRST, HELD = 400_000, 1024, 160, 1_000_000
#: Segments of a SimHash where they are searched, those of a chain (of at most 64 bits), pairs of chains at a time.
SEGMENTS, CHAIN, CELLS = 18, 4, 65_536
#: Nodes up to which all products cost less than a search.
DENSE = 80_000
_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
_LOW = np.uint64((1 << 44) - 1)
_SHIFT = np.uint64(44)


def features(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk: first row, rows, and the distinct (row, word) pairs in order of row; a word is 44 bits of its hash."""
    for at, part in K.chunks(arr):
        w = K.words(part)
        pairs = np.unique((w.hash >> np.uint64(20)) | (w.doc.astype(np.uint64) << _SHIFT))
        yield at, len(part), (pairs >> _SHIFT).astype(np.int64), pairs & _LOW


def document_frequency(docs: DataFrame) -> DataFrame:
    """(word, df): in how many documents each word occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        words, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def settle() -> None:
            nonlocal words, df, size
            new, n = np.unique(np.concatenate(held), return_counts=True)
            both = np.concatenate([words, new])
            words, where = np.unique(both, return_inverse=True)
            df = np.bincount(where, np.concatenate([df, n]), len(words)).astype(np.int64)
            held.clear()
            size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(df)], ["word", "part"])

        for batch in batches:
            for _, _, _, f in features(K.strings(batch.column(0))):
                held.append(f)
                size += len(f)
                if size > 2_000_000:
                    settle()
                    if len(words) > 1_000_000:
                        yield out()
                        words, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if held:
            settle()
        yield out()

    parts = docs.select("text").mapInArrow(count, "word long, part long")
    return parts.groupBy("word").agg(F.sum("part").alias("df"))


def sketch(word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """SimHash, as four 64-bit words, of each run of words that begins at start."""
    total = np.diff(np.append(start, len(word)))
    sig = np.empty((len(start), BITS // 64), np.uint64)
    first = 0
    while first < len(start):  # some ten thousand words at a time
        last = max(first + 1, int(np.searchsorted(start, start[first] + 40_000)))
        lo, hi = start[first], start[last] if last < len(start) else len(word)
        bits = np.stack([K.mix(word[lo:hi] ^ s) for s in _SEEDS], 1)
        bits = np.unpackbits(bits.view(np.uint8).reshape(-1, BITS // 8), axis=1)
        kind = np.uint16 if total[first:last].max() < 1 << 16 else np.int64
        ones = np.add.reduceat(bits, start[first:last] - lo, axis=0, dtype=kind).astype(np.int64)
        sig[first:last] = np.packbits(ones * 2 > total[first:last, None], axis=1).view(np.uint64)
        first = last
    return sig


def signatures(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(key, th, node, s0..s3) of every document that has words; node is a hash of the SimHash."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, row, word in features(K.strings(batch.column(2))):
                start = K.run_starts(row)
                if not len(start):
                    continue
                sig = sketch(word, start)
                node = np.zeros(len(sig), np.uint64)
                for k in range(BITS // 64):
                    node = K.mix(node + sig[:, k] + _SEEDS[k])
                pick = pa.array(row[start] + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(node.view(np.int64))]
                    + [pa.array(np.ascontiguousarray(sig[:, k]).view(np.int64)) for k in range(4)],
                    ["key", "th", "node", "s0", "s1", "s2", "s3"],
                )

    return docs.select(*doc_key(id_column), "text").mapInArrow(
        sign, "key long, th long, node long, s0 long, s1 long, s2 long, s3 long"
    )


def chain_viable(differ: np.ndarray, distance: int, length: int = 4) -> np.ndarray:
    """Pigeonring: is there a start on the ring of m segments from which every chain of
    l <= length segments differs in at most l * distance / m bits? differ: (pairs, m)."""
    m = differ.shape[1]
    viable = (differ <= distance // m).any(1)
    rows = np.flatnonzero(viable)  # most pairs have no chain of one segment
    differ = differ[rows]
    good = np.ones(differ.shape, bool)
    total = np.zeros(differ.shape, np.uint16)
    for step in range(1, min(length, m) + 1):
        total += np.roll(differ, 1 - step, axis=1)
        good &= total <= step * distance // m
    viable[rows] = good.any(1)
    return viable


def hamming_within(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Distances of pairs of signatures (n, 4), -1 where they exceed distance; the chain test comes first."""
    out = np.full(len(a), -1, np.int64)
    if not len(a):
        return out
    x = np.ascontiguousarray(a ^ b)
    differ = np.bitwise_count(x.view(np.uint16).reshape(len(x), -1))
    ok = np.flatnonzero(chain_viable(differ, distance))
    d = np.bitwise_count(x[ok]).sum(1).astype(np.int64)
    out[ok[d <= distance]] = d[d <= distance]
    return out


def _joined(rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The component of each row under links between rows, named by a row of it."""
    own = np.arange(rows)
    while len(a):
        low = np.minimum(own[a], own[b])
        np.minimum.at(own, own[a], low)
        np.minimum.at(own, own[b], low)
        own = own[own]
        apart = own[a] != own[b]
        a, b = a[apart], b[apart]
    while (own[own] != own).any():
        own = own[own]
    return own


def _signs(sig: np.ndarray, first: int = 0, end: int = FIRST) -> np.ndarray:
    """Some bits of signatures as 1 and -1."""
    return np.unpackbits(sig.view(np.uint8).reshape(len(sig), -1), axis=1)[:, first:end].astype(np.float32) * 2 - 1


def _true(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a flat mask, looked for by eights."""
    whole = len(mask) // 8 * 8
    at = (np.flatnonzero(mask[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([at[mask[at]], whole + np.flatnonzero(mask[whole:])])


def _near(x: np.ndarray, y: np.ndarray, signs: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs of the signatures x, of these signs, and y within distance."""
    product = signs @ _signs(y).T  # FIRST less twice the bits that differ, without rounding
    at = _true((product >= FIRST - 2 * distance).reshape(-1))
    if len(at) > product.size // 32:  # many near copies: a product of the other bits costs less than a test of each pair
        product += _signs(x, FIRST, BITS) @ _signs(y, FIRST, BITS).T
        return np.divmod(_true((product >= BITS - 2 * distance).reshape(-1)), len(y))
    near = [part[hamming_within(x[part // len(y)], y[part % len(y)], distance) >= 0] for part in np.split(at, range(HELD // 4, len(at), HELD // 4))]
    return np.divmod(np.concatenate(near), len(y))


def segments(distance: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of the segments. The radii plus one add up to distance + 1, so of a pair within distance some segment differs in at most its
    radius; and round the ring some such segment and the next CHAIN - 1 differ in at most the sum of their radii plus CHAIN - 1."""
    spare = distance - SEGMENTS + 1
    width = [BITS // SEGMENTS + (k < BITS % SEGMENTS) for k in range(SEGMENTS)]
    return [(sum(width[:k]), width[k], spare // SEGMENTS + (k < spare % SEGMENTS)) for k in range(SEGMENTS)]


def looked_at(distance: int) -> float:
    """The share of all pairs of random signatures that a search by segments looks at, pairs of each segment by themselves."""
    return sum(math.comb(width, n) / 2**width for _, width, radius in segments(distance) for n in range(radius + 1))


def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of width bits of which at most radius are set."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)], np.int64)


def _segment(sig: np.ndarray, first: int, width: int) -> np.ndarray:
    """Some bits of signatures as numbers."""
    word, shift = divmod(first, 64)
    value = sig[:, word] >> np.uint64(shift)
    if shift + width > 64:
        value = value | sig[:, word + 1] << np.uint64(64 - shift)
    return value & np.uint64((1 << width) - 1)


def _sorted_chains(sig: np.ndarray, ring: list[tuple[int, int, int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of signatures in order of segment k, of each the bits of the segment and above them those of the next on the ring, and where each value begins."""
    chain, at = np.zeros(len(sig), np.uint64), 0
    for n in range(CHAIN):
        first, width, _ = ring[(k + n) % len(ring)]
        chain |= _segment(sig, first, width) << np.uint64(at)
        at += width
    value = _segment(sig, *ring[k][:2]).view(np.int64)
    order = np.argsort(value, kind="stable")
    return order, chain[order], np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << ring[k][1]))])


def _searched(x: np.ndarray, y: np.ndarray, within: bool, distance: int, share: int, shares: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of pairs of the signatures x and y within distance, each once over all shares; where within, y is x and a pair is of different rows.

    Of each segment the rows of x with one value meet the rows of y whose value differs in at most its radius: first their chains of segments, then the whole.
    A pair may be found by several segments and counts where it is found first.
    """
    ring = segments(distance)
    radius = np.array([r for _, _, r in ring])
    limit = sum(np.roll(radius, -n) for n in range(CHAIN)) + CHAIN - 1
    cells = np.empty(CELLS, np.uint64)
    held: list[np.ndarray] = []

    def settle(k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate(held, axis=1)
        held.clear()
        differ = x[a] ^ y[b]
        near = np.flatnonzero(np.bitwise_count(differ).sum(1, dtype=np.int64) <= distance)
        count = np.stack([np.bitwise_count(_segment(differ[near], first, width)) for first, width, _ in ring], 1).astype(np.int64)
        found = (count <= radius) & (sum(np.roll(count, -n, 1) for n in range(CHAIN)) <= limit)
        near = near[found.argmax(1) == k]
        return a[near], b[near]

    for k, (_, width, r) in enumerate(ring):
        begin, end = (len(ring) * len(x) * s // shares - k * len(x) for s in (share, share + 1))
        if begin >= len(x) or end <= 0 or r < 0:
            continue
        masks, rank = _masks(width, r), K.mix(np.arange(1 << width, dtype=np.uint64))
        order, theirs, edge = _sorted_chains(y, ring, k)
        place, mine, own = (order, theirs, edge) if within else _sorted_chains(x, ring, k)
        values = np.flatnonzero(own[1:] > own[:-1])
        values = values[np.argsort(rank[values])]  # near values have like numbers of rows, so they are spread over the shares
        size = own[values + 1] - own[values]
        before = np.cumsum(size) - size
        size = 0
        for u in values[(before >= begin) & (before < end)].tolist():
            v = masks ^ u
            if within:  # each two values meet once
                v = v[rank[v] >= rank[u]]
            n = edge[v + 1] - edge[v]
            upto = np.cumsum(n)
            total = int(upto[-1])
            if not total:
                continue
            at = np.repeat(edge[v] - upto + n, n) + np.arange(total)
            other = theirs[at]
            rows = max(1, CELLS // total)
            for lo in range(own[u], own[u + 1], rows):
                part = mine[lo : min(lo + rows, own[u + 1]), None]
                differ = np.bitwise_xor(part, other, out=cells[: len(part) * total].reshape(-1, total) if total <= CELLS else None)
                near = np.flatnonzero(np.bitwise_count(differ) <= limit[k])
                if len(near):
                    i, j = lo + near // total, at[near % total]
                    if within:
                        once = (j < own[u]) | (j >= own[u + 1]) | (i < j)
                        i, j = i[once], j[once]
                    held.append(np.stack([place[i], order[j]]))
                    size += len(i)
                    if size > HELD // 4:
                        yield settle(k)
                        size = 0
        if held:
            yield settle(k)


def _tiled(x: np.ndarray, y: np.ndarray, within: bool, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all pairs of the signatures x and y within distance, by products of tiles; where within, y is x and a pair is of different rows."""
    for lo in range(0, len(x), TILE):
        mine = x[lo : lo + TILE]
        signs = _signs(mine)
        for at in range(lo if within else 0, len(y), TILE):
            i, j = _near(mine, y[at : at + TILE], signs, distance)
            if within and at == lo:
                once = i < j
                i, j = i[once], j[once]
            yield i + lo, j + at


def _forest(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of rows that are own before the links (a, b), and the links that join them: in each round one out of every component, so fewer than twice the rows."""
    kept = [np.zeros((2, 0), np.int64)]
    while (apart := own[a] != own[b]).any():
        a, b = a[apart], b[apart]
        out = np.unique(np.unique(np.concatenate([own[a], own[b]]), return_index=True)[1] % len(a))
        kept.append(np.stack([a[out], b[out]]))
        own = _joined(len(own), own[a[out]], own[b[out]])[own]
    return own, *np.concatenate(kept, axis=1)


def _links(key: np.ndarray, node: np.ndarray, sig: np.ndarray, distance: int, share: int = 0, shares: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that join all rows that links between the two keys join, or within the one key that there is, and of each row the number of all such links.
    With shares, those of a share of the search by segments."""
    left = np.flatnonzero(key == key[0])
    right = np.flatnonzero(key != key[0])
    within = not len(right)
    right = left if within else right
    own, degree = np.arange(len(key)), np.zeros(len(key), np.int64)
    a, b, held, size = [], [], [], 0

    def settle() -> None:
        nonlocal own, size
        i, j = np.concatenate(held, axis=1)
        degree[:] += np.bincount(i, minlength=len(key)) + np.bincount(j, minlength=len(key))
        own, x, y = _forest(own, i, j)
        a.append(x)
        b.append(y)
        held.clear()
        size = 0

    x, y = sig[left], sig[right]
    for i, j in _searched(x, y, within, distance, share, shares) if shares else _tiled(x, y, within, distance):
        if len(i):
            held.append(np.stack([left[i], right[j]]))
            size += len(i)
            if size > HELD:
                settle()
    if held:
        settle()
    none = np.zeros(0, np.int64)
    return node[np.concatenate([none, *a])], node[np.concatenate([none, *b])], degree


def block_count(nodes: int, parallel: int) -> int:
    """Blocks of nodes: as many as their size asks for, and in smaller tables enough for a dozen pairs of blocks a core."""
    return max(1, math.ceil(nodes / BLOCK), min(math.ceil(nodes / (4 * TILE)), math.ceil(math.sqrt(24 * parallel))))


def compared(nodes: DataFrame, count: int, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """(a, b, links) of nodes (node, s0..s3): links a < b within distance that join all that such links join, links 0; and rows a = b with a number of links
    of the node, which add up to all it has.

    Up to dense nodes, and where distance is so large that segments tell little, all products are made; else the segments are searched. Either passes over no pair.
    """
    parallel = nodes.sparkSession.sparkContext.defaultParallelism
    if count <= dense or looked_at(distance) > 0.25:
        blocks, shares = block_count(count, parallel), 0
    else:
        blocks = math.ceil(count / BLOCK)
        shares = math.ceil(3 * parallel / (blocks * (blocks + 1) // 2))
    each = max(1, shares)
    tasks = min(blocks * (blocks + 1) // 2 * each, 10_000)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            (pair, share), block = divmod(rows[0, 0], each), rows[0, 1]
            if pair != block * (block + 3) // 2 and (rows[:, 1] == block).all():  # two blocks, one of them without nodes
                rows = rows[:1]
            node = rows[:, 2]
            x, y, degree = _links(rows[:, 1], node, np.ascontiguousarray(rows[:, 3:]).view(np.uint64), distance, share, shares)
            some = degree > 0
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.minimum(x, y), node[some]])), pa.array(np.concatenate([np.maximum(x, y), node[some]])),
                    pa.array(np.concatenate([np.zeros(len(x), np.int64), degree[some]])),
                ],
                ["a", "b", "links"],
            )

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            for lo, hi in K.runs(rows[:, 0]):
                if held and held[0][0, 0] != rows[lo, 0]:
                    yield solve()
                held.append(rows[lo:hi])
        if held:
            yield solve()

    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block")
    spread = nodes.select(block, "node", "s0", "s1", "s2", "s3", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    pair = F.expr("greatest(block, other) * (greatest(block, other) + 1) div 2 + least(block, other)")
    if shares:
        spread = spread.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        pair = pair * shares + F.col("share")
    spread = spread.select(pair.alias("pair"), "block", "node", "s0", "s1", "s2", "s3")
    together = spread.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair")
    return together.mapInArrow(match, "a long, b long, links long")


def links(nodes: DataFrame, count: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b) links between nodes (node, s0..s3) within distance that join all that such links join."""
    return compared(nodes, count, distance).where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_column: str = "doc_id") -> DataFrame:
    """(key, th, group_id, group_size, links, keep) of the documents that have near duplicates.

    group_id is the least key of the group, links the number of other SimHashes within the distance of the document's
    (0 if all of its group are copies); keep is true for the one that stays.
    """
    signed = checkpointed(signatures(docs, id_column))
    nodes = signed.dropDuplicates(["node"])
    pairs = checkpointed(compared(nodes, nodes.count(), distance))
    ends = pairs.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    found = components(pairs).join(ends, "node")
    grouped = signed.select("key", "th", "node").join(found, "node", "left")
    grouped = grouped.select("key", "th", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    # A group may hold a large part of all rows: its first row and size come from an aggregate, not a window.
    least = grouped.groupBy("component").agg(
        F.min(F.struct("key", "th")).alias("first"), F.count("*").alias("group_size")
    ).where("group_size > 1")
    out = grouped.join(least, "component").select(
        "key", "th", F.col("first.key").alias("group_id"), "group_size", "links",
        (F.struct("key", "th") == F.col("first")).alias("is_first"),
    )
    again = Window.partitionBy("key", "th").orderBy("is_first")
    return out.select(
        "key", "th", "group_id", "group_size", "links", (F.col("is_first") & (F.row_number().over(again) == 1)).alias("keep")
    )


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs without near duplicates: one row of each group stays, with the columns of docs."""
    gone = near_duplicates(docs, distance).where("not keep")
    gone = gone.groupBy("key", "th").agg(F.count("*").alias("gone_n"))
    names = docs.columns
    key, th = doc_key()
    at = docs.select(F.struct(*named(names)).alias("row"), key, th)
    # Rows equal in id and text are numbered: as many of them go as the groups say.
    number = F.row_number().over(Window.partitionBy("key", "th").orderBy("key"))
    left = at.withColumn("n", number).join(gone, ["key", "th"], "left")
    return left.where(F.col("gone_n").isNull() | (F.col("n") > F.col("gone_n"))).select("row.*")
