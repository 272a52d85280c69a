"""Vector expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.text import let

_A, _C, _MOD = 1_664_525, 1_013_904_223, 1 << 32


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; the longer vector's rest is ignored."""
    product = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def steps(dim: int) -> list[tuple[int, int]]:
    """(factor, summand) that lead from a seed to each of its first dim successors."""
    out, factor, summand = [], 1, 0
    for _ in range(dim):
        factor, summand = factor * _A % _MOD, (summand * _A + _C) % _MOD
        out.append((factor, summand))
    return out


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector from a congruential sequence seeded by the low 32 bits of the MD5 of text; null stays null.

    The hash is made in the JVM, so no text goes to Python; each element comes from the seed at once, a batch of vectors a call.
    """
    factor, summand = (np.array(x, np.uint64) for x in zip(*steps(dim), strict=True))

    @F.arrow_udf("array<double>")
    def vectors(seeds: pa.Array) -> pa.Array:
        seed = seeds.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        state = (seed[:, None] * factor + summand) & np.uint64(_MOD - 1)  # what overflows is a multiple of the modulus
        raw = state.astype(np.float64) / float(_MOD - 1) * 2.0 - 1.0
        length = np.sqrt((raw * raw).sum(1, keepdims=True))
        raw /= np.where(length == 0, 1.0, length)
        offsets = np.arange(len(seed) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(raw.reshape(-1)), mask=seeds.is_null())

    return vectors(F.conv(F.substring(F.md5(text), 25, 8), 16, 10).cast("long"))


def unit(a: Column) -> Column:
    """a at length one; a zero vector as it is."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))))
