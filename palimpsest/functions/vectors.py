"""Vectors as arrays of double."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import bounded_batches


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column, norms: tuple[Column, Column] | None = None) -> Column:
    """0 if a norm is 0; null if the sizes differ. ``norms``: those of both, where they are there already."""
    a, b = doubles(a), doubles(b)
    size = norms[0] * norms[1] if norms else norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def with_norm(df: DataFrame, v: str, name: str) -> DataFrame:
    """The vectors as doubles with their norms: once a row, before a join repeats it."""
    return df.withColumn(v, doubles(F.col(v))).withColumn(name, norm(F.col(v)))


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def _mean(v: Column, start: Column, size: Column) -> Column:
    """Mean of ``size`` elements from the one with index ``start`` (0: first)."""
    return _sum(F.slice(v, (start + 1).cast("int"), size.cast("int"))) / size


def bucket_compressed(v: Column, dim: int) -> Column:
    """Means of ``dim`` buckets whose bounds are rounded down, normalised; a vector that is short enough stays."""
    v, n = doubles(v), F.size(v)
    start = lambda i: F.floor(i * n / F.lit(dim))
    means = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _mean(v, start(i), start(i + 1) - start(i)))
    return F.when(n <= dim, v).otherwise(normalised(means))


def decay_compressed(v: Column, factor: Column, least: int, most: int) -> Column:
    """Means of buckets of equal size, as many as the decay factor leaves, normalised."""
    v, n = doubles(v), F.size(v)
    dim = F.least(n, F.greatest(F.lit(least), F.least(F.lit(most), F.floor(n * F.least(F.lit(1.0), F.greatest(F.lit(0.0), factor))).cast("int"))))
    bucket = F.ceil(n / dim).cast("int")
    starts = F.sequence(F.lit(0), n - 1, bucket)
    means = F.transform(starts, lambda i: _mean(v, i, F.least(bucket, n - i)))
    return F.when(dim >= n, v).otherwise(normalised(means))


#: Code points that are hashed at a time.
HASHED_AT_ONCE = 1 << 16
_PRIME, _MASK = 16777619, 0xFFFFFFFF


def fnv1a(text: str) -> int:
    """FNV-1a, 32 bits, over code points; an empty text counts as one 0.

    Multiplying by an odd number carries upwards only: given all lower bits, a bit of the hash is the
    exclusive or of bits before it, and what a code point changes depends on as many low bits
    as it has. With the changes known, the hash is a sum of them times powers.
    """
    points = np.frombuffer((text or "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    h = 2166136261
    if len(points) < 64:
        for c in points.tolist():
            h = (h ^ c) * _PRIME & _MASK
        return h
    for at in range(0, len(points), HASHED_AT_ONCE):
        part = points[at : at + HASHED_AT_ONCE]
        bits = int(part.max()).bit_length()
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
        own, low, prime = part.astype(kind), np.zeros(len(part), kind), kind(_PRIME & np.iinfo(kind).max)
        for k in range(bits):
            bit = kind(1 << k)
            turned = (own ^ (((own ^ low) & (bit - kind(1))) * prime)) & bit
            low[1:] |= np.bitwise_xor.accumulate(turned)[:-1] ^ (kind(h & 1 << k))
            low[0] |= kind(h & 1 << k)
        change = (low ^ own).astype(np.uint32) - low.astype(np.uint32)
        powers = _powers()[: len(part)]
        h = (h * int(powers[-1]) + int((change * powers[::-1]).sum(dtype=np.uint64))) & _MASK
    return h


@cache
def _powers() -> np.ndarray:
    """The prime to the powers from 1 on."""
    return np.multiply.accumulate(np.full(HASHED_AT_ONCE, _PRIME, np.uint32), dtype=np.uint32)


def fingerprint(text: Column, dim: int = 32) -> Column:
    """A unit vector from the text: FNV-1a of its code points, stepped by xorshift."""
    bounded_batches()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array([1 if t is None else fnv1a(t) or 1 for t in s], np.uint32)
            v = np.empty((len(s), dim))
            for k in range(dim):
                x ^= x << np.uint32(13)
                x ^= x >> np.uint32(17)
                x ^= x << np.uint32(5)
                v[:, k] = x / float(_MASK) * 2 - 1
            size = np.zeros(len(s))
            for k in range(dim):  # in order, as columns are added up
                size += v[:, k] * v[:, k]
            v /= np.sqrt(size)[:, None]
            yield pd.Series([None if t is None else row for t, row in zip(s, v, strict=True)], dtype=object)

    return run(text)


def padded(v: Column, dim: int) -> Column:
    """Cut or filled up with zeros to ``dim``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(dim) - F.size(v)))), 1, dim)


def trimmed(v: Column, dim: Column) -> Column:
    return F.slice(v, F.lit(1), dim)
