"""Vectors and matrices (arrays of rows) as Column functions; sums are in double precision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: a column named inside a function of array entries is computed for each
    entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """null for a vector of no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    """F7"""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit(v: Column) -> Column:
    """Of length 1; null for a vector of no length."""
    return bound(norm(v), lambda length: F.when(length > 0, F.transform(v, lambda x: x / length)))


def pool_mean(ft: Column, drop_edges: bool = False) -> Column:
    """V1: mean over time; drop_edges leaves out the first and last step. Null if nothing is left."""
    rows = F.slice(ft, F.lit(2), F.greatest(F.size(ft) - 2, F.lit(0))) if drop_edges else ft
    sums = F.aggregate(rows, F.transform(rows[0], lambda x: F.lit(0.0)), lambda acc, row: F.zip_with(acc, row, lambda a, x: a + x))
    return bound(F.size(rows), lambda n: F.transform(sums, lambda x: x / n))


def pool_first(ft: Column) -> Column:
    """V2"""
    return F.try_element_at(ft, F.lit(1))


def pool_last(ft: Column) -> Column:
    """V2"""
    return F.try_element_at(ft, F.lit(-1))


def zero_if_missing(v: Column, dim: int) -> Column:
    """V3: zeros for a null or empty vector."""
    return F.when(F.coalesce(F.size(v), F.lit(0)) <= 0, F.array_repeat(F.lit(0.0), dim)).otherwise(v)


def squeeze_batch(ft: Column) -> Column:
    """V4: without a leading axis of 1."""
    return F.element_at(ft, 1)


def downsample_mean(ft: Column, n: int) -> Column:
    """V5: means of blocks of n steps, the last one maybe shorter."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(ft) - 1) / n).cast("int"))
    return F.transform(blocks, lambda k: pool_mean(F.slice(ft, k * n + 1, F.lit(n))))


def clip_to(ft: Column, n: int) -> Column:
    """V6"""
    return F.slice(ft, 1, n)


def pad_to(v: Column, n: int | Column, zero: Column | None = None) -> Column:
    """V6: zeros, or copies of `zero`, up to n entries."""
    missing = F.greatest(F.lit(n) - F.size(v) if isinstance(n, int) else n - F.size(v), F.lit(0))
    return F.concat(v, F.array_repeat(F.lit(0.0) if zero is None else zero, missing))


def zscore(v: Column) -> Column:
    """V9: by a row's own mean and population deviation; 0 where that is 0."""
    scaled = lambda mean, dev: F.transform(v, lambda x: F.coalesce(F.try_divide(x - mean, dev), F.lit(0.0)))
    dev = lambda mean: F.sqrt(F.try_divide(total(F.transform(v, lambda x: (x - mean) * (x - mean))), F.size(v)))
    return bound(F.try_divide(total(v), F.size(v)), lambda mean: bound(dev(mean), lambda d: scaled(mean, d)))


def scale_minmax(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """0 where largest and least are the same."""
    scaled = lambda a, b: F.transform(v, lambda x: F.when(b == a, F.lit(0.0)).otherwise((x - a) / (b - a) * (high - low) + low))
    return bound(F.struct(F.array_min(v).alias("a"), F.array_max(v).alias("b")), lambda ends: scaled(ends["a"], ends["b"]))


def scale_by(v: Column, divisor: float) -> Column:
    """V10"""
    return F.transform(v, lambda x: x / divisor)


def standardize(v: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def fuse(*vectors: Column) -> Column:
    """The modalities' vectors one after the other."""
    return F.concat(*vectors)


def length_mask(items: Column) -> Column:
    """V19"""
    return F.transform(items, lambda _: F.lit(1))


def fused_dims(name: Column, dims: dict[str, int], modalities: Sequence[str] = "AVL") -> Column:
    """Map of modality to the dimension of the feature that a name such as A<ft>-V<ft>-L<ft> gives it."""
    parts = F.filter(F.split(name, "-"), lambda p: F.substring(p, 1, 1).isin(*modalities))
    table = F.create_map(*[F.lit(x) for pair in dims.items() for x in pair])
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1), F.coalesce(table[F.substr(p, F.lit(2))], F.lit(0)))))
