"""Vectors as arrays: column expressions without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _v(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_v(a), _v(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_v(a), F.lit(0.0), lambda s, x: s + x * x))


def unit(a) -> Column:
    """The vector at length one; zero vectors stay."""
    n = norm(a)
    return F.transform(_v(a), lambda x: x / F.when(n > 0, n).otherwise(1.0))


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n > 0, n).otherwise(1.0)


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_v(a), _v(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def usable(a, dim: int | None = None) -> Column:
    """Not null, of length ``dim`` if given, all values finite, not all zero."""
    v = _v(a)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = ok if dim is None else ok & (F.size(v) == dim)
    return F.coalesce(ok, F.lit(False))


def pair_features(a, b) -> Column:
    """Absolute differences, then products."""
    return F.concat(F.zip_with(_v(a), _v(b), lambda x, y: F.abs(x - y)), F.zip_with(_v(a), _v(b), lambda x, y: x * y))


def fuse(blocks: list[Column], weights: list[float]) -> Column:
    """Unit blocks, each times the root of its share of the weights, in one vector."""
    total = sum(weights)
    scaled = lambda w: lambda x: x * (w / total) ** 0.5
    return F.concat(*[F.transform(unit(b), scaled(w)) for b, w in zip(blocks, weights)])


def language_block(vec, lang, vocabulary: list[str], weight: float = 3.0) -> Column:
    """The unit vector with a block for languages that pushes other languages away."""
    flags = F.array(*[F.when(F.col(lang) == v, F.lit(weight**0.5)).otherwise(0.0) for v in vocabulary])
    return F.concat(unit(vec), flags)
