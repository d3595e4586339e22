"""Vector expressions in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Zero for a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def with_prefix(c: Column, kind: str) -> Column:
    """``kind`` is ``query`` or ``passage``; asymmetric encoders expect it."""
    return F.concat(F.lit(f"{kind}: "), c)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays as sets; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    hit = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), hit / union).otherwise(F.lit(0.0))
