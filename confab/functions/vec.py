"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """VEC-01."""
    return dot(a, b) / (norm(a) * norm(b))


def clipped_cosine(a: Column, b: Column) -> Column:
    """VEC-04: norms of at least 1e-9, result within [-1, 1]."""
    floor = F.lit(1e-9)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))))


def l2_normalize(a: Column) -> Column:
    """VEC-02: a zero vector stays."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))


def best_two_mean(scores: Column) -> Column:
    """VEC-03: mean of the best two scores; of one, itself; of none, -1."""
    best = F.slice(F.reverse(F.array_sort(scores)), 1, 2)
    return F.when(F.size(best) == 0, F.lit(-1.0)).otherwise(F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / F.size(best))


def reservoir_score(probe: Column, reservoir: Column, centroid: Column) -> Column:
    """VEC-03 over a profile: its kept vectors and its centroid (null: none)."""
    all_ = F.concat(F.coalesce(reservoir, F.array()), F.when(centroid.isNotNull(), F.array(centroid)).otherwise(F.array()))
    return best_two_mean(F.transform(all_, lambda v: cosine(probe, v)))


def in_plane_ratio(v: Column, basis: list[list[float]]) -> Column:
    """VEC-06: which share of a vector's length two basis vectors explain; 0 for a zero vector."""
    p = [dot(v, F.array(*[F.lit(float(x)) for x in b])) for b in basis]
    n = norm(v)
    return F.when(n > 0, F.sqrt(sum((x * x for x in p), F.lit(0.0))) / n).otherwise(F.lit(0.0))


def mean_pairwise_cosine(vectors: Column) -> Column:
    """AGG-26: mean cosine of all pairs of an array of vectors; null under two. Arrays are small (a candidate's vectors)."""

    def mean(v: Column) -> Column:
        n = F.size(v)
        at = lambda i: F.element_at(v, (i + 1).cast("int"))
        row = lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: cosine(at(i), at(j)))
        total = F.aggregate(F.flatten(F.transform(F.sequence(F.lit(0), n - 2), row)), F.lit(0.0), lambda acc, x: acc + x)
        return F.when(n >= 2, total / (n * (n - 1) / 2))

    return let(vectors, mean)
