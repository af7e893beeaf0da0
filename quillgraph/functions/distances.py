"""Distances of count vectors, given as arrays of one length; and in long form, as (key, a, b) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda t, x: t + x)


def jaccard(a: Column, b: Column) -> Column:
    """1 - shared / all positions that are not zero; 1 for nothing."""
    return 1 - F.coalesce(F.try_divide(_sum(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("double")), _sum(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("double"))), F.lit(0.0))


def generalised_jaccard(a: Column, b: Column) -> Column:
    """1 - sum of the lesser / sum of the greater; 1 for nothing."""
    return 1 - F.coalesce(F.try_divide(_sum(a, b, F.least), _sum(a, b, F.greatest)), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """1 / (1 + sum of the lesser), the default."""
    return 1 / (1 + _sum(a, b, F.least))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either is zero."""
    return 1 - F.coalesce(F.try_divide(_sum(a, b, lambda x, y: x * y), F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def hamming(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x != y).cast("double")).cast("int")


def kullback_leibler(p: Column, q: Column) -> Column:
    """Sum of q log2(q / p); positions without q add nothing."""
    return _sum(p, q, lambda x, y: F.when(y > 0, y * F.log2(F.try_divide(y, x))).otherwise(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Mean divergence of both from their middle."""
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kullback_leibler(mid, p) + kullback_leibler(mid, q)) / 2


def smoothed(counts: Column, delta: float = 0.5) -> Column:
    """Counts as shares, each drawn to equality by ``delta``."""
    total = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x) + delta * F.size(counts)
    return F.transform(counts, lambda c: F.try_divide(c + F.lit(float(delta)), total))


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "jaccard": jaccard, "generalised_jaccard": generalised_jaccard, "overlap": overlap, "cosine": cosine, "euclidean": euclidean, "hamming": hamming, "kullback_leibler": kullback_leibler, "jensen_shannon": jensen_shannon,
}


def distance(kind: str, a: Column, b: Column) -> Column:
    """The distance named ``kind``."""
    return DISTANCES[kind](a, b)


def long_form(kind: str) -> Column:
    """The same over rows with counts ``a`` and ``b`` of one pair: an aggregate for groupBy(pair)."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    if kind == "jaccard":
        return 1 - F.coalesce(F.try_divide(F.count_if((a > 0) & (b > 0)), F.count_if((a > 0) | (b > 0))), F.lit(0.0))
    if kind == "generalised_jaccard":
        return 1 - F.coalesce(F.try_divide(F.sum(F.least(a, b)), F.sum(F.greatest(a, b))), F.lit(0.0))
    if kind == "overlap":
        return 1 / (1 + F.sum(F.least(a, b)))
    if kind == "cosine":
        return 1 - F.coalesce(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))), F.lit(0.0))
    if kind == "euclidean":
        return F.sqrt(F.sum((a - b) * (a - b)))
    if kind == "hamming":
        return F.count_if(a != b).cast("double")
    if kind in ("kullback_leibler", "jensen_shannon"):  # of smoothed shares; a pair's keys are few
        each = F.collect_list(F.struct(a.alias("a"), b.alias("b")))
        p, q = (smoothed(F.transform(each, lambda x, c=c: x[c])) for c in ("a", "b"))
        return distance(kind, p, q)
    raise ValueError(f"{kind} is none of {', '.join(DISTANCES)}")
