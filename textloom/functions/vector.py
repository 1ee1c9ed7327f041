"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Metric
from .expr import let


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _pairs(a: Column, b: Column, f) -> Column:
    """The sum of f over both vectors' elements; vectors of unequal length are an error."""
    same = F.size(a) == F.size(b)
    total = _total(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))
    return F.when(same, total).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unequal dimension")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return let(norm(a) * norm(b), lambda size: F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size)))


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """cosine_similarity() with a given vector, whose length is worked out beforehand."""
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    return let(norm(a) * F.lit(size), lambda both: F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, literal(query)), both)))


def distance_to(a: Column, query: Sequence[float], metric: Metric = Metric.COSINE) -> Column:
    """distance() to a given vector."""
    return 1.0 - cosine_to(a, query) if metric is Metric.COSINE else distance(a, literal(query), metric)


def distance(a: Column, b: Column, metric: Metric = Metric.COSINE) -> Column:
    """Smaller is nearer: 1 - cosine (1 without length), L2, L1, or the negated dot product."""
    if metric is Metric.COSINE:
        return 1.0 - cosine_similarity(a, b)
    if metric is Metric.L2:
        return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))
    if metric is Metric.L1:
        return _pairs(a, b, lambda x, y: F.abs(x - y))
    return -dot(a, b)


def normalise(a: Column) -> Column:
    """a of length 1; a vector without length stays."""
    by = lambda size: F.transform(a, lambda x: x.cast("double") / size)
    return let(norm(a), lambda size: by(F.when(size == 0, F.lit(1.0)).otherwise(size)))


def nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)
