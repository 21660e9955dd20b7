"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, summed in double in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def finite(a: Column) -> Column:
    """Whether a vector has no null, NaN or infinite component and isn't null or empty."""
    good = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")))
    return a.isNotNull() & (F.size(a) > 0) & good
