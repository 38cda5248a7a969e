"""Dense vectors as arrays; arithmetic in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| |b|); null if either is null, of another length, or zero."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def literal(values: list[float]) -> Column:
    """A vector given as numbers, as one constant."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def mean_vector(vector: str, size: int) -> Column:
    """Aggregate: component-wise mean of a column of vectors of this size."""
    return F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(size)])
