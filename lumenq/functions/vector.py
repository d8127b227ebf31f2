"""Distances of vector columns, in double, as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def parse(text: Column, dim: int | None = None) -> Column:
    """A vector from '[0.1, 0.2]'; with dim, another length raises."""
    v = F.from_json(text, "array<double>")
    if dim is None:
        return v
    wrong = F.concat(F.lit("vector dimension mismatch: expected "), F.lit(dim), F.lit(", got "), F.size(v))
    return F.when(text.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(wrong).cast("array<double>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    """``<->``"""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """``<=>``: 1 when either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / n)


def negative_inner_product(a: Column, b: Column) -> Column:
    """``<#>``"""
    return -dot(a, b)


METRICS = {"l2": l2, "cosine": cosine, "ip": negative_inner_product}
