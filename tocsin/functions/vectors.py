"""Expressions on dense arrays and on score arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


TIE_DIGITS = 9  # scores that agree to this many decimals are a draw


def arg_max(scores: Column) -> Column:
    """Zero-based position of the largest score, the first one on a draw.

    Sums of the same numbers in another order differ in their last bits, so
    equal scores are recognised after rounding.
    """
    rounded = F.transform(scores, lambda s: F.round(s, TIE_DIGITS))
    return (F.array_position(rounded, F.array_max(rounded)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(exps, lambda e: e / total)


def class_name(position: Column, classes: list[str]) -> Column:
    """Name at a zero-based position of a literal list."""
    return F.get(F.array(*[F.lit(c) for c in classes]), position)
