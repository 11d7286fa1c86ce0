"""Column expressions on scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import rules


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x); NaN counts as 0 and so gives 0, beyond 700 it is 0 or 1."""
    return F.when(F.isnan(x), 0.0).when(x >= 700, 1.0).when(x <= -700, 0.0).otherwise(1 / (1 + F.exp(-x)))


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def blend(rerank: Column, cosine: Column, text: Column) -> Column:
    return rules.BLEND_RERANK * logistic(rerank) + rules.BLEND_COSINE * cosine + rules.BLEND_TEXT * text


def first_number(*scores: Column) -> Column:
    """The first that is a number, as text or not; 0 if none is."""
    numbers = [s.try_cast("double") for s in scores]
    return F.coalesce(*(F.when(~F.isnan(n), n) for n in numbers), F.lit(0.0))


def min_max(score: Column, *by: str) -> Column:
    """Within a result set: 0 to 1; all 1 if they do not differ."""
    w = W.partitionBy(*by)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return F.round(F.when(span <= 0, 1.0).otherwise((score - low) / span), 6)


def over_max(score: Column, *by: str) -> Column:
    return F.round(score / F.max(score).over(W.partitionBy(*by)), 6)


def reciprocal(rank: Column) -> Column:
    """1 / rank, 0 for none."""
    return F.coalesce(1.0 / rank, F.lit(0.0))
