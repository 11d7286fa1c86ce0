"""Numeric curves: column expressions, sampled tables, roots, and checks of their parameters."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 500


def check_range(low: float, high: float) -> None:
    if not low < high:
        raise ValueError("a range needs low < high")


def finite(y: Column) -> Column:
    """Null for what is no finite number."""
    return F.when(F.isnan(y) | (F.abs(y) == math.inf), None).otherwise(y)


def polynomial(coefficients: Sequence[Column], x: Column) -> Column:
    """By Horner's rule, highest power first."""
    return reduce(lambda y, a: y * x + a, coefficients[1:], coefficients[0].cast("double"))


def trigonometric(kind: str, x: Column, amplitude: float = 1.0, frequency: float = 1.0, shift: float = 0.0, limit: float = 10.0) -> Column:
    """amplitude * f(frequency * x) + shift, null beyond the limit where f has asymptotes."""
    if not amplitude:
        raise ValueError("amplitude is zero")
    f = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "sec": F.sec, "csc": F.csc, "cot": F.cot}[kind]
    y = amplitude * f(frequency * x) + shift
    return y if kind in ("sin", "cos") else F.when(F.abs(y) <= limit, y)


def exponential(base: float, x: Column) -> Column:
    if base <= 0 or base == 1:
        raise ValueError("a base is positive and not 1")
    return finite(F.pow(F.lit(float(base)), x))


def logarithm(base: float, x: Column) -> Column:
    if base <= 0 or base == 1:
        raise ValueError("a base is positive and not 1")
    return F.when(x > 0, F.log(x) / math.log(base))


def piecewise(pieces: Sequence[tuple[Column, Column]]) -> Column:
    """The first piece whose test holds, null between pieces."""
    return reduce(lambda out, p: out.when(*p), pieces[1:], F.when(*pieces[0]))


def polar(re: Column, im: Column) -> tuple[Column, Column]:
    """Modulus, and argument in [0, 360) degrees."""
    degrees = F.degrees(F.atan2(im, re))
    return F.sqrt(re * re + im * im), F.when(degrees < 0, degrees + 360).otherwise(degrees)


def quadratic(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Discriminant and real roots, null for none."""
    d = b * b - 4 * a * c
    return d, F.when(d >= 0, (-b - F.sqrt(d)) / (2 * a)), F.when(d >= 0, (-b + F.sqrt(d)) / (2 * a))


def sample(spark: SparkSession, low: float, high: float, f: Callable[[Column], Column], n: int = SAMPLES) -> DataFrame:
    """(i, x, y) at n points from low to high."""
    check_range(low, high)
    x = F.lit(low) + F.col("id") * ((high - low) / (n - 1))
    return spark.range(n).select(F.col("id").alias("i"), x.alias("x")).withColumn("y", f(F.col("x")))


def real_roots(coefficients: Column, low: float, high: float) -> Column:
    """Real roots of polynomials (arrays, highest power first) within a range, each once."""
    import numpy as np

    def roots(a: pd.Series) -> pd.Series:
        out = []
        for row in a:
            found = np.roots(np.trim_zeros(np.asarray(row, float), "f"))
            real = sorted(x.real for x in found if abs(x.imag) < 1e-7 and low <= x.real <= high)
            out.append([float(x) for i, x in enumerate(real) if not i or x - real[i - 1] > 1e-7])
        return pd.Series(out)

    return F.pandas_udf(roots, "array<double>")(coefficients)


def turning_points(coefficients: Column, low: float, high: float) -> Column:
    """(x, y) of the points within a range at which polynomials (arrays, highest power first) are level."""
    n = F.size(coefficients)
    slope = F.transform(F.slice(coefficients, 1, F.greatest(n - 1, F.lit(0))), lambda a, i: a * (n - 1 - i))
    value = lambda x: F.aggregate(coefficients, F.lit(0.0), lambda y, a: y * x + a)
    return F.transform(real_roots(slope, low, high), lambda x: F.struct(x.alias("x"), value(x).alias("y")))


# Spellings of comparison operators.
OPERATORS = {"<": "<", ">": ">", "<=": "<=", ">=": ">=", "=<": "<=", "=>": ">=", "≤": "<=", "≥": ">="}


def operator_of(c: Column) -> Column:
    """A comparison operator in one spelling; null for anything else."""
    bare = F.replace(F.trim(c), F.lit(" "))
    return reduce(lambda out, o: F.when(bare == o[0], o[1]).otherwise(out), OPERATORS.items(), F.lit(None).cast("string"))


def number_text(x: Column, digits: int = 6) -> Column:
    """So many significant digits without trailing zeros, with an exponent below 1e-4 and from 10^digits on; halves go up."""
    shown = F.format_string(f"%.{digits}g", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(shown, r"(\.[0-9]*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")


def axis_text(x: Column) -> Column:
    """Whole numbers as such, others with two decimals at most."""
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", ""))


def added(x: Column, digits: int = 6, minus: str = "−") -> Column:
    """ + 2 or − 2, to follow another term; nothing for 0."""
    return F.when(x == 0, "").otherwise(F.concat(F.when(x > 0, " + ").otherwise(f" {minus} "), number_text(F.abs(x), digits)))


def times_x(a: Column, digits: int = 6) -> Column:
    return F.when(a == 1, "x").otherwise(F.concat(number_text(a, digits), F.lit("x")))


def trigonometric_text(kind: Column, amplitude: Column, period: Column, phase: Column, shift: Column) -> Column:
    """y = 2 sin(3x - 1.5) + 1 from a period and a phase."""
    frequency = 2 * math.pi / period
    inner = F.when(F.abs(frequency - 1) < 1e-9, "x").otherwise(times_x(frequency, 3))
    return F.concat(F.lit("y = "), number_text(amplitude), F.lit(" "), kind, F.lit("("), inner, added(-frequency * phase, 3, "-"), F.lit(")"), added(shift))


def _base(base: Column) -> Column:
    return F.when(F.abs(base - math.e) < 1e-6, "e").otherwise(number_text(base))


def _factor(a: Column) -> Column:
    return F.when(a == 1, "").otherwise(F.concat(number_text(a), F.lit(" · ")))


def exponential_text(base: Column, factor: Column, rate: Column, offset: Column) -> Column:
    """y = 3 · e^(-x) + 1"""
    power = F.when(rate == -1, "-x").otherwise(times_x(rate))
    return F.concat(F.lit("y = "), _factor(factor), _base(base), F.lit("^("), power, F.lit(")"), added(offset))


def logarithm_text(base: Column, factor: Column, scale: Column, offset: Column) -> Column:
    """y = 3 · log_2(4x) − 1, with ln for the natural one."""
    name = F.when(_base(base) == "e", "ln").otherwise(F.concat(F.lit("log_"), _base(base)))
    return F.concat(F.lit("y = "), _factor(factor), name, F.lit("("), times_x(scale), F.lit(")"), added(offset))


def polynomial_text(coefficients: Column) -> Column:
    """x² − 4x + 3 from an array of coefficients, highest power first; 0 if all are 0."""
    n = F.size(coefficients)
    raised = F.array(*map(F.lit, ["", "x", "x²", "x³", "x⁴", "x⁵", "x⁶"]))

    def term(a: Column, i: Column) -> Column:
        power, size = n - 1 - i, F.abs(a)
        shown = F.when((size == 1) & (power > 0), "").otherwise(number_text(size))
        name = F.when(power <= 6, F.get(raised, power)).otherwise(F.concat(F.lit("x^"), power.cast("string")))
        return F.struct((a < 0).alias("minus"), F.concat(shown, name).alias("text"))

    terms = F.filter(F.transform(coefficients, lambda a, i: F.when(a != 0, term(a, i))), lambda t: t.isNotNull())
    signed = F.transform(terms, lambda t, k: F.concat(F.when(k == 0, F.when(t.minus, "-").otherwise("")).otherwise(F.when(t.minus, " − ").otherwise(" + ")), t.text))
    return F.when(F.size(terms) == 0, "0").otherwise(F.array_join(signed, ""))


def number_line(boundary: Column, operator: Column) -> dict[str, Column]:
    """An inequality as a ray: the line's ends, the ray's ends, whether its boundary belongs to it, and its text."""
    op, pad = operator_of(operator), F.greatest(F.lit(4.0), F.abs(boundary) * 0.5)
    low, high, greater = boundary - pad, boundary + pad, op.startswith(">")
    shown = F.replace(F.replace(op, F.lit("<="), F.lit("≤")), F.lit(">="), F.lit("≥"))
    return {
        "low": low, "high": high, "from": F.when(greater, boundary).otherwise(low), "to": F.when(greater, high).otherwise(boundary),
        "closed": F.endswith(op, F.lit("=")), "text": F.concat_ws(" ", F.lit("x"), shown, number_text(boundary)),
    }


def shapes(degrees: DataFrame, degree: str, low: float, high: float, n: int = SAMPLES) -> DataFrame:
    """(degree, sign, i, x, y): the curves x^degree and -x^degree of each row, at n points."""
    check_range(low, high)
    each = degrees.select(F.col(degree).alias("degree"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    points = each.select("degree", "sign", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    x = F.lit(low) + F.col("i") * ((high - low) / (n - 1))
    return points.withColumn("x", x).withColumn("y", F.col("sign") * F.pow("x", "degree"))


def figure_kind(first_trace: Column) -> Column:
    """What a figure shows, by the name of its first trace."""
    name = F.lower(F.coalesce(first_trace, F.lit("")))
    return F.when(name.isin("sin", "cos", "tan", "sec", "cosec", "csc", "cot"), "trig").when(name == "data", "data_points").when(name == "f(x)", "polynomial").otherwise("overlay")


def solution_bands(samples: DataFrame, holds: Column) -> DataFrame:
    """Intervals of x over which an inequality holds, from a sampled curve."""
    marked = samples.withColumn("_ok", holds)
    from quarry.operators.ordered import runs

    bands = runs(marked.withColumn("curve", F.lit(0)), F.col("_ok"), ["curve"], "i")
    ends = samples.select("i", "x")
    return bands.join(ends.select(F.col("i").alias("first"), F.col("x").alias("low")), "first").join(ends.select(F.col("i").alias("last"), F.col("x").alias("high")), "last").select("low", "high", "n")


def overlay(*curves: tuple[str, DataFrame], colours: int = 6) -> DataFrame:
    """Several sampled curves in one table, each with its name and colour number."""
    named = [c.withColumns({"trace": F.lit(n), "colour": F.lit(i % colours)}) for i, (n, c) in enumerate(curves)]
    return reduce(DataFrame.unionByName, named)
