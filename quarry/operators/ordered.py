"""Order-dependent operators: inheritance, shares, forward fill, islands, windows in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_known(value: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """A row's value, else the first that is known in its group."""
    whole = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return F.coalesce(value, F.first(value, ignorenulls=True).over(whole))


def distribute(total: Column, own: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """A row's own amount, else its share of what the group's total leaves.

    Shares are whole; what is left over goes to the first rows, one each; none is
    less than the total over the rows of the group, or 1.
    """
    group = W.partitionBy(*by)
    missing = own.isNull()
    n, left = F.count_if(missing).over(group), F.greatest(total - F.coalesce(F.sum(own).over(group), F.lit(0)), F.lit(0))
    place = F.count_if(missing).over(group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    share = F.floor(left / n)
    given = share + F.when(place <= left - share * n, 1).otherwise(0)
    least = F.greatest(F.lit(1), F.floor(total / F.count("*").over(group)))
    return F.when(missing, F.greatest(given, least)).otherwise(own).cast("long")


def forward_fill(value: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def island(starts: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """The number of the section that a row is in: sections begin where ``starts`` holds."""
    return F.sum(starts.cast("int")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def runs(df: DataFrame, test: Column, by: Sequence[str], order: str) -> DataFrame:
    """Maximal runs of rows where ``test`` holds: first and last ``order`` value, and rows."""
    w = W.partitionBy(*by).orderBy(order)
    marked = df.withColumn("_ok", test).withColumn("_run", F.row_number().over(w) - F.row_number().over(W.partitionBy(*by, "_ok").orderBy(order)))
    return marked.where("_ok").groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def trailing_counts(df: DataFrame, by: Sequence[str], ts: str, seconds: Sequence[int]) -> DataFrame:
    """``n_<s>``: rows of the key in the s seconds up to and including this one (both ends count)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    df = df.withColumn("_at", at)
    over = lambda s: F.count("*").over(W.partitionBy(*by).orderBy("_at").rangeBetween(-s * 1_000_000, 0))
    return df.withColumns({f"n_{s}": over(s) for s in seconds}).drop("_at")


def cap_crossing(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: str, cap: float) -> DataFrame:
    """Running total of each group, and whether this row is the first to reach the cap."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("running", F.round(F.sum(amount).over(w), 6))
    return out.withColumn("crosses", (F.col("running") >= cap) & (F.col("running") - F.col(amount) < cap))


def share_of_total(df: DataFrame, *by: str) -> DataFrame:
    """Rows of each group and their share of all, by one more row of totals."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))
