"""Keyed merges as joins: upsert, upsert that keeps columns, accumulation, and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, staging: DataFrame, key: str, keep: Sequence[str] = (), stamp: Column | None = None) -> DataFrame:
    """All staged rows, and the target rows that are not staged.

    A match takes every staged value, nulls too, but for the columns to ``keep``.
    ``stamp`` becomes ``loaded_at`` of all staged rows, changed or not.
    """
    t, s = target.alias("t"), staging.alias("s")
    staged = F.col(f"s.{key}").isNotNull()
    both = staged & F.col(f"t.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == "loaded_at" and stamp is not None:
            return F.when(staged, stamp).otherwise(F.col("t.loaded_at"))
        if c in keep:
            return F.when(both | ~staged, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        return F.when(staged, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(*(value(c).alias(c) for c in target.columns))


def accumulate(target: DataFrame, deltas: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    return target.select(*keys, amount).unionByName(deltas.select(*keys, amount)).groupBy(*keys).agg(F.sum(amount).alias(amount))


def merge_counts(target: DataFrame, staging: DataFrame, key: str) -> DataFrame:
    """One row: inserted, updated."""
    joined = staging.select(key).join(target.select(key, F.lit(True).alias("_old")), key, "left")
    return joined.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull()).alias("updated"))


def delete_where(target: DataFrame, stale: Column) -> DataFrame:
    return target.where(~F.coalesce(stale, F.lit(False)))


def update_where(target: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    return target.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})
