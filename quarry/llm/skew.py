"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many is hot, so there are fewer hot keys than this.
SHARE = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has a key once at most, wherever a third of all rows may have one key.

    Rows are counted by key (combined before the shuffle).  The fewer than SHARE
    hot keys are joined by broadcast, so their rows are not shuffled; all others
    by an ordinary join.  Both tables should be written ones, since they are
    read several times.  Null keys match nothing.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") > max(1, total // SHARE)) & F.col(key).isNotNull())
    hot = [r[0] for r in counts.select(key).collect()]
    if not hot:
        return rows.filter(F.col(key).isNotNull()).join(table, key, how)
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key, how).unionByName(rows.filter(~is_hot).join(table.filter(~is_hot), key, how))
