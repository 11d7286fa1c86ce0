"""Results that cost: a cache by content that is filled within a budget of calls, and runs that stop and go on.

Both keep their rows in a versioned table, so a result becomes visible with its
batch or not at all, and nothing is computed twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources.versions import Versions, append_once, materialize


def content_key(*values: Column) -> Column:
    """SHA-1 of the values, each with its length, so that no two lists of values meet; null is not empty."""
    parts = [F.coalesce(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha1(F.concat(*parts))


def look_up(cache: Versions, wanted: DataFrame, kind: str) -> DataFrame:
    """``wanted`` (key, ...) with ``value``, null where the cache does not have it."""
    known = cache.read("rows")
    if known is None:
        return wanted.withColumn("value", F.lit(None).cast(kind))
    return wanted.join(known.select("key", "value"), "key", "left")


def fill(cache: Versions, wanted: DataFrame, compute: Callable[[list], list], kind: str, calls: int, call_rows: int) -> dict[str, int]:
    """Computes what the cache lacks of ``wanted`` (key, input), at most ``calls`` calls of ``call_rows`` inputs.

    The missing keys come in their order, each once whatever its number of rows, so
    another run goes on where this one ended.  The inputs of a call meet in one task;
    all calls together take calls x call_rows rows, which the caller chose.  Returns
    the numbers of distinct keys that were hits, filled, and still open.
    """
    needed = materialize(wanted.groupBy("key").agg(F.first("input").alias("input")), "wanted-results")
    known = cache.read("rows")
    missing = needed if known is None else needed.join(known.select("key"), "key", "left_anti")
    now = missing.orderBy("key").limit(calls * call_rows)
    # At most calls x call_rows rows are numbered.
    batched = now.withColumn("call", F.floor((F.row_number().over(W.orderBy("key")) - 1) / call_rows))

    def one_call(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": rows["key"], "value": compute(rows["input"].tolist())})

    asked, open_before = needed.count(), missing.count()
    filled = append_once(cache, batched.groupBy("call").applyInPandas(one_call, f"key string, value {kind}"), "key")
    return {"hits": asked - open_before, "filled": filled, "open": open_before - filled}


def run_parts(table: Versions, rows: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], parts: int, budget_seconds: float, clock: Callable[[], float] = time.monotonic) -> dict[str, int]:
    """Scores ``rows`` part by part until the budget of time is spent; returns done and left parts.

    The first run deals the rows to ``parts`` parts by a hash of their key and stores
    them, so a later run reads what it still has to do and no row moves.  A part's
    results become visible with its number; a run that dies within a part leaves no
    trace of it.
    """
    began = clock()
    if table.latest() == 0:
        dealt = rows.withColumn("part", part_of(F.col(key), parts)).repartition("part")
        table.commit(0, {"pending": [table.stage(dealt, ["part"])], "rows": []}, {"parts": parts, "done": []})
    while True:
        base = table.latest()
        manifest = table.manifest(base)
        done, tables = manifest["facts"]["done"], manifest["tables"]
        left = [p for p in range(manifest["facts"]["parts"]) if p not in done]
        if not left or clock() - began >= budget_seconds:
            return {"done": len(done), "left": len(left)}
        pending = table.open(tables["pending"]).where(F.col("part") == left[0]).drop("part")
        scored = table.stage(score(pending))
        table.commit(base, {**tables, "rows": [*tables["rows"], scored]}, {**manifest["facts"], "done": [*done, left[0]]})


def part_of(key: Column, parts: int) -> Column:
    """A part by MD5, which other engines can repeat."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % parts).cast("int")


def texts_scored(rows: DataFrame, key: str, text: str, scorer: Callable[[list[str]], Iterable[float]]) -> DataFrame:
    """(key, score) by a function of a batch of texts."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "score": list(scorer(b[text].tolist()))})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")
