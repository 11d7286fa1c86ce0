"""Tables that change by one switch: data is staged in new folders, and a manifest makes it visible.

A version is a small JSON manifest that names the folders of each table.  It is
written under another name and renamed to its number, which fails if another
writer took that number first.  So readers see the old version or the new one, and
what a failed writer staged is named by no manifest.  Files go through Spark's
file systems, so any store that Spark reads will do.

Defined cases: without a manifest the version is 0 and there are no tables; a table
without folders is None.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import merge
from quarry.streaming.jobs import work_folder


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Rejected(ValueError):
    """Staged rows that may not become visible; ``counts`` says how many break which rule."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(f"staged rows break rules: {counts}")
        self.counts = counts


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def latest(self) -> int:
        folder = self._path("_versions")
        files = folder.getFileSystem(self._conf())
        if not files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The tables (lists of folders) and facts of a version, the latest if none is given."""
        version = self.latest() if version is None else version
        if not version:
            return {"tables": {}, "facts": {}}
        text = self.spark.read.text(f"{self.root}/_versions/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, base: int, tables: dict[str, list[str]], facts: dict | None = None) -> int:
        """Makes version ``base`` + 1; Conflict if there is one."""
        jvm, own = self.spark._jvm, self._path("_versions", f".{uuid.uuid4().hex}.tmp")
        files = own.getFileSystem(self._conf())
        out = files.create(own, True)
        out.write(bytearray(json.dumps({"tables": tables, "facts": facts or {}}).encode()))
        out.close()
        final = self._path("_versions", f"{base + 1:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(own), context.makeQualified(final), no_overwrite)
        except Exception as e:
            files.delete(own, False)
            if files.exists(final):
                raise Conflict(f"version {base + 1} of {self.root} exists") from e
            raise
        return base + 1

    def stage(self, rows: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """A new folder with the rows, which no version names yet."""
        where = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(where)
        return where

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        return self.open(self.manifest(version)["tables"].get(table, []))

    def open(self, folders: Sequence[str]) -> DataFrame | None:
        """Folders of one table, whose partition columns are found in each."""
        if not folders:
            return None
        out = None
        for f in folders:
            one = self.spark.read.parquet(f)
            out = one if out is None else out.unionByName(one)
        return out


def materialize(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written once to the shared folder and read from there."""
    path = f"{work_folder(rows.sparkSession, tag)}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def merge_staged(
    table: Versions, incoming: DataFrame, key: str, rules: dict[str, Column] | None = None, keep: Sequence[str] = (), stamp: Column | None = None, before_switch: Callable[[], None] | None = None
) -> dict[str, int]:
    """Stages ``incoming``, checks it, merges it by ``key`` and switches; returns staged, inserted and updated rows.

    ``rules`` are names and tests that no row may meet.  Null and repeated keys are
    rejected too.  ``before_switch`` runs when all is written and nothing visible.
    """
    base = table.latest()
    staged = table.open([table.stage(incoming)])
    tests = {"null key": F.col(key).isNull(), **(rules or {})}
    repeats = staged.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated key"))
    found = staged.agg(F.count("*").alias("rows"), *(F.count_if(t).alias(name) for name, t in tests.items())).crossJoin(F.broadcast(repeats)).first().asDict()
    broken = {name: n for name, n in found.items() if name != "rows" and n}
    if broken:
        raise Rejected(broken)
    current = table.read("rows", base)
    if current is None:
        counts, merged = {"inserted": found["rows"], "updated": 0}, staged if stamp is None else staged.withColumn("loaded_at", stamp)
    else:
        counts, merged = merge.merge_counts(current, staged, key).first().asDict(), merge.upsert(current, staged, key, keep, stamp)
    folder = table.stage(merged)
    if before_switch:
        before_switch()
    table.commit(base, {"rows": [folder]}, {"staged": found["rows"], **counts})
    return {"staged": found["rows"], **counts}


def append_once(table: Versions, rows: DataFrame, key: str, facts: dict | None = None, attempts: int = 20) -> int:
    """Appends the rows whose key the table does not have; returns how many.

    If another writer comes first, what it added is left out and the switch is
    tried again.
    """
    for _ in range(attempts):
        base = table.latest()
        known = table.manifest(base)
        current = table.open(known["tables"].get("rows", []))
        new = rows.dropDuplicates([key])
        new = new if current is None else new.join(current.select(key), key, "left_anti")
        folder = table.stage(new)
        n = table.open([folder]).count()
        if not n and not facts:
            return 0
        try:
            table.commit(base, {"rows": [*known["tables"].get("rows", []), *([folder] if n else [])]}, {**known["facts"], **(facts or {})})
        except Conflict:
            continue
        return n
    raise Conflict(f"{table.root} changed {attempts} times")
