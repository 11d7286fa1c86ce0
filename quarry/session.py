"""Sessions, and the package's code on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that the library's plans are written for.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows and bytes that a Python worker gets at once: long texts stay bounded.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    # Spark 4.1 takes a union for partitioned as its parts are, also where their partitions do
    # not match, and then groups and joins by key come out wrong.
    "spark.sql.unionOutputPartitioning": "false",
}
#: Those that results or bounds depend on; they are set in any session.
NEEDED = [k for k in SETTINGS if ".arrow.max" in k or ".union" in k]


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; further settings use ``__`` for dots."""
    builder = SparkSession.builder.appName("quarry")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once per context, and makes the NEEDED settings.

    A cluster that has it installed, or got it by --py-files, loses nothing.
    """
    for key in NEEDED:
        spark.conf.set(key, SETTINGS[key])
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "quarry.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    context.addPyFile(target)
    context._quarry_shipped = True
