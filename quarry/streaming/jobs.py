"""Structured Streaming jobs: aggregates, deduplication with and without expiry, and a batched log sink that counts its losses.

``run_to_table`` drives a job over a table of the input folder until it is
drained, and returns what it wrote; the same jobs run on any stream.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry import rules

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir; on a local master without it, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table of the folder as a stream of files; times as timestamps, for watermarks."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    files = table.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        # A stream reads folders, so a table of one file is picked from its folder by name.
        rows = stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    else:
        rows = stream.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def daily_spend(events: DataFrame) -> DataFrame:
    """Spend of each type and day, as days close."""
    windows = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.round(F.sum("value"), 4).alias("spend"))
    return windows.select("event_type", F.to_date("window.start").cast("string").alias("day"), "spend")


def distinct_days(events: DataFrame, late: str | None = None) -> DataFrame:
    """Each user's types of a day, once: verification tokens and the like that live for a while.

    A table's files come in any order of time, so without ``late`` no row is too
    late and the state holds all keys.  An endless stream in order of time may
    name the delay after which keys are forgotten and rows dropped.
    """
    keyed = events.withColumn("day", F.date_trunc("day", "ts"))
    keyed = keyed.withWatermark("day", late) if late else keyed
    return keyed.dropDuplicates(["user_id", "event_type", "day"]).select("user_id", "event_type", F.to_date("day").cast("string").alias("day"))


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose state lies in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def run_to_table(t, name: str, job: Callable[[DataFrame], DataFrame], complete: bool = False) -> DataFrame:
    """What a job writes over the table; a ``complete`` job's last batch is its whole result."""
    own, where = streaming_session(t.spark), work_folder(t.spark, "stream")
    out = job(read_stream(own, t.folder, name))
    writer = out.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
    if complete:

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{where}/out")

        query = writer.outputMode("complete").foreachBatch(replace).start()
    else:
        query = writer.outputMode("append").format("parquet").option("path", f"{where}/out").start()
    query.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{where}/out")


def expiring_distinct(rows: DataFrame, keys: Sequence[str], ts: str, lifetime: str) -> DataFrame:
    """Each key once until it expires: verified tokens, say, which are checked again after their lifetime.

    A key is forgotten once the watermark (the latest time seen, less the lifetime) has
    passed the time at which it was let through, plus the lifetime.  So the state holds
    the keys of some lifetimes and no more, whatever the length of the stream.  Rows
    that are later than the watermark are dropped, as they count as expired.
    """
    return rows.withWatermark(ts, lifetime).dropDuplicatesWithinWatermark(list(keys))


def write_rows(rows: DataFrame, folder: str) -> None:
    """A file for each task: files follow the input's splits, not the number of rows."""
    rows.write.mode("overwrite").parquet(folder)


def log_sink(rows: DataFrame, required: Sequence[str], where: str, writer: Callable[[DataFrame, str], None] = write_rows):
    """Micro-batches of log rows by ``writer``; rows without a required column are dropped and counted.

    A batch is what arrived in SINK_SECONDS, and is written at once: a row waits for
    no other one, so SINK_ROWS, which flushes a buffer early, has no part here (it is
    replayed by ``reports.flushes``).  A batch's number names its folder, so a batch that is written twice
    after a failure is stored once.  Rows are counted while they are written; a
    batch whose writer fails is lost and counted as such, and the stream goes on.
    """
    whole = " AND ".join(f"{c} IS NOT NULL" for c in required)
    sums = [F.count("*").alias("enqueued"), F.count_if(~F.expr(whole)).alias("dropped_invalid"), *(F.count_if(F.col(c).isNull()).alias(f"without_{c}") for c in required)]

    def write(batch: DataFrame, number: int) -> None:
        seen, failed = Observation(), False
        try:
            writer(batch.observe(seen, *sums).where(whole), f"{where}/rows/batch={number}")
            found = seen.get
        except Exception:  # whatever the writer raises, the rows are lost and the stream goes on
            failed, found = True, batch.agg(*sums).first().asDict()
        good = found["enqueued"] - found["dropped_invalid"]
        row = {**found, "flushed": 0 if failed else good, "dropped_on_error": good if failed else 0, "flush_errors": int(failed)}
        names = sorted(row)
        one = batch.sparkSession.createDataFrame([tuple(row[c] for c in names)], ", ".join(f"{c} long" for c in names))
        one.coalesce(1).write.mode("overwrite").parquet(f"{where}/counts/batch={number}")

    sink = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint")
    return sink.trigger(processingTime=f"{rules.SINK_SECONDS} seconds")


def sink_statistics(counts: DataFrame) -> DataFrame:
    """The sink's counters over all its batches: each row is flushed, invalid, or lost with its batch."""
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("enqueued", "flushed", "dropped_invalid", "dropped_on_error", "flush_errors")))


def run_log_sink(t, name: str, required: Sequence[str], counts: bool = False) -> DataFrame:
    """What the sink wrote for a table, or its counts by batch."""
    where = work_folder(t.spark, "log")
    rows = read_stream(streaming_session(t.spark), t.folder, name)
    log_sink(rows, required, where).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{where}/{'counts' if counts else 'rows'}")
