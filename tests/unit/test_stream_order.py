"""Streams over tables of more files than one trigger takes, whose files are not in order of time."""

from datetime import datetime, timedelta
from types import SimpleNamespace

from quarry.streaming import jobs


def test_dedup_keeps_days_that_come_late(spark, tmp_path):
    def write(day, n):
        rows = [(k, k % 7, "view", datetime(2024, 1, day) + timedelta(hours=k % 48)) for k in range(8 * n)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").repartition(n).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    write(20, 80)
    write(10, 60)
    write(2, 4)
    table = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert len(table.inputFiles()) > 128
    want = {(r.user_id, r.event_type, str(r.ts.date())) for r in table.collect()}
    got = jobs.run_to_table(SimpleNamespace(spark=spark, folder=str(tmp_path)), "events", jobs.distinct_days).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
