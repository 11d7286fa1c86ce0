"""Versioned tables, caches, resumable runs, recomputation, write-back, walks, streams with loss and expiry."""

import datetime as dt
import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation, paid_results
from quarry.sources import incremental, markdown
from quarry.sources.versions import Conflict, Rejected, Versions, append_once, merge_staged
from quarry.streaming import jobs


@pytest.fixture()
def table(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/table")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "key long, text string")


def test_a_version_is_seen_whole_or_not_at_all(spark, table):
    assert table.latest() == 0 and table.read("rows") is None
    assert merge_staged(table, rows(spark, (1, "a"), (2, "b")), "key") == {"staged": 2, "inserted": 2, "updated": 0}

    def fail():
        raise OSError("lost between stage and switch")

    with pytest.raises(OSError):
        merge_staged(table, rows(spark, (2, "B"), (3, "c")), "key", before_switch=fail)
    assert table.latest() == 1 and sorted(map(tuple, table.read("rows").collect())) == [(1, "a"), (2, "b")]
    assert merge_staged(table, rows(spark, (2, "B"), (3, "c")), "key") == {"staged": 2, "inserted": 1, "updated": 1}
    assert sorted(map(tuple, table.read("rows").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, table.read("rows", 1).collect())) == [(1, "a"), (2, "b")]


def test_staged_rows_that_break_rules_stay_unseen(spark, table):
    with pytest.raises(Rejected) as e:
        merge_staged(table, rows(spark, (1, "a"), (1, "b"), (None, "c"), (4, "")), "key", {"empty text": F.col("text") == ""})
    assert e.value.counts == {"null key": 1, "repeated key": 1, "empty text": 1} and table.latest() == 0


def test_the_second_of_two_writers_meets_a_conflict(spark, table):
    merge_staged(table, rows(spark, (1, "a")), "key")
    with pytest.raises(Conflict):
        merge_staged(table, rows(spark, (2, "b")), "key", before_switch=lambda: table.commit(1, table.manifest(1)["tables"]))
    assert table.latest() == 2 and table.read("rows").count() == 1


def test_append_once(spark, table):
    assert append_once(table, rows(spark, (1, "a"), (1, "a"), (2, "b")), "key") == 2
    assert append_once(table, rows(spark, (2, "other"), (3, "c")), "key") == 1
    assert append_once(table, rows(spark, (3, "c")), "key") == 0 and table.latest() == 2
    assert sorted(map(tuple, table.read("rows").collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_cache_computes_each_content_once_within_its_calls(spark, table, tmp_path):
    log = f"{tmp_path}/calls"

    def lengths(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [len(t) for t in texts]

    texts = spark.createDataFrame([(k, "x" * (k % 23)) for k in range(100)], "id long, input string").withColumn("key", paid_results.content_key(F.col("input")))
    fill = lambda calls: paid_results.fill(table, texts.select("key", "input"), lengths, "long", calls, 5)
    assert fill(2) == {"hits": 0, "filled": 10, "open": 13}
    assert sorted(map(int, open(log).read().split())) == [5, 5]
    assert fill(2) == {"hits": 10, "filled": 10, "open": 3}
    assert fill(9) == {"hits": 20, "filled": 3, "open": 0}
    assert fill(9) == {"hits": 23, "filled": 0, "open": 0}
    assert sorted(map(int, open(log).read().split())) == [3, 5, 5, 5, 5]
    got = paid_results.look_up(table, texts, "long").collect()
    assert len(got) == 100 and all(r["value"] == len(r["input"]) for r in got)


def test_content_keys_tell_lists_of_values_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("abc", ""), ("abc", None), ("1:a", "x"), ("a", "1:x")], "a string, b string")
    assert df.select(paid_results.content_key(F.col("a"), F.col("b"))).distinct().count() == 6


def test_stopped_and_resumed_runs_equal_one(spark, table, tmp_path):
    docs = spark.createDataFrame([(k, "w " * (k % 9)) for k in range(60)], "id long, text string")
    score = lambda part: paid_results.texts_scored(part, "id", "text", lambda ts: [float(len(t)) for t in ts])
    ticks = iter(range(100))
    assert paid_results.run_parts(table, docs, "id", score, 5, 2.5, lambda: next(ticks)) == {"done": 2, "left": 3}

    def dies(part):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        paid_results.run_parts(table, docs, "id", dies, 5, 1e9)
    assert table.manifest()["facts"]["done"] == [0, 1]
    assert paid_results.run_parts(table, docs, "id", score, 5, 1e9) == {"done": 5, "left": 0}
    whole = Versions(spark, f"file://{tmp_path}/whole")
    paid_results.run_parts(whole, docs, "id", score, 5, 1e9)
    assert sorted(map(tuple, table.read("rows").collect())) == sorted(map(tuple, whole.read("rows").collect())) == [(k, 2.0 * (k % 9)) for k in range(60)]


def test_only_stale_outputs_are_written_again(spark, tmp_path):
    inputs, outputs, rules = tmp_path / "in", tmp_path / "out", tmp_path / "rules.txt"
    inputs.mkdir()
    past = time.time() - 1000
    for n in ("a", "b", "c"):
        (inputs / f"{n}.md").write_text(f"text {n}")
        os.utime(inputs / f"{n}.md", (past, past))
    upper = lambda files: files.select("name", F.upper("text").alias("clean"))
    run = lambda: incremental.recompute(spark, f"file://{inputs}", f"file://{outputs}", f"file://{rules}", upper, "*.md")
    times = lambda: {p.parent.name: p.stat().st_mtime_ns for p in outputs.rglob("*.parquet")}
    assert run() == {"new": 3}
    first = times()
    assert run() == {"fresh": 3} and times() == first
    (inputs / "b.md").write_text("text b2")
    os.utime(inputs / "b.md", (time.time() + 2, time.time() + 2))
    assert run() == {"fresh": 2, "input": 1}
    second = times()
    assert {n for n in second if second[n] != first[n]} == {"name=b"}
    os.utime(inputs / "b.md", (past, past))
    rules.write_text("a rule")
    os.utime(rules, (time.time() + 2, time.time() + 2))
    (inputs / "c.md").unlink()
    assert run() == {"rules": 2, "orphan": 1}
    assert {r["name"]: r["clean"] for r in spark.read.parquet(str(outputs)).collect()} == {"a": "TEXT A", "b": "TEXT B2", "c": "TEXT C"}


def test_references_are_written_back_once(spark, tmp_path):
    (tmp_path / "x.md").write_text("# Paper\n\nBody: é\n\n\n")
    (tmp_path / "y.md").write_text("Body\n---\n\n## Cross-references (machine-readable)\n\n```yaml\nold\n```\n")
    (tmp_path / "z.md").write_text("No parts\n")
    files = lambda: markdown.read_files(spark, f"file://{tmp_path}")
    paths = {r["name"]: r["path"] for r in files().collect()}
    parts = spark.createDataFrame([(paths["x.md"], 2, "p2", None, None), (paths["x.md"], 1, "p1", "Surds: é", ["a-1", "b-2"]), (paths["y.md"], 1, "q", "t", [])], "path string, place int, part_id string, topic string, tutorials array<string>")
    blocks = markdown.render_references(parts)
    assert markdown.write_back(markdown.with_references(files(), blocks)) == 2
    block = "\n---\n\n## Cross-references (machine-readable)\n\n```yaml\ncross_references:\n- part_id: p1\n  topic: 'Surds: é'\n  tutorials:\n  - a-1\n  - b-2\n- part_id: p2\n  topic: null\n  tutorials: []\n```\n"
    assert (tmp_path / "x.md").read_text() == "# Paper\n\nBody: é\n" + block
    assert (tmp_path / "y.md").read_text().startswith("Body\n\n---\n\n## Cross") and "old" not in (tmp_path / "y.md").read_text()
    before = {p.name: p.stat().st_mtime_ns for p in tmp_path.iterdir()}
    assert markdown.write_back(markdown.with_references(files(), blocks)) == 0
    assert {p.name: p.stat().st_mtime_ns for p in tmp_path.iterdir()} == before and len(before) == 3


def test_walk_counts_every_file_in_one_pass(spark, tmp_path):
    texts = {"_SUMMARY-a.md": "---\nslug: s\n---\n", "README.md": "hello", "plain.md": "no front matter", "empty.md": "", "noslug.md": "---\ntitle: t\n---\nb", "blank.md": "---\nslug: \n---\nb", "good.md": "---\nslug: 'g-1'\n---\nbody", "two.md": "---\ntitle: x\nslug: two\n---\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found, seen = markdown.walk(markdown.read_files(spark, f"file://{tmp_path}"))
    assert sorted((r["name"], r["slug"]) for r in found.collect()) == [("good.md", "g-1"), ("two.md", "two")]
    counts = seen.get
    assert counts == {"walked": 8, "parsed": 2, "summary": 1, "readme": 1, "no_front_matter": 2, "no_slug": 2}
    assert counts["walked"] == counts["parsed"] + sum(counts[r] for r in markdown.SKIP_REASONS)


def test_round_robin(spark):
    data = [("abc"[k % 3] if k < 12 else "d", k) for k in range(40)] + [(None, 99)]
    strata = {}
    for s, k in data:
        strata.setdefault(s, []).append(k)
    for n in (0, 1, 5, 17, 100):
        want, left = [], {s: sorted(v) for s, v in sorted(strata.items(), key=lambda x: (x[0] is None, x[0] or ""))}
        while len(want) < n and any(left.values()):
            want += [(s, v.pop(0)) for s, v in left.items() if v]
        got = evaluation.round_robin(spark.createDataFrame(data, "stratum string, key long"), "stratum", ["key"], n)
        assert sorted(map(str, got.select("stratum", "key").collect())) == sorted(f"Row(stratum={s!r}, key={k})" for s, k in want[:n])


def _batches(spark, folder, batches):
    """A table of files, one for each batch, in order of their times."""
    for k, some in enumerate(batches):
        path = f"{folder}/events.parquet/part-{k:03d}.parquet"
        spark.createDataFrame(some, "token string, ts timestamp, value double").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(_made(path))
        os.utime(path, (1e9 + k, 1e9 + k))
    return jobs.read_stream(jobs.streaming_session(spark), str(folder), "events", 1)


def _made(path):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_expired_keys_return_and_the_state_stays_small(spark, tmp_path):
    batches = [[("t", at(0), 1.0), ("t", at(3), 1.0)], [("t", at(9), 1.0), ("u", at(8), 1.0)], [("t", at(5), 1.0)]]
    batches += [[(f"n{k}-{i}", at(20 + 10 * k), 1.0) for i in range(20)] for k in range(12)]
    batches += [[("t", at(150), 1.0), ("t", at(151), 1.0)]]
    stream = _batches(spark, tmp_path, batches)
    out = jobs.expiring_distinct(stream, ["token"], "ts", "10 minutes")
    query = out.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/o").start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/o").select("token", "ts").collect()]
    assert len(got) == 2 + 1 + 240 and sum(t == "u" for t, _ in got) == 1
    t = sorted(ts for n, ts in got if n == "t")
    assert len(t) == 2 and t[0] <= at(3) and t[1] >= at(150)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 100


def test_sink_counts_what_a_failing_writer_loses(spark, tmp_path):
    batches = [[(None if i % 4 == 0 else f"b{k}", at(k), 1.0) for i in range(12)] for k in range(4)]
    stream = _batches(spark, tmp_path, batches)

    def writer(rows, folder):
        if folder.endswith("batch=1"):
            raise OSError("warehouse is gone")
        jobs.write_rows(rows, folder)

    jobs.log_sink(stream, ["token", "ts"], str(tmp_path / "log"), writer).trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(str(tmp_path / "log/counts"))
    assert jobs.sink_statistics(counts).first().asDict() == {"enqueued": 48, "flushed": 27, "dropped_invalid": 12, "dropped_on_error": 9, "flush_errors": 1}
    assert spark.read.parquet(str(tmp_path / "log/rows")).count() == 27
    assert counts.agg(F.sum("without_token"), F.sum("without_ts")).first()[:] == (12, 0)
    assert SimpleNamespace(**counts.where("batch = 1").first().asDict()).dropped_on_error == 9


def test_sink_files_follow_tasks_not_rows(spark, tmp_path):
    """A batch of thousands of rows is a few files: with one for each hundred rows, files grew with the table."""
    stream = _batches(spark, tmp_path, [[(f"b{i}", at(i % 50), 1.0) for i in range(3000)] for _ in range(2)])
    jobs.log_sink(stream, ["token", "ts"], str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "log/rows"))
    assert rows.count() == 6000 and len(rows.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
