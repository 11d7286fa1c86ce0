"""State machines, merges, evaluation and curves on small made-up rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import checks, curves, evaluation, gates, merge, ordered, retrieval
from quarry.operators.gates import Breaker, Cache, Limiter, Subnet


def test_limiter():
    a = Limiter("anonymous")
    assert [a.decide(t) for t in (0, 59, 61, 120, 86461, 86462)] == ["ok", "minute_cap", "ok", "soft_wall", "ok", "minute_cap"]
    edge = Limiter("anonymous")
    assert [edge.decide(0), edge.decide(60)] == ["ok", "minute_cap"]
    other = Limiter("unknown")
    assert [other.decide(t) for t in (0, 61, 200)] == ["ok", "ok", "day_cap"]
    paying = Limiter("paying")
    assert [paying.decide(i * 0.5) for i in range(61)].count("minute_cap") == 1


def test_subnet_flag():
    s = Subnet()
    got = [s.decide(i) for i in range(15)]
    assert got == ["ok"] * 12 + ["subnet_cap"] * 3 and s.flagged(15) and not s.flagged(14 + 7 * 86400)


def test_breaker_and_cache():
    b = Breaker()
    assert [b.record(t, True) for t in range(5)] == ["closed"] * 4 + ["open"]
    assert b.record(10, False) == "open" and b.is_open(303) and not b.is_open(304)
    spread = Breaker()
    assert all(spread.record(t * 61, True) == "closed" for t in range(10))
    c = Cache()
    assert [c.look_up(t, 10) for t in (0, 10, 11, 21)] == ["miss", "hit", "stale", "hit"]


def test_fold_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, i * 20), "k") for i in range(3)] + [(10 + i, dt.datetime(2024, 1, 1, 0, 2 + i), "k") for i in range(4)]
    events = spark.createDataFrame([(*r, "anonymous") for r in rows], "event_id long, ts timestamp, key string, tier string")
    got = {r.event_id: r.decision for r in gates.limit_requests(events, "key", "tier").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert [got[k] for k in (0, 1, 2, 10, 11, 12, 13)] == ["ok", "minute_cap", "minute_cap", "ok", "soft_wall", "soft_wall", "soft_wall"]


def test_merge(spark):
    schema = "key string, a int, flag boolean, loaded_at timestamp"
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    target = spark.createDataFrame([("x", 1, True, old), ("y", 2, True, old), ("z", 3, False, old)], schema)
    staging = spark.createDataFrame([("x", None, False, None), ("y", 2, False, None), ("w", 9, False, None)], schema)
    got = {r.key: tuple(r)[1:] for r in merge.upsert(target, staging, "key", ["flag"], F.lit(new)).collect()}
    assert got == {"x": (None, True, new), "y": (2, True, new), "z": (3, False, old), "w": (9, False, new)}
    assert tuple(merge.merge_counts(target, staging, "key").first()) == (1, 2)


def test_evaluation(spark):
    golden = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, ["d"])], "query_id long, accepted array<string>")
    ranking = spark.createDataFrame([(1, "a", 0.9, 1), (2, "z", 0.9, 1), (2, "c", 0.8, 2), (3, "q", 0.9, 1)], "query_id long, doc_id string, score double, rank int")
    m = evaluation.score_rows(golden, ranking).agg(*evaluation.metrics()).first()
    assert (m.n, m.p1, m.p3, m.mrr, m.above_floor) == (3, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 0.5, 1.0)
    failed = evaluation.score_rows(golden, ranking).agg(*evaluation.metrics(error=F.col("query_id") > 0)).first()
    assert (failed.n, failed.errors, failed.p1) == (3, 3, 0.0)
    rows = spark.createDataFrame([(0.15, True), (0.35, False), (0.8, True)], "s double, ok boolean")
    sweep = {r.threshold: (r.tp, r.fp, r.precision) for r in evaluation.threshold_sweep(rows, F.col("s"), F.col("ok"), [0.1, 0.3, 0.9]).collect()}
    assert sweep == {0.1: (2, 1, 0.667), 0.3: (1, 1, 0.5), 0.9: (0, 0, None)}
    df = spark.createDataFrame([("long-division", "x-division-y"), ("", "a"), (None, "b"), ("Abc", "zABCz")], "a string, b string")
    assert [r[0] for r in df.select(evaluation.common_substring(F.col("a"), F.col("b"))).collect()] == [9, 0, 0, 3]


def test_buckets(spark):
    rows = [(2, 0, 0, True, "a", "a", 0, "E"), (1, 0, 1, True, "a", "a", 0, "E"), (0, 0, 0, False, "a", "a", 0, "D"), (0, 1, 0, True, "a", "a", 0, "A"), (0, 1, 0, True, "a", "b", 0, "B"), (0, 1, 0, True, None, "b", 6, "C"), (0, 1, 0, True, None, None, 5, "F")]
    df = spark.createDataFrame(rows, "ot int, oe int, d int, r boolean, es string, ts string, l int, want string")
    got = df.select("want", evaluation.failure_bucket(*(F.col(x) for x in ("ot", "oe", "d", "r", "es", "ts", "l"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_scores(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (800.0,), (-800.0,)], "x double")
    assert [r[0] for r in df.select(S.logistic(F.col("x"))).collect()] == [0.0, 0.5, 1.0, 0.0]
    assert [r[0] for r in df.select(S.clamp01(F.col("x"))).collect()] == [0.0, 0.0, 1.0, 0.0]
    s = spark.createDataFrame([(None, "nan", "0.5"), ("x", None, None)], "a string, b string, c string").select(S.first_number(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in s] == [0.5, 0.0]


def test_rewrite_backend(spark):
    ranking = lambda score: spark.createDataFrame([(q, f"{score}", score, 1) for q in (1, 2, 3, 4)], "query_id long, doc_id string, score double, rank int")
    firing = spark.createDataFrame([(1, "iter1"), (2, "fallback"), (3, "none")], "query_id long, mechanism string")
    for low, high, want in ((0.2, 0.2, {1: "0.2", 2: "0.2"}), (0.2, 0.1, {1: "0.1", 2: "0.2"}), (0.4, 0.9, {1: "0.9", 2: "0.4"})):
        got = {r.query_id: r.doc_id for r in retrieval.rewrite_aware(ranking(low), ranking(high), firing).collect()}
        assert got == {3: str(low), 4: str(low), **want}


def test_ordered(spark):
    rows = spark.createDataFrame([("q", i, m) for i, m in enumerate([5, None, None, None])], "q string, i int, m int")
    assert [r[0] for r in rows.select("i", ordered.distribute(F.lit(25), F.col("m"), ["q"], ["i"]).alias("x")).orderBy("i").select("x").collect()] == [5, 7, 7, 6]
    over = spark.createDataFrame([("q", 0, 30), ("q", 1, None)], "q string, i int, m int")
    assert [r[0] for r in over.select("i", ordered.distribute(F.lit(20), F.col("m"), ["q"], ["i"]).alias("x")).orderBy("i").select("x").collect()] == [30, 10]


def test_checks(spark):
    df = spark.createDataFrame([("a", None, ["b", "x"]), ("b", "TBD", [])], "slug string, title string, xref array<string>")
    got = {(r.slug, r.rule, r.severity) for r in checks.diagnostics(df, "slug", {**checks.required(["title"]), **checks.placeholders(["title"])}, {"placeholder_title": "WARN"}).collect()}
    assert got == {("a", "missing_title", "ERROR"), ("b", "placeholder_title", "WARN")}
    assert [tuple(r) for r in checks.dangling(df, "slug", ["xref"], df, "slug").collect()] == [("a", "xref", "x")]
    h = checks.health(spark.createDataFrame([(1, "db", "ok"), (2, "api", "down"), (3, "x", "skipped")], "position int, name string, status string")).first()
    assert (h.ok, h.first_failing, h.n_failing) == (False, "api", 1)


def test_curves(spark):
    s = curves.sample(spark, 0, 2, lambda x: curves.polynomial([F.lit(1), F.lit(0), F.lit(-1)], x), 5)
    assert [r.y for r in s.orderBy("i").collect()] == [-1.0, -0.75, 0.0, 1.25, 3.0]
    band = curves.solution_bands(s, F.col("y") <= 0).first()
    assert (band.low, band.high) == (0.0, 1.0)
    roots = spark.createDataFrame([([1.0, 0.0, -1.0],), ([1.0, 0.0, 1.0],), ([1.0, -2.0, 1.0],)], "c array<double>").select(curves.real_roots(F.col("c"), -5, 5)).collect()
    assert [len(r[0]) for r in roots] == [2, 0, 1]
    for bad in (lambda: curves.check_range(1, 1), lambda: curves.exponential(1, F.lit(1)), lambda: curves.logarithm(0, F.lit(1)), lambda: curves.trigonometric("sin", F.lit(1), 0)):
        with pytest.raises(ValueError):
            bad()
    assert spark.range(1).select(curves.logarithm(2, F.lit(-1.0))).first()[0] is None
    assert spark.range(1).select(curves.trigonometric("tan", F.lit(math.pi / 2))).first()[0] is None
    assert curves.overlay(("a", s), ("b", s)).groupBy("trace").count().count() == 2


def test_content_tokens_and_frequencies_of_wanted_ones(spark):
    """Odd marks and spaces against the plain rule; only wanted tokens are counted, each once a document."""
    import re

    from quarry.functions import text as T
    from quarry.operators import evaluation

    rows = [(0, None), (1, ""), (2, "--Solve:: x²+y³=12345, (Solve) solve;- the/quotient\\rule 'rule's' 12345 --!!--"), (3, "a\tQUOTIENT\nquotient \"Σίγμα\" -:;!ab-cd!;:- --quotient"), (4, "x" * 5 + "-" * 9)]

    def plain(text, least):
        low = re.sub(r"[?.,()'\"/\\]", " ", (text or "").lower().replace("²", "2").replace("³", "3"))
        clean = [re.sub(r"^[-:;!]+|[-:;!]+$", "", t) for t in re.split(r"\s+", low)]
        return list(dict.fromkeys(t for t in clean if len(t) >= least and not re.search(r"^[0-9]+$", t) and t != "rule"))

    docs = spark.createDataFrame(rows, "k int, text string")
    for least in (4, 5):
        got = {r.k: r.t for r in docs.select("k", T.content_tokens(docs.text, least, ["rule"]).alias("t")).collect()}
        assert got == {k: plain(t, least) for k, t in rows}
    wanted = spark.createDataFrame([("quotient",), ("solve",), ("absent",)], "token string")
    counted = evaluation.token_frequency(docs, "k", T.content_tokens(docs.text, 5), wanted)
    assert {r.token: r.n_docs for r in counted.collect()} == {"quotient": 2, "solve": 1}
