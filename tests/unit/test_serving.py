"""Prompts, events, figures and costs on small made-up rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import serving as S


def test_prompts(spark):
    queries = spark.createDataFrame([(1, " what is x ", "concept"), (2, "y", "analytical")], "query_id long, text string, route string")
    hits = spark.createDataFrame([(1, k, f"s{k}", 0.5 + k / 100, f"snippet {k}") for k in range(1, 7)], "query_id long, rank int, doc_id string, score double, snippet string")
    got = {r.query_id: r.prompt.split("\n") for r in S.prompts(queries, hits).collect()}
    assert got[1][:3] == ["Question: what is x", "", "Routing decision: concept"]
    assert got[1][5:] == [f"- [s{k}] (score={0.5 + k / 100:.2f}): snippet {k}" for k in range(1, 5)]
    assert got[2] == ["Question: y", "", "Routing decision: analytical"]


def test_answer_events(spark):
    answers = spark.createDataFrame([(1, "two  words", False, ["a", "b"]), (2, "kept whole", True, [])], "query_id long, answer string, single boolean, citations array<string>")
    got = [tuple(r) for r in S.answer_events(answers).orderBy("query_id", "seq").collect()]
    assert got == [(1, 0, "token", "two  "), (1, 1, "token", "words"), (1, 2, "citation", "a"), (1, 3, "citation", "b"), (1, 4, "done", ""), (2, 0, "token", "kept whole"), (2, 1, "done", "")]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_gates(spark):
    lit = F.lit
    spam = lambda trap, dwell, ua, tier: one(spark, S.spam_reason(lit(trap), lit(dwell), lit(ua), lit(tier), ["curl"]))
    assert [spam("x", None, "b", "paying"), spam(None, "1499", "b", "anonymous"), spam(None, "soon", "b", "anonymous"), spam("", "1500", " ", "anonymous"), spam(None, None, "CURL/8", "anonymous")] == ["honeypot", "dwell_too_short", "dwell_too_short", "empty_ua", "bot_ua"]
    assert spam(None, "1", "curl", "paying") is None and spam(None, None, "browser", "anonymous") is None
    anchor = lambda q, s, score: one(spark, S.anchored(lit(q), lit(s), lit(None).cast("string"), lit(score)))
    assert anchor("what are pensions", "financial-maths-8-pensions", 0.02) and not anchor("what are pensions", "financial-maths-8-pensions", 0.001) and not anchor("explain this", "algebra-1-this", 0.5)
    guard = lambda route, n, top, anchor: one(spark, S.guarded(lit(route), lit(n), lit(top).cast("double"), lit(anchor)))
    assert guard("concept", 0, None, False) and guard("concept", 3, 0.29, False) and not guard("concept", 3, 0.29, True) and not guard("concept", 3, 0.3, False) and not guard("analytical", 0, None, False)
    figure = lambda route, q, slug: one(spark, S.wants_figure(lit(route), lit(q), lit(""), lit(slug)))
    assert figure("concept", "Sketch it", "algebra-1-a") and figure("concept", "why", "trigonometry-1-a") and not figure("analytical", "sketch", "statistics-1") and not figure("concept", "why", None)


def test_costs_and_calls(spark):
    cost = lambda m: one(spark, S.cost_eur(F.lit(m), F.lit(1_000_000), F.lit(100_000)))
    assert cost("small") == pytest.approx(1.5 * 0.92) and cost("large") == pytest.approx(4.5 * 0.92) and cost("analyst") == pytest.approx(0.00092) and cost("?") == pytest.approx(0.0005)
    call = lambda text: one(spark, S.tool_call(F.lit(text), "kind string"))
    assert call('```json\n{"kind": "venn"}\n```').kind == "venn" and call('{"kind": "x"}').kind == "x" and call("no call") is None


def test_references_and_audit(spark):
    hits = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c", "d"]), (1, 3, ["e", "f"])], "query_id long, rank int, refs array<string>")
    assert [r.slug for r in S.first_references(hits, "refs").orderBy("place").collect()] == list("abcde")
    runs = spark.createDataFrame([("t", "ok", 3, 1, 10), ("s", "failed", 9, 9, 5)], "loader string, status string, inserted int, updated int, duration_ms int")
    assert tuple(S.audit(runs).first()) == (3, 1, 15, "FAILURES: s")
    t = dt.datetime(2024, 1, 1)
    spans = spark.createDataFrame([("q", "start", t), ("q", "end", t + dt.timedelta(milliseconds=250))], "id string, phase string, ts timestamp")
    assert S.spans(spans, ["id"]).first().ms == 250


def test_orders_meet_once_for_their_references(spark, capsys):
    from quarry.plans import REGISTRY

    REGISTRY.queries["first_references"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
