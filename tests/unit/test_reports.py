"""Reports, sources of maps, and figures' numbers on small rows."""

import csv
import glob
import json
import math

from pyspark.sql import functions as F

from quarry.operators import curves, evaluation, reports, retrieval, serving
from quarry.sources import tables


def test_appearances_and_prices(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"line-1": [{"year": 2020, "paper": 1, "question_number": 4, "sitting": "main"}, {"year": 2021}], "empty": []}))
    got = tables.read_appearances(spark, str(tmp_path / "a.json")).orderBy("place").collect()
    assert [(r.slug, r.place, r.year, r.paper, r.marks) for r in got] == [("line-1", 0, 2020, 1, None), ("line-1", 1, 2021, None, None)]
    (tmp_path / "p.yaml").write_text("# prices\nsmall:\n  input: 1.0  # usd\n  output: 5\nlarge-2:\n  input: 3.5\n  note: none\nversion: 3\n")
    got = {(r.model, r.name): r.price for r in tables.read_prices(spark, str(tmp_path / "p.yaml")).collect()}
    assert got == {("small", "input"): 1.0, ("small", "output"): 5.0, ("large-2", "input"): 3.5}


def test_report_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    lines = reports.markdown_table(rows, [F.col("k")], name=F.col("k"), n=F.col("n").cast("string"))
    reports.write_report(lines, str(tmp_path / "r"))
    (part,) = glob.glob(str(tmp_path / "r" / "part-*"))
    assert open(part).read().splitlines() == ["| name | n |", "| --- | --- |", "| a | 1 |", "| b | 2 |"]


def test_fixed_rounds_halves_up(spark):
    values = [0.0, 0.125, 0.994999, 0.995, 12.3]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(reports.fixed(F.col("v"), 2).alias("x")).collect()]
    assert got == ["0.00", "0.13", "0.99", "1.00", "12.30"]


def test_polynomials(spark):
    rows = spark.createDataFrame([([1.0, 0.0, -3.0, 0.0],), ([0.0, 0.0],), ([-2.5, 1.0],), ([1.0] + [0.0] * 7,), ([],)], "a array<double>")
    got = rows.select(curves.polynomial_text(F.col("a")).alias("t"), curves.turning_points(F.col("a"), -5, 5).alias("p")).collect()
    assert [r.t for r in got] == ["x³ − 3x", "0", "-2.5x + 1", "x^7", "0"]
    assert [(round(p.x, 6), round(p.y, 6)) for p in got[0].p] == [(-1.0, 2.0), (1.0, -2.0)] and got[2].p == []
    kinds = spark.createDataFrame([("Sin",), ("f(x)",), (None,)], "n string").select(curves.figure_kind(F.col("n")).alias("k")).collect()
    assert [r.k for r in kinds] == ["trig", "polynomial", "overlay"]


def test_placeholders_at_any_depth(spark):
    deep = "TBD"
    for _ in range(60):
        deep = {"k": [deep]}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps({"a": {"b": ["ok", "TODO"]}, "n": 3})), (3, None)], "id int, j string")
    got = {(r.id, r.path) for r in serving.placeholder_paths(rows, "id", "j").collect()}
    assert got == {(1, ".".join(["k[0]"] * 60)), (2, "a.b[1]")}


def test_rankings_keep_the_best_over_batches_and_blocks(spark, monkeypatch):
    """Ties go to the smaller id, however rows and queries are divided."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "TRIPLES", 7)
    words = "red green blue grey pink teal".split()
    docs = [(i, " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 5))) for i in range(60)]
    asked = [(q, f"{words[q % 6]} {words[(q + 2) % 6]}") for q in range(8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([*asked, (99, None)], "query_id long, text string")
    terms = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")
    lists, n = {i: t.split() for i, t in docs}, len(docs)
    mean = sum(map(len, lists.values())) / n

    def bm25(q, d):
        total = 0.0
        for w in set(q.split()):
            df, tf = sum(w in x for x in lists.values()), lists[d].count(w)
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(lists[d]) / mean))
        return round(total, 6)

    for kept in (None, [i for i in lists if i % 3]):
        keep = None if kept is None else F.col("doc_id").isin(kept)
        got = {}
        for r in retrieval.bm25_topk(queries, frame, terms, 4, keep).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
        for q, text in asked:
            want = sorted((d for d in kept or lists if bm25(text, d) > 0), key=lambda d: (-bm25(text, d), d))[:4]
            assert [d for _, d in sorted(got[q])] == want
        assert 99 not in got
    same = {(r.query_id, r.doc_id): r.score for r in retrieval.overlap_topk(queries, frame, terms, 60).collect()}
    assert same == {(q, d): len(set(t.split()) & set(x)) for q, t in asked for d, x in lists.items() if set(t.split()) & set(x)}


def test_one_scan_and_one_count_for_thousands_of_queries(spark, monkeypatch):
    """Packets of queries, however small, give the same ranking; thousands of short queries are one packet."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} w{i % 13}") for i in range(40)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, f"w{q % 14} w{q % 5}") for q in range(2500)], "query_id long, text string")
    terms = lambda c: F.split(c, " ")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    scans = lambda df: df._jdf.queryExecution().analyzed().toString().count("MapInArrow")
    whole = retrieval.bm25_topk(queries, docs, terms, 3)
    assert scans(whole) == 1
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)], "id long, v array<double>")
    near = retrieval.dense_topk(vectors, vectors, 2, "id", "v")
    monkeypatch.setattr(retrieval, "PACKET_BYTES", 400)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    few = queries.where("query_id < 100")
    parts, same = retrieval.bm25_topk(few, docs, terms, 3), retrieval.dense_topk(vectors, vectors, 2, "id", "v")
    assert scans(parts) > 1 and scans(same) > 1
    assert rows(parts) == [r for r in rows(whole) if r[0] < 100] and rows(same) == rows(near)


def test_numbers_in_texts(spark):
    values = [0.0, 1.0, -2.5, 100000.0, 1234567.0, 1e-7, 0.0001, 0.00012345678, 1e22, 123456.7, 3.14159265, 120.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", curves.number_text(F.col("v")).alias("g"), curves.number_text(F.col("v"), 3).alias("h"), curves.axis_text(F.col("v")).alias("a")).collect()
    assert [(r.g, r.h) for r in got] == [(f"{v:g}", f"{v:.3g}") for v in values]
    assert [r.a for r in got] == [str(int(v)) if v.is_integer() else f"{v:.2f}".rstrip("0").rstrip(".") for v in values]


def test_titles_of_curves(spark):
    one = spark.range(1)
    title = lambda f, *v: one.select(f(*(F.lit(x) for x in v)).alias("t")).first().t
    assert title(curves.trigonometric_text, "sin", 2.0, 2 * math.pi, 0.0, 0.0) == "y = 2 sin(x)"
    assert title(curves.trigonometric_text, "cos", -0.5, math.pi, 0.75, -1.0) == "y = -0.5 cos(2x - 1.5) − 1"
    assert title(curves.trigonometric_text, "tan", 1.0, 3.0, -1.0, 2.0) == "y = 1 tan(2.09x + 2.09) + 2"
    assert title(curves.exponential_text, math.e, 1.0, -1.0, 0.0) == "y = e^(-x)"
    assert title(curves.exponential_text, 2.0, 3.0, 0.5, -4.0) == "y = 3 · 2^(0.5x) − 4"
    assert title(curves.logarithm_text, math.e, 1.0, 1.0, 1.5) == "y = ln(x) + 1.5"
    assert title(curves.logarithm_text, 10.0, 2.0, 4.0, 0.0) == "y = 2 · log_10(4x)"


def test_results_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 'a "b", c\nd'), (2, None, None), (3, 3, " x ")], "query_id int, rank int, topic string").repartition(2)
    hits = spark.createDataFrame([(1, 9, 1), (1, 4, 2), (3, 5, 1)], "query_id int, doc_id int, rank int")
    out = reports.result_rows(rows, hits, eval_id=F.col("query_id"), topic=F.col("topic"))
    reports.write_csv(out, f"file://{tmp_path}/r")
    files = sorted((tmp_path / "r").glob("*.csv"))
    plain = []
    for f in files:
        with f.open(newline="") as text:
            plain += list(csv.DictReader(text))
    back = [r.asDict() for r in reports.read_csv(spark, f"file://{tmp_path}/r", out.columns).collect()]
    by_id = lambda x: sorted(x, key=lambda r: r["eval_id"])
    assert by_id(plain) == by_id(back) == by_id(r.asDict() for r in out.collect())
    assert by_id(back)[0]["top_k_slugs"] == "9,4" and [r["mrr"] for r in by_id(back)] == ["1.0000", "0.0000", "0.3333"] and by_id(back)[1]["rank"] == ""


def test_what_is_no_json_has_no_placeholders(spark):
    rows = spark.createDataFrame([(1, "{not json"), (2, '["TODO"]'), (3, "[" * 100_000)], "id int, j string")
    assert [(r.id, r.path) for r in serving.placeholder_paths(rows, "id", "j").collect()] == [(2, "[0]")]


def test_failures_carry_their_evidence(spark):
    rows = spark.createDataFrame(
        [
            (1, "algebra-13-long-division", "the-line-7-circumcircle", True, "the circumcircle, please"),
            (2, "algebra-13-long-division", "algebra-2-quadratic", True, "long quadratic division"),
            (3, "algebra-13-long-division", None, False, None),
            (4, "algebra-1-a", "algebra-1-a", True, "a"),
            (5, "other-13-long", "odd-2-long", True, "what is long?"),
            (6, "algebra-1-sets", "the-line-1-slope", True, "sets of slope"),
        ],
        "query_id int, expected_slug string, top_slug string, in_top5 boolean, text string",
    )
    slugs = spark.createDataFrame([("algebra-13-long-division",), ("algebra-2-quadratic",), ("algebra-3-quadratic",), ("algebra-4-quadratic",), ("the-line-7-circumcircle",), ("the-line-7-circumcircle",)], "slug string")
    got = {r.query_id: r for r in evaluation.failure_evidence(rows, slugs, ["algebra", "the-line"], F.col("text")).collect()}
    assert [got[k].bucket for k in range(1, 7)] == ["E", "A", "D", None, "F", "B"]
    assert got[1].distinctive == ["circumcircle"] and got[2].distinctive == [] and got[2].shared_top == ["quadratic"] and got[2].shared_expected == ["division", "long"]
    assert got[3].common_length == 0 and got[5].expected_strand is None and got[5].common_length == 5
