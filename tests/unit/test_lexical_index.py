"""The stored index against a scan of all documents, before and after refreshes."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical_index as L
from quarry.operators.retrieval import bm25_topk
from quarry.sources.versions import Rejected, Versions


def terms(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(6000)]
    return {k: " ".join(rng.choices(words, k=rng.randint(1, 60))) for k in range(n)}


@pytest.fixture()
def small_chunks(monkeypatch):
    monkeypatch.setattr(L, "CHUNK_DOCS", 16)


def same(spark, index, texts, queries, k, keep=None):
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    found = sorted(map(tuple, L.search(index, asked, terms, k, keep).select("query_id", "doc_id", "score", "rank").collect()))
    allowed = None if keep is None else F.col("doc_id") % 3 == 0
    want = sorted(map(tuple, bm25_topk(asked, docs_of(spark, texts), terms, k, allowed).select("query_id", "doc_id", "score", "rank").collect()))
    assert [(q, d, r) for q, d, _, r in found] == [(q, d, r) for q, d, _, r in want]
    assert [s for *_, s, _ in found] == pytest.approx([s for *_, s, _ in want], abs=2e-6)
    return found


def test_search_and_refresh_equal_a_scan(spark, tmp_path, small_chunks):
    texts = made(1, 300) | {900: None, 901: "", 902: "w1 only here"}
    rng = random.Random(2)
    queries = {q: " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(1, 8))) for q in range(40)} | {77: "unknown words", 78: "", 79: "here"}
    index = Versions(spark, f"file://{tmp_path}/index")
    assert L.search(index, spark.createDataFrame([(1, "w1")], "query_id long, text string"), terms, 3).collect() == []
    assert L.refresh(index, docs_of(spark, texts), terms, "monday") == {"added": 303, "changed": 0, "removed": 0, "untouched": 0}
    assert len(same(spark, index, texts, queries, 5)) > 150
    same(spark, index, texts, queries, 5, docs_of(spark, {d: "" for d in texts if d % 3 == 0}))
    # Some change, some go, some come.
    other = made(3, 500)
    after = {d: t for d, t in texts.items() if d % 7} | {d: other[d] for d in range(0, 500, 11)}
    counts = L.refresh(index, docs_of(spark, after), terms, "tuesday")
    both = texts.keys() & after.keys()
    changed = sum((texts[d] or "") != (after[d] or "") for d in both)
    assert counts == {"added": len(after.keys() - both), "changed": changed, "removed": len(texts.keys() - both), "untouched": len(both) - changed}
    same(spark, index, after, queries, 5)
    postings = index.manifest()["tables"]["postings"]
    touched = {e["doc_id"] for r in index.open(postings[1:]).collect() for e in r["entries"]}
    assert touched == {d for d in after if after[d] and texts.get(d) != after[d]}
    assert L.refresh(index, docs_of(spark, after), terms)["untouched"] == len(after) and index.latest() == 2
    # An older version stays readable, and a third brings one document back.
    assert L.refresh(index, docs_of(spark, after | {0: texts[0], 7: texts[7]}), terms, "wednesday")["untouched"] >= len(after) - 1
    same(spark, index, after | {0: texts[0], 7: texts[7]}, queries, 3)
    assert [(v, at) for v, at, _ in L.freshness(index)] == [(1, "monday"), (2, "tuesday"), (3, "wednesday")]


def test_only_folders_of_the_terms_are_read(spark, tmp_path, small_chunks, capsys):
    index = Versions(spark, f"file://{tmp_path}/index")
    L.refresh(index, docs_of(spark, made(4, 200)), terms)
    found = L.search(index, spark.createDataFrame([(1, "w1 w2")], "query_id long, text string"), terms, 5)
    found.explain("formatted")
    plan = capsys.readouterr().out
    scans = [part for part in plan.split("\n\n") if "PartitionFilters: [isnotnull(bucket" in part or "PartitionFilters: [bucket" in part]
    assert scans and all("bucket" in s for s in scans)
    # Bounds come from the heads; lists are read only where they are scored.
    assert any("max_tf" in s and "entries" not in s for s in scans) and any("entries" in s for s in scans)


def test_lists_meet_by_chunks_and_not_by_scores(spark, tmp_path, small_chunks, capsys):
    index = Versions(spark, f"file://{tmp_path}/index")
    texts = made(6, 120)
    L.refresh(index, docs_of(spark, texts), terms)
    L.refresh(index, docs_of(spark, {d: t for d, t in texts.items() if d % 5} | {3: "w1 w2"}), terms)
    found = L.search(index, spark.createDataFrame([(q, "w1 w2 w3") for q in range(9)], "query_id long, text string"), terms, 5)
    found.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(version" in line for line in exchanges) and not any("query_id" in line and "doc_id" in line.split("ENSURE")[0] for line in exchanges)
    assert all(row.doc_id % 5 for row in found.collect())


def test_rejected_ids(spark, tmp_path):
    index = Versions(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    with pytest.raises(Rejected) as e:
        L.refresh(index, docs, terms)
    assert e.value.counts == {"null key": 1, "repeated key": 1} and index.latest() == 0
