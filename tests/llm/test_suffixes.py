"""Removal of repeated strings against a count of all strings, and the suffix order against sorting."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import suffixes

L = suffixes.LENGTH


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + L]) for d in data for i in range(len(d) - L + 1))
    rows = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - L + 1):
            if seen[hash(d[i : i + L])] > 1:
                gone[i : i + L] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        rows.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_order(letters):
    s = np.array(letters, np.int64)
    assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: letters[i:])


def made(rng, n, words=40):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) if rng.random() < 0.5 else f"w{rng.integers(0, 9)}" for _ in range(n // 5))[:n]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    passage, long = made(rng, 700), made(rng, 6000)
    out = [None, "", "", "short", "a" * 900, "ab" * 300, "x" * 199, "x" * 200, made(rng, 500) + "é" * 300]
    for k in range(40):
        own = made(rng, int(rng.integers(50, 900)))
        cut = int(rng.integers(0, 500))
        out.append(own + passage[cut : cut + int(rng.integers(150, 260))] + made(rng, 80))
    for k in range(30):  # near copies
        at = int(rng.integers(0, 5900))
        out.append(long[:at] + "#" + long[at + int(rng.integers(0, 3)) :])
    out += [made(rng, 1200)] * 3 + [passage] * 2 + [passage + "!", passage[:L], passage[1 : L + 1]]
    twice = made(rng, 230)
    return out + [twice + made(rng, 33) + twice, twice[:199] + "?"]


@pytest.mark.parametrize("group_rows,sort_bytes,unit", [(2048, 1 << 20, 1 << 20), (6, 2000, 1 << 20), (1, 1 << 20, 257)])
def test_removed_bytes(spark, texts, monkeypatch, group_rows, sort_bytes, unit):
    monkeypatch.setattr(suffixes, "SORT_BYTES", sort_bytes)
    monkeypatch.setattr(suffixes, "UNIT", unit)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs, group_rows).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_cores_that_are_not_broadcast(spark, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 3)
    docs = spark.createDataFrame([(None if k == 9 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((tuple(r) for r in suffixes.remove_repeats(docs, 20).collect()), key=str)
    assert got == sorted(((None if k == 9 else k // 2, *r) for k, r in enumerate(plain(texts))), key=str)


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs).collect()}
    assert got == dict(zip((r[0] for r in rows), plain([r[1] for r in rows]), strict=True))
    assert sum(v[1] > 0 for v in got.values()) > 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).collect() == []


def test_known_cores_are_looked_up_without_being_sorted_again():
    """Each batch looks its cores up in all repeated ones; sorting these for each batch made the job grow with their square."""
    rng = np.random.default_rng(5)
    known = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 2_000_000))
    values = np.concatenate([known[::2_000], rng.integers(-(1 << 63), (1 << 63) - 1, 1_000), [known[0], known[-1], -(1 << 63), (1 << 63) - 1]])
    assert (suffixes.among(known, values) == np.isin(values, known)).all()
    assert not suffixes.among(known[:0], values).any() and len(suffixes.among(known, values[:0])) == 0
    start = time.process_time()
    for _ in range(100):
        suffixes.among(known, values)
    assert time.process_time() - start < 2
