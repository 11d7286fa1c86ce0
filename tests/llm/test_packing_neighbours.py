"""Packing: a seed's neighbours by all its terms, and shards by content."""

import math

import numpy as np

from quarry.llm import packing


def test_neighbours_score_all_terms_of_the_seed():
    """A seed with 40 rare terms that one document shares each, and common ones that another shares."""
    common, rare = np.arange(1000, 1200, dtype="<u2"), np.arange(1, 41, dtype="<u2")
    docs = [np.concatenate([rare, common]), common, *(np.array([r, 5000 + r], "<u2") for r in rare.tolist())]
    docs += [np.concatenate([common[k::4], np.arange(9000 + 60 * k, 9050 + 60 * k, dtype="<u2")]) for k in range(4)] * 12
    n, df = len(docs), np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    mean = sum(map(len, docs)) / n

    def score(k):
        both = np.intersect1d(docs[0], docs[k])
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(docs[k]) / mean)) for t in both)

    got = packing.Bm25Index(docs).neighbours(0, np.ones(n, bool)).tolist()
    want = sorted((k for k in range(1, n)), key=lambda k: -score(k))
    assert got[0] == want[0] == 1
    assert np.allclose([score(k) for k in got], [score(k) for k in want[: len(got)]], rtol=1e-4)
    assert min(map(score, got)) > 0 and len(got) == packing.NEIGHBOURS


def test_shards_hold_like_documents(spark, monkeypatch):
    """Copies and documents of one topic meet, however many shards there are."""
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    rng, rows = np.random.default_rng(3), []
    for k in range(400):
        topic = k % 8
        ids = rng.integers(1000 * topic, 1000 * topic + 300, 60) if k < 380 else np.frombuffer(rows[k - 380][4], "<u2")
        rows.append((k, 0, len(ids), int(rng.permutation(1 << 20)[0]) * 512 + k, ids.astype("<u2").tobytes()))
    rest = spark.createDataFrame(rows, "doc_id long, start long, doc_tokens long, number long, ids binary").repartition(4)
    about = packing.collection(rest)
    assert about.total == 400 and about.mean == 60
    assert about.df.sum() == sum(len(np.unique(np.frombuffer(r[4], "<u2"))) for r in rows)
    shards = packing.deal(rest, about, 8).rdd.glom().map(lambda p: [r.doc_id for r in p]).collect()
    shard = {d: k for k, p in enumerate(shards) for d in p}
    assert len(shard) == 400 and max(map(len, shards)) < 100
    assert sum(shard[k] == shard[k - 380] for k in range(380, 400)) >= 18
    same = np.mean([shard[a] == shard[b] for a in range(0, 380) for b in range(a % 8, 380, 8)])
    assert same > 0.5
