"""Texts with a part of their shingles in common, none of them linked, do not all meet each other."""

import random

import numpy as np
import pytest
from test_near_duplicates import SCHEMA, components, shingles, texts

from quarry.llm import similar


def copies_with_edits(n, edits, seed=14):
    rng, base = random.Random(seed), " ".join(texts(2, 90)).split()[:150]
    for i in range(n):
        w = base[:]
        for k in rng.sample(range(len(w)), i % (edits + 1)):
            w[k] = f"edit{rng.randrange(40)}"
        yield " ".join(w)


def test_near_copies_that_no_link_joins_make_few_pairs(spark, monkeypatch):
    """Of 500 copies with up to 9 edits more than half are similar to none; as rows, 23,910 pairs met in all segments before."""
    made, plain = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, tag: (made.append(out.count()) if tag in ("crossing-pairs", "close-pairs") else None, out)[1] if (out := plain(df, tag)) else None)
    rows = list(dict.fromkeys(copies_with_edits(500, 9)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows)], SCHEMA).repartition(4)
    kept = sorted(r.doc_id for r in similar.keep_one(docs).collect())
    group = components(rows)
    assert kept == sorted(min(i for i, g in enumerate(group) if g == x) for x in set(group))
    assert len(kept) > 150 and sum(made) < 5_000, made


@pytest.mark.parametrize("linked", [0, 40])
def test_pairs_of_a_crowd_are_all_that_are_similar(spark, linked):
    """Also with texts of other sizes, of which the first ones have a root in common."""
    rows = [" ".join(t.split()[: 150 - i % 23]) for i, t in enumerate(copies_with_edits(120, 5, 3))]
    frame = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(rows)], "node long, text binary").repartition(3)
    roots = spark.createDataFrame([(i, 0) for i in range(linked)], "node long, root long")
    got = {(r.a, r.b) for r in similar._unlinked(similar.rare_shingles(frame), roots).collect()}
    sets = [shingles(t) for t in rows]
    want = {(i, j) for j in range(120) for i in range(j) if j >= linked and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 200 and want <= got
    assert all(j >= linked for _, j in got)


@pytest.mark.parametrize("meeting", [similar.MEETING, 40])
def test_meeting_leaves_out_pairs_within_a_crowd_alone(spark, monkeypatch, meeting):
    monkeypatch.setattr(similar, "MEETING", meeting)
    monkeypatch.setattr(similar, "PAIRS", 50)
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 32, (160, similar.SEGMENTS), np.uint32)
    for i in range(20, 160):
        for k in (0, 1):
            prints[i, k] = prints[i % 5, k] ^ np.uint32(rng.choice([0, 1 << int(rng.integers(0, 32))]))
    root, crowd = [i % 7 if i < 60 else i for i in range(160)], [i % 3 > 0 for i in range(160)]
    near = {(i, j) for i in range(160) for j in range(i + 1, 160) if (np.bitwise_count(prints[i] ^ prints[j]) <= 1).any()}
    want = {(i, j) for i, j in near if root[i] != root[j] and not (crowd[i] and crowd[j])}
    frame = spark.createDataFrame([(i, root[i], bytearray(prints[i].astype("<u4").tobytes()), crowd[i]) for i in range(160)], "node long, root long, fp binary, crowd boolean").repartition(3)
    got = similar._met(frame, 160, similar.SEGMENTS, similar._crossing, ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want) and 100 < len(want) < len(near)
