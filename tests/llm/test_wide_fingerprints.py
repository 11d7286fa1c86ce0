"""The near-duplicate stage finds its candidates by one-wildcard variants of SimHash segments."""

import random

import numpy as np
import pytest

from quarry.llm import similar


def texts_of_eight_tenths(n):
    rng = random.Random(21)
    for _ in range(n):
        a = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
        b = a[:]
        for k in rng.sample(range(len(a)), len(a)):
            c = [*b[:k], f"edit{k}", *b[k + 1 :]]
            if not similar.similar(similar.shingles(" ".join(a).encode()), similar.shingles(" ".join(c).encode())):
                break
            b = c
        yield " ".join(a).encode(), " ".join(b).encode()


def test_pairs_of_the_similarity_meet_and_pass_as_fingerprints():
    met = near = 0
    for a, b in texts_of_eight_tenths(60):
        differ = np.bitwise_count(similar.fingerprint(a)[0] ^ similar.fingerprint(b)[0])
        met += bool((differ <= 1).any())
        near += differ.sum() <= similar.DIFFER * similar.SEGMENTS * similar.SEGMENT_BITS
    assert met >= 59 and near == 60


@pytest.mark.parametrize("meeting", [similar.MEETING, 40])
def test_meeting_is_that_of_all_pairs(spark, monkeypatch, meeting):
    """Also where segments are dealt by the first bits of their halves."""
    monkeypatch.setattr(similar, "MEETING", meeting)
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 32, (240, similar.SEGMENTS), np.uint32)
    for i in range(100, 240):
        for k in rng.choice(similar.SEGMENTS, 2, replace=False):
            prints[i, k] = prints[rng.integers(0, 100 if i < 170 else 5), k] ^ np.uint32(rng.choice([0, 1 << int(rng.integers(0, 32)), 3 << int(rng.integers(0, 31))]))
    root = [i % 7 if i < 30 else i for i in range(240)]
    near = {(i, j) for i in range(240) for j in range(i + 1, 240) if (np.bitwise_count(prints[i] ^ prints[j]) <= 1).any()}
    want = {(i, j) for i, j in near if root[i] != root[j]}
    frame = spark.createDataFrame([(i, root[i], bytearray(prints[i].astype("<u4").tobytes())) for i in range(240)], "node long, root long, fp binary").repartition(3)
    got = similar._met(frame, 240, similar.SEGMENTS, similar._crossing, ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want) and 50 < len(want)
    grouped = similar._met(frame, 240, similar.SEGMENTS, similar._grouping, ["band", "node"]).collect()
    assert {r.node for r in grouped} == {x for pair in near for x in pair}
