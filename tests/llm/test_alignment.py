"""Alignment of two tokenizers against plain encoding and set intersection."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import alignment

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = [
    "The quick brown fox, 12345 times.", "The quick brown fox, 12345 times.", "", None, " lead  two   three ", "a\nb\n\nc\td\r\n", "▁odd",
    "<|endoftext|> and <s> </s>", "Été à ﬁn ½ é 日本語 😀 ", "x", " ", "the the the the", "wonderfully unpronounceable " * 400, "\x00z \x85  n", "end ",
]


def plain(texts):
    """By the libraries, whole text by whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    one.encode_special_tokens = True
    tables = alignment.ByteLevel(PATHS[0]).pieces, alignment.Pieces(PATHS[1]).pieces
    rows, pairs = [], []
    for t in texts:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        want = b" " + (t or "").encode()
        if any(b"".join(table[i] for i in ids) != want for table, ids in zip(tables, (a, b), strict=True)):
            a, b = [], []
        ends = [np.cumsum([len(table[i]) for i in ids]).astype(int).tolist() for table, ids in zip(tables, (a, b), strict=True)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], (0, 0)
        for c in cuts:
            at = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append(",".join(map(str, a[before[0] : at[0]])) + "|" + ",".join(map(str, b[before[1] : at[1]])))
            before = at
        links = [(a[ends[0].index(c)], b[ends[1].index(c)]) for c in cuts]
        pairs += links
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    n = Counter(pairs)
    most = {b: max(v for (_, y), v in n.items() if y == b) for b in {b for _, b in n}}
    return [(x, y, c, c, sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), sha) for x, y, c, links, sha in rows]


@pytest.mark.parametrize("broadcast_pairs", [10, alignment.BROADCAST_PAIRS])
def test_alignment_equals_plain_encoding(spark, broadcast_pairs):
    docs = spark.createDataFrame([(k // 2 if k != 3 else None, t, 0) for k, t in enumerate(TEXTS)], "doc_id long, text string, links int")
    got = sorted(map(tuple, alignment.align_documents(docs, *PATHS, broadcast_pairs).collect()), key=str)
    want = [(k // 2 if k != 3 else None, *r) for k, r in enumerate(plain(TEXTS))]
    assert got == sorted(want, key=str)


def test_alignment_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in alignment.align_documents(docs, *PATHS).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    assert got == dict(zip((r[0] for r in rows), plain([r[1] for r in rows]), strict=True))
    assert sum(v[0] > 0 for v in got.values()) > 150


def test_lanes_cut_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.arange(0, 9)
    a = [rng.integers(1, 9, 300).astype(np.uint16) for _ in range(5)]
    b = []
    for x in a:
        total, own = int(sizes[x].sum()), []
        while total:
            own.append(int(rng.integers(1, min(total, 8) + 1)))
            total -= own[-1]
        b.append(np.array(own, np.uint16))
    whole = alignment.align(a, b, sizes, sizes)
    monkeypatch.setattr(alignment, "LANE_BYTES", 7)
    for x, y in zip(whole, alignment.align(a, b, sizes, sizes), strict=True):
        assert x.tolist() == y.tolist()
    ends = [np.cumsum(np.concatenate(side)) for side in (a, b)]
    assert ends[0][whole[0]].tolist() == ends[1][whole[1]].tolist() == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    assert np.diff(whole[2]).tolist() == [int(((whole[0] >= k * 300) & (whole[0] < (k + 1) * 300)).sum()) for k in range(5)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string").withColumn("n_a", F.lit(1))
    assert alignment.align_documents(docs, *PATHS).collect() == []
