"""Rows of one id, of none, and equal rows spread over token files."""

import public_tokenizers

from quarry.llm import token_files
from quarry.llm.storage import new_path


def test_equal_rows_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    rows = [(7, "one and the same text") for _ in range(4000)] + [(None, None) for _ in range(4000)] + [(k, f"text {k} of many others") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    files = token_files.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), 1, True, new_path(spark, "tokens"))
    sizes = sorted(r.n_docs for r in files.collect())
    assert sum(sizes) == 12_000 and len(sizes) >= 8 and sizes[-1] <= 2 * 12_000 / len(sizes)
    read = token_files.read_files(files).collect()
    order = [r.doc_id for r in sorted(read, key=lambda r: r.start)]
    assert order == [None] * 4000 + sorted([7] * 4000 + list(range(4000)))
