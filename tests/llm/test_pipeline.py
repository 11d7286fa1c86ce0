"""The pipeline against a plain-Python version of every stage, on documents with copies, junk and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(11)
    stems = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    word = lambda: rng.choice(stems) + rng.choice(["", "", ",", "."])
    out = []
    for i in range(160):
        w = [word() for _ in range(rng.randrange(60, 400))]
        if i % 8 == 1:
            for _ in range(len(w) // 15):
                w[rng.randrange(len(w))] = rng.choice(["snarl", "grumbling"])
        if i % 20 == 3:
            w = w[:10] * 12
        if i % 20 == 7:
            w = [x + "###" for x in w]
        text = " ".join(w)
        if i % 16 == 5:
            text = out[i - 1][1]
        if i % 32 == 10:
            text = out[i - 2][1] + " coda"
        out.append((i, text, "en", [None, "a", "b", "c", "d"][i % 5], len(text)))
    return [*out, (200, None, None, None, None), (201, "", "en", "a", 0), (202, "few words", "de", "b", 9), out[0], (None, out[2][1] + " and more of it than before", "en", "a", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(made(), SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(r[0], 1, int(r[0] % 8 == 1 and r[0] % 20 not in (3, 7))) for r in made() if r[0] is not None and r[0] < 160 and r[0] % 16 != 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def words(t):
    return (t or "").encode().split()


def good(t):
    w = words(t)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(3)}
    signs = sum((t or "").count(c) for c in "#*$%&|<>")
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 10 * signs <= len(w)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def one_of_each(rows):
    """Of the components of five-word shingle similarity 0.8 or more, the row of the smallest id."""
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        if g not in best or (r[0] is not None and (best[g][0] is None or r[0] < best[g][0])):
            best[g] = r
    return list(best.values())


def mixed(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names, total = sorted(sizes, key=lambda s: (s is None, s or "")), sum(sizes.values())
    weight, capped = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, set()
    while True:
        left, free = total - sum(3 * sizes[n] for n in capped), [n for n in names if n not in capped]
        target = {n: 3 * sizes[n] if n in capped else left * weight[n] / sum(weight[x] for x in free) for n in names}
        if not (over := {n for n in free if target[n] > 3 * sizes[n]}):
            break
        capped |= over
    out = []
    for n in names:
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        own = sorted((int(md5(f"{'' if r[0] is None else r[0]}/{md5(r[1] or '')}")[:15], 16), str(r), r) for r in rows if r[3] == n)
        whole = math.floor(target[n] / sizes[n])
        rest, upto = target[n] - whole * sizes[n], 0
        for _, _, r in own:
            size = len(words(r[1]))
            more = upto + size <= rest or (upto <= rest and upto + size - rest < rest - upto)
            out += [r] * (whole + more)
            upto += size
    return out


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows, frame = made(), docs
    want = [r for r in rows if good(r[1])]
    assert 100 < len(want) < len(rows)
    frame = corpus_pipeline.quality_rules(spark, frame, folder)
    check = lambda: sorted(map(str, (tuple(r) for r in frame.collect()))) == sorted(map(str, want))
    assert check() and frame.columns == docs.columns
    model = toxicity.learn(frame, labels)
    want = [r for r, s in zip(want, model.score([r[1] for r in want]), strict=True) if s < 0.5]
    assert not any("snarl" in r[1] or "grumbling" in r[1] for r in want)
    frame = corpus_pipeline.toxic_texts(spark, frame, folder)
    assert check()
    want = one_of_each(want)
    frame = corpus_pipeline.near_duplicates(spark, frame, folder)
    assert check()
    want = mixed(want)
    frame = corpus_pipeline.source_mix(spark, frame, folder)
    assert check()
    pieces = corpus_pipeline.run(spark, folder).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.array([*tok.encode(r[1], add_special_tokens=False).ids, 0], "<u4") for r in want}
    times, seen = Counter(r[0] for r in want), Counter()
    for p in pieces:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        seen.update((p.doc_id, i) for i in range(p.start, p.start + p.length))
    assert seen == Counter({(i, k): n for i, n in times.items() for k in range(len(ids[i]))})


def test_stages_keep_columns_and_take_odd_rows(spark, folder):
    docs = spark.createDataFrame(
        [(1, None, "en", "a", 1, 1, "x", 1, 1.0, 2), (1, None, "en", "a", 1, 1, "x", 1, 1.0, 2), (None, "w " * 60, None, None, None, None, None, None, None, None), (3, " ".join(f"w{i}" for i in range(90)), "en", "a", 1, 5, "y", 3, 0.1, 4)],
        "doc_id long, text string, lang string, source string, n_chars long, `_id` long, row string, n long, score double, epochs int",
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, folder)
            assert out.columns == docs.columns, name
            out.collect()
    for frame in (docs, docs.limit(0)):
        corpus_pipeline.packed(spark, frame, folder).collect()
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()) == ["1", "3", "None"]
