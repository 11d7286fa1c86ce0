"""Each operator on nulls, ties, repeated rows, long texts, clashing columns and empty tables, against brute force."""

import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import brown_lm, jpeg, mixing, packing, quality, sharding, simhash, token_files, tokens, toxicity, warc
from quarry.llm.components import components
from quarry.llm.storage import new_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, hash long, shard int, fp long, row string, score double, k int"


def texts():
    rng = random.Random(3)
    prose = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 90))) for _ in range(40)]
    odd = [None, "", " \n\t ", "one", "two words", "a b c a b c a b c", "Ünïcode ñ 日本 語", "x\n\nx\ny\n \ny", "  spaced   out  ", "<|endoftext|> a", "#*$%&|<>" * 9, prose[0], prose[0], prose[0] + " tail"]
    return prose + odd + [" ".join(f"{rng.choice(WORDS)}{rng.randrange(3000)}" for _ in range(9000))]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", [None, "a", "b", "ü"][i % 4], 1, 5, 5, 5, 5, "r", 0.5, 1) for i, t in enumerate(texts())]
    return out + [out[3], out[3], (None, "no id", "en", "a", 1, 1, 1, 1, 1, "r", 0.1, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, int(r[0] % 3 == 0) if r[0] is not None else 1) for r in rows] + [(5, 0, None)], "doc_id long, quality int, toxic int")


def bytes_of(t):
    return (t or "").encode()


def test_quality_ledger(docs, rows):
    def brute(t):
        w, lines = bytes_of(t).split(), (t or "").split("\n")
        lines = [x for x in lines if x.encode().split()]
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    led = quality.apply_policy(quality.ledger(docs), quality.V1)
    got = sorted([tuple(r[k] for k in ("doc_id", *quality.MEASUREMENTS)) for r in led.collect()], key=str)
    assert got == sorted([(r[0], *brute(r[1])) for r in rows], key=str)
    bad = {r.doc_id for r in led.filter("not kept").collect()}
    assert bad == {r[0] for r in rows if (m := brute(r[1]))[0] < 50 or 100 * m[4] > 50 * m[0] or 10 * m[2] > m[0]} and 54 not in bad
    kept = quality.keep_rows(docs, quality.V1)
    assert kept.columns == docs.columns and kept.count() == led.filter("kept").count()


def test_quality_ablation(docs):
    led = quality.ledger(docs)
    policy = quality.POLICIES["strict"]
    bits, one = [r.fail_bits for r in led.collect()], {r.name: 1 << r.bit for r in quality.RULES}
    whole = quality.mask(policy)
    for r in quality.ablation(led, policy).collect():
        b = one[r.rule]
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(x & b != 0 for x in bits), sum(x & whole == b for x in bits), sum(x & whole & ~b == 0 for x in bits))


def test_hypergeometric_is_exact():
    rng = random.Random(5)
    got = Counter(sharding.hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    for k in range(6):
        want = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(got[k] / 20_000 - want) < 0.012
    m = sharding.communication_matrix([10, 0, 7, 3], sharding.equal_sizes(20, 6), 1)
    assert [sum(r) for r in m] == [10, 0, 7, 3] and [sum(c) for c in zip(*m, strict=True)] == [4, 4, 3, 3, 3, 3]
    assert 0 <= sharding.hypergeometric(rng, 10**10, 3 * 10**10, 10**9) <= 10**9


def test_sharding(docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 2)
    got = sharding.shuffle_documents(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(bytes_of(r[1])) + 8, zlib.crc32(bytes_of(r[1]))) for r in rows)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(got, key=str) == sorted(sharding.shuffle_documents(docs, 5).collect(), key=str)



def test_native_draws_follow_the_law(spark):
    """Counts by column expressions: their law on small cases, and sums and bounds on large ones."""
    rows = spark.range(20_000).select(sharding.hypergeometric_column(F.lit(6).cast("long"), F.lit(9).cast("long"), F.lit(5).cast("long"), (F.col("id") + 0.5) / 20_000).alias("k"))
    got = Counter(r.k for r in rows.collect())
    for k in range(6):
        assert abs(got[k] - 20_000 * math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)) <= 1
    big = spark.range(50).select(sharding.hypergeometric_column(F.lit(10**6).cast("long"), F.lit(3 * 10**6).cast("long"), F.lit(10**5).cast("long"), (F.col("id") + 0.5) / 50).alias("k"))
    ks = [r.k for r in big.collect()]
    assert ks == sorted(ks) and abs(np.mean(ks) - 25_000) < 20 and abs(np.std(ks) - 135) < 12
    for n in (0, 1, 15, 16, 17, 1000, 10**9):
        assert spark.range(1).select(sharding.log_factorial(F.lit(n).cast("long")).alias("x")).first().x == pytest.approx(math.lgamma(n + 1), rel=1e-12, abs=1e-11)


def test_matrix_drawn_in_levels(spark, monkeypatch):
    """Few groups on the driver and many blocks: exact sizes, even with 100,000 equal rows of a null id."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 2000)
    monkeypatch.setattr(sharding, "MOST_GROUPS", 4)
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("text"))
    got = sharding.shuffle_documents(docs, 7).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sorted(r.n for r in got) == sorted(sharding.equal_sizes(100_000, 7)) and all(r.n == r.d == r.m + 1 for r in got)


def test_sharding_against_a_plain_deal(spark, monkeypatch):
    """The same draws, dealt row by row in Python."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 8)
    monkeypatch.setattr(sharding, "MOST_GROUPS", 3)
    rows = spark.range(300).select("id", (F.col("id") % 5).alias("v")).repartition(3).cache()
    held, counts = [], {}
    plain, blocks = sharding.materialize, sharding.block_counts
    monkeypatch.setattr(sharding, "materialize", lambda df, tag: held.append(out := plain(df, tag)) or out)
    monkeypatch.setattr(sharding, "block_counts", lambda *a: counts.setdefault("all", blocks(*a)))
    got = {(r.id, r.v): (r.shard, r.slot) for r in sharding.assign(rows, 4).collect()}
    of_block = {r._block: r._counts for r in counts["all"].collect()}
    draw = lambda k: F.xxhash64(F.lit(f"42/{k}"), "_at", "id", "v").alias(k)
    drawn = held[0].select("id", "v", "_at", draw("block"), draw("first"), draw("second")).collect()
    n_blocks = len(of_block)
    assert n_blocks > 8 and [sum(c) for c in zip(*of_block.values(), strict=True)] == [75] * 4
    shards = [[] for _ in range(4)]
    for b, wanted in of_block.items():
        mine = sorted((r for r in drawn if r.block % n_blocks == b), key=lambda r: (r.first, r._at))
        assert len(mine) == sum(wanted)
        for k, n in enumerate(wanted):
            shards[k] += mine[:n]
            mine = mine[n:]
    for k, members in enumerate(shards):
        # Ranges are those of the unsigned hash, rows within one in signed order.
        order = sorted(members, key=lambda r: ((r.second & (1 << 64) - 1) >> 60, r.second, r._at))
        assert [got[r.id, r.v] for r in order] == [(k, j) for j in range(len(order))]


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, capped, total = {n: weights[i % 3] for i, n in enumerate(names)}, set(), sum(sizes.values())
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(most * sizes[n] for n in capped)
        t = {n: most * sizes[n] if n in capped else left * w[n] / sum(w[x] for x in free) for n in names}
        if not (over := [n for n in free if t[n] > most * sizes[n]]):
            return t
        capped |= set(over)


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, rng.randrange(10**6)]) for i in range(9)} | {None: 50}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(water(sizes))


def test_mixing(docs, rows):
    got = mixing.mix_documents(docs).collect()
    size = {(r[0], r[1]): len(bytes_of(r[1]).split()) for r in rows}
    sums = Counter()
    for r in rows:
        sums[r[3]] += size[r[0], r[1]]
    targets = water(sums)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for (i, t), n in ((((r[0], r[1])), size[r[0], r[1]]) for r in rows))
    source, taken = {r[0]: r[3] for r in rows}, Counter()
    for r in got:
        assert r.taken in {k * r.size for k in range(4)} and r.target == pytest.approx(targets[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s in targets:
        assert abs(taken[s] - targets[s]) <= max(size[r[0], r[1]] for r in rows if r[3] == s)
    repeated = Counter(r.doc_id for r in mixing.repeat_rows(docs).collect())
    times = Counter()
    for r in got:
        times[r.doc_id] += r.taken // r.size if r.size else 0
    assert {k: v for k, v in times.items() if v} == {k: v for k, v in repeated.items() if times[k]}


def test_mixing_ties(spark, monkeypatch):
    """Null and repeated ids, and equal rows, come near the target like any others."""
    rows = [(None, f"w{i} x y z", "a") for i in range(100)] + [(7, " ".join(["v"] * 4), "b") for _ in range(90)] + [(8, "q", "b")] * 9 + [(None, "k", None)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_documents(docs).collect()
    target, taken, times = {}, Counter(), Counter()
    for r in got:
        key = {4: "a", 1: None}.get(r.size, "b") if r.doc_id is None else "b"
        target[key] = r.target
        taken[key] += r.taken
    assert len(got) == len(rows) and all(abs(taken[k] - target[k]) <= 4 for k in target)
    for r in mixing.repeat_rows(docs).collect():
        times[r.source] += len(r.text.split())
    assert times == taken


def test_simhash_and_components(docs, rows, spark):
    def fp(t):
        w = bytes_of(t).lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    near = simhash.near_duplicates(docs).collect()
    fps = {r[0]: fp(r[1]) for r in rows}
    assert all(r.fp & (1 << 64) - 1 == fps[r.doc_id] for r in near) and len(near) == len(rows)
    group = {i: {i} for i in fps}
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] is not group[j]:
                both = group[i] | group[j]
                for x in both:
                    group[x] = both
    assert all(r.component_id == min((x for x in group[r.doc_id] if x is not None), default=None) for r in near)
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert Counter(kept) == Counter({min((x for x in g if x is not None), default=None) for g in group.values()})
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(30)]
    some = {b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 1, 2, 3, 3, 4)}
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(i, 200) for i in range(100, 130)] + [(7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(chain).collect()}
    assert roots == {**dict.fromkeys(range(51), 0), **dict.fromkeys([*range(100, 130), 200], 100)}


def test_token_files(docs, rows, spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 30_000)
    monkeypatch.setattr(token_files, "FRAME_BYTES", 2_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_files.write_files(docs, path, 1, True, new_path(spark, "t"))
    got = sorted(token_files.read_files(files).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(path)
    ids = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    want, at = [], 0
    # Rows that share an id share a text here, so their order is free.
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, at, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())))
        at += want[-1][2]
    assert [tuple(r) for r in got] == want
    uri = files.orderBy("part").collect()[-1].uri
    reader = token_files.FrameReader(uri)
    last = int(reader.index["doc_id"][-1])
    before = reader.frames_read
    (doc_id, _, found), = reader.documents({last})
    text = next(r[1] for r in rows if r[0] == last)
    assert doc_id == last and found.tolist() == ids(text) and reader.frames_read == before + 1
    raw = open(uri.removeprefix("file://"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain.startswith(np.array(ids(next(r[1] for r in rows if r[0] == reader.index["doc_id"][0])), "<u2").tobytes())
    k = int(reader.starts[0]) + 12
    damaged = uri.removeprefix("file://") + ".bad"
    open(damaged, "wb").write(raw[:k] + bytes([raw[k] ^ 0x55]) + raw[k + 1 :])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FrameReader("file://" + damaged).documents())


def test_token_files_split_one_id(spark, monkeypatch):
    """Rows without an id fill several files, and all come back."""
    monkeypatch.setattr(token_files, "FILE_BYTES", 2_000)
    docs = spark.createDataFrame([(None, f"text number {i} of many") for i in range(600)], "doc_id long, text string").repartition(3)
    files = token_files.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), 1, True, new_path(spark, "t"))
    assert files.count() > 2 and files.agg(F.max("n_docs")).first()[0] < 400
    assert token_files.read_files(files).count() == 600


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_parts_encode_as_whole_texts(name, drops):
    path = public_tokenizers.path(name)
    odd = ["", " ", "  ", "a  b", "a   b c ", " lead", "x \n y", "x\n\n  y", "don't  we'll", "ΣΑΣ İ", "é café", "\xa0nb sp　y", "a\tb\x0bc", "1234 5a", "\x1c\x1d a\x85b c", "ſ ﬁ µ"]
    tok = Tokenizer.from_file(path)
    for t in [*odd, *(x for x in texts() if x)]:
        assert np.frombuffer(tokens.encoder(path, drops)([t])[0], "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 64).collect()
    whole = Counter(tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows)
    by_sequence, total = {}, 0
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        total += r.length
    assert total == sum(len(k) * n for k, n in whole.items())
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(sum(r.length for r in p) < 64 for p in by_sequence.values()) <= 1
    ids = {r[0]: np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    seen = Counter()
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
    copies = Counter(r[0] for r in rows)
    assert all(n == copies[i] for (i, _), n in seen.items())


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(0)
    docs = [rng.integers(1000 * (k % 4), 1000 * (k % 4) + 60, 30).astype("<u2") for k in range(40)]
    mixed = 0
    for window in {p[3] for p in packing.pack_shard(docs, 90)}:
        topics = {p[0] % 4 for p in packing.pack_shard(docs, 90) if p[3] == window}
        mixed += len(topics) > 1
    assert mixed <= 4


def test_bm25_against_formula():
    docs = [np.array(x, "<u2") for x in ([1, 2, 2, 3], [2, 3], [4, 5, 4], [2, 9, 9, 9, 9], [7])]
    index = packing.Bm25Index(docs)
    mean, n = np.mean([len(d) for d in docs]), len(docs)

    def score(k):
        return sum(
            math.log(1 + (n - df + 0.5) / (df + 0.5)) * (f := (docs[k] == t).sum()) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[k]) / mean))
            for t in {1, 2, 3}
            if (df := sum((d == t).any() for d in docs)) > 1
        )

    best = index.neighbours(0, np.array([True] * 5)).tolist()
    assert best == sorted((k for k in (1, 2, 3, 4) if score(k) > 0), key=lambda k: -score(k))
    assert index.neighbours(0, np.array([True, False, True, True, True])).tolist() == [3]


def test_brown_lm(docs, rows):
    got = {(r.doc_id, r.n_tokens): r for r in brown_lm.score_documents(docs).collect()}
    toks = {(r[0], r[1]): [*bytes_of(r[1]).lower().split(), b""] for r in rows}
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(t for r in rows if not out(r[0]) for t in toks[r[0], r[1]])
    n, v = sum(c.values()), len(c)
    for (i, _), t in toks.items():
        r = got[i, len(t)]
        assert r.held_out == out(i) and r.train_tokens == n and r.n_known == sum(x in c for x in t)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))


@pytest.fixture
def brown(docs, rows, monkeypatch):
    """A model with few unit words; tokens of each document number; count and class of each training word."""
    monkeypatch.setattr(brown_lm, "UNIT_WORDS", 20)
    monkeypatch.setattr(brown_lm, "FIRST_WORDS", 8)
    monkeypatch.setattr(brown_lm, "UNIT_ENDINGS", 5)
    model, encoded, rare = brown_lm.train(docs)
    units, toks, known, of_no = model.units, {}, {}, {}
    for k, (w, c) in enumerate(zip(units.names.to_pylist(), model.counts.tolist(), strict=True)):
        known[w] = (c, int(model.class_of[k]))
    for r in rare.collect():
        of_no.setdefault(r.no, []).append((r.h, r.k, r.c))
    for r in encoded.collect():
        u, words = np.frombuffer(r.units, "<u2"), iter(r.rare)
        named = units.names.to_pylist()
        toks[r.no] = (r.doc_id, r.held_out, [named[x] if x <= units.n_words else next(words) for x in u.tolist()])
    return model, encoded, rare, toks, known, of_no


def history(model, word):
    return int(model.class_of[model.units.of(pa.array([word]))[0]])


def test_brown_documents_come_back(brown, rows):
    model, encoded, rare, toks, known, of_no = brown
    assert Counter((i, tuple(t)) for i, _, t in toks.values()) == Counter((r[0], (*(w.decode() for w in bytes_of(r[1]).lower().split()), "")) for r in rows)
    assert model.units.n_words <= 20 and sum(map(len, of_no.values())) > 5000


def rare_classes(brown):
    """The class that every rare training word should have, by all its contexts, and ties."""
    model, encoded, _, toks, known, _ = brown
    of, grid = brown_lm.cluster(brown_lm.neighbours(encoded, model.units), model.units)
    assert of.tolist() == model.class_of.tolist()
    log, tokens, fits, count = brown_lm.transitions(grid), np.log10(np.maximum(grid.sum(0), 1)), {}, Counter()
    for _, held, t in toks.values():
        for i, w in enumerate(t):
            if not held and w not in known:
                fits[w] = fits.get(w, 0) + log[history(model, t[i - 1]) if i else 0] - tokens + log[:, history(model, t[i + 1])]
                count[w] += 1
    return fits, count


def test_brown_scores_against_brute_force(brown):
    model, encoded, rare, toks, known, of_no = brown
    fits, count = rare_classes(brown)
    classes = {}
    for no, (_, _, t) in toks.items():
        before = [0, *(history(model, w) for w in t[:-1])]
        want = [(h, w) for h, w in zip(before, t, strict=True) if w not in known]
        got = sorted(of_no.get(no, []))
        ks = {}
        for h, w in want:
            # Any class within rounding of the best will do, but one for each word.
            ok = [k for k in range(1, 33) if fits[w][k] >= fits[w][1:].max() - 1e-9] if w in fits else [history(model, w)]
            ks.setdefault((h, count[w]), []).append(ok)
            if len(ok) == 1:
                classes[w] = ok[0]
        for (h, c), oks in ks.items():
            mine = [k for a, k, n in got if (a, n) == (h, c)]
            assert len(mine) == len(oks) and all(any(k in ok for ok in oks) for k in mine)
    assert len(classes) > 1000
    grid, words = np.zeros((33, 33), np.int64), Counter()
    for no, (_, held, t) in toks.items():
        if not held:
            for i, w in enumerate(t):
                if w in known:
                    grid[history(model, t[i - 1]) if i else 0, known[w][1]] += 1
            for h, k, _ in of_no.get(no, []):
                grid[h, k] += 1
    assert np.allclose(10.0 ** model.transition, (grid + 0.5) / (grid.sum(1, keepdims=True) + 0.5 * 33))
    assert model.class_tokens.tolist() == grid.sum(0).tolist() and model.class_words.sum() == model.train_words
    by_id = {}
    for no, (i, held, t) in toks.items():
        total = sum(model.emission(np.array([c]), np.array([k]))[0] + model.transition[h, k] for h, k, c in of_no.get(no, []))
        for j, w in enumerate(t):
            if w in known:
                c, k = known[w]
                total += model.emission(np.array([c]), np.array([k]))[0] + model.transition[history(model, t[j - 1]) if j else 0, k]
        by_id.setdefault((i, len(t)), []).append(total)
    for r in brown_lm.score(encoded, rare, model).collect():
        assert any(r.score == pytest.approx(x) for x in by_id[r.doc_id, r.n_tokens])


def test_brown_model_is_a_distribution(brown):
    model, _, _, toks, known, of_no = brown
    # Rare words by class: each occurrence of a training word counts one part of it.
    parts = [Counter() for _ in range(33)]
    for no, (_, held, _) in toks.items():
        for _, k, c in of_no.get(no, []):
            if not held:
                parts[k][c] += 1
    for before in range(3):
        total = 0.0
        for k in range(33):
            own = np.array([c for c, of in known.values() if of == k and c] + [c for c, n in parts[k].items() for _ in range(n // c)], np.int64)
            assert own.sum() == model.class_tokens[k] and len(own) == model.class_words[k]
            inside = (10 ** model.emission(own, np.full(len(own), k))).sum() + (10 ** model.emission(np.array([0]), np.array([k])))[0]
            total += 10 ** model.transition[before, k] * inside
        assert total == pytest.approx(1, abs=1e-6)


def test_wide_sweeps_raise_the_likelihood(docs, rows, monkeypatch):
    """The likelihood of all units' classes, counted plainly, is that of the class counts, and no lower than at the start."""
    monkeypatch.setattr(brown_lm, "FIRST_WORDS", 8)
    monkeypatch.setattr(brown_lm, "UNIT_ENDINGS", 5)
    words = brown_lm.vocabulary(docs)
    units = brown_lm.choose_units(words, brown_lm.frequent(words, 800))
    encoded = brown_lm.encode(docs, units)
    near = brown_lm.neighbours(encoded, units)
    of, grid = brown_lm.cluster(near, units)
    bigrams = np.zeros((units.n, units.n), np.int64)
    for r in encoded.filter("not held_out").collect():
        u = np.frombuffer(r.units, "<u2").astype(int)
        np.add.at(bigrams, (np.concatenate([[0], u[:-1]]), u), 1)
    one_hot = np.eye(brown_lm.CLASSES + 1, dtype=np.int64)
    assert (one_hot[of].T @ bigrams @ one_hot[of] == grid).all() and bigrams.sum() == grid.sum()
    first = units.first_units()
    start = brown_lm.exchange(brown_lm.class_grid(near, first, int(first.max()) + 1))[first]
    assert brown_lm.likelihood(grid) > brown_lm.likelihood(one_hot[start].T @ bigrams @ one_hot[start])


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(4)
    bigrams, of, eye = rng.integers(0, 9, (12, 12)), np.array([0, *rng.integers(1, 5, 11)]), np.eye(5, dtype=np.int64)
    grid = lambda c: eye[c].T @ bigrams @ eye[c]
    out, into = bigrams @ eye[of], bigrams.T @ eye[of]
    got = brown_lm.gains(grid(of), out[1:], into[1:], np.diag(bigrams)[1:], of[1:])
    for u in range(1, 12):
        moved = [brown_lm.likelihood(grid(np.where(np.arange(12) == u, k, of))) for k in range(1, 5)]
        assert np.allclose(np.array(moved) - moved[of[u] - 1], got[u - 1, 1:] - got[u - 1, of[u]])


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    kinds = np.concatenate([[0], 1 + np.arange(40) % 2])
    seq = [0]
    for _ in range(4000):
        seq.append(int(rng.choice(np.nonzero(kinds == (3 - kinds[seq[-1]] if kinds[seq[-1]] else 1))[0])))
    grid = np.zeros((41, 41), np.int64)
    np.add.at(grid, (seq[:-1], seq[1:]), 1)
    of = brown_lm.exchange(grid, 2)
    assert all(len({of[u] for u in range(1, 41) if kinds[u] == k}) == 1 for k in (1, 2)) and of[0] == 0


def test_jpeg(docs, rows):
    got = jpeg.media_features(jpeg.encode_media(docs)).collect()
    assert len(got) == len(rows)
    text = {r[0]: bytes_of(r[1]) for r in rows}
    for r in got:
        p = jpeg.padded(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({r.feature for r in got if r.doc_id in (40, 41, 0)}) == 2


def test_jpeg_payloads_and_parts():
    payloads = [bytes([255]) * 576, bytes(range(256)) * 9, b"\0\xff" * 288, random.Random(1).randbytes(576 * 3000)]
    media = jpeg.encode_bytes(payloads)
    images = [jpeg.parse_media(m) for m in media]
    flat = iter(jpeg.decode_luminance([i for x in images for i in x]))
    assert [b"".join(jpeg.byte_of_sample()[next(flat)].tobytes() for _ in x) for x in images] == payloads
    assert [len(x) for x in images] == [1, 1, 1, 3] and images[0][0].width == 768
    assert sorted(jpeg.sample_of_byte().tolist()) == list(range(256))


def test_jpeg_of_a_long_text_takes_bounded_memory(monkeypatch):
    """Images of one text are expanded some at a time."""
    most, plain = [], jpeg._encode_images
    monkeypatch.setattr(jpeg, "_encode_images", lambda parts: (most.append(sum(map(len, parts))), plain(parts))[1])
    text = jpeg.padded(b"a long text of many words " * 300_000)
    media = jpeg.encode_bytes([text, jpeg.padded(b"short")])
    images = jpeg.parse_media(media[0])
    back = b"".join(jpeg.byte_of_sample()[p].tobytes() for s in jpeg.grouped(i.width * i.height // 64 for i in images) for p in jpeg.decode_luminance(images[s]))
    assert back == text and max(most) < jpeg.BATCH_BYTES + max(jpeg.images_of(len(text))) and len(most) > 2


def baseline_jpeg(grid, chroma, restart=0):
    """A colour image of 2 x 2 sampled luminance with AC terms, written bit by bit, as an independent check."""
    dc, ac = jpeg.canonical_codes(jpeg.DC_LENGTHS, jpeg.DC_SYMBOLS), jpeg.canonical_codes((0, 2, 1, *[0] * 13), (0x00, 0x01, 0xF0))
    down, across = grid.shape[0] // 2, grid.shape[1] // 2
    parts, bits, last, unit = [], "", [0, 0, 0], 0

    def put(code, value, size):
        return f"{code[0]:0{code[1]}b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    def block(c, value, busy):
        d, last[c] = value - last[c], value
        out = put(dc[abs(d).bit_length()], d, abs(d).bit_length())
        return out + (put(ac[0x01], 1, 1) + put(ac[0xF0], 0, 0) + put(ac[0x01], -1, 1) if busy else "") + put(ac[0], 0, 0)

    def close(b):
        b += "1" * (-len(b) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")

    for y in range(down):
        for x in range(across):
            if restart and unit and unit % restart == 0:
                parts.append(close(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]))
                bits, last = "", [0, 0, 0]
            for v in (0, 1):
                for h in (0, 1):
                    bits += block(0, int(grid[2 * y + v, 2 * x + h]), (x + v) % 2)
            bits += block(1, int(chroma[y, x]), True) + block(2, int(-chroma[y, x]), False)
            unit += 1
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [4] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0, *jpeg.DC_LENGTHS, *jpeg.DC_SYMBOLS])) + seg(0xC4, bytes([0x10, 0, 2, 1, *[0] * 13, 0x00, 0x01, 0xF0]))
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + b"".join(parts) + close(bits) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2, 5])
def test_jpeg_reads_colour_images_with_ac_terms(restart):
    rng = np.random.default_rng(restart)
    grid, chroma = rng.integers(-200, 200, (6, 8)), rng.integers(-50, 50, (3, 4))
    other = rng.integers(-200, 200, (4, 4))
    images = [jpeg.Image(baseline_jpeg(grid, chroma, restart)), jpeg.Image(baseline_jpeg(other, chroma[:2, :2], restart))]
    for got, want in zip(jpeg.decode_luminance(images), (grid, other), strict=True):
        assert got.tolist() == np.clip((want * 4 + 4 >> 3) + 128, 0, 255).tolist()


def test_toxicity(spark, docs, labels, rows):
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    rng = random.Random(2)
    bad = ["grumble", "snarl"]
    made = []
    for i in range(400):
        w = [rng.choice(WORDS) + rng.choice("xyz") for _ in range(rng.randrange(20, 200))]
        toxic = i % 5 == 0
        for _ in range(max(1, len(w) // 40) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "ing", "!", "ed"])
        made.append((i, " ".join(w), int(toxic)))
    d = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    model = toxicity.learn(d, spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int"))
    assert (model.score([m[1] for m in made]) >= 0.5).tolist() == [bool(m[2]) for m in made]
    hidden = ["they grսmble".replace("ս", "u"), "GRUМBLE all", "gr​umble all", "5narl 5narl", "ｓｎａｒｌ", "alpha beta"]
    assert (model.score(hidden) >= 0.5).tolist() == [True] * 5 + [False]
    spared = toxicity.Lexicon({" trash": 5.0}, ("trash can",))
    assert spared.density("the trash can there") == 0 and spared.density("trash talk") > 0 and spared.density(None) == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_documents(docs, none).collect()} == {0}
    assert toxicity.score_documents(empty, none).count() == 0


def test_warc(spark):
    rows = [(i, f"http://h/{i}\n", h) for i, h in enumerate(["a", "b", None, "a", "", "a", "é\r\n\r\nWARC/1.1", "b"])] + [(5, None, "a"), (None, "u", "a")]
    assert_warc(spark, rows)


def test_warc_repeated_ids(spark):
    assert_warc(spark, [(5, "u", "A"), (5, None, "BBBB"), (3, "u", "BBBB"), (2, "v", "A"), (1, "u", "BBBB"), (None, "u", "CC"), (None, "u", "CC"), *((k, "u", "hot") for k in range(10, 60))])


def test_warc_headers(spark):
    """Records carry what the format asks of responses and revisits."""
    pages = spark.createDataFrame([(1, None, "a"), (2, "http://h/2", "a")], "page_id long, url string, html string").coalesce(1)
    folder = new_path(spark, "warc")
    files = warc.write_resolved(warc.resolve(warc.write_responses(pages, f"{folder}/raw")), f"{folder}/resolved")
    heads = [warc.parse(m)[0] for r in files.collect() for m in warc._members(r.uri)]
    assert sorted(h["WARC-Type"] for h in heads) == ["response", "revisit"]
    response, revisit = sorted(heads, key=lambda h: h["WARC-Type"])
    assert all(h["WARC-Target-URI"] and h["Content-Type"].startswith("application/http") for h in heads)
    assert revisit["WARC-Refers-To"] == response["WARC-Record-ID"] and revisit["WARC-Refers-To-Target-URI"] == "http://h/2"


def assert_warc(spark, rows):
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload_bytes int, uri string").repartition(3)
    got = Counter(tuple(r) for r in warc.deduplicate_pages(spark, pages).collect())
    want, groups = Counter(), {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    for h, ids in groups.items():
        top, left = max((x for x in ids if x is not None), default=None), 1
        for i in ids:
            own = i == top and left
            left -= own
            want[i, len(h.encode()), warc.digest(h.encode()), "response" if own else "revisit", None if own else top] += 1
    assert got == want


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert quality.ledger(empty).count() == 0
    assert sharding.shuffle_documents(empty, 3).count() == 0
    assert mixing.mix_documents(empty).count() == 0 and mixing.repeat_rows(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert token_files.encode_and_read_back(spark, empty, path, 1, False).count() == 0
    assert packing.pack(empty, path).count() == 0
    assert brown_lm.score_documents(empty).count() == 0
    assert jpeg.media_features(jpeg.encode_media(empty)).count() == 0
    assert warc.deduplicate_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_units_of_words():
    units = brown_lm.Units(["a", "b"], ["xyz", "éüß."])
    assert units.of(pa.array(["a", "q", "wxyz", "", "äéüß!?", "b"])).tolist() == [1, 5, 3, 0, 4, 2] and units.n == 6
    words, size = brown_lm.words_of(pa.array(["  A b\x0b\x0c C\xa0Ä ", None, "", " \n", "x"]))
    assert words.to_pylist() == ["a", "b", "c\xa0Ä", "x"] and size.tolist() == [3, 0, 0, 0, 1]
