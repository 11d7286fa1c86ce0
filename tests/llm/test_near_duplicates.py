"""The near-duplicate stage keeps one row of each component, whatever the ids."""

import random

import corpus_pipeline

from quarry.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n, seed=5):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA).repartition(3)


def test_ids_that_are_null_or_shared_do_not_drop_texts(spark):
    a, b, c, d, e, f = texts(6)
    rows = [(None, a), (None, a), (None, b), (None, c), (7, d), (7, e), (7, e), (8, d), (9, f), (None, f)]
    docs = frame(spark, rows)
    want = sorted([("None", a), ("None", b), ("None", c), ("7", d), ("7", e), ("9", f)])
    for stage in (simhash.keep_one, lambda x: corpus_pipeline.near_duplicates(spark, x, "")):
        assert sorted((str(r.doc_id), r.text) for r in stage(docs).collect()) == want


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(texts):
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, whole = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * whole and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_stage_links_texts_of_similarity_of_eight_tenths(spark):
    rng, all_texts = random.Random(9), []
    for t in texts(30, 8):
        # Edits that move far from the first step by step, so that some are linked only through others.
        w = t.split()
        for k in range(4):
            all_texts.append(" ".join(w))
            for _ in range(rng.choice([1, 2, 3])):
                w[rng.randrange(len(w))] = f"edit{k}"
    big = texts(1, 77)[0].split()
    all_texts += [" ".join(big[:k] + [f"w{k}"] + big[k:]) for k in range(60)] + [None, "", "  ", "a b", "a B", "few words here"]
    group = components(all_texts)
    want = sorted(min(i for i, g in enumerate(group) if g == x) for x in set(group))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(all_texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert 30 < len(want) < 100
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_texts_that_share_bands_without_links_meet_all_others(spark, monkeypatch):
    """Bands of one minimum: most members are not similar to the leader, and are still linked among themselves."""
    from quarry.llm import similar

    monkeypatch.setattr(similar, "LEADERS", 2)
    nodes = [(k, t.encode(), [0]) for k, t in enumerate(t + x for t in texts(6, 4) for x in ("", " coda", " more coda"))]
    signatures = spark.createDataFrame(nodes, "node long, text binary, bands array<long>")
    group = components([t.decode() for _, t, _ in nodes])
    pairs = {(r.a, r.b) for r in similar.links(signatures).collect()}
    assert all(group[a] == group[b] for a, b in pairs)
    found = list(range(len(nodes)))
    for a, b in pairs:
        found = [found[a] if g == found[b] else g for g in found]
    assert len(set(found)) == len(set(group)) == 6


def test_rare_shingles_part_texts_that_share_a_passage(spark):
    """Texts with three fifths in common share no rare shingle, texts of the similarity do."""
    from quarry.llm import similar

    passage = texts(1, 31)[0]
    own = texts(12, 32)
    rows = [(k, f"{passage} {t[: len(passage) * 2 // 3]}") for k, t in enumerate(own)]
    rows += [(100 + k, t + " coda") for k, t in rows]
    frame = spark.createDataFrame([(k, t.encode()) for k, t in rows], "node long, text binary")
    keys = {}
    for r in similar.rare_shingles(frame).collect():
        keys.setdefault(r.node, set()).add(r.band)
    sets = {k: shingles(t) for k, t in rows}
    for a in sets:
        for b in sets:
            if a < b:
                linked = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
                assert linked == (b == a + 100) and (not linked or keys[a] & keys[b])
                assert linked or not keys.get(a, set()) & keys.get(b, set())


def test_near_copies_with_many_edits_are_not_compared_with_each_other(spark, monkeypatch):
    """Near copies that are too far from all others take few comparisons, and components are those of all pairs."""
    from quarry.llm import similar

    rng, base = random.Random(12), texts(1, 50)[0].split() + texts(1, 51)[0].split()
    rows = []
    for i in range(150):
        w = base[:]
        for k in rng.sample(range(len(w)), i % 9):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    compared, plain = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, tag: (compared.append(out.count()) if tag == "candidate-pairs" else None, out)[1] if (out := plain(df, tag)) else None)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(3)
    group = components([t for _, t in rows])
    got = sorted(r.doc_id for r in similar.keep_one(docs).collect())
    assert got == sorted(min(i for i, g in enumerate(group) if g == x) for x in set(group))
    assert sum(compared) < 150 * 20  # all pairs: 11,175


def _compared(monkeypatch, run):
    """What ``run`` gives, and how many pairs of texts were compared for it."""
    from quarry.llm import similar

    compared, plain = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, tag: (compared.append(out.count()) if tag == "candidate-pairs" else None, out)[1] if (out := plain(df, tag)) else None)
    return run(), sum(compared)


def test_variants_that_are_similar_to_none_take_few_comparisons(spark, monkeypatch):
    """600 texts of 300 words with 6 words changed each: no pair reaches the similarity, all share most of a text."""
    from quarry.llm import similar

    rng = random.Random(3)
    base = " ".join(texts(4, 60)).split()[:300]
    rows = []
    for i in range(600):
        w = base[:]
        for k in rng.sample(range(len(w)), 6):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(4)
    kept, compared = _compared(monkeypatch, lambda: sorted(r.doc_id for r in similar.keep_one(docs).collect()))
    group = components([t for _, t in rows])
    assert kept == sorted(min(i for i, g in enumerate(group) if g == x) for x in set(group))
    assert compared < 40_000, compared  # all pairs: 179,700


def test_recall_of_pairs_of_little_more_than_the_similarity(spark):
    """Pairs of 0.8 to 0.85 hidden among variants that are similar to none."""
    from quarry.llm import similar

    rng = random.Random(4)
    base, pairs, rows = " ".join(texts(4, 61)).split()[:300], [], []
    for i in range(150):
        w = base[:]
        for k in rng.sample(range(len(w)), 8):
            w[k] = f"edit{i}x{k}"
        twin = w[:]
        for k in rng.sample(range(len(w)), 6):
            twin[k] = f"twin{i}x{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(twin))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs.append(2 * i)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(4)
    kept = {r.doc_id for r in similar.keep_one(docs).collect()}
    assert len(pairs) > 60 and sum(i + 1 not in kept for i in pairs) >= 0.9 * len(pairs)
    linked = {2 * i + 1 for i in range(150)} - kept
    assert all(5 * len(shingles(rows[i][1]) & shingles(rows[i - 1][1])) >= 4 * len(shingles(rows[i][1]) | shingles(rows[i - 1][1])) for i in linked)
