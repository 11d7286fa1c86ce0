"""The lexicon against a naive matcher, and learning against plain counting."""

import math
import random
import time
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity


def naive_fold(text):
    out, text = [], unicodedata.normalize("NFKC", text)
    for i, c in enumerate(text):
        if c == "!" and text[i + 1 : i + 2].isalpha():
            c = "i"
        c = {**toxicity.GREEK_CAPITALS, **toxicity.CHEROKEE}.get(c, c).lower()
        same = {**toxicity.CYRILLIC, **toxicity.GREEK, **toxicity.ARMENIAN, **toxicity.SMALL_CAPITALS, **toxicity.LATIN, **toxicity.LEET}.get(c)
        kind = unicodedata.category(c)
        out.append(same or ("" if kind in ("Cf", "Mn") else c if kind[0] in "LN" else " "))
    return " " + " ".join("".join(out).split()) + " "


def naive_weight(lexicon, folded):
    total = 0.0
    phrases = [p for p in map(naive_fold, lexicon.exceptions) if p not in lexicon.weights]
    for at in range(len(folded)):
        here = [w for t, w in lexicon.weights.items() if folded.startswith(t, at)]
        if here and not any(folded.startswith(p, a) for p in phrases for a in range(max(0, at - len(p) + 2), at + 1)):
            total += max(here)
    return total


def test_matches_are_those_of_a_naive_matcher():
    rng = random.Random(1)
    lexicon = toxicity.Lexicon({" trash": 2.0, " trash ": 3.5, " scum ": 4.0, " clow": 1.5, " clown ": 2.5, " ode": 0.5}, ("trash can", "can scum", "scum trash", "rodeo clown"))
    words = ["trash", "TRASH!", "trashy", "can", "scum", "5cum", "clown", "cl0wn", "rodeo", "odes", "ѕсum", "good", "—", "cĺown"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        assert toxicity.fold(text) == naive_fold(text) or not text.strip()
        folded = toxicity.fold(text)
        assert lexicon.weight(folded) == pytest.approx(naive_weight(lexicon, folded))


def test_disguises_fold_to_plain_words():
    """Each disguise against the word that a reader sees."""
    seen = {
        "ΙDΙΟΤ": "idiot", "ìdìot": "idiot", "idıot": "idiot", "Z\u0301ΖΒ": "zzb", "ΗΜ": "hm", "ɑss": "ass", "!diot": "idiot", "ᎠᎾ".replace("Ꮎ", "Ꭼ"): "de", "ꜱᴄᴜᴍ": "scum",
        "𝕚𝕕𝕚𝕠𝕥": "idiot", "ＩＤＩＯＴ": "idiot", "5cum": "scum", "ѕсum": "scum", "i\u200bd\u00adiot": "idiot", "trash!": "trash", "a ! b": "a b", "no!": "no", "lоѕеr": "loser", "øaf": "oaf",
    }
    assert {k: toxicity.unaccented(toxicity.fold(k)).strip() for k in seen} == seen
    lexicon = toxicity.Lexicon({" idiot": 3.0, " été ": 1.0}, ())
    assert [lexicon.density(t) > 0 for t in ("ìdìot", "un ìdiot", "été", "ete", "ídol", "")] == [True, True, True, False, False, False]


def test_exceptions_are_learned_from_clean_texts(spark):
    rows = [(f"the scum of earth {i}", 1) for i in range(30)] + [(f"pool scum filter {i}", 0) for i in range(20)] + [(f"plain words {i}", 0) for i in range(400)]
    got = toxicity.learn_exceptions(spark.createDataFrame(rows, "text string, toxic int"), {" scum": 3.0})
    assert got == ["pool scum", "scum filter"]
    spared = toxicity.Lexicon({" scum": 3.0}, tuple(got))
    assert spared.weight(toxicity.fold("a POOL SCUM filter")) == 0 and spared.weight(toxicity.fold("you scum")) == 3.0


def test_learned_rows_are_bounded_though_one_id_has_many(spark):
    docs = spark.range(2000).select((F.when(F.col("id") < 1500, 1).otherwise(F.col("id"))).alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    n = toxicity.labelled_sample(docs, labels, 300).count()
    assert 0 < n < 450


def test_long_texts_take_time_in_proportion():
    lexicon = toxicity.Lexicon({" trash": 2.0, " can": 1.0}, ("trash can",))
    text = "trash can " * 200_000 + "trash"
    start = time.time()
    assert lexicon.weight(toxicity.fold(text)) == 2.0
    assert time.time() - start < 20


def naive_terms(text):
    out = set()
    for w in naive_fold(text).split():
        out |= {f" {w} "} if len(w) > 2 else set()
        out |= {f" {w[:k]}" for k in range(4, 9) if k <= len(w)}
    return out


def test_lexicon_is_that_of_plain_counts(spark):
    rng = random.Random(6)
    stems = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    rows = []
    for i in range(300):
        w = [rng.choice(stems) for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["grumble", "grumbling", "snarled", "growl"])
        rows.append((" ".join(w), int(i % 3 == 0)))
    rows = sorted(dict(rows).items())
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")).weights
    n = Counter(y for _, y in rows)
    often, also = (Counter(t for x, y in rows if y == side for t in naive_terms(x)) for side in (1, 0))
    least = max(4, math.ceil(0.02 * n[1]))
    odds = {t: math.log((k + 0.5) / (n[1] + 1)) - math.log((also[t] + 0.5) / (n[0] + 1)) for t, k in often.items() if k >= least}
    strong = {t for t, x in odds.items() if x >= 3}
    whole = {t for t in strong if not any(odds.get(t[:k], 0) >= max(3, odds[t] - 1) for k in range(2, len(t)))}
    longer = {b: sum(often[t] for t in whole if t != b and t.startswith(b) and odds[b] < odds[t] - 1) for b in odds}
    assert got and got == pytest.approx({t: odds[t] for t in whole if longer[t] < 0.8 * often[t]})
