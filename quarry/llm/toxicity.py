"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes what hides a word: compatibility forms and look-alike letters of
other scripts become Latin (capitals by their own looks, before case goes), digits
and signs that stand for letters become them, invisible characters go, case goes,
and other signs become spaces; a ! right before a letter is an i.  Accents stay, as
they tell words of other languages apart; an accented word without an entry of its
own is also looked up without its accents.

The lexicon is learned from labelled documents: whole words, and beginnings of
words (for inflected and compounded terms), that a fair share of the toxic
documents has and clean ones hardly do, weighted by their log odds.  The score
is the weight found for the length of the text, through a logistic curve fitted
to the same documents.  Matches inside an exception phrase do not count: phrases
that are given, and pairs of words of which one is in the lexicon while clean
documents have the pair and toxic ones hardly do.

Learning takes at most about ``SAMPLE_ROWS`` labelled rows, chosen by hashes of
ids and rows, from those that are not held out; matching covers all whole texts.

Defined cases: a null or empty text has no weight and scores like any clean one;
null ids are held out, and labels with a null id or label are not used; several
labels of an id count as one, toxic if any is; without both toxic and clean
labels the lexicon is empty and all scores are the smoothed share of toxic
labels; very long texts are matched whole, in time that grows with their length
and matches; repeated rows are scored each on its own; an empty table gives no
rows; further columns are ignored, or returned by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import materialize

#: Labelled rows that are learned from, in expectation.
SAMPLE_ROWS = 24_000
#: Lengths of word beginnings; the share of toxic texts, and how many, that an entry needs; its least log odds.
BEGINNINGS, LEAST_SHARE, LEAST_TEXTS, LEAST_ODDS = range(4, 9), 0.02, 4, 3.0
#: Toxic texts for each clean one that a pair of words may have and be an exception.
MOST_TOXIC = 0.12
#: Words added to a text's length, so that one match in a few words is not all.
EXTRA_WORDS = 40

# Letters that look like Latin ones, digits and signs that stand for letters.
CYRILLIC = dict(zip("авекмнорстухіјѕԁӏ", "abekmhopctyxijsdl", strict=True))
GREEK = dict(zip("αεικνορτυχ", "aeiknoptux", strict=True))
GREEK_CAPITALS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abezhikmnoptyx", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "abcdeghjklmprstvwz", strict=True))
ARMENIAN = dict(zip("հոսօ", "hnuo", strict=True))
SMALL_CAPITALS = dict(zip("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoprstuvwyz", strict=True))
LATIN = dict(zip("ıɑɡɩøđłħ", "iagiodlh", strict=True))
LEET = dict(zip("0134578@$", "oieastbas", strict=True))
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "rodeo clown")


class _Folds(dict):
    """Of a code point: what it becomes; signs become spaces."""

    def __missing__(self, code: int):
        c = chr(code)
        kind = unicodedata.category(c)
        self[code] = out = None if kind in ("Cf", "Mn") else c if kind[0] in "LN" else " "
        return out


_CAPITALS = str.maketrans({**GREEK_CAPITALS, **CHEROKEE})
_FOLDS = _Folds(str.maketrans({**CYRILLIC, **GREEK, **ARMENIAN, **SMALL_CAPITALS, **LATIN, **LEET}))
_MARK = re.compile(r"!(?=[^\W\d_])")


def fold(text: str) -> str:
    """Folded words, each with a space on both sides."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_CAPITALS)
    if "!" in text:
        text = _MARK.sub("i", text)
    return f" {' '.join(text.lower().translate(_FOLDS).split())} "


def unaccented(folded: str) -> str:
    """The same words without accents."""
    return unicodedata.normalize("NFKD", folded).translate(_FOLDS)


def terms(folded: str) -> set[str]:
    """' word ' for words and ' begin' for beginnings of longer ones."""
    out = set()
    for w in set(folded.split()):
        if len(w) > 2:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in BEGINNINGS if k <= len(w))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            self._automaton = a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                if (folded := fold(phrase)) not in self.weights:
                    a.add_word(folded, (len(folded), None))
            a.make_automaton()
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def weight(self, folded: str) -> float:
        """The weight of all matches outside exception phrases; of those that begin together, the heaviest."""
        if not self.weights:
            return 0.0
        hits, spared = {}, []
        for end, (n, w) in self.automaton().iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            else:
                hits[start] = max(w, hits.get(start, 0.0))
        spared.sort(reverse=True)
        total, upto = 0.0, 0
        for at in sorted(hits):
            # Of the phrases that begin at or before here, the furthest end.
            while spared and spared[-1][0] <= at:
                upto = max(upto, spared.pop()[1])
            if at >= upto:
                total += hits[at]
        return total

    def accented(self, folded: str) -> float:
        """The weight of words that match without their accents only."""
        words = [(a, b) for a, b in zip(folded.split(), unaccented(folded).split(), strict=True) if a != b]
        if not words or not self.weight(" . ".join(["", *(b for _, b in words), ""])):
            return 0.0
        return sum(self.weight(f" {b} ") for a, b in words if not self.weight(f" {a} "))

    def density(self, text: str | None) -> float:
        """Weight for each hundred words."""
        folded = fold(text or "")
        w = self.weight(folded)
        if not folded.isascii():
            w += self.accented(folded)
        if w:
            return 100 * w / (folded.count(" ") + EXTRA_WORDS)
        return 0.0


@dataclass
class Model:
    """P(toxic) = logistic(slope * log(1 + density) + bias)."""

    lexicon: Lexicon
    slope: float
    bias: float

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.log1p(np.array([self.lexicon.density(t) for t in texts], float))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about ``most`` training rows; equal texts are taken once."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    # At most about ``most`` pairs of numbers, so their size is bounded; an id may have any number of rows.
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = chosen.count()
    if rows > most:
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 20)) < int(most / rows * (1 << 20)))
    return materialize(chosen.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")


def _count_terms(texts: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """In how many texts each (wanted) term is."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found = terms(fold(t))
                seen.update(found if wanted is None else found & wanted)
            if len(seen) > 400_000:
                yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())})

    return texts.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    n_of = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n_of.get(1, 0), n_of.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, exceptions)
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * toxic))
    # A text of w words has fewer than 6 w terms and each needs its share of texts, so few pass.
    often = {r["term"]: r["n"] for r in _count_terms(sample.filter("toxic = 1")).filter(F.col("n") >= least).collect()}
    also = {r["term"]: r["n"] for r in _count_terms(sample.filter("toxic = 0"), frozenset(often)).collect()}
    odds = {t: math.log((n + 0.5) / (toxic + 1)) - math.log((also.get(t, 0) + 0.5) / (clean + 1)) for t, n in often.items()}
    strong = sorted((t for t in odds if odds[t] >= LEAST_ODDS), key=lambda t: (-odds[t] * often[t], t))
    # An entry adds nothing to a beginning of it that is as telling; a beginning adds
    # nothing to far more telling entries that account for most of it.
    whole = [t for t in strong if not any(odds.get(t[:k], 0) >= max(LEAST_ODDS, odds[t] - 1) for k in range(2, len(t)))]
    longer: Counter = Counter()
    for t in whole:
        for k in range(2, len(t)):
            if t[:k] in odds and odds[t[:k]] < odds[t] - 1:
                longer[t[:k]] += often[t]
    kept = {t: odds[t] for t in whole if longer[t] < 0.8 * often[t]}
    return Lexicon(kept, (*exceptions, *learn_exceptions(sample, kept, exceptions)))


def pairs(folded: str, weights: dict[str, float]) -> set[str]:
    """Neighbouring words of which one or both are, or begin with, an entry."""
    words = folded.split()
    bad = [f" {w} " in weights or any(f" {w[:k]}" in weights for k in BEGINNINGS) for w in words]
    return {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if bad[i] or bad[i + 1]}


def learn_exceptions(sample: DataFrame, weights: dict[str, float], given: tuple[str, ...] = ()) -> list[str]:
    """Pairs of words around entries that LEAST_TEXTS or more clean texts have, and hardly any toxic one; none that is given."""
    if not weights:
        return []

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((p, toxic) for p in pairs(fold(text), weights))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["pair", "toxic", "n"])

    found = sample.select("text", "toxic").mapInArrow(count, "pair string, toxic int, n long")
    of = lambda side: F.coalesce(F.sum(F.when(F.col("toxic") == side, F.col("n"))), F.lit(0))
    often = found.groupBy("pair").agg(of(0).alias("clean"), of(1).alias("toxic")).filter((F.col("clean") >= LEAST_TEXTS) & (F.col("toxic") + 0.5 <= MOST_TOXIC * (F.col("clean") + 0.5)))
    return sorted({r["pair"] for r in often.collect()} - {fold(g).strip() for g in given})


def fit_curve(counts: dict[tuple[float, int], int]) -> tuple[float, float]:
    """Slope and bias from {(log density, toxic): rows}, by Newton steps with a weak prior; classes weigh alike."""
    x, y = np.array([k[0] for k in counts]), np.array([k[1] for k in counts], float)
    n = np.array(list(counts.values()), float)
    for side in (0, 1):
        n[y == side] /= n[y == side].sum()
    design, w, prior = np.stack([x, np.ones_like(x)], 1), np.zeros(2), 1e-4 * np.eye(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        slope = design.T @ (n * (p - y)) + prior @ w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + prior, slope)
        w -= step * min(1, 4 / max(1e-12, np.abs(step).max()))
    return float(w[0]), float(w[1])


def _densities(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [round(math.log1p(lexicon.density(t)), 2) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], ["x", "toxic"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels)
    lexicon = learn_lexicon(sample)
    found = sample.select("text", "toxic").mapInArrow(_densities(lexicon), "x double, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n"))
    counts = {(r["x"], r["toxic"]): r["n"] for r in found.collect()}
    if lexicon.weights:
        return Model(lexicon, *fit_curve(counts))
    toxic = sum(n for (_, y), n in counts.items() if y)
    share = (toxic + 0.5) / (sum(counts.values()) + 2)
    return Model(lexicon, 0.0, math.log(share / (1 - share)))


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(model.score(t.to_pylist()))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(learn(docs, labels), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under one half, with their columns."""
    return docs.filter(score_column(learn(docs, labels), F.col("text")) < 0.5)
