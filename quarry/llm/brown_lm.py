"""A Brown class-based bigram model: exchange clustering, then scoring.

P(text) is the product over tokens of P(class | class before) * P(word | class).
Tokens are the words of a text and one end; a text starts after an end.

Everything that is counted covers all training documents:

* words, by one distributed sum (combined in each worker first);
* bigrams of *units*: all words but rare ones, and for a rare or unknown word its
  ending.  Units are the words that a worker can know (65,000 of them), so the
  table of bigrams is bounded by its units and not by the corpus.

Exchange clustering moves a unit to the class that raises the likelihood of the
class bigrams most.  It starts on the driver, over the most frequent words and
endings, and goes on in Spark over all units: each row holds a unit with its
neighbours, each sweep lets half of the units move against the classes of the
others, and sweeps end when the likelihood no longer rises.  Then every rare
training word gets the class that its own contexts make likeliest, by one sum
over its occurrences.  So each word of the training documents is emitted from a
class of its own contexts; unseen words are emitted from their ending's class.
What comes after a rare or unseen word is conditioned on its ending's class: a
document then needs the classes of rare words one by one and not in sequence.

Class transitions are smoothed by adding a constant; word emissions by absolute
discounting, whose discount (from the numbers of words seen once and twice) pays
for unknown words of the class.

Texts are read twice: to count words, and to store each document as its units and
its rare words.  Rare words meet in a shuffle by word, where none is frequent, so
no key is hot; what they give is summed by document.

Defined cases: a null or empty text is its end alone; a null id counts as held
out; repeated rows are counted and scored each on its own; very long texts are
taken whole, as one row each; with no training document every probability is that
of an untrained model; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.storage import discard, materialize

#: The token that ends a text; no word is empty.
END = ""
#: Words that are units of their own; those that clustering starts with; endings; classes beside that of the end.
UNIT_WORDS, FIRST_WORDS, UNIT_ENDINGS, CLASSES = 65_000, 1024, 512, 32
#: Sweeps over the first units, and over all.
SWEEPS, WIDE_SWEEPS = 12, 6
#: Added to class transitions; added to unigram counts by the base score.
TRANSITION, BASE = 0.5, 0.1
#: Tokens (by eight) that a task sums before it passes the counts on; units that are judged at once.
HELD, TOGETHER = 400_000, 256


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, with A-Z in lower case, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    # White space at an edge of a text leaves an empty part.
    kept = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(kept), np.bincount(row[kept.to_numpy(zero_copy_only=False)], minlength=len(texts))


def ending(words: pa.Array) -> pa.Array:
    """The last three characters before closing punctuation, and whether there is any."""
    core = pc.ascii_rtrim(words, characters=".,;:!?\"')")
    closed = pc.if_else(pc.less(pc.binary_length(core), pc.binary_length(words)), ".", "")
    return pc.binary_join_element_wise(pc.utf8_slice_codeunits(core, start=-3), closed, "")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c) of all tokens of training documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def summed() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held, pa.string()))
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "c"])

        for b in batches:
            words, _ = words_of(b.column(0))
            held.append(words)
            size, ends = size + len(words), ends + b.num_rows
            if size > 8 * HELD:
                yield summed()
                held, size = [], 0
        yield summed()
        yield pa.RecordBatch.from_pydict({"word": pa.array([END] if ends else [], pa.string()), "c": pa.array([ends] if ends else [], pa.int64())})

    training = _input(docs).filter(~F.col("held_out")).select("text")
    words = training.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return materialize(words, "vocabulary")


def frequent(words: DataFrame, most: int) -> dict[str, int]:
    """All words above the least count that at most ``most`` words exceed; ties at it stay out."""
    by_count = words.groupBy("c").agg(F.count("*").alias("n"))
    upto = by_count.select("c", F.sum("n").over(W.orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    least = upto.filter(F.col("upto") <= most).agg(F.min("c")).first()[0]
    return {} if least is None else {r["word"]: r["c"] for r in words.filter(F.col("c") >= least).collect()}


class Units:
    """Numbers words: 0 is the end, then frequent words, then endings, last all others."""

    def __init__(self, words: Iterable[str], endings: Iterable[str]):
        self.names, self.endings = pa.array([END, *words], pa.string()), pa.array(endings, pa.string())
        #: The last unit that is a word.
        self.n_words = len(self.names) - 1
        self.n = self.n_words + len(self.endings) + 2

    def by_ending(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(ending(words), value_set=self.endings).fill_null(len(self.endings))
        return self.n_words + 1 + at.to_numpy().astype(np.int64)

    def of(self, words: pa.Array) -> np.ndarray:
        out = pc.index_in(words, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)
        if (missing := out < 0).any():
            out[missing] = self.by_ending(words.filter(pa.array(missing)))
        return out

    def first_units(self) -> np.ndarray:
        """For each unit, the one that clustering starts with: itself, or a less frequent word's ending."""
        kept = min(FIRST_WORDS, self.n_words)
        tail = np.concatenate([self.by_ending(self.names[kept + 1 :]), np.arange(self.n_words + 1, self.n)])
        return np.concatenate([np.arange(kept + 1), tail - (self.n_words - kept)])


def choose_units(words: DataFrame, top: dict[str, int]) -> Units:
    names = sorted((w for w in top if w != END), key=lambda w: (-top[w], w))
    first = pa.array([END, *names[:FIRST_WORDS]], pa.string())

    def endings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            other = b.filter(pc.invert(pc.is_in(b.column(0), value_set=first)))
            sums = pa.table([ending(other.column(0)), other.column(1)], ["e", "n"]).group_by("e").aggregate([("n", "sum")])
            yield from pa.table([sums.column("e"), sums.column("n_sum")], ["e", "c"]).to_batches()

    found = words.mapInArrow(endings, "e string, c long").groupBy("e").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(UNIT_ENDINGS)
    return Units(names, [r["e"] for r in found.collect()])


# --- documents as units ------------------------------------------------------

ENCODED = "no long, doc_id long, held_out boolean, n_tokens long, units binary, rare array<string>"


def encode(docs: DataFrame, units: Units) -> DataFrame:
    """Each document numbered, with the unit of each token (two bytes) and its rare words in order; written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 40
        for b in batches:
            words, size = words_of(b.column(1))
            u = units.of(words)
            rare, row = u > units.n_words, np.repeat(np.arange(len(size)), size)
            ends = np.cumsum(size + 1)
            flat = np.zeros(len(u) + len(size), "<u2")
            flat[np.arange(len(u)) + row] = u
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int64)), pa.py_buffer(flat)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=len(size)))]).astype(np.int32)), words.filter(pa.array(rare)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(no, no + len(size))), b.column(0), b.column(2), pa.array(size + 1), blobs.cast(pa.binary()), lists], ["no", "doc_id", "held_out", "n_tokens", "units", "rare"]
            )
            no += len(size)

    return materialize(_input(docs).mapInArrow(run, ENCODED), "lm-encoded")


def _joined(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _after_end(x: np.ndarray) -> np.ndarray:
    """What comes before each of ``x``; every document ends with 0, so the next one starts after it."""
    return np.concatenate([x[:0], [0], x[:-1]]) if len(x) else x


# --- exchange clustering -----------------------------------------------------


def neighbours(encoded: DataFrame, units: Units) -> DataFrame:
    """One row per unit: the units after it and before it with their counts in training documents; written once.

    ``others`` (two bytes each) has those after it first, ``split`` of them;
    ``counts`` has eight bytes each.
    """
    n = units.n

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            pair, times = np.unique(np.concatenate(held), return_counts=True)
            for k in range(0, len(pair), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + (1 << 16)]), pa.array(times[k : k + (1 << 16)])], ["pair", "n"])

        for b in batches:
            u = _joined(b.column(0).to_pylist(), "<u2").astype(np.int64)
            held.append(_after_end(u) * n + u)
            size += len(u)
            if size > 8 * HELD:
                yield from summed()
                held, size = [], 0
        if size:
            yield from summed()

    # A task has summed its own pairs, so they are shuffled as they are.
    counted = encoded.filter(~F.col("held_out")).select("units").mapInArrow(count, "pair long, n long").repartition("pair")
    pairs = materialize(counted.groupBy("pair").agg(F.sum("n").alias("n")), "lm-bigrams")
    first, second = F.expr(f"pair div {n}"), F.col("pair") % n
    side = lambda unit, other, k: pairs.select((F.shiftleft(unit, 17) + (k << 16) + other).alias("key"), "n")
    both = side(first, second, 0).union(side(second, first, 1))
    tasks = 1 + 2 * pairs.count() // (1 << 20)
    ordered = both.repartition(tasks, F.shiftright("key", 17)).sortWithinPartitions("key")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                key, times = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate((key, times)))
            starts = np.flatnonzero(np.diff(key >> 17, prepend=-1)).tolist()
            # The last unit may go on in the next batch.
            ends = [*starts[1:], *([len(key)] if b is None and len(key) else [])]
            rows = [(int(key[s] >> 17), int(np.searchsorted(key[s:e] >> 16 & 1, 1)), (key[s:e] & 0xFFFF).astype("<u2").tobytes(), times[s:e].astype("<i8").tobytes()) for s, e in zip(starts, ends, strict=False)]
            if ends:
                key, times = key[ends[-1] :], times[ends[-1] :]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["unit", "split", "others", "counts"])

    packed = materialize(ordered.mapInArrow(pack, "unit int, split int, others binary, counts binary"), "lm-neighbours")
    discard(pairs)
    return packed


def _side_counts(b: pa.RecordBatch, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of a batch; counts [unit, class] after and before it; and of itself after itself."""
    unit, split = b.column(0).to_numpy(), b.column(1).to_numpy()
    blobs = b.column(2).to_pylist()
    size = np.array([len(x) // 2 for x in blobs], np.int64)
    other, times = _joined(blobs, "<u2"), _joined(b.column(3).to_pylist(), "<i8").astype(float)
    row, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    before = np.arange(len(other)) - starts[row] >= split[row]
    counts = np.bincount((2 * row + before) * width + of[other], times, 2 * len(size) * width).reshape(len(size), 2, width)
    itself = (other == unit[row]) & ~before
    return unit, counts[:, 0], counts[:, 1], np.bincount(row[itself], times[itself], len(size))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(grid: np.ndarray) -> float:
    """Log likelihood of class bigrams [class, next class], but for a constant."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(1)).sum() - _xlogx(grid.sum(0)).sum())


def gains(grid: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What each class [unit, class] would add to the likelihood, each unit taken from its class ``of`` alone.

    ``out`` and ``into`` count classes after and before a unit, ``own`` the unit
    after itself.  The end's class 0 takes no other unit.
    """
    b, rows, cols = np.arange(len(of)), out.sum(1, keepdims=True), into.sum(1, keepdims=True)
    out, into = out.astype(float), into.astype(float)
    out[b, of] -= own
    into[b, of] -= own
    g = np.repeat(grid[None].astype(float), len(of), 0)
    g[b, of] -= out
    g[b, :, of] -= into
    g[b, of, of] -= own
    now, own = _xlogx(g), own[:, None]
    diagonal, diagonal_now = np.einsum("bkk->bk", g), np.einsum("bkk->bk", now)
    by_row, by_col = _xlogx(g + out[:, None, :]) - now, _xlogx(g + into[:, :, None]) - now
    gain = by_row.sum(2) - np.einsum("bkk->bk", by_row) + by_col.sum(1) - np.einsum("bkk->bk", by_col)
    gain += _xlogx(diagonal + out + into + own) - diagonal_now
    # Classes as wholes lose the unit alone, not what is beside it.
    left, right = g.sum(2) + into, g.sum(1) + out
    gain -= _xlogx(left + rows) - _xlogx(left) + _xlogx(right + cols) - _xlogx(right)
    gain[:, 0] = -np.inf
    return gain


def best_classes(gain: np.ndarray, of: np.ndarray) -> np.ndarray:
    stay = gain[np.arange(len(of)), of] >= gain.max(1) - 1e-9
    return np.where(stay, of, gain.argmax(1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit, one move after another; the end (unit 0) keeps class 0 for itself."""
    n = len(bigrams)
    of = np.concatenate([[0], 1 + np.arange(n - 1) % classes])
    one_hot = np.eye(classes + 1, dtype=np.int64)[of]
    to_class, from_class = bigrams @ one_hot, bigrams.T @ one_hot
    grid = one_hot.T @ to_class
    order = 1 + np.argsort(-(bigrams.sum(1) + bigrams.sum(0))[1:], kind="stable")
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            s, own = of[u], bigrams[u, u]
            gain = gains(grid, to_class[u : u + 1], from_class[u : u + 1], np.array([own]), np.array([s]))
            k = int(best_classes(gain, np.array([s]))[0])
            if k != s:
                out, into = to_class[u].copy(), from_class[u].copy()
                out[s] -= own
                into[s] -= own
                for c, sign in ((s, -1), (k, 1)):
                    grid[c] += sign * out
                    grid[:, c] += sign * into
                    grid[c, c] += sign * own
                    to_class[:, c] += sign * bigrams[:, u]
                    from_class[:, c] += sign * bigrams[u]
                of[u], moved = k, moved + 1
        if not moved:
            break
    return of


def class_grid(near: DataFrame, of: np.ndarray, width: int) -> np.ndarray:
    """Counts [class of a unit, class of the next] over all units; a class for each unit is given."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((width, width))
        for b in batches:
            # Those after a unit are enough.
            split = b.column(1).to_pylist()
            other = _joined([x[: 2 * n] for x, n in zip(b.column(2).to_pylist(), split, strict=True)], "<u2")
            times = _joined([x[: 8 * n] for x, n in zip(b.column(3).to_pylist(), split, strict=True)], "<i8")
            code = np.repeat(of[b.column(0).to_numpy()], split) * width + of[other]
            grid += np.bincount(code, times.astype(float), width * width).reshape(width, width)
        at = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(grid.ravel()[at].astype(np.int64))], ["pair", "n"])

    return _square(near.mapInArrow(count, "pair long, n long"), width)


def _square(sums: DataFrame, width: int) -> np.ndarray:
    """Partial sums of (pair, n) as a matrix of ``width`` squared, whatever the input's size."""
    table, out = sums.groupBy("pair").agg(F.sum("n").alias("n")).toArrow(), np.zeros(width * width, np.int64)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(width, width)


def _moves(near: DataFrame, of: np.ndarray, grid: np.ndarray, turn: int) -> list:
    """(unit, class) of the units that gain by moving, of every other unit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, out, into, own = _side_counts(b, of, len(grid))
            for k in range(0, len(unit), TOGETHER):
                at = slice(k, k + TOGETHER)
                was = of[unit[at]]
                new = best_classes(gains(grid, out[at], into[at], own[at], was), was)
                yield pa.RecordBatch.from_arrays([pa.array(unit[at][new != was]), pa.array(new[new != was])], ["unit", "k"])

    return near.filter((F.col("unit") % 2 == turn % 2) & (F.col("unit") > 0)).mapInArrow(run, "unit int, k long").collect()


def cluster(near: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the counts between classes."""
    first = units.first_units()
    coarse = class_grid(near, first, int(first.max()) + 1)
    of, width = exchange(coarse)[first], CLASSES + 1
    grid = class_grid(near, of, width)
    for turn in range(WIDE_SWEEPS):
        moves, new = _moves(near, of, grid, turn), of.copy()
        for unit, k in moves:
            new[unit] = k
        after = class_grid(near, new, width)
        if likelihood(after) <= likelihood(grid):
            break
        of, grid = new, after
    return of, grid


def transitions(grid: np.ndarray) -> np.ndarray:
    """log10 P(next class | class)."""
    return np.log10((grid + TRANSITION) / (grid.sum(1, keepdims=True) + TRANSITION * len(grid)))


# --- rare words ---------------------------------------------------------------


def _array(values: Iterable[float]) -> str:
    """A constant array for an SQL expression."""
    return f"array({', '.join(f'{x:.12e}D' for x in values)})"


def rare_words(encoded: DataFrame, units: Units, of: np.ndarray, grid: np.ndarray) -> DataFrame:
    """no, held_out, h, k and c of each rare word: the class before it, its own, and its count in training documents; written once.

    Its class is the one that is likeliest by all its training contexts; that of
    its ending where it has none.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, rare = b.column(2).to_pylist(), b.column(3)
            size = np.array([len(x) // 2 for x in blobs], np.int64)
            u = _joined(blobs, "<u2")
            k = of[u]
            at = np.flatnonzero(u > units.n_words)
            row = np.repeat(np.arange(len(size)), size)[at]
            held = b.column(1).to_numpy(zero_copy_only=False)[row].astype(np.int64)
            # A rare word is never the end, so something follows it in its document.
            info = held << 24 | k[at] << 16 | k[np.minimum(at + 1, len(k) - 1)] << 8 | _after_end(k)[at]
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[row]), rare.flatten(), pa.array(info.astype(np.int32))], ["no", "word", "info"])

    rows = encoded.select("no", "held_out", "units", "rare").mapInArrow(emit, "no long, word string, info int").repartition("word")
    field = lambda shift: F.shiftright("info", shift).bitwiseAND(0xFF)
    log, tokens = transitions(grid), np.log10(np.maximum(grid.sum(0), 1))
    fits = [F.sum(F.expr(f"get({_array(log[:, k] - tokens[k])}, info & 255) + get({_array(log[k])}, shiftright(info, 8) & 255)")) for k in range(1, CLASSES + 1)]
    training = rows.filter(field(24) == 0).groupBy("word").agg(F.count("*").alias("c"), F.array(*fits).alias("fits"))
    classes = training.select("word", "c", F.array_position("fits", F.array_max("fits")).cast("int").alias("best"))
    out = rows.join(classes, "word", "left").select(
        "no", (field(24) == 1).alias("held_out"), field(0).alias("h"), F.coalesce("best", field(16)).alias("k"), F.coalesce("c", F.lit(0)).alias("c")
    )
    return materialize(out, "lm-rare")


@dataclass
class Model:
    units: Units
    class_of: np.ndarray
    counts: np.ndarray  # of the end and the words that are units
    transition: np.ndarray  # log10, [class, next class]
    class_tokens: np.ndarray
    class_words: np.ndarray
    discount: float
    train_tokens: int
    train_words: int

    def emission(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words seen ``c`` times; unknown words share what discounting leaves."""
        mass = np.where(c > 0, c - self.discount, self.discount * self.class_words[k])
        return np.where(self.class_tokens[k] > 0, np.log10(np.maximum(mass, 1e-300) / np.maximum(self.class_tokens[k], 1)), 0.0)

    @property
    def whole(self) -> float:
        return self.train_tokens + BASE * (self.train_words + 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + BASE) / self.whole)


def _word_transitions(encoded: DataFrame, units: Units, of: np.ndarray) -> np.ndarray:
    """Counts [class, class of a word that is a unit after it] in training documents."""
    width = CLASSES + 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * width, np.int64)
        for b in batches:
            u = _joined(b.column(0).to_pylist(), "<u2")
            k = of[u]
            sums += np.bincount((_after_end(k) * width + k)[u <= units.n_words], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["pair", "n"])

    return _square(encoded.filter(~F.col("held_out")).select("units").mapInArrow(count, "pair long, n long"), width)


def train(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, all documents as units, and their rare words with classes."""
    words = vocabulary(docs)
    top = frequent(words, UNIT_WORDS)
    units = choose_units(words, top)
    tokens, distinct, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    counts = np.array([top.get(w, 0) for w in units.names.to_pylist()], np.int64)
    encoded = encode(docs, units)
    near = neighbours(encoded, units)
    of, grid = cluster(near, units)
    discard(near)
    rare = rare_words(encoded, units, of, grid)
    # A word of count c adds 1 / c at each of its occurrences, so it counts once.
    sums = rare.filter(~F.col("held_out")).groupBy((F.col("h") * (CLASSES + 1) + F.col("k")).cast("long").alias("pair")).agg(F.count("*").alias("n"), F.sum(1 / F.col("c")).alias("words")).collect()
    between, class_words = _word_transitions(encoded, units, of), np.bincount(of[: len(counts)][counts > 0], minlength=CLASSES + 1).astype(float)
    for r in sums:
        between[divmod(r["pair"], CLASSES + 1)] += r["n"]
        class_words[r["pair"] % (CLASSES + 1)] += r["words"]
    return Model(units, of, counts, transitions(between), between.sum(0), class_words.round().astype(np.int64), discount, tokens, distinct), encoded, rare


PART = "no long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"


def score(encoded: DataFrame, rare: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    width, seen = CLASSES + 1, -np.log10(np.maximum(model.class_tokens, 1))
    emission, base = model.emission(model.counts, model.class_of[: len(model.counts)]), model.base(model.counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(4).to_pylist()
            size = np.array([len(x) // 2 for x in blobs], np.int64)
            u = _joined(blobs, "<u2")
            own, k, starts = u <= model.units.n_words, model.class_of[u], np.cumsum(size) - size
            word = np.where(own, u, 0)
            total = lambda each: np.add.reduceat(np.where(own, each, 0), starts)
            known, given = total((model.counts[word] > 0).astype(np.int64)), total(model.transition[_after_end(k), k] + emission[word])
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in range(4)), pa.array(known), pa.array(total(base[word])), pa.array(given)], [x.split()[0] for x in PART.split(", ")])

    parts = encoded.select("no", "doc_id", "held_out", "n_tokens", "units").mapInArrow(run, PART)
    c, known = F.col("c"), F.col("c") > 0
    unknown = model.emission(np.zeros(width, np.int64), np.arange(width))
    emitted = F.when(known, F.log10(c - model.discount) + F.expr(f"get({_array(seen)}, k)")).otherwise(F.expr(f"get({_array(unknown)}, k)"))
    sums = rare.groupBy("no").agg(
        F.count_if(known).alias("rare_known"), F.sum(F.log10((c + BASE) / model.whole)).alias("rare_base"), F.sum(F.expr(f"get({_array(model.transition.ravel())}, h * {width} + k)") + emitted).alias("rare_score")
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return parts.join(sums, "no", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "rare_known").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"), plus("score", "rare_score").alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on the documents that are not held out, and scores all."""
    model, encoded, rare = train(docs)
    return score(encoded, rare, model)
