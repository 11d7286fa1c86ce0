"""Repeated byte strings of documents by difference-cover suffix sorting.

Every byte covered by a string of 200 bytes that starts anywhere else too is
removed.  A suffix array of all bytes of a corpus would move some hundred bytes for
each, so the suffixes are first dealt to classes that can be sorted apart:

1. Of the 32-byte strings that a 200-byte string contains, the one with the least
   hash is its core.  Equal strings have equal cores in equal places, and
   neighbouring strings mostly share theirs: a row stands for a run of strings with
   one core, some 85 in the mean, and holds the bytes that they cover.
2. Rows of a core that no other row has cannot repeat, and go.  Equal rows of the
   others are collapsed and counted.
3. The distinct rows of each core meet in one task, which sorts all their suffixes:
   sampled triples (those that start at positions not divisible by three) are sorted
   and named, the sort recurses on the names until they differ, the remaining
   suffixes follow from the ranks of their successors, and both are merged.
   Neighbours in the suffix order are compared over their first 200 bytes.

A core with more distinct rows than a task takes is cut into its single strings,
which are counted (combined before the shuffle), since all of a core cannot meet.

Results go back to texts by rows, and to documents by texts.  A text that repeats as
a whole is removed as a whole, so only texts that are themselves single are read
again for what is left of them.

Defined cases: null and empty texts have no bytes; texts of fewer than 200 bytes
lose nothing; equal texts of 200 bytes or more lose all; repeated ids and rows stand
each for itself; very long texts are cut into overlapping units, and lose no string;
an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.skew import join_hot
from quarry.llm.storage import materialize

#: Bytes of a string that is removed where it repeats, and of its core.
LENGTH, CORE = 200, 32
#: 32-byte strings in a string of LENGTH bytes.
SPAN = LENGTH - CORE + 1
#: Strings of a text that are looked at together; bytes of a task's sort; distinct rows of a core that are sorted.
UNIT, SORT_BYTES, GROUP_ROWS = 1 << 20, 1 << 20, 2048
#: Rows of a single number that are broadcast.
BROADCAST_ROWS = 4_000_000

_WORDS = np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64)
_FACTORS = np.random.default_rng(13).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def core_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the CORE bytes from each place on."""
    h, n = _WORDS[data], 1
    for factor in _FACTORS[: CORE.bit_length() - 1]:
        h, n = h[:-n] * factor + h[n:], 2 * n
    h = (h ^ (h >> np.uint64(31))) * _FACTORS[-1]
    return h ^ (h >> np.uint64(29))


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of strings with one core: text, first and last start of a string, and the core's hash."""
    units = [(k, at, t[at : at + UNIT + LENGTH - 1]) for k, t in enumerate(texts) for at in range(0, len(t) - LENGTH + 1, UNIT)]
    found = [_unit_runs(some) for some in _bundles(units)]
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4))


def _bundles(units: list[tuple]) -> Iterator[list[tuple]]:
    some, size = [], 0
    for u in units:
        if some and size + len(u[2]) > UNIT:
            yield some
            some, size = [], 0
        some.append(u)
        size += len(u[2])
    if some:
        yield some


def _unit_runs(units: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(u[2] for u in units), np.uint8)
    sizes = np.array([len(u[2]) for u in units])
    hashes = core_hashes(data)
    # The least hash wins, and of equal ones the first.
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    n = 1
    while 2 * n <= SPAN:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    if n < SPAN:
        low = np.minimum(low[: n - SPAN], low[SPAN - n :])
    core = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    unit = np.repeat(np.arange(len(units)), sizes - LENGTH + 1)
    # Places of strings that lie in one unit.
    place = np.arange(len(unit)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes - LENGTH + 1)[:-1]]), sizes - LENGTH + 1)
    core = core[place]
    new = np.flatnonzero(np.concatenate([[True], (core[1:] != core[:-1]) | (unit[1:] != unit[:-1])]))
    last = np.append(new[1:], len(core)) - 1
    of = unit[new]
    shift = np.array([u[1] for u in units])[of] - starts[of]
    return np.array([u[0] for u in units])[of], place[new] + shift, place[last] + shift, hashes[core[new]].view(np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``s``, whose letters are 1 up to 2^21; at most 2^21 - 2 of them."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s, np.zeros(3, np.int64)])
    # A length of 3k + 1 gets an empty triple at its end, so that the two samples stay apart.
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n + (n % 3 == 1), 3)])
    triples = s[sampled] << 42 | s[sampled + 1] << 21 | s[sampled + 2]
    names, name = np.unique(triples, return_inverse=True)
    if len(names) == len(sampled):
        order = np.empty(n and len(sampled), np.int64)
        order[name] = np.arange(len(sampled))
    else:
        order = suffix_array(name.astype(np.int64) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    others = np.arange(0, n, 3)
    key = s[others] << 21 | rank[others + 1]
    by_key = np.argsort(key, kind="stable")
    others, key = others[by_key], key[by_key]
    further = s[others] << 42 | s[others + 1] << 21 | rank[others + 2]
    sample = sampled[order]
    sample = sample[sample < n]
    before = np.where(
        sample % 3 == 1,
        np.searchsorted(key, s[sample] << 21 | rank[sample + 1]),
        np.searchsorted(further, s[sample] << 42 | s[sample + 1] << 21 | rank[sample + 2]),
    )
    out, place = np.empty(n, np.int64), np.arange(len(sample)) + before
    free = np.ones(n, bool)
    free[place] = False
    out[place], out[free] = sample, others
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether LENGTH bytes from each place of ``a`` and of ``b`` on are equal."""
    words, n = data.astype(np.uint64), 1
    while n < 8:
        words, n = words[:-n] << np.uint64(8 * n) | words[n:], 2 * n
    left = np.arange(len(a))
    for at in range(0, LENGTH, 8):
        left = left[words[a[left] + at] == words[b[left] + at]]
    same = np.zeros(len(a), bool)
    same[left] = True
    return same


def repeated(rows: list[bytes]) -> np.ndarray:
    """Of all strings of LENGTH bytes in ``rows``, in order: whether another one is equal."""
    sizes = np.array([len(r) + 1 for r in rows])
    data = np.frombuffer(b"".join(r + b"\0" for r in rows), np.uint8)
    letters = data.astype(np.int64) + 2
    letters[np.cumsum(sizes) - 1] = 1
    strings = sizes - LENGTH
    begins = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(strings) + strings, strings) + np.arange(strings.sum())
    is_begin = np.zeros(len(data), bool)
    is_begin[begins] = True
    order = suffix_array(letters)
    order = order[is_begin[order]]
    same = np.flatnonzero(_same(data, order[:-1], order[1:]))
    hit = np.zeros(len(data), bool)
    hit[order[same]] = hit[order[same + 1]] = True
    return hit[begins]


def _spread(hit: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """First and last places of the runs of true values, for each part of ``counts`` values."""
    part = np.repeat(np.arange(len(counts)), counts)
    own = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.concatenate([[False], hit, [False]])
    edge = np.concatenate([[True], part[1:] != part[:-1], [True]]) if len(part) else np.array([True])
    first = np.flatnonzero(padded[1:-1] & (~padded[:-2] | edge[:-1]))
    last = np.flatnonzero(padded[1:-1] & (~padded[2:] | edge[1:]))
    offsets = pa.array(np.searchsorted(part[first], np.arange(len(counts) + 1)), pa.int32())
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(own[x], pa.int32())) for x in (first, last))


_FOUND = "row binary, firsts array<int>, lasts array<int>"


def _sorted_cores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows (core, row, bytes, n) in order of core; a core lies in one task."""

    def solve(ids: list[bytes], rows: list[bytes], counts: list[int], alone: list[bool]) -> pa.RecordBatch:
        strings = np.array([len(r) - LENGTH + 1 for r in rows])
        hit = np.repeat(np.array(counts) > 1, strings)
        met = ~np.repeat(np.array(alone), strings)
        if not all(alone):
            hit[met] |= repeated([r for r, a in zip(rows, alone, strict=True) if not a])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *_spread(hit, strings)], ["row", "firsts", "lasts"])

    each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ids, rows, counts, alone, size = [], [], [], [], 0
    for _, group in groupby(each, key=lambda r: r[0]):
        group = list(group)
        for _, row, data, n in group:
            ids.append(row)
            rows.append(data)
            counts.append(n)
            alone.append(len(group) == 1)
            size += len(data) + 1
        if size > SORT_BYTES:
            yield solve(ids, rows, counts, alone)
            ids, rows, counts, alone, size = [], [], [], [], 0
    if ids:
        yield solve(ids, rows, counts, alone)


def _single_strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, ids, data, counts = (c.to_pylist() for c in b.columns)
        for row, d, n in zip(ids, data, counts, strict=True):
            k = len(d) - LENGTH + 1
            strings = [xxhash.xxh3_128_digest(d[i : i + LENGTH]) for i in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array([row] * k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([n] * k)], ["string", "row", "at", "n"])


def _counted_strings(rows: DataFrame) -> DataFrame:
    """What ``_sorted_cores`` finds, for rows of which too many have one core."""
    strings = materialize(rows.mapInArrow(_single_strings, "string binary, row binary, at int, n long"), "hot-strings")
    several = materialize(strings.groupBy("string").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("string"), "hot-repeats")
    places = join_hot(strings, several, "string").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("firsts"))
    return places.select("row", "firsts", F.col("firsts").alias("lasts"))


def among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in ``known``, which is sorted; a batch's work does not grow with it, as sorting both would."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _text_key() -> Column:
    return F.sha2(F.col("text"), 256)


def _small(table: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if it has few enough rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _rows(docs: DataFrame) -> DataFrame:
    """(text_key, first, strings, core, row, bytes): the rows of all texts whose core repeats."""

    def cores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core, n = np.unique(runs([t or b"" for t in b.column(0).to_pylist()])[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(n)], ["core", "n"])

    counted = docs.select("text").mapInArrow(cores, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))
    several = materialize(counted.filter(F.col("n") > 1).select("core"), "repeated-cores")
    known = None
    if several.count() <= BROADCAST_ROWS:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(several.toArrow()["core"].to_numpy()))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
            of, first, last, core = runs(texts)
            if known is not None:
                picked = np.flatnonzero(among(known.value, core))
                of, first, last, core = (x[picked] for x in (of, first, last, core))
            data = [texts[k][i : j + LENGTH] for k, i, j in zip(of.tolist(), first.tolist(), last.tolist(), strict=True)]
            columns = [pa.array([keys[k] for k in of.tolist()], pa.string()), pa.array(first), pa.array(core), pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "first", "core", "row", "bytes"])

    made = docs.select(_text_key().alias("text_key"), "text").mapInArrow(cut, "text_key string, first long, core long, row binary, bytes binary")
    rows = materialize(made, "core-rows")
    # Too many cores to be broadcast: their rows are found by a join.
    return rows if known is not None else materialize(join_hot(rows, several, "core"), "candidate-rows")


def _repeats(rows: DataFrame, group_rows: int) -> DataFrame:
    """(row, firsts, lasts): where in each distinct row the strings that repeat begin, as runs."""
    distinct = materialize(rows.groupBy("core", "row", "bytes").agg(F.count("*").alias("n")), "distinct-rows")
    crowded = materialize(distinct.groupBy("core").agg(F.count("*").alias("k")).filter(F.col("k") > group_rows).select("core"), "crowded-cores")
    if crowded.isEmpty():
        met, many = distinct, None
    else:
        met, many = (distinct.join(_small(crowded), "core", how) for how in ("left_anti", "left_semi"))
    found = met.repartition("core").sortWithinPartitions("core").mapInArrow(_sorted_cores, _FOUND)
    found = found if many is None else found.unionByName(_counted_strings(many))
    return materialize(found.filter(F.size("firsts") > 0), "repeats")


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal removed runs of each text, from the runs of strings of its rows."""
    for b in batches:
        keys, begins, ends = b.column(0).to_pylist(), [], []
        for parts in b.column(1).to_pylist():
            spans = np.array([[p["first"] + i, p["first"] + j + LENGTH] for p in parts for i, j in zip(p["firsts"], p["lasts"], strict=True)])
            spans = spans[np.argsort(spans[:, 0])]
            reach = np.maximum.accumulate(spans[:, 1])
            new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
            begins.append(spans[new, 0].tolist())
            ends.append(reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(begins, kind), pa.array(ends, kind)], ["text_key", "begins", "ends"])


def removed_spans(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(text_key, begins, ends) of each text with a removed byte: its maximal removed runs."""
    rows = _rows(docs.select(F.col("text").cast("binary").alias("text")))
    found = _repeats(rows, group_rows)
    # Copies of a text have the same rows.
    own = materialize(rows.groupBy("text_key", "first", "row").agg(F.lit(1)).select("text_key", "first", "row"), "text-rows")
    placed = join_hot(own, found, "row").groupBy("text_key").agg(F.collect_list(F.struct("first", "firsts", "lasts")).alias("parts"))
    return materialize(placed.mapInArrow(_merged, "text_key string, begins array<long>, ends array<long>"), "removed-spans")


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts, begins, ends = (c.to_pylist() for c in b.columns)
        digests = []
        for t, x, y in zip(texts, begins, ends, strict=True):
            kept = hashlib.sha256()
            for i, j in zip([0, *y], [*x, len(t)], strict=True):
                kept.update(t[i:j])
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], ["text_key", "kept_sha256"])


def remove_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    size = F.octet_length("text").cast("long")
    spans = removed_spans(slim, group_rows)
    removed = F.aggregate(F.zip_with("ends", "begins", lambda e, b: e - b), F.lit(0).cast("long"), lambda s, x: s + x)
    figures = spans.select("text_key", removed.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"))
    keyed = materialize(slim.select("doc_id", size.alias("n_bytes"), _text_key().alias("text_key")), "text-keys")
    of = F.col("n_bytes") >= LENGTH
    met = join_hot(keyed.filter(of), figures, "text_key", "left").fillna(0, ["n_removed", "n_spans"])
    some = (F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_bytes"))
    # A text of which something is left is in one row only.
    left = met.filter(some).select("text_key").join(spans, "text_key")
    again = slim.filter(size >= LENGTH).select(_text_key().alias("text_key"), "text")
    kept = again.join(left, "text_key").select("text_key", "text", "begins", "ends").mapInArrow(_kept, "text_key string, kept_sha256 string")
    whole = F.when(F.col("n_removed") == 0, F.col("text_key")).otherwise(F.sha2(F.lit(""), 256))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans")
    parts = [
        keyed.filter(~of).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text_key").alias("kept_sha256")),
        met.filter(~some).select(*columns, whole.alias("kept_sha256")),
        met.filter(some).join(kept, "text_key").select(*columns, "kept_sha256"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
