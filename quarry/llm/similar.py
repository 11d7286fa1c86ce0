"""Near-duplicates by word shingles: wide SimHash fingerprints find candidates, exact Jaccard similarity links them.

Texts are linked at a similarity of 0.8 or more over the sets of their five-word
shingles.  At 0.8 at least 8/9 of the shingles of two texts of one size are common, so
their bits differ with probability acos(8/9) / pi = 0.15.  A fingerprint has 192 segments
of 32 bits, and a pair meets where a segment differs by at most one bit: under a
one-wildcard variant (one bit position left out) that both have, as in ``simhash``.  One
segment of a pair of 0.8 does so with probability 0.035, one of 192 with 0.9989, and of a
more similar pair with a greater one; of other texts about one in 10^8.  What has met is
verified on the whole fingerprint, and then on the texts.

The 6,144 variants of a text are not rows.  Two segments that differ by at most one bit
have an equal half, so segments are dealt once for each half by its first bits (as one
column while they are few), and the equality join of variants runs within a task, over
some 500,000 segments.

First, texts that meet in one of 32 segments are grouped under the least text that they
meet.  Those of a group are not all compared with each other: each is compared with one
leader, the text that shares most groups with others; in the next rounds leaders come
from those that are still unlinked.  So a group of near copies takes a few comparisons
each.  What shares a group but no leader (texts with a long passage in common, say) goes
by its rarest shingles: of n shingles the rarest n - ceil(0.8 n) + 1, of which two texts
of the similarity always share one.  Texts that share a rare shingle, and enough shingles
with any others to be similar to one of them, are led in the same way.

Texts of the groups in which some are still unlinked are a crowd: many may meet many, with
a part of their shingles in common.  Pairs of a crowd come from an equality join by those
rarest shingles, which misses none, and only where no link joins the two yet and the places
of the shingle leave room for the similarity.  Then texts of all segments meet, but only
those that no link joins yet and that are not both of a crowd.  A text that met none or
few in the 32 segments meets few in the others: of d expected in all, it met none before
with probability exp(-d / 6).

Two limits: a pair of little more than 0.8 may be missed (1 in 900 at 0.8, by formula),
and texts that differ from a text that is not there by less than a ninth of their
shingles, and by others each, are compared as fingerprints, all pairs of them.

Defined cases: null texts and texts without words are linked to each other; a text
of fewer than five words is one shingle; copies of a text are collapsed first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.simhash import KEY, one_of_each, text_key
from quarry.llm.skew import join_hot
from quarry.llm.storage import discard, materialize
from quarry.llm.words import ascii_words

#: Words of a shingle; the least similarity of a link, as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Bits of a segment and segments of a fingerprint; those that group texts before all meet; rounds of leaders.
SEGMENT_BITS, SEGMENTS, GROUPING, LEADERS = 32, 192, 32, 2
#: Of the bits of two texts of the similarity, at most this part differs, and of those with few shingles this one.
DIFFER, FEW, DIFFER_FEW = 0.172, 50, 0.22
#: Bits of a sketch, the first ones of a fingerprint, that differ at most.
SKETCH_DIFFER = 24
#: Segments that meet in a task; texts that a task deals at once; pairs that it makes at once.
MEETING, DEALT, PAIRS = 1 << 19, 1 << 14, 1 << 20
#: Shingles whose bits are summed at once; rows of one or two numbers, and fingerprints, that are broadcast.
CHUNK, BROADCAST_ROWS, BROADCAST_FINGERPRINTS = 128, 1_000_000, 16_384

_XOR, _FACTOR = np.random.default_rng(42).integers(0, 1 << 64, (2, SEGMENTS), np.uint64)
_FACTOR |= np.uint64(1)


def shingles(text: bytes) -> set[bytes]:
    w = ascii_words(text)
    if len(w) < SHINGLE:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def fingerprint(text: bytes) -> tuple[np.ndarray, int]:
    """Its segments, and how many shingles the text has; a bit is 1 if more than half of the shingles' hashes have it."""
    hashes = np.array([xxhash.xxh64_intdigest(s) for s in shingles(text)], np.uint64)
    ones = np.zeros(SEGMENTS * SEGMENT_BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        # The upper half of a product hangs on all bits of the hash.
        mixed = ((hashes[at : at + CHUNK, None] ^ _XOR) * _FACTOR) >> np.uint64(32)
        ones += np.unpackbits(mixed.astype("<u4").view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view("<u4"), len(hashes)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = TaskContext.get().partitionId() << 33
    for b in batches:
        prints = [fingerprint(t or b"") for t in b.column(1).to_pylist()]
        sketch = np.array([fp[:2].view(np.int64)[0] for fp, _ in prints], np.int64)
        columns = [np.arange(node, node + len(prints)), b.column(0), b.column(1), pa.array([fp.tobytes() for fp, _ in prints], pa.binary()), sketch, np.array([n for _, n in prints], np.int64)]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["node", KEY, "text", "fp", "sketch", "size"])
        node += len(prints)


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)


def _deal(segments: int, bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, root, fp, crowd) to the segments of many texts in a row: those of one bucket.

    A bucket is a segment's number, one of its halves and the first ``bits`` of that
    half; without any, a segment is dealt once and not for each half.
    """

    def rows(batch: pa.Table) -> Iterator[tuple]:
        node, root, crowd = (batch.column(c).to_numpy() for c in (0, 1, 3))
        prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(len(node), SEGMENTS)
        pack = lambda at: (_packed(np.diff(node[at], prepend=0)), _packed(2 * (root[at] - node[at]) + crowd[at]))
        whole = pack(slice(None))
        for k in range(segments):
            values = np.ascontiguousarray(prints[:, k])
            if not bits:
                yield 2 * k << 16, len(node), values.tobytes(), *whole
                continue
            for half, first in enumerate((values >> np.uint32(32 - bits), (values & np.uint32(0xFFFF)) >> np.uint32(16 - bits))):
                order = np.argsort(first, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
                    yield (2 * k + half) << 16 | int(first[at[0]]), len(at), values[at].tobytes(), *pack(at)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def flush() -> Iterator[pa.RecordBatch]:
            made = rows(pa.Table.from_batches(held))
            while part := list(islice(made, 64)):
                kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part, strict=True), kinds, strict=True)], ["bucket", "n", "segments", "nodes", "roots"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= DEALT:
                yield from flush()
                held = []
        if sum(x.num_rows for x in held):
            yield from flush()

    return run


def _adjacent(values: np.ndarray, positions: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, k) of places in the sorted distinct ``values`` that have a one-wildcard variant of one of these positions in common."""
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in positions:
        bit = np.uint32(1 << p)
        zero = np.flatnonzero((values & bit) == 0)
        other = values[zero] | bit
        at = np.minimum(np.searchsorted(values, other), len(values) - 1)
        hit = values[at] == other
        firsts.append(zero[hit])
        seconds.append(at[hit])
    return np.concatenate(firsts), np.concatenate(seconds)


def _grouping(segments: np.ndarray, node: np.ndarray, root: np.ndarray, crowd: np.ndarray, positions: range, equal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(least node that a text meets, itself included; node) of the texts that meet any."""
    values, own, count = np.unique(segments, return_inverse=True, return_counts=True)
    first, second = _adjacent(values, positions)
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, own, node)
    met, best = count > 1, least.copy()
    for x, y in ((first, second), (second, first)):
        met[x] = True
        np.minimum.at(best, x, least[y])
    yield best[own][met[own]], node[met[own]]


def _crossing(segments: np.ndarray, node: np.ndarray, root: np.ndarray, crowd: np.ndarray, positions: range, equal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of nodes of different roots that meet and are not both of a crowd."""
    order = np.lexsort((root, segments))
    segments, node, root, crowd = segments[order], node[order], root[order], crowd[order]
    values, start, own, count = np.unique(segments, return_index=True, return_inverse=True, return_counts=True)
    first, second = _adjacent(values, positions)
    if equal:
        several = np.flatnonzero(count > 1)
        first, second = np.concatenate([first, several]), np.concatenate([second, several])
    low, high = root[start], root[start + count - 1]
    mixed = np.minimum(low[first], low[second]) != np.maximum(high[first], high[second])
    first, second = first[mixed], second[mixed]
    rank, every = np.unique(root, return_inverse=True)[1], np.arange(len(node))
    for xs, ys in ((every[~crowd], every), (every[crowd], every[~crowd])):
        for x, y in _across(first, second, own[xs], own[ys], rank[xs], rank[ys]):
            one, other = node[xs[x]], node[ys[y]]
            yield np.minimum(one, other), np.maximum(one, other)


def _across(first: np.ndarray, second: np.ndarray, own_x: np.ndarray, own_y: np.ndarray, rank_x: np.ndarray, rank_y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of other ranks in the classes ``first`` of x and ``second`` of y; both are in order of class and rank."""
    (start_x, n_x), (start_y, n_y) = ((np.searchsorted(own, c, "left"), np.searchsorted(own, c, "right") - np.searchsorted(own, c, "left")) for own, c in ((own_x, first), (own_y, second)))
    width = max(rank_x.max(initial=0), rank_y.max(initial=0)) + 1
    place = own_y * width + rank_y
    sums = np.cumsum(n_x)
    for at in np.split(np.arange(len(first)), np.searchsorted(sums, np.arange(PAIRS, sums[-1] if len(sums) else 0, PAIRS))):
        n = n_x[at]
        x = np.repeat(start_x[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # Each member of the first class with those of the second that have another root: all but one run.
        same = np.repeat(second[at], n) * width + rank_x[x]
        lo, hi = np.searchsorted(place, same, "left"), np.searchsorted(place, same, "right")
        begin, others = np.repeat(start_y[at], n), np.repeat(n_y[at], n) - (hi - lo)
        ends = np.cumsum(others)
        for part in np.split(np.arange(len(x)), np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS))):
            m = others[part]
            y = np.repeat(begin[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            y += np.where(y >= np.repeat(lo[part], m), np.repeat((hi - lo)[part], m), 0)
            yield np.repeat(x[part], m), y


def _meet(bits: int, pairs: Callable, names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``_deal``, sorted by bucket, to the ``pairs`` of each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for bucket, rows in groupby(each, lambda row: row[0]):
            parts = [(np.frombuffer(v, "<u4"), np.cumsum(_unpacked(x, n)), _unpacked(r, n)) for _, n, v, x, r in rows]
            segments, node, mark = map(np.concatenate, zip(*parts, strict=True))
            half = bucket >> 16 & 1
            # The first half is equal: a bit of the second differs, or none.
            positions = range(SEGMENT_BITS) if not bits else range(16, 32) if half else range(16)
            for a, b in pairs(segments, node, (mark >> 1) + node, (mark & 1).astype(bool), positions, not half):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)

    return run


def _met(prints: DataFrame, texts: int, segments: int, pairs: Callable, names: list[str]) -> DataFrame:
    """``pairs`` of the texts of ``prints`` (node, root, fp and, if any are, crowd) that meet in one of the first ``segments``."""
    bits = min(16, max(0, (texts - 1) // MEETING).bit_length())
    crowd = F.col("crowd") if "crowd" in prints.columns else F.lit(False)
    dealt = prints.select("node", "root", "fp", crowd.cast("long")).mapInArrow(_deal(segments, bits), "bucket long, n long, segments binary, nodes binary, roots binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(bits, pairs, names), ", ".join(f"{c} long" for c in names)).distinct()


def _few_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (2, 3))
        share = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) / (SEGMENTS * SEGMENT_BITS)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(share <= np.where(b.column(4).to_numpy() < FEW, DIFFER_FEW, DIFFER)))


def _near(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` whose whole fingerprints differ by few bits enough."""
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met-texts")
    own = materialize(prints.select("node", "fp", "size").join(_small(nodes), "node", "left_semi"), "met-fingerprints")
    own = F.broadcast(own) if own.count() <= BROADCAST_FINGERPRINTS else own
    one, other = (own.select(F.col("node").alias(c), F.col("fp").alias(f"{c}_fp"), F.col("size").alias(f"{c}_size")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "a_fp", "b_fp", F.least("a_size", "b_size"))
    return both.mapInArrow(_few_bits, "a long, b long")


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = lru_cache(64)(shingles)
    for b in batches:
        ok = [similar(held(x or b""), held(y or b"")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _small(table: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if it has few enough rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _leaders(members: DataFrame) -> DataFrame:
    """(band, lead): the node of each band that meets most others in all its bands."""
    return members.groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("w"), "node")).alias("best")).select("band", F.col("best.node").alias("lead"))


def _grouped(index: DataFrame, tag: str) -> DataFrame:
    """(band, node, n, weight) of the bands that several nodes share; ``index`` is shuffled once.

    The weight of a node is the size of all its bands: a text in the middle of its
    near copies shares more bands with them than they do with each other.
    """
    dealt = index.select("band", "node").repartition("band")
    several = dealt.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    shared = materialize(dealt.join(several, "band"), tag)
    return materialize(shared.join(shared.groupBy("node").agg(F.sum("n").alias("weight")), "node"), tag)


def _verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    pairs = materialize(pairs.distinct(), "candidate-pairs")
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("x")).join(_small(pairs), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "similar-pairs")


def links(signatures: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes at the similarity or above that join the groups of ``index`` (band, node).

    Without it, a text of ``signatures`` is in its ``bands``; with ``fp`` and ``size``
    there, only texts of close fingerprints are compared.
    """
    return _links(signatures, index)[0]


def _links(signatures: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The links of ``links``; the nodes of the groups in which some are left, and their ``rare_shingles``, or None."""
    members = _grouped(signatures.select("node", F.explode("bands").alias("band")) if index is None else index, "band-members")
    nodes = materialize(members.select("node").distinct(), "candidates")
    texts = materialize(signatures.drop(KEY, "bands", "sketch").join(_small(nodes), "node", "left_semi"), "candidate-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        return _verify(texts, _near(texts, materialize(pairs.distinct(), "led-pairs")) if "fp" in texts.columns else pairs)

    found, left = _lead(members, verified)
    again = rare = None
    if left is not None:
        # All texts of the groups in which some are left meet again by their rarest shingles.
        again = materialize(members.join(left.select("band").distinct(), "band", "left_semi").select("node").distinct(), "unled")
        rare = materialize(rare_shingles(texts.join(_small(again), "node", "left_semi")), "rare-shingles")
        more, _ = _lead(_grouped(rare, "rare-members"), verified)
        found = found.union(more)
    return found, again, rare


def _lead(members: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Links of ``members`` (band, node, n, weight) to leaders of their bands, and the (band, node) not linked to any, or None."""
    led, found = members.join(_leaders(members), "band"), None
    for _ in range(LEADERS):
        followers = led.filter(F.col("node") != F.col("lead"))
        good = verified(followers.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")))
        found = good if found is None else found.union(good)
        # Rows still open: not linked to their leader, and not alone with it.
        linked = good.select(F.col("a").alias("lead"), F.col("b").alias("node")).union(good.select(F.col("b").alias("lead"), F.col("a").alias("node")))
        left = followers if "open" not in led.columns else followers.filter("open")
        left = materialize(left.filter(F.col("n") > 2).join(linked, ["lead", "node"], "left_anti").select("band", "node", "weight"), "open-members")
        if left.isEmpty():
            return found, None
        marked = members.join(_leaders(left), "band")
        led = materialize(marked.join(left.select("band", "node", F.lit(True).alias("open")), ["band", "node"], "left").withColumn("open", F.coalesce("open", F.lit(False))), "led-members")
    return found, left


def _enough(common: Column, sizes: Column) -> Column:
    """Whether texts with ``common`` shingles in common, of ``sizes`` together, can have the similarity."""
    return sum(SIMILARITY) * common >= SIMILARITY[0] * sizes


def rare_shingles(texts: DataFrame) -> DataFrame:
    """(band, node, size, place, shared): the rarest shingles of each text among ``texts``, as hashes, that another text has too.

    They are the first n - ceil(0.8 n) + 1 of its n shingles in order of frequency,
    so texts of the similarity have one in common.  ``shared`` shingles of a text
    are in other texts; one that shares too few for the smallest text of a group to
    be similar is not in that group.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.array([xxhash.xxh64_intdigest(s) for s in shingles(t or b"")], np.uint64).view(np.int64) for t in b.column(1).to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), size)), pa.array(flat), pa.array(np.repeat(size, size))], ["node", "band", "size"])

    each = materialize(texts.select("node", "text").mapInArrow(run, "node long, band long, size long"), "text-shingles")
    counted = each.join(each.groupBy("band").agg(F.count("*").alias("df")), "band")
    place, own = F.row_number().over(W.partitionBy("node").orderBy("df", "band")), W.partitionBy("node")
    first = F.col("size") - F.ceil(F.col("size") * SIMILARITY[0] / SIMILARITY[1]) + 1
    placed = counted.withColumns({"place": place, "shared": F.count_if(F.col("df") > 1).over(own)}).filter((F.col("place") <= first) & (F.col("df") > 1))
    least = F.min("size").over(W.partitionBy("band"))
    return placed.withColumn("least", least).filter(_enough(F.col("shared"), F.col("size") + F.col("least"))).select("band", "node", "size", "place", "shared")


def _unlinked(rare: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different roots by ``linked`` (node, root) that may be similar by a shingle of ``rare_shingles``.

    At the first shingle in common, texts have no more in common than that one and
    those after it in either.  Of a band's rows, those of its largest root meet only
    the others, so a group that is linked already is not joined to itself.
    """
    rows = rare.join(_small(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.withColumn("most", F.least(F.col("size") - F.col("place") + 1, "shared")).select("band", "node", "root", "size", "most")
    rows = materialize(rows, "rooted-rare")
    by_root = rows.groupBy("band", "root").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    main = by_root.groupBy("band").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("main"), F.min("least").alias("least")).filter(F.col("roots") > 1)
    rows = rows.join(main, "band").filter(_enough(F.col("most"), F.col("size") + F.col("least"))).withColumn("other", F.col("root") != F.col("main"))
    rows = materialize(rows.select("band", "node", "root", "size", "most", "other"), "mixed-rare")
    one, two = rows.filter("other").alias("x"), rows.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & (~F.col("y.other") | (F.col("x.node") < F.col("y.node")))
    room = _enough(F.least("x.most", "y.most"), F.col("x.size") + F.col("y.size"))
    met = one.join(two, (F.col("x.band") == F.col("y.band")) & apart & room)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def roots(docs: DataFrame) -> DataFrame:
    """(KEY, root) of each distinct text: the least node of its component."""
    rows = docs.select(text_key().alias(KEY), F.col("text").cast("binary").alias("text"))
    rows = materialize(rows.mapInArrow(_signatures, f"node long, {KEY} long, text binary, fp binary, sketch long, size long"), "shingle-signatures")
    texts = materialize(rows.groupBy(KEY).agg(F.min("node").alias("node")), "distinct-texts")
    # Only the copies are looked up: a join of all texts would shuffle them whenever they are read.
    copies = join_hot(rows.select(KEY, "node"), texts.withColumnRenamed("node", "least"), KEY).filter(F.col("node") != F.col("least"))
    copies = materialize(copies.select("node"), "copies")
    signatures, count = materialize(rows.join(_small(copies), "node", "left_anti"), "signatures"), texts.count()
    discard(rows)

    met = materialize(_met(signatures.withColumn("root", F.col("node")), count, GROUPING, _grouping, ["band", "node"]), "least-met")
    grouped, crowd, rare = _links(signatures, met.union(met.select("band", F.col("band").alias("node"))).distinct())

    # All segments, between texts that no link joins yet; a crowd has met by its rarest shingles.
    linked = components(grouped)
    rooted = signatures.select("node", "fp", "size").join(_small(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    if crowd is not None:
        # Texts without shingles have no rare ones, so they meet as all others do.
        rooted = rooted.join(_small(crowd.withColumn("in", F.lit(True))), "node", "left").withColumn("crowd", F.coalesce("in", F.lit(False)) & (F.col("size") > 0))
    pairs = materialize(_met(rooted, count, SEGMENTS, _crossing, ["a", "b"]), "crossing-pairs")
    sketches = [signatures.select(F.col("node").alias(c), F.col("sketch").alias(f"{c}_sketch")) for c in "ab"]
    close = F.bit_count(F.col("a_sketch").bitwiseXOR(F.col("b_sketch"))) <= SKETCH_DIFFER
    pairs = materialize(pairs.join(sketches[0], "a").join(sketches[1], "b").filter(close).select("a", "b"), "close-pairs")
    if rare is not None:
        pairs = materialize(pairs.union(_unlinked(rare, linked)).distinct(), "close-pairs")
    near = materialize(_near(signatures, pairs), "near-pairs")
    nodes = materialize(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-texts")
    crossing = _verify(materialize(signatures.select("node", "text").join(_small(nodes), "node", "left_semi"), "near-texts"), near)

    found = components(grouped.union(crossing))
    return texts.join(found, "node", "left").select(KEY, F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: that of the smallest id."""
    return one_of_each(docs, roots(docs))
