"""Lexical retrieval packing into token windows, by a sharded BM25 index.

Every document is encoded once.  A document fills as many windows as it can
alone; what remains of it is packed with its lexical neighbours.  Remainders are
put in order by content (a tree of cuts across the main axes of their BM25
weights, so that copies and documents of one topic lie together) and cut into
shards of even, bounded size.  Document frequencies, the number of remainders and
their mean length are those of all remainders.  A shard builds an inverted index of its
remainders (terms are their token ids, weights are BM25), and the longest unused
one seeds a window: the index returns its best unused neighbours, which fill the
window greedily, the last one cut to fit.  What was cut off stays available.  So
all windows but the last of a shard are full.

Every shard is one bounded group, whatever the number of documents, and token
ids of remainders alone are shuffled.

Defined cases: a null or empty text is its end id alone; repeated rows and ids
are packed each on its own; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import materialize
from quarry.llm.tokens import encoder

#: Remainders of a shard, on average.
SHARD_ROWS = 2048
#: BM25's saturation and length normalisation, and neighbours that are ranked at a time.
K1, B, NEIGHBOURS = 1.2, 0.75, 48
#: Documents of a shard that make a term common there; seeds whose common terms are scored at once.
COMMON, SEEDS = 32, 128
#: Remainders from which the order by content is learned, the axes it uses, and the sample behind each leaf of its tree.
SAMPLE, AXES, LEAF_SAMPLE = 8192, 24, 16

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(f.split()[0], pa.int64()) for f in PIECE.split(", ")])
_ENCODED = _PIECE.append(pa.field("number", pa.int64())).append(pa.field("ids", pa.binary()))


_DEALT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("number", pa.int64()), ("ids", pa.binary()), ("leaf", pa.int64()), ("along", pa.float64())])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]


def term_weights(df: np.ndarray, total: int) -> np.ndarray:
    return np.log1p((total - df + 0.5) / (df + 0.5))


def saturation(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def encode(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces that fill a window alone (with their even sequence_id), and remainders with ``ids`` and ``number``."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, number = encoder(vocabulary, False), TaskContext.get().partitionId() << 32
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), batch([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids = np.frombuffer(raw + end, "<u2")
                n, whole = len(ids), len(ids) // window
                for k in range(whole):
                    rows.append((doc_id, k * window, window, crc(ids[k * window : (k + 1) * window]), n, 2 * number, 0, number, None))
                    number += 1
                if n > whole * window:
                    rows.append((doc_id, whole * window, n - whole * window, None, n, None, None, number, ids[whole * window :].tobytes()))
                    number += 1
            yield pa.RecordBatch.from_arrays(_columns(rows, _ENCODED), schema=_ENCODED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE + ", number long, ids binary")


class Bm25Index:
    """An inverted index of token-id arrays; documents are numbered from 0.

    ``df``, ``total`` and ``mean`` are the documents with each term, all documents
    and their mean length in the whole collection; without them, those of ``docs``.
    """

    def __init__(self, docs: list[np.ndarray], df: np.ndarray | None = None, total: int | None = None, mean: float | None = None):
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
        self.terms, n = terms, len(docs)
        flat, owner = np.concatenate(terms), np.repeat(np.arange(n), [len(t) for t in terms])
        order = np.argsort(flat, kind="stable")
        self.df = np.bincount(flat, minlength=1 << 16)
        self.start = np.concatenate([[0], np.cumsum(self.df)])
        length = np.array([len(d) for d in docs], float)
        tf = np.concatenate(counts).astype(float)
        weight = term_weights(self.df if df is None else df, total or n)[flat] * saturation(tf, length[owner], mean or length.mean())
        self.owner, self.weight, self.n = owner[order], weight[order], n
        # Terms of many documents are scored for a block of seeds at once, the others from their postings.
        common = np.nonzero(self.df >= COMMON)[0]
        self.column = np.full(1 << 16, -1)
        self.column[common] = np.arange(len(common))
        self.grid = np.zeros((n, len(common)), np.float32)
        at = self.column[flat]
        self.grid[owner[at >= 0], at[at >= 0]] = weight[at >= 0]
        self.by_length = np.argsort(-length, kind="stable")
        self.rank = np.argsort(self.by_length)
        self.ready: dict[int, np.ndarray] = {}

    def _common(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """What common terms give each document; longer seeds come first, so the next ones are computed too."""
        if seed not in self.ready:
            block = self.by_length[self.rank[seed] :]
            block = np.concatenate([[seed], block[unused[block] & (block != seed)][: SEEDS - 1]])
            self.ready = dict(zip(block.tolist(), (self.grid[block] > 0).astype(np.float32) @ self.grid.T, strict=True))
        return self.ready[seed]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share any term of ``seed``, best first."""
        t = self.terms[seed]
        t = t[(self.df[t] > 1) & (self.column[t] < 0)]
        score = self._common(seed, unused).astype(float)
        if len(t):
            spans = [slice(self.start[x], self.start[x + 1]) for x in t.tolist()]
            score += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[~unused] = 0
        score[seed] = 0
        found = np.nonzero(score)[0]
        if len(found) > NEIGHBOURS:
            found = found[np.argpartition(-score[found], NEIGHBOURS)[:NEIGHBOURS]]
        return found[np.lexsort((found, -score[found]))]


def pack_shard(docs: list[np.ndarray], window: int, about: Collection | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, window number, offset there) of all pieces."""
    index = Bm25Index(docs, about.df, about.total, about.mean) if about else Bm25Index(docs)
    left = np.array([len(d) for d in docs])
    done, unused, out = np.zeros(len(docs), int), left > 0, []
    by_length, at, number = np.argsort(-left, kind="stable"), 0, 0

    def longest() -> int | None:
        nonlocal at
        while at < len(by_length) and not unused[by_length[at]]:
            at += 1
        return int(by_length[at]) if at < len(by_length) else None

    while (seed := longest()) is not None:
        room = window

        def put(k: int) -> None:
            nonlocal room
            n = min(room, int(left[k]))
            out.append((k, int(done[k]), n, number, window - room))
            done[k] += n
            left[k] -= n
            unused[k] = left[k] > 0
            room -= n

        put(seed)
        while room and len(near := index.neighbours(seed, unused)):
            for k in near.tolist():
                put(k)
                if not room:
                    break
        while room and (other := longest()) is not None:
            put(other)
        number += 1
    return out


@dataclass
class Collection:
    """Document frequencies over all remainders, their number and mean length."""

    df: np.ndarray
    total: int
    mean: float


def collection(rest: DataFrame) -> Collection:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            for ids in b.column(0).to_pylist():
                x = np.frombuffer(ids, "<u2")
                df[np.unique(x)] += 1
                n, tokens = n + 1, tokens + len(x)
        term = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *term.tolist()]), pa.array([tokens, n, *df[term].tolist()])], ["term", "n"])

    sums = rest.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    df = np.zeros(1 << 16, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    total = int(n[term == -1].sum())
    return Collection(df, total, float(n[term == -2].sum()) / max(1, total))


class Map:
    """Orders remainders by content: a tree of even cuts across the main axes of their term weights.

    It is learned from a sample; a leaf of the tree has a place, and within it
    documents lie along the leaf's own main axis.
    """

    def __init__(self, sample: list[np.ndarray], about: Collection, leaves: int):
        self.about, self.axes = about, np.random.default_rng(0).standard_normal((1 << 16, AXES))
        parts = [self._weights(d) for d in sample]
        for _ in range(3):  # power iteration
            q, _ = np.linalg.qr((p := np.array([w @ self.axes[t] for t, w in parts])) - p.mean(0))
            self.axes = np.zeros_like(self.axes)
            for row, (t, w) in zip(q, parts, strict=True):
                self.axes[t] += w[:, None] * row
        self.axes = self.axes.astype(np.float32)
        self.nodes: list[tuple] = []
        self._grow(np.array([w @ self.axes[t] for t, w in parts]), max(1, min(leaves, len(sample) // LEAF_SAMPLE)))

    def _weights(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, tf = np.unique(doc, return_counts=True)
        w = term_weights(self.about.df[t], self.about.total) * saturation(tf, len(doc), self.about.mean)
        return t, w / np.linalg.norm(w)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        axis = np.linalg.svd(points - points.mean(0), full_matrices=False)[2][0]
        along, me = np.sort(points @ axis), len(self.nodes)
        left = leaves // 2
        cut = along[len(along) * left // leaves]
        below = points @ axis < cut
        if leaves == 1 or below.sum() < 2 or (~below).sum() < 2:
            self.nodes.append((axis, None, -1, -1))
            return me
        self.nodes.append(())
        a, b = self._grow(points[below], left), self._grow(points[~below], leaves - left)
        self.nodes[me] = (axis, cut, a, b)
        return me

    def place(self, doc: np.ndarray) -> tuple[int, float]:
        t, w = self._weights(doc)
        at, x = 0, w @ self.axes[t]
        while self.nodes[at][1] is not None:
            axis, cut, left, right = self.nodes[at]
            at = left if x @ axis < cut else right
        return at, float(x @ self.nodes[at][0])


def content_map(rest: DataFrame, about: Collection, shards: int) -> Map:
    part = min(1.0, SAMPLE / about.total)
    some = rest.filter(F.pmod(F.xxhash64("number", F.lit(1)), F.lit(1 << 30)) < int(part * (1 << 30))).select("ids")
    return Map([np.frombuffer(x, "<u2") for x in some.toArrow().column("ids").to_pylist()], about, shards)


def deal(rest: DataFrame, about: Collection, shards: int) -> DataFrame:
    """Remainders in partitions of like content and even size, each with its place in the order."""
    if shards == 1:
        return rest.select(*_DEALT.names[:5], F.lit(0).cast("long").alias("leaf"), F.lit(0.0).alias("along")).repartitionByRange(1, "leaf", "along", "number")
    chart = content_map(rest, about, shards)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [chart.place(np.frombuffer(x, "<u2")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([p[k] for p in places], f.type) for k, f in ((0, _DEALT[5]), (1, _DEALT[6])))], schema=_DEALT)

    placed = rest.select(*_DEALT.names[:5]).mapInArrow(run, "doc_id long, start long, doc_tokens long, number long, ids binary, leaf long, along double")
    return materialize(placed, "pack-placed").repartitionByRange(shards, "leaf", "along", "number")


def _pack(window: int, about: Collection):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=_DEALT) for b in batches], _DEALT).sort_by([(c, "ascending") for c in ("leaf", "along", "number")])
        first = TaskContext.get().partitionId() << 32
        blocks = max(1, math.ceil(len(whole) / (1.5 * SHARD_ROWS)))
        for k in range(blocks if len(whole) else 0):
            table = whole.slice(at := len(whole) * k // blocks, len(whole) * (k + 1) // blocks - at)
            docs = [np.frombuffer(x, "<u2") for x in table.column("ids").to_pylist()]
            ids, base, total = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
            packed = pack_shard(docs, window, about)
            rows = [(ids[j], base[j] + at, n, crc(docs[j][at : at + n]), total[j], 2 * (first + number) + 1, offset) for j, at, n, number, offset in packed]
            first += packed[-1][3] + 1
            yield pa.RecordBatch.from_arrays(_columns(rows, _PIECE), schema=_PIECE)

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece; sequence ids are odd for packed windows and even for windows of one document."""
    encoded = materialize(encode(docs, vocabulary, window, end_id), "pack-pieces")
    alone = encoded.filter(F.col("ids").isNull()).select(*_PIECE.names)
    rest = encoded.filter(F.col("ids").isNotNull())
    about = collection(rest)
    dealt = deal(rest, about, max(1, math.ceil(about.total / SHARD_ROWS)))
    return alone.unionByName(dealt.mapInArrow(_pack(window, about), PIECE))
