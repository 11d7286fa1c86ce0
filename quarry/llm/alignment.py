"""Token alignment across two tokenizers by lockstep vectorised merging.

Both tokenizers encode the same bytes (a space and the text); a token is the range
of bytes that ends where the tokens up to it end.  Documents are cut into lanes of
some kilobytes, and all lanes of a batch are merged at once: a NumPy vector holds
each lane's place in tokenizer A and in tokenizer B, and a step moves the side
that ends first, or both where they end together.  Where they end together the two
tokens are linked and the documents cut into groups there.  Lanes that have reached
their end leave the vectors, so a step costs what is still open.  A lane takes the
tokens that end in its bytes, whatever side they are of, so lanes need nothing from
each other and a document of any length takes as many steps as one lane has tokens.

Tokenizing runs once: each document's links are stored as pairs of ids.  The counts
of pairs are summed in each task before the shuffle, their best ones found for each
id of B, and both looked up for the stored links: by a broadcast table while that
has few enough pairs, else by a join of each document's distinct pairs.

Defined cases: texts that are null, empty, or that a tokenizer does not give back
byte for byte have no tokens, so counts of zero and an empty digest; repeated ids
and rows stand each for itself; very long texts are aligned whole; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.skew import join_hot
from quarry.llm.storage import materialize
from quarry.llm.tokens import CLOSING, PartEncoder, byte_symbols

#: Bytes of a lane; distinct pairs that a task sums before it passes them on; pairs that are broadcast.
LANE_BYTES, TASK_PAIRS, BROADCAST_PAIRS = 4096, 1 << 20, 4_000_000
#: Parts of texts that a worker remembers for tokenizer B.
CACHE_PARTS = 900_000
#: Texts of a batch that are aligned together.
BATCH_TEXTS = 1000

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class ByteLevel:
    """Tokenizer A: ids of a space and a text, and the bytes of each id."""

    def __init__(self, path: str):
        self.parts = PartEncoder(path, False)
        self.parts.tokenizer.encode_special_tokens = True
        own = {c: b for b, c in byte_symbols().items()}
        size = self.parts.tokenizer.get_vocab_size()
        # So any bytes come back as they are.
        if self.parts.tokenizer.normalizer is not None or any(self.parts.tokenizer.token_to_id(c) is None for c in own):
            raise ValueError("a vocabulary without all bytes, or with a normaliser")
        pieces = [self.parts.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.pieces = [bytes(own[c] for c in p) if all(c in own for c in p) else p.encode() for p in pieces]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """No ids for None."""
        return [np.frombuffer(x, "<u2") for x in self.parts.batch(["" if t is None else " " + t for t in texts])]


class Pieces:
    """Tokenizer B, which adds the space itself.

    No piece of the vocabulary goes on from a word into the space or the closing sign
    after it, so a text may be cut before each run of spaces.  Cut parts are
    remembered; one whose pieces do not give it back has None, and so has its text.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if len(pieces) > 65_536 or any("▁" in p.lstrip("▁") or any(a.isalpha() and b in CLOSING for a, b in itertools.pairwise(p)) for p in pieces):
            raise ValueError("pieces that go on after a space or a word, or ids of more than two bytes")
        self.pieces = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.known: dict[str, bytes | None] = {}
        after = len(self.model.encode("a"))
        self.closing = {c: np.array(self.model.encode(f"a{c}")[after:], "<u2").tobytes() for c in CLOSING}

    def _encode(self, texts: list[str]) -> Iterator[bytes | None]:
        """Ids of whole texts, None where their pieces are not a space and the text."""
        for t, ids in zip(texts, self.model.encode(texts), strict=True):
            same = b"".join([self.pieces[i] for i in ids]) == b" " + t.encode()
            yield np.array(ids, "<u2").tobytes() if same else None

    def batch(self, texts: list[str]) -> list[np.ndarray | None]:
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        known, whole, cut = self.known, {}, {}
        for k, t in enumerate(texts):
            if "  " in t or t[:1] in ("", " ") or t[-1:] == " " or "▁" in t:
                whole[k] = t
            else:
                cut[k] = t.split(" ")
        new = list({p for parts in cut.values() for p in parts if p not in known})
        # No piece goes on from a letter to a closing sign, so words are learned without it.
        bare = {p: p[:-1] for p in new if p[-1] in CLOSING and p[:-1].isalpha()}
        words = list({bare.get(p, p) for p in new} - known.keys())
        known.update(zip(words, self._encode(words), strict=True))
        known.update({p: None if known[w] is None else known[w] + self.closing[p[-1]] for p, w in bare.items()})
        out: list[bytes | None] = [None] * len(texts)
        for k, ids in zip(whole, self._encode(list(whole.values())), strict=True):
            out[k] = ids
        for k, parts in cut.items():
            ids = [known[p] for p in parts]
            out[k] = None if None in ids else b"".join(ids)
        return [None if ids is None else np.frombuffer(ids, "<u2") for ids in out]


_held: dict[tuple, object] = {}


def _tokenizers(byte_level: str, pieces: str) -> tuple[ByteLevel, Pieces]:
    """The worker's tokenizers, kept between tasks."""
    if (byte_level, pieces) not in _held:
        _held[byte_level, pieces] = ByteLevel(byte_level), Pieces(pieces)
    return _held[byte_level, pieces]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, last_a: np.ndarray, first_b: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tokens that end together, in the order of A.

    ``ends_*`` are the ends of all tokens in one numbering of bytes; lane k has
    the tokens first_*[k] up to last_*[k].
    """
    a, b, stop_a, stop_b = first_a.copy(), first_b.copy(), last_a, last_b
    linked_a, linked_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        going = (a < stop_a) & (b < stop_b)
        if not going.all():  # finished lanes leave
            a, b, stop_a, stop_b = a[going], b[going], stop_a[going], stop_b[going]
        if not len(a):
            break
        at_a, at_b = ends_a[a], ends_b[b]
        together = at_a == at_b
        linked_a.append(a[together])
        linked_b.append(b[together])
        step_a, step_b = at_a <= at_b, at_b <= at_a
        a, b = a + step_a, b + step_b
    links_a, links_b = np.concatenate(linked_a), np.concatenate(linked_b)
    order = np.argsort(links_a, kind="stable")
    return links_a[order], links_b[order]


def _ends(ids: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token ends in the bytes of all documents, and each document's first token."""
    flat = np.concatenate([*ids, np.zeros(0, np.uint16)])
    return np.cumsum(sizes[flat]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linked tokens' places in the tokens of all documents, and each document's first link; both sides have the same bytes."""
    ends_a, docs_a = _ends(ids_a, sizes_a)
    ends_b, _ = _ends(ids_b, sizes_b)
    total = int(ends_a[-1]) if len(ends_a) else 0
    edges = np.arange(0, total + LANE_BYTES, LANE_BYTES)
    # A lane takes tokens that end after its first edge and up to its last.
    cut_a, cut_b = np.searchsorted(ends_a, edges, "right"), np.searchsorted(ends_b, edges, "right")
    cut_a[:1], cut_b[:1] = 0, 0
    links_a, links_b = lockstep(ends_a, ends_b, cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:])
    return links_a, links_b, np.searchsorted(links_a, docs_a)


def group_texts(ids_a: list[np.ndarray], ids_b: list[np.ndarray], links_a: np.ndarray, links_b: np.ndarray, named: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each document.

    ``named`` has the ids in decimal with a comma, then with a bar, then with a
    semicolon.  The last token of a group is its linked one; a token's place in the
    text of all documents is its number and that of the other side's tokens before.
    """
    a, b = (np.concatenate([*x, np.zeros(0, np.uint16)]).astype(np.int64) for x in (ids_a, ids_b))
    last_a, last_b, ids = np.zeros(len(a), bool), np.zeros(len(b), bool), len(named) // 3
    last_a[links_a] = last_b[links_b] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.concatenate([[0], links_b + 1])[group_a]] = a + ids * last_a
    out[np.arange(len(b)) + (links_a + 1)[group_b]] = b + 2 * ids * last_b
    words, texts, at = out.tolist(), [], 0
    for x, y in zip(ids_a, ids_b, strict=True):
        n = len(x) + len(y)
        texts.append("".join([named[i] for i in words[at : at + n]])[:-1])
        at += n
    return texts


def link_documents(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_links, groups_sha256 and links (id of A and of B, two bytes each) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _tokenizers(byte_level, pieces)
        sizes = [np.array([len(p) for p in t.pieces], np.int64) for t in (one, two)]
        named = [f"{i}{sign}" for sign in ",|;" for i in range(max(map(len, sizes)))]
        none = np.zeros(0, np.uint16)
        for batch in (b.slice(at, BATCH_TEXTS) for b in batches for at in range(0, b.num_rows, BATCH_TEXTS)):
            b = [none if ids is None else ids for ids in two.batch([t or "" for t in batch.column(1).to_pylist()])]
            a = one.batch([t if len(ids) else None for t, ids in zip(batch.column(1).to_pylist(), b, strict=True)])
            links_a, links_b, at = align(a, b, *sizes)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(a, b, links_a, links_b, named)]
            pairs = np.column_stack([np.concatenate([*x, none])[y] for x, y in ((a, links_a), (b, links_b))]).astype("<u2")
            packed, counts = [pairs[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], np.diff(at)
            columns = [batch.column(0), *(pa.array([len(x) for x in side], pa.int64()) for side in (a, b)), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_links", "groups_sha256", "links"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, links binary")


def _pairs(links: bytes) -> np.ndarray:
    """Pairs as numbers: the id of B times 65,536 and the id of A."""
    both = np.frombuffer(links, "<u2").reshape(-1, 2).astype(np.int64)
    return both[:, 1] << 16 | both[:, 0]


def _flat_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all rows, and the row of each."""
    each = [_pairs(x) for x in column.to_pylist()]
    return np.concatenate([*each, np.zeros(0, np.int64)]), np.repeat(np.arange(len(each)), [len(x) for x in each])


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold a pair, and whether no pair of its id of B has more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            new, n = np.unique(_flat_pairs(batch.column(0))[0], return_counts=True)
            both = np.concatenate([pairs, new])
            pairs, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
            if len(pairs) > TASK_PAIRS:
                yield rows()
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield rows()

    counted = linked.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # The pairs of one id of B are at most as many as A has ids.
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", 16)))
    return counted.withColumn("best", F.col("n") == most)


def _looked_up(linked: DataFrame, counts: DataFrame) -> DataFrame:
    rows = counts.toArrow()
    order = np.argsort(rows["pair"].to_numpy())
    table = linked.sparkSession.sparkContext.broadcast([rows[c].to_numpy()[order] for c in ("pair", "n", "best")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            pairs, of = _flat_pairs(batch.column("links"))
            at = np.searchsorted(known, pairs)
            sums = [np.bincount(of, x[at], batch.num_rows).astype(np.int64) for x in (best, n)] if len(pairs) else [np.zeros(batch.num_rows, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, sums)], [*batch.schema.names[:-1], "n_best", "count_sum"])

    return linked.mapInArrow(run, "doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _joined(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """As ``_looked_up``, by a join of each row's distinct pairs; equal rows are numbered apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, of = _flat_pairs(batch.column(1))
            both, times = np.unique(np.stack([of, pairs]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both[0])), pa.array(both[1]), pa.array(times)], ["row", "pair", "times"])

    rows = materialize(linked.withColumn("row", F.monotonically_increasing_id()), "numbered-links")
    each = materialize(rows.select("row", "links").mapInArrow(run, "row long, pair long, times long"), "document-pairs")
    sums = join_hot(each, counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("links").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])


def align_documents(docs: DataFrame, byte_level: str, pieces: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    linked = materialize(link_documents(docs, byte_level, pieces), "links")
    counts = materialize(pair_counts(linked), "pair-counts")
    out = (_looked_up if counts.count() <= broadcast_pairs else _joined)(linked, counts)
    # Each link ends a group, the last one at the end of the text.
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
