"""Ranked retrieval as set operations: dense, BM25, fusion, reranking, and rewriting.

A ranking is a table (query_id, doc_id, score, rank); all queries of a batch are
answered at once.  Ties are broken by doc_id.

Searches take queries in packets of about PACKET_BYTES, tens of thousands of
questions, so that the driver holds no more than one and the corpus is read once
for each.  A packet is sent to the tasks that read the corpus; each scores its
rows, whole, where they are, for one block of QUERY_BLOCK queries after another,
and keeps k of them for each query over all that it reads.  So neither texts nor
vectors are shuffled, no term is a join key, and what is shuffled has k rows for
each query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import scores as S

#: Queries that are scored at once, bytes of queries that go along with one scan, and (document, term, query) triples that are summed at once.
QUERY_BLOCK, PACKET_BYTES, TRIPLES = 1024, 16 << 20, 1 << 22
SCORED = "query_id long, doc_id long, score double"


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """``rank`` by score, best first, and the first ``k`` of each query."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k is not None else out


class Best:
    """The k best documents of each query among those added."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        q, d, s = (np.concatenate(x) for x in ((self.query, query), (self.doc, doc), (self.score, score)))
        order = np.lexsort((d, -s, q))
        q = q[order]
        kept = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.query, self.doc, self.score = (np.concatenate(x)[kept] for x in ((self.query, query), (self.doc, doc), (self.score, score)))

    def add_grid(self, ids: np.ndarray, docs: np.ndarray, grid: np.ndarray, kept: np.ndarray) -> None:
        """``grid``: scores [query, document], of which those in ``kept`` count."""
        if grid.shape[1] > self.k:
            masked = np.where(kept, grid, -np.inf)
            kept = kept & (grid >= np.partition(masked, -self.k, axis=1)[:, -self.k, None])
        q, d = np.nonzero(kept)
        self.add(ids[q], docs[d], grid[q, d])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.query), pa.array(self.doc), pa.array(self.score)], ["query_id", "doc_id", "score"])


def _packets(queries: DataFrame, size: Callable[[Row], int]) -> Iterator[list[Row]]:
    """Queries in packets of at most PACKET_BYTES, or of one query that is larger."""
    packet, held = [], 0
    for row in queries.toLocalIterator():
        n = size(row)
        if packet and held + n > PACKET_BYTES:
            yield packet
            packet, held = [], 0
        packet.append(row)
        held += n
    if packet:
        yield packet


def _in_packets(queries: DataFrame, size: Callable[[Row], int], answer: Callable[[list[Row]], DataFrame]) -> DataFrame:
    """The union of the answers to packets of queries."""
    answers = [answer(rows) for rows in _packets(queries, size)]
    return reduce(DataFrame.unionByName, answers) if answers else queries.sparkSession.createDataFrame([], SCORED)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """Exact top k + 1 by cosine similarity, clamped to [0, 1] and rounded to 6 digits."""
    slim = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def answer(rows: list[Row]) -> DataFrame:
        ids, asked = np.array([r["id"] for r in rows]), _unit(np.array([r["v"] for r in rows], float))
        cuts = range(QUERY_BLOCK, len(ids), QUERY_BLOCK)
        blocks = list(zip(np.split(ids, cuts), np.split(asked, cuts), strict=True))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(k + 1) for _ in blocks]
            for b in batches:
                if b.num_rows:
                    m = _unit(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(float)).T
                    for found, (block, vectors) in zip(best, blocks, strict=True):
                        grid = np.round(np.clip(vectors @ m, 0, 1), 6)
                        found.add_grid(block, b.column(0).to_numpy(), grid, np.ones_like(grid, bool))
            yield from (found.rows() for found in best)

        return slim(corpus).mapInArrow(run, SCORED)

    return ranked(_in_packets(slim(queries), lambda r: 8 * len(r["v"]) + 8, answer), k + 1)


def without_self(ranking: DataFrame, k: int) -> DataFrame:
    """A ranking of rows by rows of the same table, without each row itself."""
    return ranked(ranking.where(F.col("query_id") != F.col("doc_id")).drop("rank"), k)


def merge_fields(*rankings: DataFrame) -> DataFrame:
    """The best score of each document over several fields."""
    union = rankings[0].select("query_id", "doc_id", "score")
    for r in rankings[1:]:
        union = union.unionByName(r.select("query_id", "doc_id", "score"))
    return union.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


class Asked:
    """A packet of queries: the terms of all, and its blocks of queries."""

    def __init__(self, rows: list[Row]):
        number: dict[str, int] = {}
        of = [np.array([number.setdefault(t, len(number)) for t in r["terms"]], np.int64) for r in rows]
        ids = np.array([r["query_id"] for r in rows], np.int64)
        self.terms = pa.array(list(number), pa.string())
        self.blocks = [Block(ids[k : k + QUERY_BLOCK], of[k : k + QUERY_BLOCK]) for k in range(0, len(rows), QUERY_BLOCK)]

    def postings(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents as lists of terms: row, term and count of each pair that some query asks for; and all lengths."""
        length = terms.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        at = pc.index_in(terms.flatten(), value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(length)), length)
        n = max(1, len(self.terms))
        pair, tf = np.unique((row * n + at)[at >= 0], return_counts=True)
        return pair // n, pair % n, tf, length


class Block:
    """Queries that are scored at once: the terms that they ask for, and which of them have each."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray]):
        self.ids, flat = ids, np.concatenate(terms)
        query = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        self.terms, self.count = np.unique(flat, return_counts=True)
        self.queries = query[np.argsort(flat, kind="stable")]
        self.start = np.cumsum(self.count) - self.count

    def scores(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums [query, row] of the weights of the terms that a query has."""
        out = np.zeros(len(self.ids) * n_rows)
        mine = np.isin(term, self.terms)
        row, weight, at = row[mine], weight[mine], np.searchsorted(self.terms, term[mine])
        many = self.count[at]
        upto = np.cumsum(many)
        for part in np.split(np.arange(len(row)), np.searchsorted(upto, np.arange(TRIPLES, upto[-1], TRIPLES))) if len(row) else []:
            each = many[part]
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            query = self.queries[np.repeat(self.start[at[part]], each) + inside]
            out += np.bincount(query * n_rows + np.repeat(row[part], each), np.repeat(weight[part], each), len(out))
        return out.reshape(len(self.ids), n_rows)


def _lexical(queries: DataFrame, docs: DataFrame, terms: Callable[[Column], Column], k: int, keep: Column | None, weigher: Callable[[DataFrame, Asked], Callable]) -> DataFrame:
    """The k best documents of each query by the sums of their terms' weights; documents that score 0 are dropped."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), terms(F.col("text")).alias("terms"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(terms(F.col("text"))).alias("terms"))

    def answer(rows: list[Row]) -> DataFrame:
        packet = Asked(rows)
        weigh = weigher(known, packet)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in packet.blocks]
            for b in batches:
                row, term, tf, length = packet.postings(b.column(1))
                weight, may = weigh(term, tf, length[row]), b.column(2).to_numpy(zero_copy_only=False)
                for found, block in zip(best, packet.blocks, strict=True):
                    grid = np.round(block.scores(row, term, weight, b.num_rows), 6)
                    found.add_grid(block.ids, b.column(0).to_numpy(), grid, (grid > 0) & may)
            yield from (found.rows() for found in best)

        return known.mapInArrow(run, SCORED)

    return ranked(_in_packets(asked, lambda r: sum(map(len, r["terms"])) + 8, answer), k)


def bm25_topk(queries: DataFrame, docs: DataFrame, terms: Callable[[Column], Column], k: int, keep: Column | None = None, k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> DataFrame:
    """The k best by BM25, from (query_id, text) and (doc_id, text); counts are those of all ``docs``, ``keep`` says which may be found."""

    def weigher(known: DataFrame, packet: Asked) -> Callable:
        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, total = np.zeros(len(packet.terms), np.int64), 0, 0
            for batch in batches:
                _, term, _, length = packet.postings(batch.column(0))
                df += np.bincount(term, minlength=len(df))
                n, total = n + len(length), total + int(length.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(df))), pa.array(np.concatenate([[total, n], df]))], ["term", "n"])

        sums = {r["term"]: r["n"] for r in known.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, df = sums.get(-1, 0), np.array([sums.get(t, 0) for t in range(len(packet.terms))], float)
        idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), sums.get(-2, 0) / max(1, n) or 1.0
        return lambda term, tf, length: idf[term] * tf / (tf + k1 * (1 - b + b * length / mean))

    return _lexical(queries, docs, terms, k, keep, weigher)


def overlap_topk(queries: DataFrame, docs: DataFrame, terms: Callable[[Column], Column], k: int) -> DataFrame:
    """The k best by the number of distinct terms that they share with the query."""
    return _lexical(queries, docs, terms, k, None, lambda known, packet: lambda term, tf, length: np.ones(len(term)))


def rrf(*rankings: DataFrame, k: int = rules.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion, over the best of each query, so that it leads with 1."""
    union = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select("query_id", "doc_id", "rank"))
    fused = union.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return fused.withColumn("score", S.over_max(F.col("score"), "query_id"))


def rerank(candidates: DataFrame, pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int, chars: int = 256) -> DataFrame:
    """Scores (query text, document text) pairs of the candidates in batches, and ranks anew.

    ``pairs`` has query_id, doc_id, query_text and doc_text; ``scorer`` takes the
    texts of a batch and returns logits.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            logits = scorer(b["query_text"].tolist(), b["doc_text"].str[:chars].tolist())
            yield pd.DataFrame({"query_id": b["query_id"], "doc_id": b["doc_id"], "logit": np.asarray(logits, float)})

    texts = candidates.select("query_id", "doc_id").join(pairs, ["query_id", "doc_id"])
    scored = texts.mapInPandas(run, "query_id long, doc_id long, logit double")
    return ranked(scored.select("query_id", "doc_id", F.round(S.logistic(F.col("logit")), 6).alias("score")), k)


def rewrite_aware(plain: DataFrame, rewritten: DataFrame, firing: DataFrame, floor: float = rules.SCORE_FLOOR) -> DataFrame:
    """The ranking of the rewritten question where a rewrite fired.

    ``firing``: (query_id, mechanism).  'iter1' replaces the question; 'fallback'
    only counts if the plain top score is under the floor, and the better of both
    tops wins, ties going to the rewrite.
    """
    top = lambda r, name: r.where("rank = 1").select("query_id", F.col("score").alias(name))
    choice = firing.join(top(plain, "p"), "query_id", "left").join(top(rewritten, "r"), "query_id", "left")
    p, r = F.coalesce("p", F.lit(0.0)), F.coalesce("r", F.lit(-1.0))
    use = F.when(F.col("mechanism") == "iter1", r >= 0).when(F.col("mechanism") == "fallback", (p < floor) & (r >= p)).otherwise(False)
    chosen = choice.where(use).select("query_id")
    return plain.join(chosen, "query_id", "left_anti").unionByName(rewritten.join(chosen, "query_id", "left_semi"))


def fan_in(rankings: Iterable[DataFrame], k: int) -> DataFrame:
    """Several surfaces' hits as one ranking, each document once with its best score."""
    return ranked(merge_fields(*rankings), k)
