"""Registered queries: what is stored and kept up to date (indexes, caches, staged tables, runs that go on)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluation, lexical_index, paid_results
from quarry.plans.registry import Registry
from quarry.plans.retrieval_queries import _BM25, _TOP, words
from quarry.sources import incremental
from quarry.sources.versions import Versions, merge_staged
from quarry.streaming import jobs

R = Registry()
c = F.col


def _versions(t, tag: str) -> Versions:
    return Versions(t.spark, jobs.work_folder(t.spark, tag))


def _items(t) -> DataFrame:
    return t.benchmark.select(c("item_id").alias("query_id"), "text")


def _before(t) -> DataFrame:
    """An earlier state of the documents: German ones are yet to come, those of one source were shorter, French ones are there twice."""
    short = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 5), " ")
    old = t.documents.where("lang <> 'de'").select("doc_id", F.when(c("source") == "src1", short).otherwise(c("text")).alias("text"))
    return old.unionByName(t.documents.where("lang = 'fr'").select((-c("doc_id") - 1).alias("doc_id"), "text"))


@R.query("index_topk", _BM25 + _TOP.format(name="r", of="b", k=5) + "SELECT query_id, doc_id, score, rank FROM r")
def index_topk(t) -> DataFrame:
    """From the stored index; the SQL scores all documents."""
    index = _versions(t, "lexical-index")
    lexical_index.refresh(index, t.documents, words)
    return lexical_index.search(index, _items(t), words, 5)


@R.query("index_refresh_topk", _BM25 + _TOP.format(name="r", of="b", k=5) + "SELECT query_id, doc_id, score, rank FROM r")
def index_refresh_topk(t) -> DataFrame:
    """From an index of an earlier state that was brought up to date."""
    index = _versions(t, "lexical-index")
    lexical_index.refresh(index, _before(t), words)
    lexical_index.refresh(index, t.documents, words)
    return lexical_index.search(index, _items(t), words, 5)


@R.query(
    "index_refresh_counts",
    "WITH o AS (SELECT doc_id, CASE WHEN source = 'src1' THEN array_to_string(string_split(coalesce(text, ''), ' ')[1:5], ' ') ELSE coalesce(text, '') END AS text FROM documents WHERE lang <> 'de' UNION ALL SELECT -doc_id - 1, coalesce(text, '') FROM documents WHERE lang = 'fr'), "
    "z AS (SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.text <> coalesce(n.text, '') THEN 'changed' ELSE 'untouched' END AS state FROM o FULL JOIN documents n USING (doc_id)) "
    "SELECT 1 AS version, 'added' AS state, count(*) AS n FROM o UNION ALL SELECT 2, state, count(*) FROM z GROUP BY 2",
)
def index_refresh_counts(t) -> DataFrame:
    """What each refresh did, by the index's own record."""
    index = _versions(t, "lexical-index")
    lexical_index.refresh(index, _before(t), words)
    lexical_index.refresh(index, t.documents, words)
    rows = [(v, state, n) for v, _, counts in lexical_index.freshness(index) for state, n in counts.items() if n]
    return t.spark.createDataFrame(rows, "version int, state string, n long")


@R.query(
    "staged_merge",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'second' ELSE 'first' END AS load, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 1000",
)
def staged_merge(t) -> DataFrame:
    """Orders staged and merged twice, the second load over some of the first; a load that breaks a rule stays unseen."""
    table = _versions(t, "orders")
    load = lambda rows, name, price: rows.select("o_orderkey", F.lit(name).alias("load"), price.alias("price"))
    price = c("o_totalprice")
    merge_staged(table, load(t.orders.where((c("o_orderstatus") != "P") | (price > 1000)), "first", price), "o_orderkey")
    merge_staged(table, load(t.orders.where("o_orderstatus = 'F'"), "second", F.round(price * 2, 2)), "o_orderkey", {"no price": c("price").isNull()})
    return table.read("rows")


@R.query(
    "staged_counts",
    "SELECT 1 AS version, count(*) AS staged, count(*) AS inserted, 0 AS updated FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE c_acctbal <= 0), count(*) FILTER (WHERE c_acctbal > 0) FROM customer WHERE c_custkey % 3 > 0",
)
def staged_counts(t) -> DataFrame:
    """What each staged load inserted and updated, as its manifest says."""
    table, rows = _versions(t, "customers"), t.customer.select("c_custkey", "c_acctbal")
    merge_staged(table, rows.where("c_acctbal > 0"), "c_custkey")
    merge_staged(table, rows.where("c_custkey % 3 > 0"), "c_custkey")
    facts = [(v, *(table.manifest(v)["facts"][n] for n in ("staged", "inserted", "updated"))) for v in (1, 2)]
    return t.spark.createDataFrame(facts, "version int, staged long, inserted long, updated long")


#: Calls of the two fills of the cache, and texts of a call.
_FIRST_CALLS, _SECOND_CALLS, _CALL_ROWS = 3, 4, 40


@R.query(
    "result_cache",
    f"WITH k AS (SELECT doc_id, text, dense_rank() OVER (ORDER BY sha1(length(text) || ':' || text)) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN n <= {_FIRST_CALLS * _CALL_ROWS} THEN 'hit' WHEN n <= {(_FIRST_CALLS + _SECOND_CALLS) * _CALL_ROWS} THEN 'filled' ELSE 'open' END AS state, CASE WHEN n <= {(_FIRST_CALLS + _SECOND_CALLS) * _CALL_ROWS} THEN length(text) END AS value FROM k",
)
def result_cache(t) -> DataFrame:
    """Of each text: whether a second run found it in the cache, paid for it, or had no calls left."""
    cache = _versions(t, "results")
    wanted = t.documents.where("text IS NOT NULL").select("doc_id", paid_results.content_key(c("text")).alias("key"), c("text").alias("input"))
    lengths = lambda texts: [len(x) for x in texts]
    paid_results.fill(cache, wanted.select("key", "input"), lengths, "long", _FIRST_CALLS, _CALL_ROWS)
    hits = paid_results.look_up(cache, wanted, "long").select("doc_id", "key", c("value").isNotNull().alias("hit"))
    paid_results.fill(cache, wanted.select("key", "input"), lengths, "long", _SECOND_CALLS, _CALL_ROWS)
    found = paid_results.look_up(cache, hits, "long")
    return found.select("doc_id", F.when(c("hit"), "hit").when(c("value").isNotNull(), "filled").otherwise("open").alias("state"), "value")


@R.query("resumed_scores", "SELECT doc_id, len([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+') IF length(x) > 1])::DOUBLE AS score, (('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % 6) < 2 AS first_run FROM documents")
def resumed_scores(t) -> DataFrame:
    """A run that stops after two of six parts, and one that goes on where it stopped."""
    table = _versions(t, "scores")

    def score(name: str):
        return lambda part: part.select("doc_id", F.size(words(F.coalesce("text", F.lit("")))).cast("double").alias("score"), F.lit(name).alias("run"))

    ticks = iter(range(1 << 30))
    paid_results.run_parts(table, t.documents.select("doc_id", "text"), "doc_id", score("first"), 6, 2.5, lambda: next(ticks))
    paid_results.run_parts(table, t.documents.select("doc_id", "text"), "doc_id", score("second"), 6, float("inf"))
    return table.read("rows").select("doc_id", "score", (c("run") == "first").alias("first_run"))


@R.query(
    "stale_outputs",
    "WITH i AS (SELECT o_custkey AS name, max(o_orderdate) AS at FROM orders GROUP BY 1), o AS (SELECT o_custkey AS name, max(o_orderdate) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT -c_custkey, NULL FROM customer WHERE c_acctbal < 0) "
    "SELECT coalesce(i.name, o.name) AS name, CASE WHEN i.at IS NULL THEN 'orphan' WHEN o.name IS NULL THEN 'new' WHEN o.at <= DATE '1994-06-01' THEN 'rules' WHEN o.at < i.at THEN 'input' ELSE 'fresh' END AS state FROM i FULL JOIN o ON i.name = o.name",
)
def stale_outputs(t) -> DataFrame:
    """A customer's newest order as the input, the newest finished one as the output."""
    newest = lambda rows: rows.groupBy(c("o_custkey").alias("name")).agg(F.max("o_orderdate").alias("at"))
    done = newest(t.orders.where("o_orderstatus = 'F'"))
    gone = t.customer.where("c_acctbal < 0").select((-c("c_custkey")).alias("name"), F.lit(None).cast(done.schema["at"].dataType).alias("at"))
    return incremental.staleness(newest(t.orders), done.unionByName(gone), F.to_date(F.lit("1994-06-01")))


@R.query(
    "round_robin",
    "SELECT event_id, event_type, wave FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS wave FROM events) ORDER BY wave, event_type LIMIT 53",
)
def round_robin(t) -> DataFrame:
    ordered = t.events.withColumn("_least", -c("value"))
    return evaluation.round_robin(ordered, "event_type", ["_least", "event_id"], 53).select("event_id", "event_type", "wave")


@R.query(
    "sink_statistics",
    "SELECT count(*) AS enqueued, count(*) FILTER (WHERE event_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL) AS flushed, count(*) FILTER (WHERE event_id IS NULL OR event_type IS NULL OR value IS NULL) AS dropped_invalid, 0 AS dropped_on_error, 0 AS flush_errors FROM events",
)
def sink_statistics(t) -> DataFrame:
    """The log sink's own counters after the table has gone through it."""
    return jobs.sink_statistics(jobs.run_log_sink(t, "events", ["event_id", "event_type", "value"], counts=True))
