"""A stored lexical index: postings in blocks with their maxima, exact pruned search, and refresh.

Documents lie in chunks of some CHUNK_DOCS by a hash of their id.  A posting row is a
term in a chunk: its documents with their counts and lengths, and, in columns of their
own, the highest count and the shortest length.  No document of the chunk can get more
from the term than these two give, whatever the mean length is by then.  Rows are
partitioned by a hash of the term and sorted by it, so a search reads the folders of
its terms only, and the lists only where it scores.

A search first scores, for each query, the chunks in which its rarest sufficient term
can give most; the k-th score there is its floor.  Terms that cannot reach the floor
together need not be followed, and of the chunks that the others name, those whose
bounds stay under the floor are left out.  The rest is scored whole, so the result
equals that of scoring all documents.

A refresh compares digests and writes postings of new and changed documents only, as
one more version; older postings of changed and removed documents are dead, and their
terms are subtracted from the counts.  A version becomes visible by one switch.

Defined cases: document ids are keys, and null or repeated ones are rejected; a
null text has no terms; a query without known terms finds nothing; documents that
score 0 are left out; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import rules
from quarry.operators.retrieval import ranked
from quarry.sources.versions import Rejected, Versions, materialize

#: Folders of terms, documents of a chunk, chunks that give a query its floor.
BUCKETS, CHUNK_DOCS, FLOOR_CHUNKS = 64, 256, 4
#: What rounding may add to a score of six digits.
SLACK = 2e-6
#: Documents whose terms a task counts at once, documents of a file of postings in each folder, rows of keys that are broadcast.
TASK_DOCS, FILE_DOCS, BROADCAST_ROWS = 4096, 200_000, 1_000_000


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def refresh(index: Versions, docs: DataFrame, terms: Callable[[Column], Column], at: str | None = None) -> dict[str, int]:
    """Brings the index to the state of ``docs`` (doc_id, text); returns added, changed, removed and untouched documents.

    ``at`` is kept as the version's time.
    """
    base = index.latest()
    old = index.manifest(base)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    now = materialize(slim.select("doc_id", F.sha1("text").alias("digest")), "digests")
    checked = now.agg(F.count("*").alias("rows"), F.count("doc_id").alias("known"), F.count_distinct("doc_id").alias("distinct")).first()
    if checked["distinct"] != checked["rows"]:
        raise Rejected({"null key": checked["rows"] - checked["known"], "repeated key": checked["known"] - checked["distinct"]})
    known = _live(index, old)
    if known is None:
        states = now.select("doc_id", F.lit("added").alias("state"), F.lit(None).cast("int").alias("old_version"))
    else:
        both = now.alias("n").join(known.alias("o"), F.col("n.doc_id") == F.col("o.doc_id"), "full_outer")
        state = F.when(F.col("o.doc_id").isNull(), "added").when(F.col("n.doc_id").isNull(), "removed").when(F.col("n.digest") != F.col("o.digest"), "changed").otherwise("untouched")
        states = both.select(F.coalesce("n.doc_id", "o.doc_id").alias("doc_id"), state.alias("state"), F.col("o.version").alias("old_version"))
    states = materialize(states, "document-states")
    counts = {"added": 0, "changed": 0, "removed": 0, "untouched": 0} | {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    fresh, gone = counts["added"] + counts["changed"], counts["changed"] + counts["removed"]
    if known is not None and not fresh + gone:
        return counts
    version, tables = base + 1, {name: list(old["tables"].get(name, [])) for name in ("documents", "postings", "frequencies", "dead")}

    # The documents with their terms, which are written once; their postings are made from there.
    written = slim
    if known is not None:
        written = slim.join(_small(states.where(F.col("state").isin("added", "changed")).select("doc_id"), fresh), "doc_id", "left_semi")
    chunks = max(1, -(-fresh // CHUNK_DOCS))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")
    cut = written.select("doc_id", F.sha1("text").alias("digest"), chunk.alias("chunk"), terms(F.col("text")).alias("terms"))
    new = cut.select("doc_id", F.lit(version).alias("version"), "digest", "chunk", F.size("terms").cast("long").alias("length"), "terms", F.lit(True).alias("live"))
    removed = states.where(F.col("state") == "removed").select("doc_id", F.lit(version).alias("version"), F.lit("").alias("digest"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("length"), F.array().cast("array<string>").alias("terms"), F.lit(False).alias("live"))
    tables["documents"].append(index.stage(new.unionByName(removed)))
    staged = index.open(tables["documents"][-1:]).where("live")
    # Chunks meet as documents, some in a task, so the words themselves are counted where they are.
    tasks = max(-(-fresh // TASK_DOCS), min(chunks, index.spark.sparkContext.defaultParallelism))
    met = staged.select("doc_id", "chunk", "length", "terms").repartition(tasks, "chunk")
    each = met.select("doc_id", "chunk", "length", F.explode("terms").alias("term")).groupBy("term", "chunk", "doc_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    lists = each.groupBy("term", "chunk").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.array_sort(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("entries"))
    postings, files = lists.withColumns({"version": F.lit(version), "bucket": _bucket()}), -(-fresh // FILE_DOCS)
    dealt = postings.repartition("bucket") if files <= 1 else postings.repartition(BUCKETS * files, "bucket", F.pmod("chunk", F.lit(files)))
    tables["postings"].append(index.stage(dealt.sortWithinPartitions("bucket", "term", "chunk"), ["bucket"]))
    written_postings = index.open(tables["postings"][-1:])
    freq = written_postings.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))

    facts = {"n": old["facts"].get("n", 0) + counts["added"] - counts["removed"], "terms": old["facts"].get("terms", 0) + (staged.agg(F.sum("length")).first()[0] or 0), "at": at}
    if gone:
        before = index.open(old["tables"]["documents"])
        lost = states.where(F.col("state").isin("changed", "removed")).select("doc_id", F.col("old_version").alias("version"))
        dead = materialize(before.join(_small(lost, gone), ["doc_id", "version"], "left_semi").select("doc_id", "version", "chunk", "length", F.array_distinct("terms").alias("terms")), "dead-documents")
        tables["dead"].append(index.stage(dead.select("doc_id", "version", "chunk")))
        facts["terms"] -= dead.agg(F.sum("length")).first()[0] or 0
        less = dead.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        freq = freq.unionByName(less.select(_bucket(), "term", "df", F.lit(None).cast("long").alias("max_tf"), F.lit(None).cast("long").alias("min_length")))
    tables["frequencies"].append(index.stage(freq.repartition("bucket").sortWithinPartitions("bucket", "term"), ["bucket"]))
    index.commit(base, tables, facts | {"counts": counts})
    return counts


def _live(index: Versions, manifest: dict) -> DataFrame | None:
    """(doc_id, version, digest, length) of the documents that the index has now."""
    documents = index.open(manifest["tables"].get("documents", []))
    if documents is None:
        return None
    newest = documents.groupBy("doc_id").agg(F.max_by(F.struct("version", "digest", "length", "live"), "version").alias("d"))
    return newest.where("d.live").select("doc_id", "d.version", "d.digest", "d.length")


def freshness(index: Versions) -> list[tuple[int, str | None, dict[str, int]]]:
    """(version, time, counts) of each version."""
    every = (index.manifest(v)["facts"] for v in range(1, index.latest() + 1))
    return [(v, f["at"], f["counts"]) for v, f in enumerate(every, 1)]


def search(index: Versions, queries: DataFrame, terms: Callable[[Column], Column], k: int, keep: DataFrame | None = None, k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> DataFrame:
    """The k best documents of each query (query_id, text) by BM25; ``keep`` (doc_id) says which may be found."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")).withColumn("bucket", _bucket())
    asked = materialize(asked.distinct(), "query-terms")
    manifest = index.manifest()
    facts, tables = manifest["facts"], manifest["tables"]
    n, mean = facts.get("n", 0), facts.get("terms", 0) / max(1, facts.get("n", 0)) or 1.0
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
    if not n or not buckets:
        return ranked(asked.sparkSession.createDataFrame([], "query_id long, doc_id long, score double"), k)

    def weight(tf: Column, length: Column) -> Column:
        return tf / (tf + k1 * (1 - b + b * length / mean))

    def read(name: str) -> DataFrame:
        return index.open(tables[name]).where(F.col("bucket").isin(buckets))

    counted = read("frequencies").join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    counted = counted.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length")).where("df > 0")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(counted, ["bucket", "term"]).select("query_id", "bucket", "term", "df", idf.alias("idf"), (idf * weight(F.col("max_tf"), F.col("min_length"))).alias("most"))
    known = materialize(known, "known-terms")
    postings, dead = read("postings"), index.open(tables["dead"])
    # At most a chunk's documents in each list.
    gone = None if dead is None else dead.groupBy("version", "chunk").agg(F.collect_set("doc_id").alias("gone"))
    # Given by number: few bytes of lists make many scores, so tasks must not be merged by bytes.
    pairs, tasks = known.count(), max(-(-n // TASK_DOCS), asked.sparkSession.sparkContext.defaultParallelism)
    weights, terms_asked = _small(known.select("query_id", "bucket", "term", "idf"), pairs), _small(known.select("bucket", "term").distinct(), pairs)
    heads = postings.select("bucket", "term", "version", "chunk", weight(F.col("max_tf"), F.col("min_length")).alias("bound"))
    spot = ["query_id", "version", "chunk"]

    def scored(spots: DataFrame) -> DataFrame:
        """Whole scores of the documents in (query_id, version, chunk)."""
        asking = spots.groupBy("version", "chunk").agg(F.collect_set("query_id").alias("asking"))
        # A list goes once to the task of its chunk, whoever asks for it; there its documents are scored.
        lists = postings.join(terms_asked, ["bucket", "term"], "left_semi").select("bucket", "term", "version", "chunk", "entries").repartition(tasks, "version", "chunk").join(asking, ["version", "chunk"])
        if gone is not None:
            alive = F.filter("entries", lambda e: ~F.array_contains("gone", e.doc_id))
            lists = lists.join(gone, ["version", "chunk"], "left").withColumn("entries", F.when(F.col("gone").isNull(), F.col("entries")).otherwise(alive))
        rows = lists.join(weights, ["bucket", "term"]).where(F.array_contains("asking", F.col("query_id"))).select("query_id", "version", "chunk", "idf", F.explode("entries").alias("e"))
        each = rows.select("query_id", "version", "chunk", F.col("e.doc_id").alias("doc_id"), (F.col("idf") * weight(F.col("e.tf"), F.col("e.length"))).alias("w"))
        sums = each.groupBy("query_id", "version", "chunk", "doc_id").agg(F.sum("w").alias("score")).select("query_id", "doc_id", "score")
        return sums if keep is None else sums.join(keep.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")

    def first(rows: DataFrame, count: int, *order: Column) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= count)

    scarce = F.col("df") < k
    seeds = first(known, 1, scarce, F.when(scarce, -F.col("df")).otherwise(F.col("df")), F.col("term")).drop("place")
    seeded = first(seeds.join(heads, ["bucket", "term"]), FLOOR_CHUNKS, F.desc("bound"), F.col("version"), F.col("chunk")).select(*spot)
    kth = first(scored(seeded), k, F.desc("score")).where(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
    floors = materialize(kth, "score-floors")
    # Terms from the weakest on whose sum stays under the floor bring in no document.
    upto = F.sum("most").over(W.partitionBy("query_id").orderBy("most", "term"))
    led = known.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK).withColumn("followed", upto >= F.col("floor"))
    rest = F.sum(F.when(F.col("followed"), 0.0).otherwise(F.col("most"))).over(W.partitionBy("query_id"))
    led = led.withColumn("rest", rest).where("followed").select("query_id", "bucket", "term", "idf", "floor", "rest")
    bounds = led.join(heads, ["bucket", "term"]).groupBy(*spot).agg(F.sum(F.col("idf") * F.col("bound")).alias("bound"), F.first("rest").alias("rest"), F.first("floor").alias("floor"))
    spots = bounds.where(F.col("bound") + F.col("rest") >= F.col("floor")).select(*spot)
    final = scored(spots).withColumn("score", F.round("score", 6)).where("score > 0")
    return ranked(final, k)
