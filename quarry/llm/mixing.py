"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text.  A source that is to give f times its words
gives each document floor(f) times, and once more those whose hash is at most a
threshold.  The threshold is found without sorting documents: words are summed
by source and hash bucket, a running sum finds the bucket in which the budget
ends, and only that bucket is split further, level by level, until it holds a
single hash.  Thresholds are nested, so a larger budget keeps what a smaller one
took, and reruns agree.

Targets share all words by weight, but none exceeds ``max_epochs`` times its
source; the excess goes to the others by weight.

Defined cases: a null text has no words and is taken zero times its size; null
is a source of its own, ordered last; null ids hash like the empty string;
repeated ids with different texts have hashes of their own; rows of equal id and
text share one, and where a budget ends among them it takes as many as come
nearest (which ones, is not told apart); an empty table gives no rows; further
columns are left alone; texts of any length count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.storage import materialize
from quarry.llm.words import word_count

HASH_BITS, LEVEL_BITS = 60, 12
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: The most rows of per-source figures that are broadcast; beyond, the join is an ordinary one.
BROADCAST_SOURCES = 10_000


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 sum of the id and the text's MD5 sum."""
    sum_ = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), sum_).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """From ``source, source_size``: with ``target``, the level where shares by weight meet the caps.

    Sources reach their caps in the order of cap / weight.  Behind each number of
    capped sources, what is left over divided by the weights left over rises as
    long as the next source is to be capped and falls afterwards, so the level
    is its maximum.  One row per source, so one task is enough.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("w", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = ranked.withColumn("level", left.cast("double") / F.sum("w").over(rest))
    return levels.withColumn("level", F.max("level").over(everything)).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target")
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _thresholds(sized: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """``plan`` with ``threshold``: hashes below it are given once more, and of the ``rows`` that have it, ``quota``."""
    wanted = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    #: prefix: the hash bits known so far; below: the words under that prefix.
    none = F.lit(None).cast("long")
    state = plan.withColumns({"rest": F.when(F.col("source_size") > 0, wanted).otherwise(0.0), "prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "threshold": none, "rows": none, "quota": none})
    state = materialize(state, "mix-state")
    for known in range(0, HASH_BITS, LEVEL_BITS):
        shift = HASH_BITS - known - LEVEL_BITS
        open_ = state.filter(F.col("threshold").isNull()).select(F.col("source").alias("s"), "rest", "prefix", "below")
        inside = sized.join(_small(open_, n_sources), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", HASH_BITS - known) == F.col("prefix")))
        buckets = inside.groupBy("s", "rest", "below", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"), F.count("*").alias("rows")
        )
        running = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        buckets = buckets.withColumn("upto", F.col("below") + F.sum("words").over(running))
        boundary = buckets.filter(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min_by(F.struct("bucket", "upto", "words", "first", "last", "rows"), "bucket").alias("b"))
        start = F.col("b.upto") - F.col("b.words")
        # The last row whose words bring the sum nearer to the budget, of rows of one size.
        nearest = F.ceil((F.col("rest") - start) * F.col("b.rows") / F.col("b.words") + 0.5) - 1
        alone = F.col("b.first") == F.col("b.last")
        state = state.join(boundary, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "rest", F.coalesce("b.bucket", "prefix").alias("prefix"), F.coalesce(start, F.col("below")).alias("below"),
            F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(F.col("b").isNull(), F.lit(1 << HASH_BITS)).when(alone, F.col("b.first")).alias("threshold"),
            F.when(F.col("threshold").isNotNull(), F.col("rows")).when(alone, F.col("b.rows")).alias("rows"),
            F.when(F.col("threshold").isNotNull(), F.col("quota")).when(alone, F.greatest(F.lit(0), F.least(F.col("b.rows"), nearest))).alias("quota"),
        )
        state = materialize(state, "mix-state")
        if state.filter(F.col("threshold").isNull()).isEmpty():
            break
    return state


def _nth(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, from 1 by source, numbered by the tasks that read them so that no source is one group."""
    at = materialize(rows.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "mix-ties")
    before = W.partitionBy("s").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = at.groupBy("s", "_task").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(W.partitionBy("s", "_task").orderBy("_at"))
    same = F.col("at.s").eqNullSafe(F.col("starts.s")) & (F.col("at._task") == F.col("starts._task"))
    joined = at.withColumn("_within", within).alias("at").join(starts.alias("starts"), same)
    return joined.select("at.*", (F.col("_start") + F.col("_within")).alias("nth")).drop("_task", "_at", "_within")


def _epochs(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``rows`` (which have source and hash) with source_size, target and epochs, by the sizes in ``sized``."""
    plan = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-targets")
    n_sources = plan.count()
    limits = _thresholds(sized, plan, n_sources)
    # Rows of one hash, of which only a part is taken; most tables have none.
    partly = F.coalesce((F.col("quota") > 0) & (F.col("quota") < F.col("rows")), F.lit(False))
    state = limits.select(F.col("source").alias("s"), "source_size", "target", "threshold", "quota", partly.alias("partly"))
    joined = rows.join(_small(state, n_sources), F.col("source").eqNullSafe(F.col("s")))
    tied = F.col("partly") & (F.col("hash") == F.col("threshold"))
    known = joined.withColumn("nth", F.lit(1).cast("long"))
    if not limits.filter(partly).isEmpty():
        known = known.filter(~tied).unionByName(_nth(joined.filter(tied)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    more = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & (F.col("nth") <= F.col("quota")))
    epochs = F.least(F.lit(max_epochs), whole + F.coalesce(more, F.lit(False)).cast("int")).cast("int")
    return known.withColumn("epochs", epochs).drop("s", "threshold", "quota", "partly", "nth")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and hash of each document, written once."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("hash")), "mix-sizes")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each document."""
    sized = sized_documents(docs)
    mixed = _epochs(sized, sized, weights, max_epochs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """The mixture itself: each row of ``docs`` as many times as the mix takes it.

    The hash depends on the row alone, so thresholds are joined beside the text
    and no wide row is shuffled.
    """
    held = docs.select(F.struct(*docs.columns).alias("row"), "source", hash60(F.col("doc_id"), F.col("text")).alias("hash"))
    taken = _epochs(held, sized_documents(docs), weights, max_epochs).filter(F.col("epochs") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("row.*")
