"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into blocks by a hash.  For each block, how many of its rows go to each
shard is drawn from the multivariate hypergeometric law, so the counts are those
of a uniformly random permutation and every shard gets exactly its size.  Rows are
then permuted within their block, dealt by the drawn counts, exchanged, and
permuted again within their shard.  Rows are handled by DataFrame expressions and
windows only.

A block has some BLOCK_ROWS rows, however many there are in all.  The driver draws
the counts of at most MOST_GROUPS groups of blocks; a larger matrix goes on from
there in Spark: each group's counts are split between its halves, again and again,
by the same law written as column expressions, until every block has its own.
Windows run over blocks and over hash ranges of a shard, so no task grows with
the table.

Every row has a number (its place in the written table of sizes), which takes part
in all hashes: equal rows, and rows of null ids, spread like any others.

Defined cases: a null text has no bytes (size 8, crc32 of nothing); texts of any
length count by their bytes; null or repeated ids and repeated rows are dealt each
on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.storage import materialize
from quarry.llm.words import let

#: Rows of a block; groups of blocks for which the driver draws.
BLOCK_ROWS, MOST_GROUPS = 4096, 4096
#: Rows of a hash range of a shard.
RANGE_ROWS = 16384
#: The largest matrix, in bytes, that is broadcast.
BROADCAST_BYTES = 8 << 20


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good, by inversion outward from the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    up = down = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    left, right, u = mode, mode, rng.random() - up
    while u > 0 and (left > low or right < high):
        if right < high:
            up *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
            right += 1
            if (u := u - up) <= 0:
                return right
        if left > low:
            down *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
            left -= 1
            if (u := u - down) <= 0:
                return left
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts [block][shard] whose rows sum to ``blocks`` and columns to ``shards``."""
    rng, room, out = random.Random(seed), list(shards), []
    for n in blocks:
        rest, row = sum(room), []
        for k, good in enumerate(room):
            rest -= good
            got = hypergeometric(rng, good, rest, n)
            row.append(got)
            room[k] -= got
            n -= got
        out.append(row)
    return out


def log_factorial(n: Column) -> Column:
    """By a table up to 15, then by Stirling's series (an error below 1e-11)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    small = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16)))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


def hypergeometric_column(good: Column, bad: Column, n: Column, u: Column) -> Column:
    """How many of ``n`` draws without replacement are good: the least count whose distribution function reaches ``u``.

    Counts further than 12 deviations from the mean are left out; all of them
    together are less likely than a double can tell from 0.
    """
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    low, high, total = F.greatest(F.lit(0).cast("long"), n - bad), F.least(n, good), (good + bad).cast("double")
    mean = n * good / F.greatest(total, F.lit(1.0))
    spread = 12 * F.sqrt(mean * bad / F.greatest(total, F.lit(1.0))) + 12
    first, last = F.greatest(low, F.floor(mean - spread)), F.least(high, F.ceil(mean + spread))

    def pick(whole: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("long").alias("k"))

        def add(acc: Column, k: Column) -> Column:
            upto = acc.upto + F.exp(choose(good, k) + choose(bad, n - k) - whole)
            return F.struct(upto.alias("upto"), F.when(acc.k.isNull() & (upto >= u), k).otherwise(acc.k).alias("k"))

        return F.aggregate(F.sequence(first, last), start, add, lambda acc: F.coalesce(acc.k, last))

    return F.when(low == high, low).otherwise(let(choose(good + bad, n), pick))


def split_counts(counts: Column, n: Column, n_shards: int, key: Column) -> Column:
    """Of ``counts`` by shard, those of ``n`` rows drawn without replacement."""
    start = F.struct(n.alias("n"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b).alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def add(acc: Column, k: Column) -> Column:
        good = F.get(counts, k)
        u = F.shiftrightunsigned(F.xxhash64(key, k), 11) / float(1 << 53)
        return let(
            hypergeometric_column(good, acc.rest - good, acc.n, u),
            lambda got: F.struct((acc.n - got).alias("n"), (acc.rest - good).alias("rest"), F.array_append(acc.out, got).alias("out")),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(n_shards - 1)), start, add, lambda acc: acc.out)


def block_counts(sizes: DataFrame, groups: DataFrame, depth: int, n_shards: int, seed: int) -> DataFrame:
    """(_block, _counts): from ``groups`` (_node, _counts) of 2^depth blocks each, and the blocks' ``sizes`` (_block, _n)."""
    state = groups
    for level in range(depth):
        child = F.shiftright("_block", depth - level - 1)
        left = sizes.filter(child % 2 == 0).groupBy(F.shiftright(child, 1).alias("_node")).agg(F.sum("_n").alias("_n"))
        drawn = split_counts(F.col("_counts"), F.coalesce("_n", F.lit(0)).cast("long"), n_shards, F.concat_ws("/", F.lit(f"{seed}/{level}"), F.col("_node")))
        halves = state.join(left, "_node", "left").select("_node", "_counts", drawn.alias("_left"))
        others = F.zip_with("_counts", "_left", lambda a, b: a - b)
        both = F.array(F.struct((2 * F.col("_node")).alias("_node"), F.col("_left").alias("_counts")), F.struct((2 * F.col("_node") + 1).alias("_node"), others.alias("_counts")))
        state = materialize(halves.select(F.inline(both)), "shard-counts")
    return state.withColumnRenamed("_node", "_block")


def equal_sizes(rows: int, n_shards: int) -> list[int]:
    """Shard sizes at most one apart."""
    return [rows // n_shards + (k < rows % n_shards) for k in range(n_shards)]


def _small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A driver-side table as one JSON literal, which the JVM parses."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _range_of(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def assign(rows: DataFrame, n_shards: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Rows should be narrow (an id, a size, a digest): they pass through two
    exchanges.  They are numbered and written first, so that lost executors
    change no draw.
    """
    spark, cols = rows.sparkSession, rows.columns
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "sizes")
    n = rows.count()
    depth = max(0, math.ceil(math.log2(max(1, n / BLOCK_ROWS / MOST_GROUPS))))
    n_groups = max(1, math.ceil(n / BLOCK_ROWS / (1 << depth)))
    draw = lambda k: F.xxhash64(F.lit(f"{seed}/{k}"), "_at", *cols)
    blocked = rows.withColumns({"_block": F.pmod(draw("block"), F.lit(n_groups << depth)), "_first": draw("first")})
    sizes = materialize(blocked.groupBy("_block").agg(F.count("*").alias("_n")), "block-sizes")
    of_group = {r["g"]: r["n"] for r in sizes.groupBy(F.shiftright("_block", depth).alias("g")).agg(F.sum("_n").alias("n")).collect()}
    matrix = communication_matrix([of_group.get(g, 0) for g in range(n_groups)], equal_sizes(n, n_shards), seed)
    groups = _small_table(spark, [{"_node": g, "_counts": row} for g, row in enumerate(matrix)], "_node bigint, _counts array<bigint>")
    upto = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda k: F.aggregate(F.slice("_counts", 1, k), F.lit(0).cast("long"), lambda a, b: a + b))
    dealt_by = block_counts(sizes, groups, depth, n_shards, seed).select("_block", upto.alias("_upto"))
    if (n_groups << depth) * n_shards * 8 <= BROADCAST_BYTES:
        dealt_by = F.broadcast(dealt_by)
    place = F.row_number().over(W.partitionBy("_block").orderBy("_first", "_at"))
    dealt = blocked.withColumn("_place", place).join(dealt_by, "_block")
    bits = max(0, math.ceil(math.log2(max(1, n / n_shards / RANGE_ROWS))))
    dealt = dealt.select(*cols, "_at", F.size(F.filter("_upto", lambda b: b < F.col("_place"))).alias("shard"), draw("second").alias("_second"))
    dealt = materialize(dealt.withColumn("_range", _range_of(F.col("_second"), bits)), "shards")
    before = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(W.partitionBy("shard", "_range").orderBy("_second", "_at"))
    slot = (F.col("_start") + F.col("_within") - 1).cast("long")
    return dealt.withColumn("_within", within).join(starts.drop("_n"), ["shard", "_range"]).select(*cols, "shard", slot.alias("slot"))


def shuffle_documents(docs: DataFrame, n_shards: int, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return assign(slim, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
