"""Evaluation of rankings: metrics, recall, thresholds, samples and failures."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import scores as S
from quarry.functions import text as T


def score_rows(golden: DataFrame, ranking: DataFrame) -> DataFrame:
    """Per golden row: best rank of any accepted document, and the top score.

    ``golden`` has query_id and ``accepted`` (an array of doc ids); ``ranking`` is
    (query_id, doc_id, score, rank).
    """
    wanted = golden.select("query_id", F.explode("accepted").alias("doc_id")).distinct()
    best = ranking.join(wanted, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    top = ranking.where("rank = 1").select("query_id", F.col("score").alias("top1"))
    return golden.join(best, "query_id", "left").join(top, "query_id", "left")


def metrics(rank: str = "rank", top: str = "top1", error: Column | None = None) -> list[Column]:
    """n, errors, p1, p3, mrr, mean_top1 and above_floor; errors leave the denominator, which is at least 1."""
    bad = error if error is not None else F.lit(False)
    good = F.greatest(F.count("*") - F.count_if(bad), F.lit(1)).cast("double")
    share = lambda x: F.round(F.coalesce(F.sum(F.when(~bad, x)), F.lit(0.0)) / good, 6)
    r = F.col(rank)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        F.count("*").alias("n"), F.count_if(bad).alias("errors"), share(flag(r <= 1)).alias("p1"), share(flag(r <= 3)).alias("p3"), share(S.reciprocal(r)).alias("mrr"),
        share(F.coalesce(F.col(top), F.lit(0.0))).alias("mean_top1"), share(flag(F.col(top) >= rules.SCORE_FLOOR)).alias("above_floor"),
    ]


def by_dimensions(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Metrics overall and by each dimension, in one pass: (dimension, value, ...)."""
    sets = rows.groupingSets([[], *([d] for d in dimensions)], *dimensions)
    out = sets.agg(*(F.grouping(d).alias(f"_{d}") for d in dimensions), *metrics())
    name = T.first_match([(F.col(f"_{d}") == 0, d) for d in dimensions], F.lit("overall"))
    value = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")) for d in dimensions))
    return out.select(name.alias("dimension"), value.alias("value"), "n", "errors", "p1", "p3", "mrr", "mean_top1", "above_floor")


def recall_at(rows: DataFrame, ks: Sequence[int], *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 6).alias(f"recall_{k}") for k in ks))


def gate(metric: Column, locked: float = rules.GATE_P1) -> Column:
    return F.round(metric, 3) >= locked


def threshold_sweep(rows: DataFrame, score: Column, correct: Column, thresholds: Sequence[float] = tuple(rules.THRESHOLDS)) -> DataFrame:
    """For each threshold: how many right and wrong rows it admits, and the precision (null if none)."""
    flat = rows.select(score.alias("s"), correct.alias("ok"))
    each = flat.select("ok", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("s") >= t)).alias("threshold"))
    admitted = each.groupBy("threshold").agg(F.count_if("ok").alias("tp"), F.count_if(~F.col("ok")).alias("fp"))
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    out = every.join(admitted, "threshold", "left").na.fill(0, ["tp", "fp"])
    return out.withColumn("precision", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)).cast("double"), 3))


def floor_percentile(rows: DataFrame, score: str, *by: str, at: float = rules.FLOOR_PERCENTILE) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.percentile(score, at), 6).alias("floor"))


def hash_order(key: str, seed: int) -> list[Column]:
    """A fixed shuffle that other engines can repeat."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def stratified_sample(rows: DataFrame, key: str, source: str, strand: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """Round-robin over strands within each source, up to the source's quota.

    A row of wave w has w - 1 rows of its strand before it, so no wave beyond the
    largest quota is ever taken, and groups are cut to it before they meet.
    """
    wave = F.row_number().over(W.partitionBy(source, strand).orderBy(*hash_order(key, seed)))
    place = F.row_number().over(W.partitionBy(source).orderBy("wave", strand, key))
    quota = T.first_match([(F.col(source) == s, str(n)) for s, n in quotas.items()], F.lit("0")).cast("int")
    few = rows.withColumn("wave", wave).where(F.col("wave") <= max(quotas.values()))
    return few.withColumn("place", place).where(F.col("place") <= quota)


def round_robin(rows: DataFrame, stratum: str, order: Sequence[str], n: int) -> DataFrame:
    """``n`` rows, one of each stratum in turn, in order within it, until all are picked or strata run out.

    A row of wave w has w - 1 rows of its stratum before it.  Strata are cut to n rows
    where they are read, and the first n by (wave, stratum) are found in each task
    before they meet.
    """
    wave = F.row_number().over(W.partitionBy(stratum).orderBy(*order))
    few = rows.withColumn("wave", wave).where(F.col("wave") <= n)
    return few.orderBy("wave", F.asc_nulls_last(stratum)).limit(n)


def sample_per_group(rows: DataFrame, key: str, group: str, n: int, seed: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*hash_order(key, seed)))).where(F.col("place") <= n)


def token_frequency(docs: DataFrame, key: str, tokens: Column, wanted: DataFrame | None = None) -> DataFrame:
    """In how many documents, one a row, each token is; of all tokens, or of the ``wanted`` ones (token) if few are asked for."""
    each = docs.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    each = each if wanted is None else each.join(wanted, "token", "left_semi")
    # A document has each of its tokens once.
    return each.groupBy("token").agg(F.count("*").alias("n_docs"))


def failure_bucket(overlap_top: Column, overlap_expected: Column, distinctive: Column, in_top5: Column, expected_strand: Column, top_strand: Column, common: Column) -> Column:
    """E defect, D not retrieved, A same strand, B other strand, C similar slug, F rest; in this order."""
    known = expected_strand.isNotNull() & top_strand.isNotNull()
    return T.first_match(
        [
            (((overlap_top >= rules.OVERLAP) | (distinctive >= 1)) & (overlap_expected == 0), "E"),
            (~in_top5, "D"),
            (known & (expected_strand == top_strand), "A"),
            (known, "B"),
            (common >= rules.COMMON_SUBSTRING, "C"),
        ],
        F.lit("F"),
    )


def failure_evidence(rows: DataFrame, slugs: DataFrame, strands: Sequence[str], question: Column) -> DataFrame:
    """``rows`` of (query_id, expected_slug, top_slug, in_top5) with the bucket of each miss and what it rests on.

    ``slugs`` are all slugs of the corpus; words of a slug that few of them have are
    distinctive.  Slugs may be null (nothing found) or repeat; a hit has no bucket.
    """
    token = lambda name: T.slug_tokens(F.col(name), strands)
    marked = rows.withColumns(
        {
            "expected_strand": T.strand_by_prefix(F.col("expected_slug"), strands), "top_strand": T.strand_by_prefix(F.col("top_slug"), strands),
            "shared_top": F.array_sort(F.array_intersect(T.content_tokens(question, 4, rules.QUESTION_STOPWORDS), token("top_slug"))),
            "shared_expected": F.array_sort(F.array_intersect(T.content_tokens(question, 4, rules.QUESTION_STOPWORDS), token("expected_slug"))),
        }
    )
    common = token_frequency(slugs.distinct(), "slug", token("slug")).where(F.col("n_docs") > rules.DISTINCTIVE_DF)
    usual = marked.select("query_id", F.explode("shared_top").alias("token")).join(common, "token").groupBy("query_id").agg(F.collect_set("token").alias("usual"))
    found = marked.join(usual, "query_id", "left").withColumn("distinctive", F.array_except("shared_top", F.coalesce("usual", F.array().cast("array<string>")))).drop("usual")
    found = found.withColumn("common_length", common_substring(F.col("expected_slug"), F.col("top_slug")))
    bucket = failure_bucket(F.size("shared_top"), F.size("shared_expected"), F.size("distinctive"), F.col("in_top5"), F.col("expected_strand"), F.col("top_strand"), F.col("common_length"))
    return found.withColumn("bucket", F.when(~F.col("expected_slug").eqNullSafe(F.col("top_slug")), bucket))


def _longest(x: str | None, y: str | None) -> int:
    """By halving: whether some run of n characters is in both falls from true to false."""
    x, y = (x or "").lower(), (y or "").lower()
    low, high = 0, min(len(x), len(y))
    while low < high:
        n = (low + high + 1) // 2
        have = {x[i : i + n] for i in range(len(x) - n + 1)}
        low, high = (n, high) if any(y[i : i + n] in have for i in range(len(y) - n + 1)) else (low, n - 1)
    return low


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring, without regard to case."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_longest(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return F.pandas_udf(run, "int")(a, b)


def contingency(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(str(v)) for v in values), F.lit(0))
    return counts.withColumn("total", total)
