"""What is written about runs: reports, inspections, replays, log rows, and plans of loaders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import text as T
from quarry.operators import evaluation as E


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 on with so many decimals, halves up, as every engine gives it."""
    n = F.floor(x * 10**digits + 0.5).cast("long")
    return F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def outcome_means(rows: DataFrame, *by: str) -> DataFrame:
    """Mean top scores of right and wrong rows; null where there are none."""
    right = F.coalesce(F.col("rank") == 1, F.lit(False))
    mean = lambda test: F.round(F.avg(F.when(test, F.col("top1"))), 6)
    return rows.groupBy(*by).agg(F.count_if(right).alias("n_right"), F.count_if(~right).alias("n_wrong"), mean(right).alias("mean_right"), mean(~right).alias("mean_wrong"))


def misses(rows: DataFrame, source: Column, metric: Column, wanted: str = "phrasings") -> DataFrame:
    """Rows of a source whose metric, in whatever way it was written, is 0."""
    return rows.where((source == wanted) & (F.coalesce(metric.try_cast("double"), F.lit(0.0)) == 0))


def report(rows: DataFrame, dimensions: Sequence[str], baseline: float = rules.GATE_P1) -> DataFrame:
    """(section, name, body): the overall metrics, the gate, and each value of each dimension, as JSON objects."""
    every = E.by_dimensions(rows, dimensions)
    metric = F.struct("n", "errors", "p1", "p3", "mrr")
    parts = every.select(F.concat(F.when(F.col("dimension") == "overall", "").otherwise("by_"), "dimension").alias("section"), F.coalesce("value", F.lit("")).alias("name"), F.to_json(metric).alias("body"))
    delta = F.round(F.col("p1") - baseline, 6)
    gate = every.where("dimension = 'overall'").select(F.lit("gate").alias("section"), F.lit("").alias("name"), F.to_json(F.struct(F.col("p1"), delta.alias("delta"), E.gate(F.col("p1"), baseline).alias("pass"))).alias("body"))
    return parts.unionByName(gate)


def markdown_table(rows: DataFrame, order: Sequence[Column], **columns: Column) -> DataFrame:
    """(line, text) of a table: a head, a rule, and a line for each of some few rows."""
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.row_number().over(W.orderBy(*order)) + 2).alias("line"), bar(columns.values()).alias("text"))
    heads = [(1, f"| {' | '.join(columns)} |"), (2, f"|{' --- |' * len(columns)}")]
    return rows.sparkSession.createDataFrame(heads, "line int, text string").unionByName(body)


def write_report(lines: DataFrame, path: str) -> None:
    """Lines in their order, as one text file."""
    lines.coalesce(1).sortWithinPartitions("line").select("text").write.mode("overwrite").text(path)


# Columns of a file of results.
RESULT_COLUMNS = ["eval_id", "source", "difficulty", "expected_slug", "topic", "rank", "precision@1", "recall@5", "mrr", "service_used", "top_k_slugs", "error"]


def result_rows(rows: DataFrame, hits: DataFrame, k: int = 5, **values: Column) -> DataFrame:
    """Rows of a file of results, all text, from scored rows (query_id, rank) and their hits; what is not known is empty."""
    place = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"))))
    tops = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_join(F.transform(place, lambda x: x.doc_id), ",").alias("_top"))
    within = lambda n: F.when(F.coalesce(F.col("rank") <= n, F.lit(False)), 1).otherwise(0)
    known = {"rank": F.col("rank"), "precision@1": within(1), "recall@5": within(5), "mrr": fixed(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 4), "top_k_slugs": F.col("_top"), **values}
    return rows.join(tops, "query_id", "left").select(*(F.coalesce(known.get(n, F.lit(None)).cast("string"), F.lit("")).alias(n) for n in RESULT_COLUMNS))


def write_csv(rows: DataFrame, path: str) -> None:
    """As CSV with heads and doubled quotes, as many files as there are partitions."""
    rows.write.csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """What ``write_csv`` wrote, as text; values may hold line ends."""
    found = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in columns), header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return found.select(*(F.coalesce(f"`{n}`", F.lit("")).alias(n) for n in columns))


def inspect(golden: DataFrame, rankings: Mapping[str, DataFrame], accepted: DataFrame) -> DataFrame:
    """Every hit of some golden rows, with its score in each ranking and the rank of what was expected.

    The first ranking is the one that was served.  ``accepted`` has query_id and
    doc_id of all documents that would have been right.
    """
    served, *_ = rankings
    parts = [r.select("query_id", "doc_id", "score", "rank", F.lit(n).alias("of")) for n, r in rankings.items()]
    one = lambda n, what: F.max(F.when(F.col("of") == n, F.col(what)))
    hits = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(one(served, "rank").alias("rank"), *(one(n, "score").alias(n) for n in rankings))
    marked = hits.join(golden.select("query_id"), "query_id", "left_semi").join(accepted.select("query_id", "doc_id", F.lit(True).alias("expected")), ["query_id", "doc_id"], "left")
    expected = F.coalesce("expected", F.lit(False))
    return marked.select("query_id", "doc_id", "rank", *rankings, expected.alias("expected"), F.min(F.when(expected, F.col("rank"))).over(W.partitionBy("query_id")).alias("expected_rank"))


def covered(golden: DataFrame, checkpoint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The golden rows that a checkpoint of rankings answers, and those it lacks."""
    known = checkpoint.select("query_id").distinct()
    return golden.join(known, "query_id", "left_semi"), golden.join(known, "query_id", "left_anti")


QUERY_LOG = (
    "query_id string, user_id string, q string, tier string, query_type string, query_class string, model_used string, top_slug string, "
    "top_reranker_score double, from_cache boolean, elapsed_ms long, cost_estimate_cents double, extracted_question string, image_bytes_size long, extraction_outcome string"
)


def log_rows(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows of the query log from what is known; an extracted question makes an image query, columns not given are null."""
    given = {"query_type": F.when(values.get("extracted_question", F.lit(None)).isNotNull(), "image").otherwise("text"), **values}
    fields = [f.split() for f in QUERY_LOG.split(", ")]
    return rows.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


def firewall_rows(breaches: DataFrame, event_id: Column, kind: str, subnet: Column, ip: Column) -> DataFrame:
    """Rows of the query log that stand for refused requests."""
    outcome = F.concat(F.lit(f"firewall_event_type={kind} subnet="), subnet, F.lit(" ip="), ip)
    none, nil = F.lit("(none)"), F.lit(0)
    return log_rows(
        breaches, query_id=F.concat(F.lit("firewall_event_"), event_id.cast("string")), user_id=F.lit("anonymous"), q=F.lit("(firewall_event)"), tier=F.lit("anonymous"), query_type=F.lit("firewall_event"),
        query_class=none, model_used=none, top_reranker_score=nil, from_cache=F.lit(False), elapsed_ms=nil, cost_estimate_cents=nil, extraction_outcome=outcome,
    )


def flushes(rows: DataFrame, ts: str, key: str, most: int = rules.SINK_ROWS, seconds: int = rules.SINK_SECONDS) -> DataFrame:
    """Rows with the flush that writes them: (window, part), full at ``most`` rows or when its window of time ends."""
    window = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    place = F.row_number().over(W.partitionBy("window").orderBy(ts, key)) - 1
    return rows.withColumn("window", window).withColumn("part", F.floor(place / most).cast("int"))


def amount_or_zero(wanted: DataFrame, amounts: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """The amount of each wanted key; 0 where nothing is recorded."""
    return wanted.join(amounts, list(keys), "left").withColumn(amount, F.coalesce(amount, F.lit(0.0)))


def flat_parameters(rows: DataFrame, scalars: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Scalars as they are, then arrays as JSON; an absent array is []."""
    empty = lambda c: F.array().cast(rows.schema[c].dataType)
    return rows.select(*scalars, *(F.to_json(F.coalesce(c, empty(c))).alias(c) for c in arrays))


def stitched(chunks: DataFrame, by: str, order: str, default: str = "en") -> DataFrame:
    """Chunks of transcripts as one: their durations summed, the first language, and their texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "language", F.trim("text").alias("text"))))
    one = chunks.groupBy(by).agg(F.sum("duration").alias("duration"), ordered.alias("c"))
    texts = F.filter(F.transform("c", lambda x: x.text), lambda x: x != "")
    languages = F.filter(F.transform("c", lambda x: x.language), lambda x: x.isNotNull())
    return one.select(by, "duration", F.coalesce(F.get(languages, F.lit(0)), F.lit(default)).alias("language"), F.array_join(texts, " ").alias("text"))


def voice_context(tops: DataFrame, strand: Column, summaries: DataFrame, voice: Column, cap: int = 12_000) -> DataFrame:
    """(query_id, strand, context): the summary of the first hit's strand in two thirds of the cap, the voice rules in the rest."""
    first = tops.where("rank = 1").select("query_id", strand.alias("strand"))
    joined = first.join(summaries.select("strand", F.col("text").alias("summary")), "strand", "left")
    share = 2 * cap // 3
    return joined.select("query_id", "strand", F.concat_ws("\n\n", T.cut_at_section(F.col("summary"), share), T.cut_at_section(voice, cap - share)).alias("context"))


#: Loaders in the order in which they depend on each other, and what stops a plan.
LOADERS = (("tutorials", "load_tutorials"), ("exam_solutions", "load_exam_parts"), ("summaries", "load_summaries"))


def loader_plan(changes: DataFrame, category: Column, by: str) -> DataFrame:
    """(by, loaders, stop): which loaders a set of changed files needs, in their order, and why a person has to look first."""
    has = lambda name: F.coalesce(F.bool_or(category == name), F.lit(False))
    loaders = F.array_compact(F.array(*(F.when(has(kind), loader) for kind, loader in LOADERS)))
    stop = F.array_compact(F.array(F.when(has("schema"), "schema"), F.when(has("loader_code"), "loader_code")))
    return changes.groupBy(by).agg(F.array_join(loaders, ",").alias("loaders"), F.array_join(stop, ",").alias("stop"))


def image_route(topic: Column, question: Column) -> tuple[Column, Column]:
    """The forced route of a question read from an image, and what is searched for: its topic, else the question."""
    return F.lit("image_extracted"), F.coalesce(F.nullif(F.trim(topic), F.lit("")), question)
