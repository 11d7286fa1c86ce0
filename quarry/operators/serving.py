"""What surrounds an answer: gates before it, routing, evidence, prompts, events, costs and audits."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import text as T
from quarry.operators.reports import fixed


def spam_reason(honeypot: Column, dwell: Column, agent: Column, tier: Column, bots: Sequence[str]) -> Column:
    """Why a request is taken for a bot's, or null; dwell time and agent count for anonymous ones."""
    ua, anonymous = F.lower(F.trim(F.coalesce(agent, F.lit("")))), tier == "anonymous"
    short = dwell.isNotNull() & (F.coalesce(dwell.try_cast("int"), F.lit(0)) < rules.DWELL_MS)
    return T.first_match([(F.coalesce(honeypot, F.lit("")) != "", "honeypot"), (anonymous & short, "dwell_too_short"), (anonymous & (ua == ""), "empty_ua"), (anonymous & T.any_of([ua.startswith(b.lower()) for b in bots]), "bot_ua")])


def anchored(query: Column, slug: Column, title: Column, score: Column) -> Column:
    """Whether the first hit names a content word of the question, or the question one of its slug's."""
    words = lambda c: F.array_except(F.filter(T.tokens(c), lambda w: F.length(w) >= rules.ANCHOR_LENGTH), F.array(*map(F.lit, rules.ANCHOR_STOPWORDS)))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    asked = F.exists(words(query), lambda w: F.contains(low(slug), w) | F.contains(low(title), w))
    return F.coalesce((score >= rules.ANCHOR_FLOOR) & (asked | F.exists(words(slug), lambda w: F.contains(low(query), w))), F.lit(False))


def guarded(route: Column, n_chunks: Column, top: Column, anchor: Column) -> Column:
    """Whether evidence is too weak for an answer."""
    return (route != "analytical") & ((n_chunks == 0) | (F.coalesce(top, F.lit(0.0)) < rules.SCORE_FLOOR)) & ~anchor


def wants_figure(route: Column, query: Column, answer: Column, slug: Column) -> Column:
    """Whether a figure may help: the words say so, or the first tutorial is of a graph-shaped strand."""
    worded = T.matches_any(F.concat_ws("\n", query, answer), rules.GRAPH_PATTERNS)
    return (route != "analytical") & (worded | T.any_of([F.coalesce(slug, F.lit("")).startswith(p) for p in rules.GRAPH_PREFIXES]))


def model_route(route: Column, top: Column, breaker_open: Column) -> Column:
    """Which kind of model answers: the analyst, the cheap one for well-covered concepts, else the hosted one."""
    covered = route.isin("concept", "summary_request") & (top >= rules.SCORE_FLOOR)
    return F.when(route == "analytical", "analyst").when(breaker_open | covered, "warehouse").otherwise("small")


def cost_eur(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Of a call: by tokens or flat; unknown models cost the fallback."""
    def one(name: str) -> Column:
        a, b, flat = rules.PRICES[name]
        usd = F.lit(flat) if flat is not None else tokens_in / 1e6 * a + tokens_out / 1e6 * b
        return usd * rules.EUR_PER_USD

    return reduce(lambda out, n: F.when(model == n, one(n)).otherwise(out), rules.PRICES, F.lit(rules.FALLBACK_EUR))


def shape_hits(ranking: DataFrame, texts: DataFrame, surface: str) -> DataFrame:
    """A surface's hits with their snippets."""
    return ranking.join(texts, "doc_id").select("query_id", "rank", "doc_id", "score", F.lit(surface).alias("surface"), T.shorten(F.col("text"), rules.SNIPPETS[surface]).alias("snippet"))


def fan_out(queries: DataFrame, surfaces: dict[str, Callable[[DataFrame], DataFrame]], routes: dict[str, Sequence[str]]) -> DataFrame:
    """Each surface answers, once and for the whole batch, the questions of the routes that use it."""
    parts = []
    for surface, answer in surfaces.items():
        mine = [r for r, uses in routes.items() if surface in uses]
        parts.append(answer(queries.where(F.col("route").isin(mine))).withColumn("surface", F.lit(surface)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, prompt): question, route, and up to four chunks with their scores."""
    first = hits.where(F.col("rank") <= rules.EVIDENCE_CHUNKS)
    line = F.concat(F.lit("- ["), F.col("doc_id").cast("string"), F.lit("] (score="), fixed(F.col("score"), 2), F.lit("): "), "snippet")
    chunks = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("c"))
    lines = F.transform(F.coalesce("c", F.array().cast("array<struct<rank:int,line:string>>")), lambda x: x.line)
    head = F.array(F.concat(F.lit("Question: "), F.trim("text")), F.lit(""), F.concat(F.lit("Routing decision: "), "route"))
    evidence = F.when(F.size(lines) > 0, F.concat(F.array(F.lit(""), F.lit("Evidence chunks (cite by slug):")), lines)).otherwise(F.array().cast("array<string>"))
    return queries.join(chunks, "query_id", "left").select("query_id", F.array_join(F.concat(head, evidence), "\n").alias("prompt"))


def answer_events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event, data): tokens of the answer, then citations, then done; a guarded or cached answer is one token."""
    pieces = F.when(F.col("single"), F.array("answer")).otherwise(F.regexp_extract_all("answer", F.lit(r"(\S+\s*|\s+)"), F.lit(1)))
    event = lambda kind, data: F.struct(F.lit(kind).alias("event"), data.alias("data"))
    events = F.concat(F.transform(pieces, lambda p: event("token", p)), F.transform(F.slice("citations", 1, 5), lambda s: event("citation", s)), F.array(event("done", F.lit(""))))
    return answers.select("query_id", F.posexplode(events).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")


def pick_one(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def first_references(hits: DataFrame, references: str, k: int = 5) -> DataFrame:
    """Each query's references in the order of its hits, each once, at most k."""
    each = hits.select("query_id", "rank", F.posexplode(references).alias("i", "slug"))
    firsts = each.groupBy("query_id", "slug").agg(F.min(F.struct("rank", "i")).alias("at"))
    return firsts.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("at"))).where(F.col("place") <= k).drop("at")


def against_baseline(metrics: DataFrame, baseline: DataFrame, key: str, margin: float = 0.05) -> DataFrame:
    """p1 beside the baseline's, their difference, and whether it fell by more than the margin."""
    joined = metrics.join(baseline.select(key, F.col("p1").alias("base_p1")), key, "left")
    return joined.withColumn("delta", F.round(F.col("p1") - F.col("base_p1"), 6)).withColumn("regressed", F.coalesce(F.col("delta") < -margin, F.lit(False)))


def rewrite_bound(rows: DataFrame) -> DataFrame:
    """P@1 if every fired rewrite that is wrong became right."""
    right = F.coalesce(F.col("rank") == 1, F.lit(False))
    return rows.agg(F.round((F.count_if(right) + F.count_if(F.col("fired") & ~right)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("upper_bound"))


def audit(runs: DataFrame) -> DataFrame:
    """Rows written by the loaders that succeeded, time of all, and what failed."""
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    failed = F.array_sort(F.collect_list(F.when(~ok, F.col("loader"))))
    return runs.agg(total("inserted").alias("rows_inserted"), total("updated").alias("rows_updated"), F.sum("duration_ms").alias("duration_ms"), F.when(F.size(failed) > 0, F.concat(F.lit("FAILURES: "), F.array_join(failed, ", "))).otherwise("").alias("notes"))


def spans(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Milliseconds between the start and end events of a span."""
    at = lambda kind: F.min(F.when(F.col("phase") == kind, F.unix_micros(F.col("ts").cast("timestamp"))))
    return events.groupBy(*by).agg(((at("end") - at("start")) / 1000).alias("ms"))


def tool_call(answer: Column, schema: str) -> Column:
    """The JSON of a tool call, in a code fence or not; null for anything else."""
    bare = F.regexp_replace(F.trim(answer), r"(?s)^```[a-z]*\s*|\s*```$", "")
    return F.when(bare.rlike(r"(?s)^\{.*\}$"), F.from_json(bare, schema))


def _leaves(document: str | None) -> list[dict[str, str]]:
    """(path, value) of each string in a JSON document, at any depth; none for what is no JSON."""
    try:
        found, open_ = [], [("", json.loads(document))] if document is not None else []
    except (ValueError, RecursionError):
        return []
    while open_:
        path, value = open_.pop()
        if isinstance(value, dict):
            open_ += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        elif isinstance(value, list):
            open_ += [(f"{path}[{i}]", v) for i, v in enumerate(value)]
        elif isinstance(value, str):
            found.append({"path": path, "value": value})
    return found


def placeholder_paths(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value) of each placeholder in a JSON document, however deep it lies; each document is read once."""

    def run(documents: pd.Series) -> pd.Series:
        return pd.Series([_leaves(d) for d in documents])

    leaves = F.pandas_udf(run, "array<struct<path: string, value: string>>")(document)
    each = rows.select(key, F.explode(leaves).alias("leaf")).select(key, "leaf.path", "leaf.value")
    return each.where(T.is_placeholder(F.col("value")))
