"""Registered queries: gates, routing, evidence, events, costs and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import text as T
from quarry.operators import evaluation as E
from quarry.operators import retrieval as V
from quarry.operators import serving as S
from quarry.plans.registry import Registry
from quarry.plans.retrieval_queries import _ANY_WORDS, _ITEMS, _ROWS, _bm25, _golden_rows, _items, bm25_ctes
from quarry.plans.text_queries import ROUTE_SQL, _matches

R = Registry()
c = F.col


@R.query(
    "anti_spam",
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'honeypot' WHEN anon AND dwell IS NOT NULL AND coalesce(try_cast(dwell AS INT), 0) < 1500 THEN 'dwell_too_short' WHEN anon AND ua = '' THEN 'empty_ua' WHEN anon AND ua LIKE 'curl%' THEN 'bot_ua' END AS reason "
    "FROM (SELECT *, user_id < 30 AS anon, CASE WHEN event_type = 'click' THEN (value * 100)::INT::VARCHAR END AS dwell, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'curl/8' ELSE 'browser' END AS ua FROM events)) GROUP BY 1",
)
def anti_spam(t) -> DataFrame:
    tier = F.when(c("user_id") < 30, "anonymous").otherwise("paying")
    dwell = F.when(c("event_type") == "click", F.round(c("value") * 100).cast("int").cast("string"))
    agent = F.when(c("user_id") % 3 == 0, "").when(c("user_id") % 3 == 1, "Curl/8").otherwise("browser")
    reason = S.spam_reason(F.when(c("event_type") == "error", "x"), dwell, agent, tier, ["curl"])
    return t.events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_FIG = _matches(rules.GRAPH_PATTERNS, "text")


@R.query("figure_trigger", f"SELECT conv_id, turn, {ROUTE_SQL} <> 'analytical' AND ({_FIG} OR conv_id % 7 = 0) AS wanted FROM conversations")
def figure_trigger(t) -> DataFrame:
    slug = F.when(c("conv_id") % 7 == 0, "statistics-3-x").otherwise("algebra-1-a")
    return t.conversations.select("conv_id", "turn", S.wants_figure(T.classify(c("text")), c("text"), F.lit(""), slug).alias("wanted"))


@R.query(
    "model_route",
    f"SELECT route, CASE WHEN route = 'analytical' THEN 'analyst' WHEN turn % 5 = 0 OR (route IN ('concept', 'summary_request') AND length(text) / 1000.0 >= 0.3) THEN 'warehouse' ELSE 'small' END AS model, count(*) AS n FROM (SELECT *, {ROUTE_SQL} AS route FROM conversations) GROUP BY 1, 2",
)
def model_route(t) -> DataFrame:
    rows = t.conversations.withColumn("route", T.classify(c("text")))
    return rows.groupBy("route", S.model_route(c("route"), F.length("text") / 1000.0, c("turn") % 5 == 0).alias("model")).agg(F.count("*").alias("n"))


@R.query(
    "call_costs",
    "SELECT role, round(sum(CASE role WHEN 'user' THEN (length(text) / 1e6 * 1.0 + 100 / 1e6 * 5.0) * 0.92 WHEN 'assistant' THEN 0.001 * 0.92 ELSE 0.0005 END), 6) AS eur FROM conversations GROUP BY 1",
)
def call_costs(t) -> DataFrame:
    model = F.when(c("role") == "user", "small").when(c("role") == "assistant", "analyst").otherwise("other")
    return t.conversations.groupBy("role").agg(F.round(F.sum(S.cost_eur(model, F.length("text"), F.lit(100))), 6).alias("eur"))


@R.query("slug_anchor", "WITH q AS (SELECT p_partkey, lower(p_type) AS q, replace(p_name, ' ', '-') AS slug, p_retailprice / 100000 AS score FROM part) SELECT p_partkey, coalesce(score >= 0.01 AND ((length(q) >= 4 AND contains(slug, q)) OR len([x FOR x IN string_split(slug, '-') IF length(x) >= 4 AND contains(q, x)]) > 0), false) AS anchored FROM q")
def slug_anchor(t) -> DataFrame:
    return t.part.select("p_partkey", S.anchored(F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(""), c("p_retailprice") / 100000).alias("anchored"))


@R.query(
    "answer_events",
    r"WITH w AS (SELECT conv_id * 1000 + turn AS query_id, CASE WHEN role = 'system' THEN [text] ELSE regexp_extract_all(text, '(\S+\s*|\s+)', 1) END AS p FROM conversations), e AS (SELECT query_id, list_concat([{'event': 'token', 'data': x} FOR x IN p], [{'event': 'citation', 'data': 'a-1'}, {'event': 'done', 'data': ''}]) AS e FROM w), "
    "u AS (SELECT query_id, (generate_subscripts(e, 1) - 1)::INT AS seq, unnest(e) AS e FROM e) SELECT query_id, seq, e.event AS event, e.data AS data FROM u",
)
def answer_events(t) -> DataFrame:
    answers = t.conversations.select((c("conv_id") * 1000 + c("turn")).alias("query_id"), c("text").alias("answer"), (c("role") == "system").alias("single"), F.array(F.lit("a-1")).alias("citations"))
    return S.answer_events(answers)


@R.query("rewrite_bound", _ROWS + "SELECT round((count(*) FILTER (WHERE coalesce(rank0 = 1, false)) + count(*) FILTER (WHERE label % 2 = 0 AND NOT coalesce(rank0 = 1, false)))::DOUBLE / greatest(count(*), 1), 6) AS upper_bound FROM g")
def rewrite_bound(t) -> DataFrame:
    return S.rewrite_bound(_golden_rows(t).withColumn("fired", c("label") % 2 == 0))


@R.query("against_baseline", _ROWS + "SELECT label, p1, 0.5::DOUBLE AS base_p1, round(p1 - 0.5, 6) AS delta, round(p1 - 0.5, 6) < -0.05 AS regressed FROM (SELECT label, round(avg((rank <= 1)::INT), 6) AS p1 FROM g GROUP BY 1)")
def against_baseline(t) -> DataFrame:
    metrics = _golden_rows(t).groupBy("label").agg(*E.metrics()).select("label", "p1")
    base = t.embeddings.select("label").distinct().withColumn("p1", F.lit(0.5))
    return S.against_baseline(metrics, base, "label")


@R.query("loader_audit", "SELECT sum(CASE WHEN p_type <> 'SMALL' THEN n ELSE 0 END)::BIGINT AS rows_inserted, sum(CASE WHEN p_type <> 'SMALL' THEN m ELSE 0 END)::BIGINT AS rows_updated, sum(n * 3)::BIGINT AS duration_ms, 'FAILURES: SMALL' AS notes FROM (SELECT p_type, count(*) AS n, count(*) FILTER (WHERE p_size > 20) AS m FROM part GROUP BY 1)")
def loader_audit(t) -> DataFrame:
    runs = t.part.groupBy(c("p_type").alias("loader")).agg(F.count("*").alias("inserted"), F.count_if(c("p_size") > 20).alias("updated"))
    return S.audit(runs.withColumns({"duration_ms": c("inserted") * 3, "status": F.when(c("loader") == "SMALL", "failed").otherwise("ok")}))


@R.query("span_ms", "SELECT user_id, round((min(epoch_us(ts)) FILTER (WHERE event_type = 'purchase') - min(epoch_us(ts)) FILTER (WHERE event_type = 'view')) / 1000.0, 3) AS ms FROM events GROUP BY 1")
def span_ms(t) -> DataFrame:
    phases = t.events.select("user_id", "ts", F.when(c("event_type") == "view", "start").when(c("event_type") == "purchase", "end").alias("phase"))
    return S.spans(phases, ["user_id"]).withColumn("ms", F.round("ms", 3))


@R.query("tool_call", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def tool_call(t) -> DataFrame:
    fenced = F.when(c("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(c("props"))
    return t.events.select("event_id", S.tool_call(fenced, "k long").k.alias("k"))


@R.query("pick_one", "SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def pick_one(t) -> DataFrame:
    return S.pick_one(t.documents.select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], [F.desc("n_chars"), c("doc_id")]).drop("n_chars")


#: Lines of orders in a task.
_TASK_LINES = 250_000


@R.query("first_references", "WITH e AS (SELECT l_orderkey AS query_id, l_partkey::VARCHAR AS slug, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2) SELECT query_id, slug, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, slug) AS place FROM e) WHERE place <= 5")
def first_references(t) -> DataFrame:
    # Orders meet once, so many lines in a task, and all that follows is done there.
    # Lines of one number are one hit, whose references are sorted.
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    tasks = max(-(-lines.count() // _TASK_LINES), t.spark.sparkContext.defaultParallelism)
    hits = lines.repartition(tasks, "l_orderkey").groupBy(c("l_orderkey").alias("query_id"), c("l_linenumber").alias("rank")).agg(F.array_sort(F.collect_set(c("l_partkey").cast("string"))).alias("refs"))
    return S.first_references(hits, "refs")


_EVIDENCE = "'- [' || pr.doc_id || '] (score=' || (floor(pr.score * 100 + 0.5)::BIGINT // 100) || '.' || lpad((floor(pr.score * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') || '): ' || CASE WHEN length(trim(d.text)) > 800 THEN rtrim(substr(trim(d.text), 1, 799)) || '…' ELSE trim(d.text) END"


@R.query(
    "prompts",
    f"WITH {bm25_ctes('p', _ITEMS)}, e AS (SELECT query_id, string_agg({_EVIDENCE}, chr(10) ORDER BY pr.rank) AS chunks FROM pr JOIN documents d USING (doc_id) WHERE pr.rank <= 4 GROUP BY 1) "
    f"SELECT item_id AS query_id, 'Question: ' || trim(text) || chr(10) || chr(10) || 'Routing decision: ' || {ROUTE_SQL} || coalesce(chr(10) || chr(10) || 'Evidence chunks (cite by slug):' || chr(10) || chunks, '') AS prompt FROM benchmark LEFT JOIN e ON query_id = item_id",
)
def prompts(t) -> DataFrame:
    hits = S.shape_hits(_bm25(t, 5), t.documents.select("doc_id", "text"), "summaries")
    return S.prompts(_items(t).withColumn("route", T.classify(c("text"))), hits)


@R.query(
    "fan_out",
    f"WITH {bm25_ctes('t', _ITEMS, "lang = 'en'", _ANY_WORDS)}, {bm25_ctes('s', _ITEMS + ' WHERE length(text) >= 200', "lang = 'de'", _ANY_WORDS)} "
    "SELECT query_id, doc_id, rank, 'tutorials' AS surface FROM tr UNION ALL SELECT query_id, doc_id, rank, 'summaries' FROM sr",
)
def fan_out(t) -> DataFrame:
    queries = _items(t).withColumn("route", F.when(F.length("text") < 200, "concept").otherwise("summary_request"))
    docs = lambda lang: t.documents.where(c("lang") == lang).select("doc_id", "text")
    search = lambda lang: lambda q: V.bm25_topk(q.select("query_id", "text"), docs(lang), T.tokens, 5)
    return S.fan_out(queries, {"tutorials": search("en"), "summaries": search("de")}, {"concept": ["tutorials"], "summary_request": ["tutorials", "summaries"]}).drop("score")


@R.query("guardrail", "SELECT doc_id, (n_chars < 300 OR n_chars / 10000.0 < 0.3) AND lang <> 'en' AS guarded FROM documents")
def guardrail(t) -> DataFrame:
    n = F.when(c("n_chars") < 300, 0).otherwise(3)
    return t.documents.select("doc_id", S.guarded(F.lit("concept"), n, c("n_chars") / 10000.0, c("lang") == "en").alias("guarded"))


@R.query("placeholder_paths", "SELECT p_partkey, 'a.b[1]' AS path, 'TBD' AS value FROM part WHERE p_size % 10 = 0 UNION ALL SELECT p_partkey, 'c', 'TODO' FROM part WHERE p_size % 3 = 0")
def placeholder_paths(t) -> DataFrame:
    second, third = F.when(c("p_size") % 10 == 0, "TBD").otherwise("x"), F.when(c("p_size") % 3 == 0, "TODO").otherwise("y")
    document = F.to_json(F.struct(F.struct(F.array(F.lit("ok"), second).alias("b")).alias("a"), third.alias("c")))
    return S.placeholder_paths(t.part.select("p_partkey", document.alias("j")), "p_partkey", "j")
