"""Registered queries: reports, inspections, replays, logs, plans and figures' numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import checks, curves
from quarry.operators import evaluation as E
from quarry.operators import reports as P
from quarry.operators import retrieval as V
from quarry.operators import serving as S
from quarry.plans.registry import Registry
from quarry.plans.retrieval_queries import _METRICS, _ROWS, _asked, _bm25, _golden_rows, _ITEMS, _cosine, _neighbours, bm25_ctes
from quarry.plans.text_queries import ROUTE_SQL, _cut_sql
from quarry.sources import tables as tb
from quarry.streaming import jobs

R = Registry()
c = F.col
_M = _METRICS.replace("1.0 / rank", "1.0 / rank0")


@R.query(
    "outcome_means",
    _ROWS + "SELECT label % 2 AS half, count(*) FILTER (WHERE rank = 1) AS n_right, count(*) FILTER (WHERE rank <> 1) AS n_wrong, round(avg(top1) FILTER (WHERE rank = 1), 6) AS mean_right, round(avg(top1) FILTER (WHERE rank <> 1), 6) AS mean_wrong FROM g GROUP BY 1",
)
def outcome_means(t) -> DataFrame:
    return P.outcome_means(_golden_rows(t).withColumn("half", c("label") % 2), "half")


@R.query("weakest_halves", _ROWS + f"SELECT label % 2 AS half, {_M} FROM g GROUP BY 1 HAVING count(*) >= 2 ORDER BY p1, half")
def weakest_halves(t) -> DataFrame:
    rows = _golden_rows(t).groupBy((c("label") % 2).alias("half")).agg(*E.metrics())
    return rows.where(c("n") - c("errors") >= 2).orderBy("p1", "half")


@R.query("miss_filter", _ROWS + "SELECT query_id FROM g WHERE label % 3 <> 0 AND rank <> 1")
def miss_filter(t) -> DataFrame:
    """Metrics as they come from files: numbers of either kind, or empty."""
    rows = _golden_rows(t)
    right = F.coalesce(c("rank") == 1, F.lit(False))
    written = F.when(right, F.when(c("label") % 2 == 0, "1").otherwise("1.0")).when(c("label") % 2 == 0, "0").when(c("rank").isNull(), "").otherwise("0.0")
    return P.misses(rows, F.when(c("label") % 3 == 0, "crossrefs").otherwise("phrasings"), written).select("query_id")


_OBJECT = "json_object('n', n, 'errors', errors, 'p1', p1, 'p3', p3, 'mrr', mrr)::VARCHAR"


@R.query(
    "json_report",
    _ROWS + f", m AS (SELECT 'overall' AS section, '' AS name, {_M} FROM g UNION ALL SELECT 'by_label', label::VARCHAR, {_M} FROM g GROUP BY label) "
    f"SELECT section, name, {_OBJECT} AS body FROM m UNION ALL SELECT 'gate', '', json_object('p1', p1, 'delta', round(p1 - 0.911, 6), 'pass', round(p1, 3) >= 0.911)::VARCHAR FROM m WHERE section = 'overall'",
)
def json_report(t) -> DataFrame:
    return P.report(_golden_rows(t), ["label"])


@R.query(
    "markdown_report",
    _ROWS + ", m AS (SELECT label, count(*) AS n, round(avg((rank <= 1)::INT), 6) AS p1 FROM g GROUP BY 1) "
    "SELECT 1 AS line, '| label | n | p1 |' AS text UNION ALL SELECT 2, '| --- | --- | --- |' UNION ALL "
    "SELECT row_number() OVER (ORDER BY label) + 2, '| ' || label || ' | ' || n || ' | ' || (floor(p1 * 1000 + 0.5)::BIGINT // 1000) || '.' || lpad((floor(p1 * 1000 + 0.5)::BIGINT % 1000)::VARCHAR, 3, '0') || ' |' FROM m",
)
def markdown_report(t) -> DataFrame:
    labels = _golden_rows(t).groupBy("label").agg(*E.metrics())
    return P.markdown_table(labels, [c("label")], label=c("label").cast("string"), n=c("n").cast("string"), p1=P.fixed(c("p1"), 3))


@R.query(
    "results_csv",
    _ROWS + ", k AS (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS top FROM n WHERE rank <= 5 GROUP BY 1) "
    "SELECT query_id::VARCHAR AS eval_id, 'vectors' AS source, CASE WHEN label % 2 = 0 THEN 'even' ELSE '' END AS difficulty, label::VARCHAR AS expected_slug, 'topic \"' || label || '\", or' || chr(10) || 'none' AS topic, coalesce(rank0::VARCHAR, '') AS rank, "
    "CASE WHEN rank = 1 THEN '1' ELSE '0' END AS \"precision@1\", CASE WHEN rank <= 5 THEN '1' ELSE '0' END AS \"recall@5\", CASE WHEN rank0 IS NULL THEN '0.0000' ELSE '' || (floor(10000.0 / rank0 + 0.5)::BIGINT // 10000) || '.' || lpad((floor(10000.0 / rank0 + 0.5)::BIGINT % 10000)::VARCHAR, 4, '0') END AS mrr, "
    "'cosine' AS service_used, coalesce(top, '') AS top_k_slugs, '' AS error FROM g LEFT JOIN k USING (query_id)",
)
def results_csv(t) -> DataFrame:
    """Written as CSV and read back; topics hold quotes, commas and line ends."""
    topic = F.concat(F.lit('topic "'), c("label").cast("string"), F.lit('", or\nnone'))
    rows = P.result_rows(_golden_rows(t), _neighbours(t, 5), eval_id=c("query_id"), source=F.lit("vectors"), difficulty=F.when(c("label") % 2 == 0, "even"), expected_slug=c("label"), topic=topic, service_used=F.lit("cosine"))
    path = jobs.work_folder(t.spark, "results")
    P.write_csv(rows, path)
    return P.read_csv(t.spark, path, rows.columns)


def _search_sql(name: str, part: str) -> str:
    q, d = (f"{x}.embedding{part}" for x in "qd")
    ranked = f"SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS ql, d.label AS dl, {_cosine(q, d)} AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0"
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({ranked})) WHERE rank <= 5)"


@R.query(
    "inspect_failures",
    f"WITH {_search_sql('w', '')}, {_search_sql('a', '[1:32]')}, {_search_sql('b', '[33:64]')}, u AS (SELECT query_id, doc_id, ql, dl, rank, score AS whole, NULL AS first_half, NULL AS second_half FROM w UNION ALL SELECT query_id, doc_id, ql, dl, NULL, NULL, score, NULL FROM a UNION ALL SELECT query_id, doc_id, ql, dl, NULL, NULL, NULL, score FROM b), "
    "h AS (SELECT query_id, doc_id, max(rank) AS rank, max(whole) AS whole, max(first_half) AS first_half, max(second_half) AS second_half, bool_or(ql = dl) AS expected FROM u GROUP BY 1, 2), "
    "e AS (SELECT *, min(CASE WHEN expected THEN rank END) OVER (PARTITION BY query_id) AS expected_rank FROM h) SELECT * FROM e WHERE coalesce(expected_rank, 0) <> 1",
)
def inspect_failures(t) -> DataFrame:
    part = lambda a: t.embeddings.select("vec_id", F.slice("embedding", a, 32).alias("v"))
    half = lambda x: V.without_self(V.dense_topk(x.where("vec_id % 100 = 0"), x, 5, "vec_id", "v"), 5)
    asked = _asked(t).select(c("vec_id").alias("query_id"), "label")
    accepted = asked.join(t.embeddings.select("label", c("vec_id").alias("doc_id")), "label")
    hits = P.inspect(asked, {"whole": _neighbours(t, 5), "first_half": half(part(1)), "second_half": half(part(33))}, accepted)
    return hits.where(F.coalesce("expected_rank", F.lit(0)) != 1)


@R.query("replay_coverage", _ROWS + "SELECT count(*) FILTER (WHERE label < 5) AS n, round(avg((rank <= 1)::INT) FILTER (WHERE label < 5), 6) AS p1, count(*) FILTER (WHERE label >= 5) AS missing FROM g")
def replay_coverage(t) -> DataFrame:
    """Saved rankings of some labels only: metrics over what they cover, and how many rows they lack."""
    asked = _asked(t).select(c("vec_id").alias("query_id"), "label")
    saved = _neighbours(t, 20).join(asked.where("label < 5").select("query_id"), "query_id", "left_semi")
    accepted = t.embeddings.groupBy("label").agg(F.collect_list("vec_id").alias("all"))
    known, lacking = P.covered(asked.join(accepted, "label").select("query_id", F.array_remove("all", c("query_id")).alias("accepted")), saved)
    scored = E.score_rows(known, saved).agg(*E.metrics()).select("n", "p1")
    return scored.crossJoin(lacking.agg(F.count("*").alias("missing")))


@R.query(
    "query_log",
    f"SELECT 'c' || conv_id || '-' || turn AS query_id, text AS q, CASE WHEN turn % 4 = 0 THEN 'image' ELSE 'text' END AS query_type, {ROUTE_SQL} AS query_class, (length(text) * 3)::BIGINT AS elapsed_ms, NULL::VARCHAR AS extraction_outcome FROM conversations WHERE role = 'user' "
    "UNION ALL SELECT 'firewall_event_' || event_id, '(firewall_event)', 'firewall_event', '(none)', 0, 'firewall_event_type=subnet_cap subnet=10.0.' || (user_id % 256) || '.0/24 ip=10.0.' || (user_id % 256) || '.' || (event_id % 200) FROM events WHERE event_type = 'error'",
)
def query_log(t) -> DataFrame:
    asked = t.conversations.where("role = 'user'")
    extracted = F.when(c("turn") % 4 == 0, c("text"))
    texts = P.log_rows(asked, query_id=F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), q=c("text"), query_class=T.classify(c("text")), elapsed_ms=F.length("text") * 3, extracted_question=extracted)
    ip = F.concat(F.lit("10.0."), (c("user_id") % 256).cast("string"), F.lit("."), (c("event_id") % 200).cast("string"))
    events = P.firewall_rows(t.events.where("event_type = 'error'"), c("event_id"), "subnet_cap", T.subnet(ip), ip)
    return texts.unionByName(events).select("query_id", "q", "query_type", "query_class", "elapsed_ms", "extraction_outcome")


@R.query(
    "sink_flushes",
    "SELECT w AS \"window\", part, count(*) AS n FROM (SELECT w, (row_number() OVER (PARTITION BY w ORDER BY ts, event_id) - 1) // 100 AS part FROM (SELECT *, (epoch_us(ts) // 30000000) AS w FROM events)) GROUP BY 1, 2",
)
def sink_flushes(t) -> DataFrame:
    return P.flushes(t.events, "ts", "event_id").groupBy("window", "part").agg(F.count("*").alias("n"))


@R.query(
    "spend_lookup",
    "WITH d AS (SELECT DISTINCT ts::DATE::VARCHAR AS day FROM events), u AS (SELECT DISTINCT user_id FROM events WHERE user_id < 20), s AS (SELECT ts::DATE::VARCHAR AS day, user_id, sum(value) AS spend FROM events GROUP BY 1, 2) "
    "SELECT day, user_id, round(coalesce(spend, 0), 4) AS spend FROM d CROSS JOIN u LEFT JOIN s USING (day, user_id)",
)
def spend_lookup(t) -> DataFrame:
    """Each day's spend of the first accounts, 0 where there is none."""
    events = t.events.withColumn("day", F.to_date("ts").cast("string"))
    days = events.agg(F.collect_set("day").alias("days"))
    wanted = events.where("user_id < 20").select("user_id").distinct().crossJoin(F.broadcast(days)).select(F.explode("days").alias("day"), "user_id")
    spend = events.groupBy("day", "user_id").agg(F.sum("value").alias("spend"))
    return P.amount_or_zero(wanted, spend, ["day", "user_id"], "spend").select("day", "user_id", F.round("spend", 4).alias("spend"))


@R.query("flat_parameters", "SELECT doc_id, source, CASE WHEN lang = 'en' THEN '[]' ELSE to_json([source, lang])::VARCHAR END AS tags FROM documents")
def flat_parameters(t) -> DataFrame:
    tags = F.when(c("lang") != "en", F.array("source", "lang")).when(c("lang").isNull(), F.array("source", "lang"))
    return P.flat_parameters(t.documents.withColumn("tags", tags), ["doc_id", "source"], ["tags"])


@R.query(
    "stitched",
    "SELECT conv_id, sum(length(text))::BIGINT AS duration, coalesce(first(CASE WHEN role = 'assistant' THEN substr(text, 1, 2) END ORDER BY turn) FILTER (WHERE role = 'assistant'), 'en') AS language, coalesce(string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') AS text FROM conversations GROUP BY 1",
)
def stitched(t) -> DataFrame:
    chunks = t.conversations.select("conv_id", "turn", "text", F.length("text").cast("long").alias("duration"), F.when(c("role") == "assistant", F.substring("text", 1, 2)).alias("language"))
    return P.stitched(chunks, "conv_id", "turn")


@R.query(
    "voice_context",
    f"WITH {bm25_ctes('p', _ITEMS)}, s AS (SELECT source AS strand, text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1), "
    "j AS (SELECT query_id, source AS strand, s.text FROM pr JOIN documents d USING (doc_id) LEFT JOIN s ON s.strand = d.source WHERE pr.rank = 1) "
    "SELECT query_id, strand, CASE WHEN text IS NULL THEN '' ELSE CASE WHEN length(text) <= 400 THEN text " + _cut_sql("chr(10) || '## '", 4) + _cut_sql("chr(10) || chr(10)", 2) + _cut_sql("chr(10)", 1) + "ELSE h END || chr(10) || chr(10) END || 'end with a sentence' AS context FROM (SELECT *, substr(text, 1, 400) AS h FROM j)",
)
def voice_context(t) -> DataFrame:
    summaries = S.pick_one(t.documents.select(c("source").alias("strand"), "doc_id", "n_chars", "text"), ["strand"], [F.desc("n_chars"), c("doc_id")])
    tops = _bm25(t, 5).join(t.documents.select("doc_id", "source"), "doc_id")
    return P.voice_context(tops, c("source"), summaries, F.lit("end with a sentence"), cap=600)


#: Paths of all kinds, made from the pages.
_PATH = "CASE page_id % 6 WHEN 0 THEN 'tutorials/AB_Maths_Exams/Solutions/20' || lpad((page_id % 24)::VARCHAR, 2, '0') || '_P1_solutions.md' WHEN 1 THEN 'tutorials/AB_The_Line/_SUMMARY-' || page_id || '.md' WHEN 2 THEN 'tutorials/AB_The_Line/' || page_id || '.md' WHEN 3 THEN url WHEN 4 THEN 'tutorials/AB_The_Circle/x' || page_id || '.md' ELSE CASE WHEN page_id % 60 = 5 THEN 'tutorials/SCHEMA.md' ELSE 'README.md' END END"
_KIND = (
    f"CASE WHEN regexp_matches({_PATH}, '^tutorials/[A-Z]+_[^/]+/_SUMMARY-[^/]+\\.md$') THEN 'summaries' WHEN regexp_matches({_PATH}, '^tutorials/[A-Z]+_Maths_Exams/Solutions/[0-9]{{4}}_(DF_)?P[12](_DF)?_solutions\\.md$') THEN 'exam_solutions' "
    f"WHEN {_PATH} = 'tutorials/SCHEMA.md' THEN 'schema' WHEN regexp_matches({_PATH}, '^tutorials/[A-Z]+_[^/]+/[^/]+\\.md$') AND NOT regexp_matches({_PATH}, '^tutorials/[A-Z]+_Maths_Exams\\b') THEN 'tutorials' END"
)


def _files(t) -> DataFrame:
    return t.pages.select("page_id", "html", F.expr(_PATH.replace("::VARCHAR", "")).alias("path"))


@R.query("path_categories", f"SELECT page_id, {_KIND} AS category FROM pages")
def path_categories(t) -> DataFrame:
    return _files(t).select("page_id", tb.classify_path(c("path")).alias("category"))


@R.query(
    "loader_plans",
    f"SELECT page_id // 20 AS change, concat_ws(',', CASE WHEN bool_or(k = 'tutorials') THEN 'load_tutorials' END, CASE WHEN bool_or(k = 'exam_solutions') THEN 'load_exam_parts' END, CASE WHEN bool_or(k = 'summaries') THEN 'load_summaries' END) AS loaders, CASE WHEN bool_or(k = 'schema') THEN 'schema' ELSE '' END AS stop FROM (SELECT page_id, {_KIND} AS k FROM pages) GROUP BY 1",
)
def loader_plans(t) -> DataFrame:
    changes = _files(t).withColumn("change", F.floor(c("page_id") / 20).cast("long"))
    return P.loader_plan(changes, tb.classify_path(c("path")), "change")


_REFERENCES = {
    "none": "",
    "good": "## Cross-references (machine-readable)\n\n```yaml\ncross_references:\n  - part_id: p1\n    tutorials: [a, b]\n  - part_id: p2\n```\n",
    "bad": "## Cross-references (machine-readable)\n\n```yaml\ncross_references:\n  - part_id: ''\n    tutorials: [1]\n  - x\n```\n",
    "open": "## Cross-references (machine-readable)\n\nno block\n",
}


def _with_references(t) -> DataFrame:
    kind = (c("page_id") / 6).cast("long") % 4
    block = F.element_at(F.array(*map(F.lit, _REFERENCES.values())), (kind + 1).cast("int"))
    return _files(t).withColumn("text", F.concat(F.regexp_replace(F.coalesce("html", F.lit("")), "```", ""), F.lit("\n"), block))


@R.query(
    "reference_errors",
    "SELECT page_id, CASE page_id // 6 % 4 WHEN 0 THEN 'no_heading' WHEN 1 THEN '' WHEN 2 THEN '0:no_part_id,0:tutorials,1:not_a_mapping' ELSE 'no_block' END AS errors FROM pages",
)
def reference_errors(t) -> DataFrame:
    return _with_references(t).select("page_id", F.array_join(checks.reference_errors(c("text")), ",").alias("errors"))


@R.query(
    "file_report",
    f"SELECT coalesce(k, 'other') AS category, count(*) FILTER (WHERE k = 'exam_solutions') AS checked, count(*) FILTER (WHERE k IS DISTINCT FROM 'exam_solutions') AS skipped, sum(CASE WHEN k = 'exam_solutions' THEN e ELSE 0 END)::BIGINT AS errors, count(*) FILTER (WHERE k = 'exam_solutions' AND e > 0) AS bad_files FROM (SELECT {_KIND} AS k, CASE page_id // 6 % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 1 END AS e FROM pages) GROUP BY 1",
)
def file_report(t) -> DataFrame:
    return checks.file_report(_with_references(t), tb.classify_path(c("path")))


@R.query("image_topics", "SELECT conv_id, turn, 'image_extracted' AS route, CASE WHEN turn % 2 = 0 THEN text ELSE 'topic ' || trim(substr(text, 1, 9)) END AS wanted FROM conversations")
def image_topics(t) -> DataFrame:
    route, wanted = P.image_route(F.when(c("turn") % 2 == 0, " ").otherwise(F.concat(F.lit("topic "), F.trim(F.substring("text", 1, 9)), F.lit(" "))), c("text"))
    return t.conversations.select("conv_id", "turn", route.alias("route"), wanted.alias("wanted"))


@R.query(
    "exam_references",
    "WITH a AS (SELECT conv_id, turn, 'show me ' || CASE WHEN conv_id % 3 = 0 THEN (2000 + conv_id % 25) || ' ' ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN 'Paper ' || (1 + turn % 2) || ' ' ELSE '' END || 'Q0' || (turn + 1) || CASE WHEN turn % 3 = 0 THEN ' deferred' ELSE '' END AS asked FROM conversations), "
    r"p AS (SELECT *, nullif(regexp_extract(asked, '(?i)\b((19|20)[0-9]{2})\b', 1), '')::INT AS year FROM a) "
    r"SELECT conv_id, turn, year, nullif(regexp_extract(asked, '(?i)\b(p|paper)\s*([12])\b', 2), '')::INT AS paper, nullif(regexp_extract(asked, '(?i)\bq(uestion)?\s*0*([0-9]+)', 2), '')::INT AS question_number, "
    r"CASE WHEN year IS NOT NULL THEN CASE WHEN regexp_matches(asked, '(?i)\b(deferred|df)\b') THEN 'df' ELSE 'main' END END AS sitting FROM p",
)
def exam_references(t) -> DataFrame:
    year = F.when(c("conv_id") % 3 == 0, F.concat((2000 + c("conv_id") % 25).cast("string"), F.lit(" "))).otherwise("")
    paper = F.when(c("conv_id") % 2 == 0, F.concat(F.lit("Paper "), (1 + c("turn") % 2).cast("string"), F.lit(" "))).otherwise("")
    asked = F.concat(F.lit("show me "), year, paper, F.lit("Q0"), (c("turn") + 1).cast("string"), F.when(c("turn") % 3 == 0, " deferred").otherwise(""))
    return t.conversations.select("conv_id", "turn", T.parse_reference(asked).alias("r")).select("conv_id", "turn", "r.year", "r.paper", "r.question_number", "r.sitting")


@R.query("turning_points", "SELECT p_partkey, round((p_size - 25) / 2.0, 6) AS x, round(3 - ((p_size - 25) / 2.0) ** 2, 6) AS y FROM part WHERE (p_size - 25) / 2.0 BETWEEN -10 AND 10")
def turning_points(t) -> DataFrame:
    quadratic = F.array(F.lit(1.0), (25 - c("p_size")).cast("double"), F.lit(3.0))
    each = t.part.select("p_partkey", F.explode(curves.turning_points(quadratic, -10, 10)).alias("p"))
    return each.select("p_partkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@R.query(
    "number_lines",
    "WITH b AS (SELECT p_partkey, p_size - 25.0 AS b, ['<', '<=', '>', '>='][p_partkey % 4 + 1] AS op FROM part), w AS (SELECT *, b - greatest(4, abs(b) * 0.5) AS low, b + greatest(4, abs(b) * 0.5) AS high FROM b) "
    "SELECT p_partkey, low::DOUBLE AS low, high::DOUBLE AS high, CASE WHEN op LIKE '>%' THEN b ELSE low END::DOUBLE AS \"from\", CASE WHEN op LIKE '>%' THEN high ELSE b END::DOUBLE AS \"to\", op LIKE '%=' AS closed, 'x ' || replace(replace(op, '<=', '≤'), '>=', '≥') || ' ' || b::INT AS text FROM w",
)
def number_lines(t) -> DataFrame:
    spelled = F.element_at(F.array(*map(F.lit, ["<", " =< ", "> ", "≥"])), (c("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", *(x.alias(n) for n, x in curves.number_line(c("p_size") - 25.0, spelled).items()))


@R.query("polynomial_shapes", "SELECT degree, sign, i, round(-2 + i * (4 / 49.0), 6) AS x, round(sign * (-2 + i * (4 / 49.0)) ** degree, 6) + 0.0 AS y FROM (SELECT DISTINCT p_size % 6 + 1 AS degree FROM part), (SELECT unnest([1, -1]) AS sign), (SELECT unnest(range(0, 50)) AS i)")
def polynomial_shapes(t) -> DataFrame:
    degrees = t.part.select((c("p_size") % 6 + 1).alias("degree")).distinct()
    return curves.shapes(degrees, "degree", -2, 2, 50).select("degree", "sign", "i", F.round("x", 6).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@R.query(
    "polynomial_texts",
    "WITH k AS (SELECT p_partkey, p_size % 3 - 1 AS a, p_size % 5 - 2 AS b, (p_size % 7 - 3) / 2.0 AS d FROM part), s AS (SELECT *, CASE a WHEN 1 THEN 'x²' WHEN -1 THEN '-x²' ELSE '' END AS t1, CASE WHEN abs(b) = 1 THEN 'x' ELSE abs(b) || 'x' END AS t2, printf('%g', abs(d)::DOUBLE) AS t3 FROM k), "
    "u AS (SELECT *, t1 || CASE WHEN b = 0 THEN '' WHEN t1 = '' THEN CASE WHEN b < 0 THEN '-' ELSE '' END || t2 ELSE CASE WHEN b < 0 THEN ' − ' ELSE ' + ' END || t2 END AS x FROM s) "
    "SELECT p_partkey, CASE WHEN d = 0 THEN CASE WHEN x = '' THEN '0' ELSE x END WHEN x = '' THEN CASE WHEN d < 0 THEN '-' ELSE '' END || t3 ELSE x || CASE WHEN d < 0 THEN ' − ' ELSE ' + ' END || t3 END AS text FROM u",
)
def polynomial_texts(t) -> DataFrame:
    k = [(c("p_size") % 3 - 1).cast("double"), (c("p_size") % 5 - 2).cast("double"), (c("p_size") % 7 - 3) / 2.0]
    return t.part.select("p_partkey", curves.polynomial_text(F.array(*k)).alias("text"))


_SHAPE = (
    "WITH k AS (SELECT p_partkey, ['sin', 'cos', 'tan'][p_partkey % 3 + 1] AS kind, (p_size % 7 - 3.5)::DOUBLE AS a, CASE WHEN p_partkey % 4 = 0 THEN 2 * pi() ELSE (p_size % 9 + 1) / 2.0 END AS period, "
    "((p_partkey % 5 - 2) / 4.0)::DOUBLE AS phase, (p_partkey % 3 - 1) * (p_retailprice * 1000 + 0.3) AS d, [2.0, exp(1), 0.5, 10.0][p_partkey % 4 + 1]::DOUBLE AS base, (p_size % 4 - 2)::DOUBLE AS rate, "
    "(p_size % 3 + 1) * 1e-5 * CASE WHEN p_size % 3 = 0 THEN 100000 ELSE 1 END AS factor FROM part), "
    "g AS (SELECT *, 2 * pi() / period AS f, CASE WHEN d = 0 THEN '' ELSE CASE WHEN d > 0 THEN ' + ' ELSE ' − ' END || printf('%g', abs(d)) END AS plus, CASE WHEN factor = 1 THEN '' ELSE printf('%g', factor) || ' · ' END AS times, CASE WHEN p_partkey % 4 = 1 THEN 'e' ELSE printf('%g', base) END AS b FROM k) "
)


@R.query(
    "curve_titles",
    _SHAPE + "SELECT p_partkey, 'y = ' || printf('%g', a) || ' ' || kind || '(' || CASE WHEN abs(f - 1) < 1e-9 THEN 'x' ELSE printf('%.3g', f) || 'x' END || CASE WHEN phase = 0 THEN '' ELSE CASE WHEN phase > 0 THEN ' - ' ELSE ' + ' END || printf('%.3g', abs(f * phase)) END || ')' || plus AS trigonometric, "
    "'y = ' || times || b || '^(' || CASE rate WHEN 1 THEN 'x' WHEN -1 THEN '-x' ELSE printf('%g', rate) || 'x' END || ')' || plus AS exponential, "
    "'y = ' || times || CASE WHEN b = 'e' THEN 'ln' ELSE 'log_' || b END || '(' || CASE WHEN rate = 1 THEN 'x' ELSE printf('%g', rate) || 'x' END || ')' || plus AS logarithm, "
    "CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE rtrim(printf('%.2f', p_retailprice), '0') END AS axis FROM g JOIN part USING (p_partkey)",
)
def curve_titles(t) -> DataFrame:
    """Titles of curves whose parameters come from the parts: unit and other factors, large and small numbers, both signs."""
    one_of = lambda *values: F.element_at(F.array(*map(F.lit, values)), (c("p_partkey") % len(values) + 1).cast("int"))
    period = F.when(c("p_partkey") % 4 == 0, 2 * math.pi).otherwise((c("p_size") % 9 + 1) / 2.0)
    offset, rate = (c("p_partkey") % 3 - 1) * (c("p_retailprice") * 1000 + 0.3), (c("p_size") % 4 - 2).cast("double")
    factor, base = (c("p_size") % 3 + 1) * F.lit(1e-5) * F.when(c("p_size") % 3 == 0, 100000).otherwise(1), one_of(2.0, math.e, 0.5, 10.0)
    return t.part.select(
        "p_partkey",
        curves.trigonometric_text(one_of("sin", "cos", "tan"), c("p_size") % 7 - 3.5, period, (c("p_partkey") % 5 - 2) / 4.0, offset).alias("trigonometric"),
        curves.exponential_text(base, factor, rate, offset).alias("exponential"),
        curves.logarithm_text(base, factor, rate, offset).alias("logarithm"),
        curves.axis_text(c("p_retailprice")).alias("axis"),
    )


@R.query("minus_idle", "SELECT p_size, p_brand FROM part EXCEPT SELECT p_size, p_brand FROM part WHERE p_type = 'SMALL'")
def minus_idle(t) -> DataFrame:
    """Sizes and brands that no small part has."""
    pairs = t.part.select("p_size", "p_brand", "p_type")
    return pairs.drop("p_type").subtract(pairs.where("p_type = 'SMALL'").drop("p_type"))


@R.query("minus_without_large", "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def minus_without_large(t) -> DataFrame:
    """Customers none of whose orders is large."""
    return t.orders.select("o_custkey").subtract(t.orders.where("o_totalprice > 300000").select("o_custkey"))
