"""Registered queries over lines of text: sections, structure, links, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ordered
from quarry.plans.ordered_queries import LIMITER_SQL
from quarry.plans.registry import Registry
from quarry.sources import markdown
from quarry.streaming import gates, jobs

R = Registry()
c = F.col


@R.query("line_table", "SELECT doc_id::VARCHAR AS path, (generate_subscripts(l, 1) - 1)::INT AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def line_table(t) -> DataFrame:
    return markdown.lines(t.documents.select(c("doc_id").cast("string").alias("path"), "text"))


@R.query(
    "line_sections",
    "WITH l AS (SELECT doc_id, (generate_subscripts(l, 1) - 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), s AS (SELECT *, sum((length(line) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM l) "
    "SELECT doc_id::VARCHAR AS path, section, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM s GROUP BY 1, 2",
)
def line_sections(t) -> DataFrame:
    rows = markdown.lines(t.documents.select(c("doc_id").cast("string").alias("path"), "text"))
    marked = rows.withColumn("section", ordered.island(F.length("line") < 40, ["path"], ["n"]))
    return marked.groupBy("path", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@R.query("page_links", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))::BIGINT AS n_links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)))::BIGINT AS n_distinct FROM pages")
def page_links(t) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return t.pages.select("page_id", F.size(found).cast("long").alias("n_links"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


@R.query("page_headings", "SELECT page_id, nullif(regexp_extract(html, '<h1>([^<]*)', 1), '') AS h1, regexp_matches(html, '<title>') AS has_title FROM pages")
def page_headings(t) -> DataFrame:
    return t.pages.select("page_id", F.nullif(F.regexp_extract("html", "<h1>([^<]*)", 1), F.lit("")).alias("h1"), c("html").contains("<title>").alias("has_title"))


@R.query("strip_generated_block", "SELECT page_id, length(regexp_replace(html, '\\n*<script>.*?</script>\\n*', chr(10), 'gs')) AS n_chars FROM pages")
def strip_generated_block(t) -> DataFrame:
    return t.pages.select("page_id", F.length(markdown.strip_block(c("html"), "<script>", "</script>")).cast("long").alias("n_chars"))


@R.query("streaming_daily_spend", "SELECT event_type, ts::DATE::VARCHAR AS day, round(sum(value), 4) AS spend FROM events GROUP BY 1, 2")
def streaming_daily_spend(t) -> DataFrame:
    return jobs.run_to_table(t, "events", jobs.daily_spend, complete=True)


@R.query("streaming_limiter", f"SELECT event_id, user_id % 3 AS user_id, decision FROM ({LIMITER_SQL}) JOIN events USING (event_id)")
def streaming_limiter(t) -> DataFrame:
    return jobs.run_to_table(t, "events", lambda events: gates.stream_limiter(events.withColumn("user_id", c("user_id") % 3)))


@R.query("streaming_dedup", "SELECT DISTINCT user_id, event_type, ts::DATE::VARCHAR AS day FROM events")
def streaming_dedup(t) -> DataFrame:
    return jobs.run_to_table(t, "events", jobs.distinct_days)


@R.query("streaming_log_sink", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 0) AS kept FROM events GROUP BY 1")
def streaming_log_sink(t) -> DataFrame:
    logged = jobs.run_log_sink(t, "events", required=["event_id", "event_type", "value"])
    return logged.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(c("value") > 0).alias("kept"))
