"""Registered queries over Markdown files, which Spark renders from the tables; their SQL parses the same files by patterns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import Registry
from quarry.sources import markdown

R = Registry()
c = F.col


def _article(g: str) -> dict[str, str]:
    """Path, name, folder and text of a document's file, for Spark (``g`` empty) and for other SQL (``g`` the flag of all matches)."""
    t = "coalesce(text, '')"
    plain = lambda at, n: f"trim(regexp_replace(substr({t}, {at}, {n}), '[^A-Za-z0-9 ]', ''{g}))"
    slug = f"lower(replace(trim(regexp_replace(substr({t}, 1, 32), '[^A-Za-z ]', ''{g})), ' ', '-'))"
    word = lambda n: f"regexp_extract({t}, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', {n})"
    name = "CASE WHEN lang = 'de' THEN '_SUMMARY-' || doc_id || '.md' WHEN source = 'src3' THEN 'README.md' ELSE doc_id || '.md' END"
    head = [
        "'---'", f"'slug: \"' || {slug} || '\"'", f"'title: \"' || {plain(1, 48)} || '\"'", f"'sequence_number: ' || length({t})", f"'keywords: [\"' || {word(1)} || '\", \"' || {word(2)} || '\"]'", "'topic: ' || coalesce(source, 'none')",
        "'common_student_phrasings:'", f"'  - \"' || {plain(49, 70)} || '\"'", f"'  - \"' || {plain(119, 60)} || '\"'", f"'  - \"' || {plain(49, 70)} || '\"'", "'---'", t,
    ]
    text = f"CASE WHEN lang = 'fr' THEN {t} ELSE concat_ws(chr(10), {', '.join(head)}) END"
    folder = "'AB_' || coalesce(source, 'none')"
    return {"path": f"{folder} || '/' || doc_id || '/' || {name}", "name": name, "folder": folder, "text": text}


_FILES = "f AS (SELECT {path} AS path, {name} AS name, {text} AS text FROM documents)".format(**_article(", 'g'"))
#: What the patterns find in a tutorial's file, where it is one.
_PARSED = (
    f"WITH {_FILES}, k AS (SELECT path, text, CASE WHEN starts_with(name, '_SUMMARY-') THEN 'summary' WHEN name = 'README.md' THEN 'readme' WHEN NOT regexp_matches(text, '^---') THEN 'no_front_matter' WHEN NOT regexp_matches(text, '(?m)^slug: \"[^\"]+\"$') THEN 'no_slug' END AS skipped FROM f), "
    "p AS (SELECT path, regexp_extract(text, '(?m)^slug: \"([^\"]*)\"$', 1) AS slug, regexp_extract(text, '(?m)^title: \"([^\"]*)\"$', 1) AS title, regexp_extract(text, '(?m)^topic: (.*)$', 1) AS topic, regexp_extract(text, '(?m)^sequence_number: ([0-9]+)$', 1)::INT AS sequence_number, "
    "regexp_extract_all(regexp_extract(text, '(?m)^keywords: (.*)$', 1), '\"([^\"]*)\"', 1) AS keywords, regexp_extract_all(regexp_extract(text, 'common_student_phrasings:\n((  - \"[^\"]*\"\n)+)---\n', 1), '- \"([^\"]*)\"', 1) AS phrasings, "
    "length(regexp_replace(text, '^---\n.*?\n---\n', '', 's')) AS body_chars FROM k WHERE skipped IS NULL)"
)


def _articles(t) -> DataFrame:
    return t.documents.select(*(F.expr(x).alias(n) for n, x in _article("").items()))


@R.query("corpus_walk", _PARSED + " SELECT 'walked' AS outcome, count(*) AS n FROM k UNION ALL SELECT x.outcome, count(k.path) FROM (SELECT unnest(['parsed', 'summary', 'readme', 'no_front_matter', 'no_slug']) AS outcome) x LEFT JOIN k ON coalesce(k.skipped, 'parsed') = x.outcome GROUP BY 1")
def corpus_walk(t) -> DataFrame:
    """What one pass over all files parsed, and skipped for which reason."""
    tutorials, seen = markdown.walk(_articles(t))
    tutorials.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame(list(seen.get.items()), "outcome string, n long")


@R.query(
    "tutorial_table",
    _PARSED + ", x AS (SELECT *, [y FOR y IN list_prepend(title, list_concat(keywords, phrasings)) IF y <> ''] AS l FROM p) "
    "SELECT path, slug, title, topic, sequence_number, array_to_string(keywords, '|') AS keywords, array_to_string(phrasings, '|') AS phrasings, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF length(array_to_string(l[1:i], chr(10))) <= 150], chr(10)) AS searchable, body_chars FROM x",
)
def tutorial_table(t) -> DataFrame:
    """Tutorials from front matter, their searchable text capped at 150 characters."""
    tutorials, _ = markdown.walk(_articles(t))
    joined = lambda n: F.array_join(n, "|").alias(n)
    return markdown.tutorial_rows(tutorials, 150).select("path", "slug", "title", "topic", "sequence_number", joined("keywords"), joined("phrasings"), c("title_plus_phrasings").alias("searchable"), F.length("body").cast("long").alias("body_chars"))


@R.query(
    "golden_phrasings",
    _PARSED + ", e AS (SELECT slug, phrasings, unnest(range(1, len(phrasings) + 1)) AS i FROM p), d AS (SELECT slug, phrasings[i] AS question_text, len(list_distinct(phrasings[1:i])) AS place FROM e WHERE list_position(phrasings, phrasings[i]) = i) "
    "SELECT 'phr-' || slug || '-' || lpad(place::VARCHAR, 3, '0') AS eval_id, question_text, slug AS expected_slug, CASE WHEN length(question_text) > 60 THEN 'auto-medium' ELSE 'auto-easy' END AS difficulty FROM d WHERE question_text <> ''",
)
def golden_phrasings(t) -> DataFrame:
    """A golden row for each distinct phrasing of a tutorial."""
    tutorials, _ = markdown.walk(_articles(t))
    return markdown.phrasing_rows(markdown.tutorial_rows(tutorials)).select("eval_id", "question_text", "expected_slug", "difficulty")


# --- summaries: a file for each order, with two tables ------------------------

_TOP_ROW = "'| ' || l_linenumber || '. | `part-' || l_partkey || '/' || l_suppkey || '` | cited ' || CAST(l_quantity AS INT) || ' times | ' || CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END || ' |'"
_TIME_ROW = "'| ' || l_linestatus || ' | ' || CASE WHEN l_returnflag = 'N' THEN 'any' ELSE 'some ' || CAST(l_quantity AS INT) || ' min' END || ' | part ' || l_partkey || ' |'"
_OPENING = ["# Summary", "", "## Top tutorials", "", "| Rank | Tutorial | Citations | Tests |", "|---|:--|---|---|"]
_BETWEEN = ["", "## Time split", "", "| Activity | Time | Why |", "| --- | --- | --- |"]
_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus"
_quoted = lambda lines: ", ".join(f"'{x}'" for x in lines)
_SUMMARIES = (
    f"WITH f AS (SELECT l_orderkey || '/_SUMMARY-order.md' AS path, concat_ws(chr(10), {_quoted(_OPENING)}, string_agg({_TOP_ROW}, chr(10) ORDER BY {_LINE_ORDER}), CASE WHEN sum(l_quantity) > 60 THEN concat_ws(chr(10), {_quoted(_BETWEEN)}, string_agg({_TIME_ROW}, chr(10) ORDER BY {_LINE_ORDER})) END) AS text FROM lineitem GROUP BY l_orderkey), "
    "r AS (SELECT path, generate_subscripts(l, 1)::INT AS row, unnest(l) AS line FROM (SELECT path, [x FOR x IN string_split(regexp_extract(text, '## {heading}(.*?)(\n## |$)', 1, 's'), chr(10)) IF x LIKE '|%'][3:] AS l FROM f)), k AS (SELECT path, row, [trim(x) FOR x IN string_split(line, '|')] AS k FROM r) "
)


def _summaries(t) -> DataFrame:
    # Lines are rendered after they have met, so that numbers are shuffled and no text.
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE_ORDER.split(", ")))).alias("l"), F.sum("l_quantity").alias("q"))
    rendered = lambda row: F.expr(f"transform(l, x -> {re.sub(r'\bl_', 'x.l_', row)})")
    text = lambda start, row: F.concat(F.array(*map(F.lit, start)), rendered(row))
    both = F.when(c("q") > 60, F.concat(text(_OPENING, _TOP_ROW), text(_BETWEEN, _TIME_ROW))).otherwise(text(_OPENING, _TOP_ROW))
    return lines.select(F.concat("l_orderkey", F.lit("/_SUMMARY-order.md")).alias("path"), F.array_join(both, "\n").alias("text"))


@R.query(
    "summary_tutorials",
    _SUMMARIES.replace("{heading}", "Top tutorials") + "SELECT path, row, regexp_extract(k[2], '([0-9]+)', 1)::INT AS rank, string_split(regexp_extract(k[3], '`([^`]+)`', 1), '/')[1] AS tutorial, replace(regexp_extract(k[3], '`([^`]+)`', 1), '/', '+') AS tutorials, regexp_extract(k[4], '([0-9]+)', 1)::INT AS citations, nullif(k[5], '') AS what_it_tests FROM k",
)
def summary_tutorials(t) -> DataFrame:
    return markdown.top_tutorials(markdown.tables(_summaries(t), r"^## Top tutorials")).withColumn("tutorials", F.array_join("tutorials", "+"))


@R.query("summary_times", _SUMMARIES.replace("{heading}", "Time split") + "SELECT path, row, k[2] AS activity, k[3] AS time_text, nullif(regexp_extract(k[3], '([0-9]+) min', 1), '')::INT AS minutes, k[4] AS why FROM k")
def summary_times(t) -> DataFrame:
    return markdown.time_split(markdown.tables(_summaries(t), r"^## Time split"))


# --- solutions: a file for each conversation, a part for each turn ------------


def _solutions(g: str) -> dict[str, str]:
    """Path, name and one part's lines of a conversation's file, as ``_article``."""
    plain = f"trim(regexp_replace(coalesce(text, ''), '[^A-Za-z ,.]+', ' '{g}))"
    word = lambda n: f"lower(regexp_extract({plain}, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', {n}))"
    question = "CAST(floor(turn / 3) AS INT) + 1"
    mine, theirs = "role = 'user'", "role = 'assistant'"
    lines = [
        "CASE WHEN turn = 3 THEN '## Section B' END", f"CASE WHEN turn % 3 = 0 AND turn % 2 = 1 THEN '## Question ' || ({question}) || ' (25 marks)' END", "''",
        f"'### Q' || ({question}) || '(' || substr('abc', CAST(turn % 3 + 1 AS INT), 1) || ')' || CASE WHEN turn % 5 = 2 THEN '(ii)' ELSE '' END || ' — ' || {word(1)}", "''",
        f"CASE WHEN {mine} AND turn % 3 = 0 THEN '**Topic:** ' || {word(2)} || '.' END",
        f"CASE WHEN {theirs} THEN 'See [x](../../AB_The_Line/' || {word(1)} || '.md), [y](../../CD_Circle/' || {word(2)} || '.md), [z](../../AB_The_Line/' || {word(2)} || '.md).' END",
        f"CASE WHEN {mine} THEN '> **🚨 ' || {word(1)} || '**' END", f"CASE WHEN {mine} THEN '> ' || {word(2)} END", "''", plain, f"CASE WHEN {theirs} AND length(text) % 2 = 0 THEN 'Show it. (4 marks)' END",
        "'#### Step 1'", "'Work of ' || coalesce(role, 'none')", f"CASE WHEN {theirs} THEN '#### Marking-scheme note' END", f"CASE WHEN {theirs} THEN 'Scale ' || length(text) END",
    ]
    name = "(2000 + conv_id % 25) || '_P' || (1 + conv_id % 2) || CASE WHEN conv_id % 3 = 0 THEN '_DF' ELSE '' END || '_solutions.md'"
    return {"path": f"'Solutions/' || conv_id || '/' || {name}", "name": name, "part": f"concat_ws(chr(10), {', '.join(lines)})"}


_PAPER, _CLOSE = ["---", "title: Solutions", "---", "# Solutions", "", "## Section A", "", "## Question 1 (30 marks)"], ["## Footnotes", "### Q9 — not a part"]
_STRIP = r"'^\s+|\s+$', '', 'g'"
_PARTS = (
    "WITH f AS (SELECT {path} AS path, {name} AS name, concat_ws(chr(10), {open}, string_agg({part}, chr(10) ORDER BY turn, role, text), {close}) AS text FROM conversations GROUP BY conv_id), ".format(open=_quoted(_PAPER), close=_quoted(_CLOSE), **_solutions(", 'g'"))
    + "t AS (SELECT path, regexp_extract(m, 'Question ([0-9]+)', 1) AS q, regexp_extract(m, '\\(([0-9]+) marks', 1)::INT AS total FROM (SELECT path, unnest(regexp_extract_all(text, '## Question [0-9]+ \\([0-9]+ marks\\)')) AS m FROM f)), "
    "s AS (SELECT path, name, string_split(split_part(text, chr(10) || '## Footnotes', 1), chr(10) || '### ') AS p FROM f), e AS (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM s), "
    "h AS (SELECT path, i, regexp_extract(name, '^([0-9]+)', 1)::INT AS year, CASE WHEN name LIKE '%\\_DF%' ESCAPE '\\' THEN 'df' ELSE 'main' END AS sitting, regexp_extract(name, '_P([12])', 1) AS paper, regexp_extract_all(array_to_string(p[1:i - 1], ' '), '## Section ([AB])', 1)[-1] AS section, string_split(p[i], chr(10))[1] AS heading, "
    "array_to_string([x FOR x IN string_split(p[i], chr(10))[2:] IF NOT x LIKE '## %'], chr(10)) AS body FROM e), "
    "b AS (SELECT *, regexp_extract(heading, '^Q([0-9]+)', 1) AS q, regexp_extract(heading, '\\(([a-z])\\)', 1) AS letter, regexp_extract(heading, '\\(([ivx]+)\\)', 1) AS roman, nullif(split_part(heading, '— ', 2), '') AS title, split_part(body, '#### Marking-scheme note', 1) AS prose, split_part(body, '#### Marking-scheme note', 2) AS note FROM h), "
    f"k AS (SELECT *, nullif(regexp_replace(prose, {_STRIP}), '') AS solution_text, nullif(regexp_replace(note, {_STRIP}), '') AS scheme, nullif(regexp_extract(prose, '\\*\\*Topic:\\*\\* ([a-z]*)\\.', 1), '') AS own_topic, regexp_extract_all(prose, '\\.\\./\\.\\./[A-Z]+_([A-Za-z_]+)/[a-z]+\\.md', 1) AS strands, regexp_extract_all(prose, '\\.\\./\\.\\./[A-Za-z_]+/([a-z]+)\\.md', 1) AS slugs, "
    f"nullif(concat_ws(chr(10) || chr(10), title, nullif(regexp_replace(regexp_replace(split_part(prose, '#### Step', 1), '(?m)^(> |\\*\\*Topic|See ).*$', '', 'g'), {_STRIP}), '')), '') AS question_text, nullif(array_to_string(regexp_extract_all(prose, '(?m)^> (.*)$', 1), chr(10)), '') AS pitfalls, nullif(regexp_extract(prose, '\\(([0-9]+) marks', 1), '')::INT AS own FROM b), "
    "d AS (SELECT *, [x FOR x, j IN slugs IF list_position(slugs, x) = j] AS u, [replace(x, '_', ' ') FOR x, j IN strands IF list_position(strands, x) = j] AS v FROM k), "
    "w AS (SELECT d.*, total, count(*) FILTER (own IS NULL) OVER g AS missing, greatest(total - coalesce(sum(own) OVER g, 0), 0) AS rest, count(*) OVER g AS parts, count(*) FILTER (own IS NULL) OVER (PARTITION BY d.path, d.q ORDER BY i) AS place, first_value(own_topic IGNORE NULLS) OVER o AS topic1, first_value(CASE WHEN len(u) > 0 THEN u END IGNORE NULLS) OVER o AS u1, first_value(CASE WHEN len(u) > 0 THEN v END IGNORE NULLS) OVER o AS v1 FROM d LEFT JOIN t ON t.path = d.path AND t.q = d.q WINDOW g AS (PARTITION BY d.path, d.q), o AS (PARTITION BY d.path, d.q ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "x AS (SELECT year || '_' || sitting || '_P' || paper || '_Q' || q || letter || roman AS part_id, year, sitting, q::INT AS question_number, letter || CASE WHEN roman <> '' THEN '(' || roman || ')' ELSE '' END AS sub_part, section, "
    "CASE WHEN total IS NULL OR own IS NOT NULL THEN own ELSE greatest(rest // missing + CASE WHEN place <= rest - rest // missing * missing THEN 1 ELSE 0 END, greatest(1, total // parts)) END::BIGINT AS marks, coalesce(own_topic, topic1) AS topic, CASE WHEN len(u) > 0 THEN u ELSE coalesce(u1, []) END AS tutorials, "
    "array_to_string(CASE WHEN len(v) > 0 THEN v ELSE coalesce(v1, []) END, '|') AS strands, question_text, solution_text, pitfalls, scheme, path FROM w) "
)


def _exam_parts(t) -> DataFrame:
    x = _solutions("")
    rows = t.conversations.select("conv_id", *(F.expr(x[n]).alias(n) for n in x), F.struct("turn", "role", "text", F.expr(x["part"]).alias("part")).alias("r"))
    files = rows.groupBy("conv_id", "path", "name").agg(F.array_sort(F.collect_list("r")).alias("l"))
    text = F.concat(F.array(*map(F.lit, _PAPER)), F.transform("l", lambda r: r.part), F.array(*map(F.lit, _CLOSE)))
    return markdown.parse_parts(files.select("path", "name", F.array_join(text, "\n").alias("text")))


@R.query("exam_parts", _PARTS + "SELECT part_id, year, sitting, question_number, sub_part, section, marks, topic, array_to_string(tutorials, '|') AS tutorials, strands, question_text, solution_text, pitfalls, scheme, path FROM x")
def exam_parts(t) -> DataFrame:
    """Parts of solutions files with inherited topics and references, and their shares of the marks."""
    return _exam_parts(t).select(
        "part_id", "year", "sitting", "question_number", "sub_part", "section", "marks", "topic", F.array_join("tutorials_referenced", "|").alias("tutorials"), F.array_join("secondary_topics", "|").alias("strands"),
        "question_text", "solution_text", c("common_pitfalls").alias("pitfalls"), c("marking_scheme_note").alias("scheme"), c("source_path").alias("path"),
    )


@R.query(
    "golden_references",
    _PARTS + ", z AS (SELECT part_id, question_text, sitting, year, len(tutorials) AS n, unnest(tutorials) AS expected_slug FROM x WHERE question_text IS NOT NULL), l AS (SELECT expected_slug FROM z GROUP BY 1 HAVING count(*) > 1) "
    "SELECT 'xref-' || part_id || '-' || expected_slug AS eval_id, question_text, expected_slug, CASE WHEN sitting = 'df' OR n > 2 THEN 'auto-hard' WHEN year >= 2022 OR n >= 2 THEN 'auto-medium' ELSE 'auto-easy' END AS difficulty FROM z JOIN l USING (expected_slug)",
)
def golden_references(t) -> DataFrame:
    """A golden row for each part and tutorial that it cites, of tutorials cited more than once."""
    parts = _exam_parts(t)
    cited = parts.where("question_text <> ''").select(F.explode("tutorials_referenced").alias("slug")).groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")
    return markdown.reference_rows(parts, cited.select("slug")).select("eval_id", "question_text", "expected_slug", "difficulty")
