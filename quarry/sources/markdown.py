"""Markdown and front matter to rows: line tables, part files, summary tables, tutorial rows.

Files are read whole, cut to lines in Spark, and their structure is found by
windows over the lines of a file; only YAML itself is parsed in Python.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import ordered


def read_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(path, name, folder, text) of all files below a folder.

    Spark's readers pass over empty files and names that begin with an underscore or a
    dot, as summaries do; those are listed by name and opened in tasks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    both = files.select("path", F.decode("content", "UTF-8").alias("text")).unionByName(_passed_over(spark, folder, glob))
    parts = F.split("path", "/")
    return both.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), "text")


def _passed_over(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed, found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().getName()
        if fnmatch.fnmatchcase(name, glob) and (name[0] in "_." or not status.getLen()) and not name.endswith((".tmp", ".crc")):
            found.append((status.getPath().toString(),))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                files, name = _open(path)
                with files.open_input_stream(name, compression=None) as f:
                    yield pd.DataFrame({"path": [path], "text": [f.read().decode("utf-8", "replace")]})

    names = spark.createDataFrame(found, "path string").repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism)))
    return names.mapInPandas(run, "path string, text string")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


SKIP_REASONS = ("summary", "readme", "no_front_matter", "no_slug")


def skip_reason(name: Column, text: Column, slug: Column) -> Column:
    """Why a file is no tutorial, or null."""
    return T.first_match([(name.startswith("_SUMMARY-"), "summary"), (name == "README.md", "readme"), (~text.startswith("---"), "no_front_matter"), (slug.isNull() | (F.trim(slug) == ""), "no_slug")])


def walk(files: DataFrame) -> tuple[DataFrame, Observation]:
    """The tutorials among ``files`` with their slug, and what one pass over them counts.

    The observation has ``walked``, ``parsed`` and the number of skipped files by
    reason, as soon as the rows have been read once.
    """
    slug = F.nullif(F.trim(F.regexp_extract(F.coalesce(front_matter(F.col("text")), F.lit("")), r"(?m)^slug:[ \t]*['\"]?([^'\"\r\n]*)", 1)), F.lit(""))
    marked = files.withColumn("slug", slug).withColumn("skipped", skip_reason(F.col("name"), F.col("text"), F.col("slug")))
    seen = Observation()
    sums = [F.count_if(F.col("skipped") == r).alias(r) for r in SKIP_REASONS]
    counted = marked.observe(seen, F.count("*").alias("walked"), F.count_if(F.col("skipped").isNull()).alias("parsed"), *sums)
    return counted.where("skipped IS NULL").drop("skipped"), seen


def lines(files: DataFrame) -> DataFrame:
    """(path, n, line) of each line; n counts from 0."""
    return files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))


HEADING = r"(?i)^###\s+Q(\d+)(?:\(([a-z])\))?(?:\(([ivx]+)\))?\s*(?:—|–|-)?\s*(.*)$"
QUESTION = r"(?i)^##\s+Question\s+(\d+)\s*\((\d+)\s*marks?\)"
SECTION = r"(?i)^##\s+Section\s+([AB])\b"
LINK = r"\[[^\]]+\]\(\.\./\.\./([A-Z]+_[^/]+)/([^)]+)\.md\)"
END = r"^\*\[End of|^## Footnotes"
OPENER = r"^> \*\*(🎯|🚨)"


def strip_block(text: Column, begin: str, end: str) -> Column:
    """A text without the generated block between two marks, so that writing it again changes nothing."""
    return F.regexp_replace(text, rf"(?s)\n*{begin}.*?{end}\n*", "\n")


#: Heading of the generated block of cross-references.
CROSS_REFERENCES = "## Cross-references (machine-readable)"


def without_references(text: Column) -> Column:
    """A text up to its last block of cross-references and the rule above it, with one line break at its end."""
    at = F.length(text) - F.length(F.substring_index(text, CROSS_REFERENCES, -1)) - len(CROSS_REFERENCES)
    head = F.rtrim(F.substring(text, F.lit(1), at.cast("int")), F.lit(" \t\r\n\f\x0b"))
    head = F.rtrim(F.regexp_replace(head, r"---$", ""), F.lit(" \t\r\n\f\x0b"))
    return F.concat(F.rtrim(F.when(F.contains(text, F.lit(CROSS_REFERENCES)), head).otherwise(text), F.lit(" \t\r\n\f\x0b")), F.lit("\n"))


def render_references(parts: DataFrame) -> DataFrame:
    """(path, block) from (path, place, part_id, topic, tutorials): the block of each file, its parts in order of place."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            blocks = []
            for rows in b["rows"]:
                entries = [{"part_id": r["part_id"], "topic": r["topic"], "tutorials": list(r["tutorials"] if r["tutorials"] is not None else [])} for r in rows]
                text = yaml.safe_dump({"cross_references": entries}, sort_keys=False, allow_unicode=True, default_flow_style=False)
                blocks.append(f"\n---\n\n{CROSS_REFERENCES}\n\n```yaml\n{text}```\n")
            yield pd.DataFrame({"path": b["path"], "block": blocks})

    grouped = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "part_id", "topic", "tutorials"))).alias("rows"))
    return grouped.mapInPandas(run, "path string, block string")


def with_references(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, new_text, changed) of the files that have a block; a second run changes none."""
    new = F.concat(without_references(F.col("text")), "block")
    return files.join(blocks, "path").select("path", new.alias("new_text"), (new != F.col("text")).alias("changed"))


def write_back(rendered: DataFrame) -> int:
    """Rewrites the changed files in their places, each complete or as it was; returns how many."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["new_text"], strict=True):
                files, name = _open(path)
                part = f"{name}.{uuid.uuid4().hex}.tmp"
                with files.open_output_stream(part, compression=None) as out:
                    out.write(text.encode())
                files.move(part, name)
            yield pd.DataFrame({"n": [len(b)]})

    return rendered.where("changed").select("path", "new_text").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def front_matter(text: Column) -> Column:
    """What stands between the first two --- lines, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1), F.lit(""))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---[ \t]*\r?\n?", "")


def parse_parts(files: DataFrame) -> DataFrame:
    """One row per part of the solutions files, with inherited topics and references, and marks.

    A part begins at its heading and ends at the next one or at the end of paper.
    """
    named = files.withColumn("meta", T.parse_file_name(F.col("name"))).where("meta IS NOT NULL")
    rows = lines(named.withColumn("text", body(F.col("text"))))
    stop = rows.where(F.col("line").rlike(END)).groupBy("path").agg(F.min("n").alias("stop"))
    rows = rows.join(stop, "path", "left").where(F.col("stop").isNull() | (F.col("n") < F.col("stop"))).drop("stop")
    take = lambda pattern, g: F.nullif(F.regexp_extract("line", pattern, g), F.lit(""))
    key, order = ["path"], ["n"]
    rows = rows.withColumns({"heading": F.col("line").rlike(HEADING), "section_here": F.upper(take(SECTION, 1))})
    rows = rows.withColumns({"chunk": ordered.island(F.col("heading"), key, order), "section": ordered.forward_fill(F.col("section_here"), key, order)})
    totals = rows.where(F.col("line").rlike(QUESTION)).select("path", take(QUESTION, 1).cast("int").alias("question_number"), take(QUESTION, 2).cast("int").alias("total")).dropDuplicates(["path", "question_number"])
    inside = rows.where((F.col("chunk") > 0) & ~F.col("line").rlike(QUESTION) & F.col("section_here").isNull())
    grouped = inside.groupBy("path", "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "line", "heading", "section"))).alias("l"))
    first = F.col("l")[0]
    plain = F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x.line)
    of = lambda g: F.nullif(F.regexp_extract(first.line, HEADING, g), F.lit(""))
    parts = grouped.select("path", "chunk", first.section.alias("section"), plain.alias("body"), of(1).cast("int").alias("question_number"), F.lower(of(2)).alias("letter"), F.lower(of(3)).alias("roman"), F.trim(of(4)).alias("title"))
    scheme = F.array_position(F.transform("body", lambda x: x.rlike("(?i)^####\\s+Marking-scheme")), True)
    parts = parts.withColumn("scheme", scheme).withColumn("prose", F.when(F.col("scheme") > 0, F.slice("body", F.lit(1), (F.col("scheme") - 1).cast("int"))).otherwise(F.col("body")))
    join = lambda a: F.nullif(F.trim(F.regexp_replace(F.array_join(a, "\n"), r"^\s+|\s+$", "")), F.lit(""))
    step = F.array_position(F.transform("prose", lambda x: x.startswith("#### ")), True)
    intro = F.when(step > 0, F.slice("prose", F.lit(1), (step - 1).cast("int"))).otherwise(F.col("prose"))
    asked = F.filter(intro, lambda x: ~x.rlike(r"^\*\*(Topic|Tutorials):\*\*|^> ") & ~x.rlike(LINK))
    text = F.array_join("prose", "\n")
    parts = parts.withColumns(
        {
            "topic": F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)^\*\*Topic:\*\*\s*(.*?)\s*$", 1), r"\.$", "")), F.lit("")),
            "tutorials_referenced": F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(2))),
            "secondary_topics": F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), T.folder_title)),
            "question_text": F.nullif(F.concat_ws("\n\n", "title", join(asked)), F.lit("")),
            "solution_text": join(F.col("prose")),
            "marking_scheme_note": F.when(F.col("scheme") > 0, join(F.slice("body", (F.col("scheme") + 1).cast("int"), F.greatest(F.size("body") - F.col("scheme").cast("int"), F.lit(0))))),
            "common_pitfalls": callouts(F.col("prose")),
        }
    ).join(named.select("path", "meta"), "path")
    marks = T.first_int(F.concat_ws("\n", "question_text", "solution_text"), r"\((\d+)\s*marks?\)")
    parts = parts.withColumn("own_marks", marks).join(totals, ["path", "question_number"], "left")
    q = ["path", "question_number"]
    listed = F.when(F.size("tutorials_referenced") > 0, F.struct("tutorials_referenced", "secondary_topics"))
    donor = ordered.first_known(listed, q, ["chunk"])
    return parts.select(
        T.part_id(F.col("meta.year"), F.col("meta.sitting"), F.col("meta.paper"), F.col("question_number"), F.col("letter"), F.col("roman")).alias("part_id"),
        "meta.year", "meta.paper", "meta.sitting", "question_number", T.sub_part(F.col("letter"), F.col("roman")).alias("sub_part"),
        F.coalesce("section", F.when(F.col("question_number") <= 6, "A").otherwise("B")).alias("section"),
        F.when(F.col("total").isNull(), F.col("own_marks").cast("long")).otherwise(ordered.distribute(F.col("total"), F.col("own_marks"), q, ["chunk"])).alias("marks"),
        ordered.first_known(F.col("topic"), q, ["chunk"]).alias("topic"),
        F.coalesce(F.when(F.size("secondary_topics") > 0, F.col("secondary_topics")), donor.secondary_topics, F.col("secondary_topics")).alias("secondary_topics"),
        F.coalesce(donor.tutorials_referenced, F.col("tutorials_referenced")).alias("tutorials_referenced"),
        "question_text", "solution_text", "common_pitfalls", "marking_scheme_note", F.col("path").alias("source_path"),
    )


def callouts(prose: Column) -> Column:
    """The marked block quotes, each from its opener to a bare > or a line outside quotes; blank lines between."""
    bare = lambda x: F.rtrim(F.regexp_replace(x, r"^[> ]+", ""))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("on"))

    def step(a: Column, x: Column) -> Column:
        opens, quoted = x.rlike(OPENER), x.startswith(">") & (bare(x) != "")
        add = F.when(a.out == "", bare(x)).otherwise(F.concat(a.out, F.when(opens, F.lit("\n\n")).otherwise(F.lit("\n")), bare(x)))
        return F.struct(F.when(opens | (a.on & quoted), add).otherwise(a.out).alias("out"), (opens | (a.on & quoted)).alias("on"))

    return F.nullif(F.aggregate(prose, start, step, lambda a: a.out), F.lit(""))


def tables(files: DataFrame, heading: str) -> DataFrame:
    """(path, row, cells) of the first table after the heading that the pattern matches, without its header.

    A file is one value, so its lines are cut where it is and nothing is shuffled.  Files
    without such a table come to an empty list: a filter here would be pushed down and
    do all of its steps again.
    """
    at = lambda test, value=True: F.array_position(F.transform("l", test), value).cast("int").alias("at")
    since = F.slice("l", F.when(F.col("at") > 0, F.col("at")).otherwise(F.size("l") + 1), F.size("l")).alias("l")
    before = F.when(F.col("at") > 0, F.slice("l", F.lit(1), F.col("at") - 1)).otherwise(F.col("l")).alias("l")
    row, rule = r"^\s*\|.*\|\s*$", r"^\s*\|[\s:|-]+\|\s*$"
    step = files.select("path", F.split("text", r"\r?\n").alias("l"))
    step = step.select("path", "l", at(lambda x: x.rlike(heading))).select("path", since).select("path", F.slice("l", F.lit(2), F.size("l")).alias("l"))
    step = step.select("path", "l", at(lambda x: x.startswith("## "))).select("path", before)
    step = step.select("path", "l", at(lambda x: x.rlike(row))).select("path", since)
    step = step.select("path", "l", at(lambda x: x.rlike(row), False)).select("path", before)
    data = step.select("path", F.posexplode_outer(F.filter("l", lambda x: ~x.rlike(rule))).alias("row", "line")).where("row > 0")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return data.select("path", "row", cells.alias("cells"))


def top_tutorials(table: DataFrame) -> DataFrame:
    """rank, tutorials (back-ticked names, a/b/c expanded), citations and what is tested."""
    cell = lambda k: F.get("cells", F.lit(k))
    slugs = F.filter(F.transform(F.flatten(F.transform(F.regexp_extract_all(cell(1), F.lit("`([^`]+)`"), F.lit(1)), lambda x: F.split(x, "/"))), lambda x: F.trim(x)), lambda s: s != "")
    return table.select("path", "row", T.first_int(cell(0), r"(\d+)").alias("rank"), F.get(slugs, F.lit(0)).alias("tutorial"), slugs.alias("tutorials"), T.first_int(cell(2), r"(\d+)").alias("citations"), F.nullif(cell(3), F.lit("")).alias("what_it_tests"))


def time_split(table: DataFrame) -> DataFrame:
    cell = lambda k: F.get("cells", F.lit(k))
    return table.select("path", "row", F.nullif(cell(0), F.lit("")).alias("activity"), F.nullif(cell(1), F.lit("")).alias("time_text"), T.first_int(cell(1), r"(\d+)\s*(?:min|m)").alias("minutes"), cell(2).alias("why"))


def repair_yaml(text: Column) -> Column:
    """List items that begin with a bare pipe become quoted strings; genuine block scalars stay."""
    return F.regexp_replace(text, r"(?m)^(\s*-\s+)(\|(?![+-]?[0-9]?[ \t]*$)[^'\n]*)$", "$1'$2'")


TUTORIAL = (
    "path string, slug string, video_id string, title string, paper string, topic string, subtopic string, sequence_number int, keywords array<string>, phrasings array<string>, techniques array<string>, "
    "course_levels array<string>, prerequisites array<string>, forward_links array<string>, xref array<string>, warnings array<string>, syllabus_strand string, syllabus_section string, syllabus_reference string, error string"
)


def _listed(v) -> list[str]:
    return [] if v is None else [str(x) for x in v] if isinstance(v, list) else [str(v)]


def _tutorial(path: str, raw: str | None) -> dict:
    import yaml

    try:
        fm = yaml.safe_load(raw or "") or {}
    except yaml.YAMLError as e:
        return {"path": path, "error": f"yaml: {e.__class__.__name__}"}
    if not isinstance(fm, dict):
        return {"path": path, "error": "not a mapping"}
    syllabus = fm.get("syllabus")
    syllabus = next(iter(syllabus), None) if isinstance(syllabus, list) else syllabus
    syllabus = syllabus if isinstance(syllabus, dict) else {}
    text = lambda v: None if v is None else str(v)
    number = str(fm.get("sequence_number", ""))
    return {
        "path": path, **{k: text(fm.get(k)) for k in ("slug", "video_id", "title", "paper", "topic", "subtopic")}, "sequence_number": int(number) if number.isdigit() else None,
        "keywords": _listed(fm.get("keywords")), "phrasings": _listed(fm.get("common_student_phrasings")), "techniques": list(dict.fromkeys(_listed(fm.get("techniques_taught")) + _listed(fm.get("techniques_used")))),
        **{k: _listed(fm.get(k)) for k in ("course_levels", "prerequisites", "forward_links", "xref")}, "warnings": _listed(fm.get("content_warnings")),
        "syllabus_strand": text(syllabus.get("strand")), "syllabus_section": text(syllabus.get("section")), "syllabus_reference": text(syllabus.get("reference") or syllabus.get("notes") or "; ".join(_listed(syllabus.get("learning_outcomes"))) or None), "error": None,
    }


def tutorial_rows(files: DataFrame, cap: int = 4000) -> DataFrame:
    """One row per tutorial file with its searchable text; files without front matter or slug have an ``error``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in TUTORIAL.split(", ")]
        for b in batches:
            parsed = pd.DataFrame([_tutorial(p, y) for p, y in zip(b["path"], b["yaml"], strict=True)], columns=names).astype(object).where(lambda d: d.notna(), None)
            yield parsed.assign(body=b["body"])

    halves = files.select("path", repair_yaml(front_matter(F.col("text"))).alias("yaml"), body(F.col("text")).alias("body"))
    parsed = halves.mapInPandas(run, TUTORIAL + ", body string")
    searchable = T.join_capped(F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("phrasings", F.array().cast("array<string>"))), cap)
    error = F.coalesce("error", F.when(F.col("slug").isNull(), "no_slug"))
    return parsed.withColumns({"title_plus_phrasings": searchable, "error": error})


def phrasing_rows(tutorials: DataFrame) -> DataFrame:
    """Golden rows from phrasings: one per distinct phrasing of a slug, numbered in order."""
    each = tutorials.where("error IS NULL").select("slug", "topic", F.posexplode(F.array_distinct(F.transform("phrasings", lambda x: F.trim(x)))).alias("i", "question_text")).where("question_text <> ''")
    number = F.lpad((F.col("i") + 1).cast("string"), 3, "0")
    return each.select(F.concat_ws("-", F.lit("phr"), "slug", number).alias("eval_id"), "question_text", F.col("slug").alias("expected_slug"), F.lit("phrasings").alias("source"), T.phrasing_difficulty(F.col("question_text"), F.col("topic")).alias("difficulty"))


def reference_rows(parts: DataFrame, slugs: DataFrame) -> DataFrame:
    """Golden rows from cross-references: one per part and known slug that it cites."""
    asked = parts.where("question_text IS NOT NULL AND question_text <> ''").select("part_id", "question_text", "sitting", "year", F.size("tutorials_referenced").alias("n_refs"), F.explode("tutorials_referenced").alias("expected_slug"))
    known = asked.join(slugs.select(F.col("slug").alias("expected_slug")).distinct(), "expected_slug", "left_semi")
    return known.select(F.concat_ws("-", F.lit("xref"), "part_id", "expected_slug").alias("eval_id"), "question_text", "expected_slug", F.lit("solution_cross_ref").alias("source"), T.reference_difficulty(F.col("sitting"), F.col("n_refs"), F.col("year")).alias("difficulty"))
