"""Structured sources and sinks: golden sets, checkpoints, replays, prices, caches, logs, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import text as T

METADATA = "phrasing_index int, topic string, paper string, part_id string, year int, sitting string, question_number int, sub_part string, n_tutorials_for_part int"


def read_golden_csv(spark: SparkSession, path: str, subset_only: bool = False) -> DataFrame:
    """The golden set from CSV: flags in any case, metadata from JSON (nulls if malformed)."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    flag = lambda c: F.coalesce(F.upper(F.trim(F.col(c))) == "TRUE", F.lit(False)) if c in rows.columns else F.lit(False)
    out = rows.withColumns({"source_metadata": F.from_json("source_metadata", METADATA), "is_in_golden_subset": flag("is_in_golden_subset"), "is_manually_reviewed": flag("is_manually_reviewed")})
    return out.where("is_in_golden_subset") if subset_only else out


def write_golden_csv(rows: DataFrame, path: str) -> None:
    """Sorted by key, TRUE and FALSE, JSON with sorted keys."""
    shown = {f.name: F.upper(F.col(f.name).cast("string")) for f in rows.schema if f.dataType.simpleString() == "boolean"}
    nested = {f.name: F.to_json(F.struct(*(F.col(f"{f.name}.{n}").alias(n) for n in sorted(f.dataType.names)))) for f in rows.schema if f.dataType.simpleString().startswith("struct")}
    rows.withColumns({**shown, **nested}).orderBy("eval_id").write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Saved rankings, one JSON object a line, as (eval_id, rank, slug, score)."""
    lines = spark.read.schema("eval_id string, hits array<array<string>>").json(path).where("eval_id IS NOT NULL")
    each = lines.select("eval_id", F.posexplode("hits").alias("i", "hit"))
    return each.select("eval_id", (F.col("i") + 1).alias("rank"), F.col("hit")[0].alias("slug"), F.col("hit")[1].try_cast("double").alias("score"))


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Rankings from a CSV of comma-joined slugs, with falling made-up scores; the last row of a question counts."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("at", F.monotonically_increasing_id())
    last = rows.groupBy("question_text").agg(F.max_by("top_k_slugs", "at").alias("slugs"))
    each = last.select("question_text", F.posexplode(F.filter(F.transform(F.split("slugs", ","), lambda x: F.trim(x)), lambda s: s != "")).alias("i", "slug"))
    return each.select("question_text", (F.col("i") + 1).alias("rank"), "slug", F.greatest(0.95 - 0.1 * F.col("i"), F.lit(0.05)).alias("score"))


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """Cached rewrites by normalised question; rows without text only say what fired."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumns({"key": T.normalise_query(F.col("original_query")), "fired": F.upper("fired") == "TRUE", "rewritten_query": F.nullif(F.trim("rewritten_query"), F.lit(""))})


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """(strand, p1) from either column name; what is no number is left out."""
    rows = spark.read.csv(path, header=True)
    found = [F.col(f"`{n}`").try_cast("double") for n in ("precision@1", "p_at_1") if n in rows.columns]
    return rows.select("strand", F.coalesce(*found).alias("p1")).where("p1 IS NOT NULL")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value, rest) of each line that is neither blank nor a comment."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(parts[0].alias("value"), F.get(parts, F.lit(1)).alias("rest"))


def read_segments(spark: SparkSession, path: str, chunk_seconds: int = rules.AUDIO_CHUNK_SECONDS) -> DataFrame:
    """Transcript lines of chunked segment files, times moved by each chunk's offset."""
    files = spark.read.schema("chunk int, segments array<struct<start: double, end: double, text: string>>").json(path, multiLine=True)
    moved = F.transform("segments", lambda s: F.struct((s.start + F.col("chunk") * chunk_seconds).alias("start"), (s.end + F.col("chunk") * chunk_seconds).alias("end"), F.trim(s.text).alias("text")))
    each = files.select("chunk", F.explode(moved).alias("s")).select("chunk", "s.start", "s.end", "s.text")
    return each.withColumn("line", F.concat(T.clock(F.col("start")), F.lit(" "), "text"))


def appearance_index(parts: DataFrame) -> DataFrame:
    """slug to its appearances, newest first; years, papers and marks out of range drop out row by row."""
    ok = F.col("year").between(2000, 2099) & F.col("paper").between(1, 3) & F.coalesce(F.col("marks").between(0, 100), F.lit(True))
    each = parts.where(ok).select(F.explode("tutorials_referenced").alias("slug"), F.struct("year", "paper", "question_number", "sitting", "marks").alias("a"))
    return each.groupBy("slug").agg(F.sort_array(F.collect_set("a"), asc=False).alias("exam_appearances"))


def read_appearances(spark: SparkSession, path: str) -> DataFrame:
    """(slug, place, year, paper, question_number, sitting, marks) from JSON files that map slugs to appearances."""
    kind = "map<string, array<struct<year: int, paper: int, question_number: int, sitting: string, marks: int>>>"
    maps = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("slug", "all"))
    each = maps.select("slug", F.posexplode("all").alias("place", "a"))
    return each.select("slug", "place", "a.*")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, name, price) from a YAML file of two levels; comments, and what is no number, are left out."""
    text = F.regexp_replace("value", r"(?m)\s*#.*$", "")
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^([\w.-]+):[ \t]*\n((?:[ \t]+\S.*(?:\n|$))+)"), F.lit(0))).alias("block"))
    model = F.regexp_extract("block", r"^([\w.-]+):", 1)
    lines = blocks.select(model.alias("model"), F.explode(F.regexp_extract_all("block", F.lit(r"(?m)^[ \t]+([\w.-]+:[ \t]*\S+)"), F.lit(1))).alias("line"))
    parts = F.split("line", r":\s*", 2)
    return lines.select("model", parts[0].alias("name"), parts[1].try_cast("double").alias("price")).where("price IS NOT NULL")


def score_key(*texts: Column) -> Column:
    """The key of a cached embedding or rerank score."""
    return F.sha1(F.concat_ws("\u0000", *texts))


def cached_or_missing(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What the cache knows, and what is still to be computed."""
    return wanted.join(cache, key), wanted.join(cache, key, "left_anti")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def change_id(sha: Column, at: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", sha, at.cast("string")), 256), 1, 16)


PATH_RULES = [
    (r"^tutorials/[A-Z]+_[^/]+/_SUMMARY-[^/]+\.md$", "summaries"),
    (r"^tutorials/[A-Z]+_Maths_Exams/Solutions/\d{4}_(?:DF_)?P[12](?:_DF)?_solutions\.md$", "exam_solutions"),
    (r"^tutorials/SCHEMA\.md$", "schema"),
    (r"^tutorials/[A-Z]+_(?!Maths_Exams\b)[^/]+/(?!_SUMMARY-)[^/]+\.md$", "tutorials"),
]


def classify_path(path: Column) -> Column:
    """What a changed file is, or null."""
    return T.first_match([(path.rlike(p), name) for p, name in PATH_RULES])


def manifest(changes: DataFrame) -> DataFrame:
    """Changed files by category, sorted, with their number."""
    named = changes.withColumn("category", classify_path(F.col("path"))).where("category IS NOT NULL")
    return named.groupBy("category").agg(F.array_sort(F.collect_set("path")).alias("files")).withColumn("n", F.size("files"))


def freshness(tables: dict[str, DataFrame], columns: Sequence[str] = ("loaded_at",)) -> DataFrame:
    """(name, latest) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.max(columns[0]).alias("latest")).select(F.lit(name).alias("name"), "latest")
        out = one if out is None else out.unionByName(one)
    return out
