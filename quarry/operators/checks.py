"""Data-quality checks: rules that rows break, duplicates, dangling links, placeholders, and health."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import is_placeholder


def diagnostics(df: DataFrame, key: str, tests: dict[str, Column], severity: dict[str, str] | None = None) -> DataFrame:
    """(key, rule, severity) of each rule that a row breaks; unknown counts as not broken."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))
    level = reduce(lambda out, s: F.when(F.col("rule") == s[0], s[1]).otherwise(out), (severity or {}).items(), F.lit("ERROR"))
    return df.select(key, F.explode(broken).alias("rule")).withColumn("severity", level)


def required(columns: Sequence[str]) -> dict[str, Column]:
    return {f"missing_{c}": F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns}


def placeholders(columns: Sequence[str]) -> dict[str, Column]:
    return {f"placeholder_{c}": is_placeholder(F.col(c).cast("string")) for c in columns}


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(df: DataFrame, key: str, links: Sequence[str], known: DataFrame, known_key: str) -> DataFrame:
    """(key, field, link) of links to rows that do not exist."""
    each = [df.select(key, F.lit(c).alias("field"), F.explode(c).alias("link")) for c in links]
    return reduce(DataFrame.unionByName, each).join(known.select(F.col(known_key).alias("link")), "link", "left_anti").select(key, "field", "link")


def has_heading(text: Column, title: Column) -> Column:
    """Whether a line is the first-level heading of this title."""
    return F.array_contains(F.transform(F.split(text, "\n"), lambda x: F.rtrim(x)), F.concat(F.lit("# "), title))


HEADING, FENCE = "## Cross-references (machine-readable)", r"(?s)```yaml\n(.*?)\n```"


def _reference_errors(block: str | None) -> list[str]:
    """What is wrong with a block of cross-references, as short codes with the place of the entry."""
    import yaml

    if block is None:
        return ["no_block"]
    try:
        parsed = yaml.safe_load(block)
    except yaml.YAMLError:
        return ["not_yaml"]
    if not isinstance(parsed, dict) or not isinstance(entries := parsed.get("cross_references"), list):
        return ["no_list"]
    out = []
    for i, e in enumerate(entries):
        if not isinstance(e, dict):
            out.append(f"{i}:not_a_mapping")
            continue
        part, tutorials = e.get("part_id"), e.get("tutorials")
        if not (isinstance(part, str) and part.strip()):
            out.append(f"{i}:no_part_id")
        if tutorials is not None and not (isinstance(tutorials, list) and all(isinstance(t, str) for t in tutorials)):
            out.append(f"{i}:tutorials")
    return out


def reference_errors(text: Column) -> Column:
    """Errors of the last YAML block of a solutions file; none for a valid one."""

    def run(blocks: pd.Series) -> pd.Series:
        return pd.Series([_reference_errors(b) for b in blocks])

    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    last = F.get(blocks, F.size(blocks) - 1)
    return F.when(~F.contains(F.coalesce(text, F.lit("")), F.lit(HEADING)), F.array(F.lit("no_heading"))).otherwise(F.pandas_udf(run, "array<string>")(last))


def file_report(files: DataFrame, category: Column) -> DataFrame:
    """By category of file: how many were checked and how many skipped, and how many errors the checked ones have."""
    kind = files.withColumn("category", F.coalesce(category, F.lit("other")))
    checked = F.col("category") == "exam_solutions"
    errors = F.when(checked, F.size(reference_errors(F.col("text")))).otherwise(0)
    return kind.withColumn("e", errors).groupBy("category").agg(F.count_if(checked).alias("checked"), F.count_if(~checked).alias("skipped"), F.sum("e").alias("errors"), F.count_if(F.col("e") > 0).alias("bad_files"))


def health(checks: DataFrame) -> DataFrame:
    """One row: ok if all checks are healthy or skipped, and the first that fails in their order."""
    bad = ~F.col("status").isin("ok", "skipped")
    return checks.agg(F.bool_and(~bad).alias("ok"), F.min_by("name", F.when(bad, F.col("position"))).alias("first_failing"), F.count_if(bad).alias("n_failing"))
