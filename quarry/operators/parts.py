"""The two analytical views over exam parts: one row per part, and one per part and cited tutorial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import text as T

QUESTION = ("year", "paper", "sitting", "question_number")


def row_strand(references: Column, topic: Column) -> Column:
    """The first strand that the references (comma-joined) or the topic name, else null."""
    joined = F.array_join(references, ",")
    return T.first_match([(T.contains_any(joined, [f"{s}-"]) | T.contains_any(topic, t), s) for s, t in rules.STRAND_TOPICS.items()])


def with_sibling_fallback(df: DataFrame, own: Column, by: tuple[str, ...], out: str, default: str = "uncategorised") -> DataFrame:
    """``out``: the row's own value, else the largest of its group, else the default."""
    df = df.withColumn("_own", own)
    return df.withColumn(out, F.coalesce("_own", F.max("_own").over(W.partitionBy(*by)), F.lit(default))).drop("_own")


def parts_flat(parts: DataFrame) -> DataFrame:
    """One row per part with strand, keys, counts and flags."""
    noted = lambda c: T.contains_any(F.col(c), ["load-bearing"])
    asked = F.lower(F.coalesce("question_text", F.lit("")))
    flat = with_sibling_fallback(parts, row_strand(F.col("tutorials_referenced"), F.col("topic")), QUESTION, "topic_strand")
    return flat.withColumnRenamed("topic", "topic_raw").withColumns(
        {
            "paper_strand_key": F.concat(F.col("paper").cast("string"), F.lit(":"), F.col("topic_strand")),
            "tutorial_count": F.coalesce(F.size("tutorials_referenced"), F.lit(0)),
            "is_load_bearing": noted("common_pitfalls") | noted("marking_scheme_note") | noted("solution_text"),
            "has_proof_request": asked.startswith("prove ") | T.contains_any(asked, ["verify", "show that"]),
            "is_recent": F.col("year") >= 2021,
        }
    )


def parts_by_tutorial(parts: DataFrame) -> DataFrame:
    """One row per part and cited tutorial; parts without any drop out."""
    keep = ["part_id", *QUESTION, "sub_part", "section", "marks", F.col("topic").alias("topic_raw"), "source_path", "loaded_at"]
    each = parts.select(*keep, F.explode("tutorials_referenced").alias("tutorial_slug"))
    return each.withColumn("tutorial_strand", T.strand_by_prefix(F.col("tutorial_slug"), list(rules.STRAND_TOPICS), F.lit("uncategorised")))
