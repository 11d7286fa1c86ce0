"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them back as the
next stage's ``docs``.  All stages but the last return the columns of
``documents``.

Defined cases, in every stage: rows of null or repeated ids stand each for itself,
null texts count as empty, texts of any length are taken whole, further columns
go along whatever their names, and an empty table gives an empty one.  The first
stage drops texts of few words, so empty ones go there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, packing, quality, similar, toxicity
from quarry.llm.storage import materialize
from quarry.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 rejects go."""
    ship(spark)
    return quality.keep_rows(docs, quality.V1)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go; the lexicon is learned from the labels of what is left.

    Without labels of both kinds no document goes.
    """
    ship(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays: that of the smallest id.

    Null ids come last; of rows of one id and text one stays, of one id and several
    texts of a group the least by hash.  Pairs are found by one-wildcard variants of
    the segments of wide SimHash fingerprints, and verified exactly.
    """
    ship(spark)
    return similar.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times; null is a source of its own."""
    ship(spark)
    return mixing.repeat_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens; an empty text is its end id."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_texts), ("near duplicates", near_duplicates), ("source mix", source_mix), ("packing", packed)]

#: Toxicity, near-duplicates and packing are not expressible in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
