"""Recomputing what is stale: outputs that are missing, older than their input, or older than the rules.

Times are those of the files, which Spark's readers give with the rows.  Outputs are a
table with a folder for each name, and only the folders of stale names are written
again (dynamic partition overwrite), so a name's output is the old one or the new one.

Defined cases: an output as old as the rules is stale, one as old as its input is not;
without a rules file only inputs count; an output without an input is an orphan and
stays; no inputs write nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.versions import materialize


def stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def modified(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, path, at) of the files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(stem(F.col("path")).alias("name"), "path", F.col("modificationTime").alias("at"))


def staleness(inputs: DataFrame, outputs: DataFrame | None, rules_at: Column) -> DataFrame:
    """(name, state) from (name, at): new, rules (older than they), input (older than it), fresh, or orphan."""
    if outputs is None:
        return inputs.select("name", F.lit("new").alias("state"))
    both = inputs.select("name", F.col("at").alias("input_at")).join(outputs.select("name", F.col("at").alias("output_at")), "name", "full_outer")
    state = (
        F.when(F.col("input_at").isNull(), "orphan").when(F.col("output_at").isNull(), "new")
        .when(F.col("output_at") <= rules_at, "rules").when(F.col("output_at") < F.col("input_at"), "input").otherwise("fresh")
    )
    return both.select("name", state.alias("state"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def recompute(spark: SparkSession, inputs: str, outputs: str, rules: str, transform: Callable[[DataFrame], DataFrame], glob: str = "*") -> dict[str, int]:
    """Writes the stale outputs again; returns how many names are in each state.

    ``transform`` takes (name, path, text) of the stale inputs and returns rows with
    their ``name``.
    """
    files = modified(spark, inputs, glob)
    # One small file, or none.
    rules_at = modified(spark, rules).agg(F.max("at")).first()[0] if _exists(spark, rules) else None
    made = None
    if _exists(spark, outputs):
        written = spark.read.parquet(outputs)
        made = written.groupBy("name").agg(F.min("_metadata.file_modification_time").alias("at"))
    states = materialize(staleness(files, made, F.lit(rules_at).cast("timestamp")), "staleness")
    counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    stale = states.where(F.col("state").isin("new", "rules", "input")).select("name")
    if sum(counts.get(s, 0) for s in ("new", "rules", "input")):
        texts = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(inputs)
        texts = texts.select(stem(F.col("path")).alias("name"), "path", F.decode("content", "UTF-8").alias("text"))
        out = transform(texts.join(stale, "name", "left_semi"))
        out.repartition("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(outputs)
    return counts
