"""Files and tables in the folder that driver and executors share.

The folder is named by ``spark.checkpoint.dir``.  Tables go through Spark's own
writers; binary archives go through ``pyarrow.fs``, which opens the same URIs.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    A local master without the setting gets one fresh folder; on a cluster the
    setting is required, since local folders are not shared there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(context, "_quarry_folder"):
        context._quarry_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return context._quarry_folder


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there.

    It cuts the lineage: what follows survives lost executors without running
    what came before again.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        files, path = fs.FileSystem.from_uri(table._quarry_path)
        files.delete_dir(path)


@contextlib.contextmanager
def create(uri: str):
    """A binary file under ``uri``, complete or absent.

    A task writes under a name of its own attempt and renames at the end, so a
    repeated or speculative attempt replaces the file by an equal one.
    """
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part, compression=None, buffer_size=1 << 20) as out:
        yield out
    files.move(part, path)


def open_at(uri: str):
    """A seekable binary reader."""
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)
