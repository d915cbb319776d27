"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    A temporary folder takes its place only where none is set and Spark runs in one process, as in tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voxlake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(spark)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for rounds that drop what they no longer need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of ``stored`` that nothing will read any more."""
    for df in tables:
        if df is not None:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
