"""Frames as a stream: the frame sum of each view, kept up to date as files of frames arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregate import frame_sum

SCHEMA = "frame int, view int, r int, c int, v double"


def frame_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def running_sum(frames: DataFrame) -> DataFrame:
    """view, r, c, v; state is one number a pixel, so it is bounded by the detector and its views."""
    return frame_sum(frames)
