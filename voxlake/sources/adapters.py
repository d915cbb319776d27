"""Star-schema tables seen as voxels, pixels, frames, atoms and samples.

All are declared plans, so a filter on a view or an atom reaches the scan's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str, side: int = 12) -> DataFrame:
    """i, j, k, v: a cube of summed quantities."""
    cell = [(F.col(c) % side).cast("int").alias(n) for c, n in (("l_partkey", "i"), ("l_suppkey", "j"), ("l_orderkey", "k"))]
    return table(spark, sf_dir, "lineitem").groupBy(*cell).agg(F.sum("l_quantity").cast("long").alias("v"))


def pixels(spark: SparkSession, sf_dir: str, side: int = 16) -> DataFrame:
    """view, r, c, v: an image for each line number."""
    cell = [(F.col(c) % side).cast("int").alias(n) for c, n in (("l_partkey", "r"), ("l_orderkey", "c"))]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("view"), *cell).agg(F.sum("l_quantity").cast("long").alias("v"))


def frames(spark: SparkSession, sf_dir: str, side: int = 16, n: int = 3) -> DataFrame:
    """frame, view, r, c, v: repeated exposures of each view."""
    cell = [(F.col(c) % m).cast("int").alias(a) for c, m, a in (("l_suppkey", n, "frame"), ("l_partkey", side, "r"), ("l_orderkey", side, "c"))]
    return table(spark, sf_dir, "lineitem").groupBy(cell[0], F.col("l_linenumber").cast("int").alias("view"), *cell[1:]).agg(F.sum("l_quantity").cast("long").alias("v"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """atom_id, x, y, z, species (0 to 2)."""
    at = [(F.col("embedding")[n].cast("double") * 10).alias(c) for n, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("atom_id"), *at, (F.col("label") % 3).cast("int").alias("species"))


def angles(spark: SparkSession, n: int = 7) -> DataFrame:
    """view, phi, theta, psi in degrees: a single tilt axis."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("view"), F.lit(0.0).alias("phi"), (F.col("id") * 10.0 - 30.0).alias("theta"), F.lit(0.0).alias("psi"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x: one number for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))
