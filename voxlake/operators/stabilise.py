"""The exact inverse of variance stabilisation, read from tables by an interpolation join.

A table's points become segments, a segment goes to the buckets that it crosses, and a value meets the segments of its
own bucket: an equi-join for a range.  Tables are small, values may be many.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a curve's range.
BUCKETS = 256


def interpolated(values: DataFrame, curves: DataFrame, by: list[str], x: str = "v", out: str = "y") -> DataFrame:
    """``values`` with ``out``: the curve (``by``, x, y) of its group at ``x``, linear between points and beyond both
    ends; null where the group has no two points, or for a value that isn't finite."""
    w = Window.partitionBy(*by).orderBy("x")
    seg = curves.select(*by, "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.row_number().over(w).alias("_n")).where("x1 > x")
    ends = curves.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    bucket = lambda v: F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS))).cast("int")
    seg = seg.join(ends, by).withColumn("_b", F.explode(F.sequence(bucket(F.col("x")), bucket(F.col("x1")))))
    seg = seg.select(*by, "_b", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("x1").alias("_x1"), F.col("y1").alias("_y1"), (F.col("x") == F.col("_lo")).alias("_first"), (F.col("x1") == F.col("_hi")).alias("_last"))
    v = F.col(x)
    placed = values.join(ends, by, "left").withColumn("_b", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), bucket(v))).drop("_lo", "_hi")
    fits = ((v >= F.col("_x")) | F.col("_first")) & ((v < F.col("_x1")) | F.col("_last"))
    names = [*by, "_b"]
    right = seg.toDF(*[f"_k{c}" if c in names else c for c in seg.columns])
    same = [placed[c] == right[f"_k{c}"] for c in names]
    joined = placed.join(right, [*same, fits], "left")
    line = F.col("_y") + (v - F.col("_x")) * (F.col("_y1") - F.col("_y")) / (F.col("_x1") - F.col("_x"))
    return joined.select(*values.columns, line.alias(out))


def _curves(noise: DataFrame, general: DataFrame) -> DataFrame:
    """view, x, y: for each view the table's two columns around its sigma, blended."""
    sigmas = general.select("sigma").distinct().withColumn("_n", F.row_number().over(Window.orderBy("sigma")) - 1)  # the table's columns
    count = F.count(F.lit(1)).over(Window.partitionBy("view"))
    upto = F.sum(F.when(F.col("sigma") <= F.col("_s"), 1).otherwise(0)).over(Window.partitionBy("view"))
    near = noise.select("view", "_s").crossJoin(F.broadcast(sigmas)).withColumn("_up", F.least(F.greatest(upto, F.lit(1)), count - 1))
    both = near.groupBy("view", "_s").agg(F.max(F.when(F.col("_n") == F.col("_up") - 1, F.col("sigma"))).alias("_a"), F.max(F.when(F.col("_n") == F.col("_up"), F.col("sigma"))).alias("_z"))
    weight = (F.col("_s") - F.col("_a")) / (F.col("_z") - F.col("_a"))
    share = F.when(F.col("sigma") == F.col("_a"), 1 - weight).otherwise(weight)
    rows = both.join(F.broadcast(general), (F.col("sigma") == F.col("_a")) | (F.col("sigma") == F.col("_z")))
    return rows.groupBy("view", F.col("ez").alias("y")).agg(F.sum(share * F.col("efz")).alias("x"))


def inverse(px: DataFrame, noise: DataFrame, general: DataFrame, plain: DataFrame) -> DataFrame:
    """``px`` (view, v and others) with v carried back; ``noise`` has sigma, alpha and mean for each view.

    ``general`` (sigma, ez, efz) has the expected transform of each mean at some sigmas, ``plain`` (ez, efz) that
    without Gaussian noise; sigma is in units of alpha.  Between two sigmas their columns are blended; over the largest,
    and over a curve's end, the plain inverse less sigma squared stands in.
    """
    ratio = noise.select("view", (F.col("sigma") / F.col("alpha")).alias("_s"), "alpha", "mean")
    if ratio.where("_s < 0").limit(1).count():
        raise ValueError("sigma must not be negative")
    most = general.agg(F.max("sigma").alias("_most"))
    ratio = ratio.crossJoin(F.broadcast(most))  # one row
    flat = ratio.select("view").crossJoin(F.broadcast(plain)).select("view", F.col("efz").alias("x"), F.col("ez").alias("y"))  # a column of the table
    curves = _curves(ratio.where("_s > 0 AND _s <= _most"), general)
    v = F.col("v")
    both = interpolated(interpolated(px, flat, ["view"], out="_plain"), curves, ["view"], out="_own")
    top = plain.agg(F.max("efz").alias("_top"))
    ends = curves.groupBy("view").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    rows = both.join(F.broadcast(ratio), "view").join(F.broadcast(ends), "view", "left").crossJoin(F.broadcast(top))  # a row for each view
    exact = F.when(v < 2 * math.sqrt(3 / 8), 0.0).when(v > F.col("_top"), v * v / 4 - 0.125).otherwise(F.col("_plain"))
    less = exact - F.col("_s") * F.col("_s")
    found = F.when(F.col("_s") > F.col("_most"), F.greatest(less, F.lit(0.0))).when(F.col("_s") == 0, exact)
    found = found.when(v < F.col("_lo"), 0.0).when(v > F.col("_hi"), less).otherwise(F.col("_own"))
    return rows.select(*[c for c in px.columns if c != "v"], (found * F.col("alpha") + F.col("mean")).alias("v"))
