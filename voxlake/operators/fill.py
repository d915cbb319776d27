"""Laplace's equation on masked pixels, by conjugate gradients over the pixel relation.

A pixel sends its value to its four neighbours, which sum what comes: that is the product with the matrix, one shuffle
with sums before it.  The preconditioner solves each tile by itself, its surroundings held at 0, so rounds grow with the
number of tiles across a region, not with its pixels.  Inner products are one aggregate, a number for each view, and
views go on or stop by themselves.  Each round's tables are written and the ones before dropped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import forget, stored

KEYS = ["view", "r", "c"]
#: Side of a tile.
TILE = 64
SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def _sent(rows: DataFrame, *values: str) -> DataFrame:
    """``values`` of each row at its four neighbours."""
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SIDES)))
    out = rows.select(*KEYS, *values, to.alias("_to"))
    return out.select("view", (F.col("r") + F.col("_to.a")).alias("r"), (F.col("c") + F.col("_to.b")).alias("c"), *values)


def _per_view(spark, numbers: dict[int, dict[str, float]], names: list[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(v, *(float(n[k]) for k in names)) for v, n in numbers.items()], "view int, " + ", ".join(f"{k} double" for k in names)))


def _tile_solution(inside: np.ndarray, degree: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one tile's equations, to rounding."""

    def product(x):
        out = degree * x
        out[1:] -= x[:-1]
        out[:-1] -= x[1:]
        out[:, 1:] -= x[:, :-1]
        out[:, :-1] -= x[:, 1:]
        return out * inside

    x, e = np.zeros_like(b), b.copy()
    p, ee = b.copy(), float((b * b).sum())
    least = 1e-26 * ee
    for _ in range(2 * int(inside.sum()) + 10):
        if ee <= least:
            break
        q = product(p)
        pq = float((p * q).sum())
        if pq <= 0:  # a region that nothing bounds
            break
        x, e = x + ee / pq * p, e - ee / pq * q
        before, ee = ee, float((e * e).sum())
        p = e + ee / before * p
    return x


def _preconditioned(rows: DataFrame) -> DataFrame:
    """view, r, c, d, x, e, p and z, the tiles' own solutions for the residuals e."""

    def run(key, got):
        r, c = (got.column(a).to_numpy() for a in "rc")
        r, c = r - r.min(), c - c.min()
        planes = {a: np.zeros((r.max() + 1, c.max() + 1)) for a in ("in", "d", "e")}
        for a, v in (("in", 1.0), ("d", got.column("d").to_numpy()), ("e", got.column("e").to_numpy())):
            planes[a][r, c] = v
        z = _tile_solution(planes["in"], planes["d"], planes["e"])[r, c]
        return got.select([*KEYS, "d", "x", "e", "p"]).append_column("z", pa.array(z))

    tiles = [F.floor(F.col(a) / TILE).alias(f"_{a}") for a in "rc"]
    return rows.select(*KEYS, "d", "x", "e", "p").groupBy("view", *tiles).applyInArrow(run, "view int, r int, c int, d double, x double, e double, p double, z double")


def fill_region(pixels: DataFrame, mask: DataFrame, rows: int, cols: int, tolerance: float = 1e-6, rounds: int = 500) -> DataFrame:
    """view, r, c, v of ``pixels`` (absent ones are 0), those of ``mask`` (view, r, c) by Laplace's equation with the
    others as boundary and nothing flowing over the frame; a view that is masked whole is 0 there.

    A view stops when its residual's length has fallen by ``tolerance``; over ``rounds`` rounds are an error.
    """
    spark = pixels.sparkSession
    inside = F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1)
    cells = [F.col(a).cast("int").alias(a) for a in KEYS]
    marked = mask.where(inside).select(*cells).distinct().withColumn("_in", F.lit(1))
    known = pixels.where(inside).select(*cells, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")).join(marked, KEYS, "left").where("_in IS NULL").drop("_in")
    degree = F.lit(4.0) - sum((F.when(F.col(a) == n, 1).otherwise(0) for a, n in (("r", 0), ("r", rows - 1), ("c", 0), ("c", cols - 1))), F.lit(0))
    near = _sent(known, "v").unionByName(marked.select(*KEYS, F.lit(None).cast("double").alias("v")))
    start = near.groupBy(*KEYS).agg(F.sum("v").alias("b"), F.max(F.col("v").isNull()).alias("own")).where("own")
    first = stored(start.select(*KEYS, degree.alias("d"), F.lit(0.0).alias("x"), F.coalesce("b", F.lit(0.0)).alias("e"), F.lit(0.0).alias("p")))
    norm = {r.view: r.n for r in first.groupBy("view").agg(F.sum(F.col("e") * F.col("e")).alias("n")).collect()}  # a number for each view
    left, along = {v for v, n in norm.items() if n > 0}, {}
    done = [first.where(~F.col("view").isin(list(left))).select(*KEYS, "x")]  # these have no other value around them
    goal, state, kept = {v: n * tolerance**2 for v, n in norm.items()}, first, None
    for _ in range(rounds):
        if not left:
            break
        solved = stored(_preconditioned(state.where(F.col("view").isin(list(left)))))
        sums = {r.view: r.n for r in solved.groupBy("view").agg(F.sum(F.col("e") * F.col("z")).alias("n")).collect()}
        turn = _per_view(spark, {v: {"t": n / along[v] if along.get(v) else 0.0} for v, n in sums.items()}, ["t"])
        along = sums
        state = solved.join(turn, "view").withColumn("p", F.col("z") + F.col("t") * F.col("p"))
        moved = _sent(state, "p").select(*KEYS, (-F.col("p")).alias("q"), *(F.lit(None).cast("double").alias(a) for a in ("d", "x", "e", "p")))
        own = state.select(*KEYS, (F.col("d") * F.col("p")).alias("q"), "d", "x", "e", "p")
        product = stored(own.unionByName(moved).groupBy(*KEYS).agg(F.sum("q").alias("q"), *(F.max(a).alias(a) for a in ("d", "x", "e", "p"))).where("d IS NOT NULL"))
        forget(solved, kept)
        kept, numbers = product, {}
        inner = {f"{a}{b}": F.sum(F.col(a) * F.col(b)) for a, b in ("pq", "ee", "eq", "qq")}
        for r in product.groupBy("view").agg(*(c.alias(n) for n, c in inner.items())).collect():
            s = along[r.view] / r.pq if r.pq else 0.0
            numbers[r.view] = {"s": s}
            norm[r.view] = max(0.0, r.ee - 2 * s * r.eq + s * s * r.qq)  # the next residual's square
        s = F.col("s")
        state = product.join(_per_view(spark, numbers, ["s"]), "view").select(*KEYS, "d", (F.col("x") + s * F.col("p")).alias("x"), (F.col("e") - s * F.col("q")).alias("e"), "p")
        over = {v for v in left if norm[v] <= goal[v]}
        if over:
            done.append(stored(state.where(F.col("view").isin(list(over))).select(*KEYS, "x")))
            left -= over
    forget(kept)
    if left:
        raise ValueError(f"no solution within {rounds} rounds in views {sorted(left)}")
    return known.unionByName(reduce(DataFrame.unionByName, done).withColumnRenamed("x", "v"))
