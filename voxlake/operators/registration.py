"""Registration of dense images (view, r, c, v), all views at once.

The numerators of a correlation come from a join of image lines, a line of the template with each line that it may lie
on; sums under the template come from four look-ups in a summed-area table, two running sums.  Fractions of a pixel are
candidates: shifted copies of a view with a number of their own, scored together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lines
from .iterate import cut

CELL = ["view", "r", "c"]
#: Candidates along an axis in a round of the search for fractions.
SPLIT = 4


def _lines(px: DataFrame, name: str) -> DataFrame:
    """view, r and the values of the row in order of c."""
    row = F.sort_array(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"))))  # an image's row
    return px.groupBy("view", "r").agg(row["v"].alias(name))


def _products(pairs: DataFrame, circular: bool) -> DataFrame:
    """view, dy, dx, s: for pairs (view, dy, t, g) of lines the sum of t times g moved by dx, over all pairs.

    A shorter t lies in the middle of g.
    """

    def run(batches):
        for batch in batches:
            parts = []
            for view, dy, t, g in zip(batch.column("view").to_pylist(), batch.column("dy").to_pylist(), batch.column("t"), batch.column("g")):
                t, g = t.values.to_numpy(), g.values.to_numpy()
                s = np.correlate(np.concatenate([g, g[:-1]]) if circular else g, t, "valid")
                dx = np.arange(len(s)) - (0 if circular else (len(g) - len(t)) // 2)
                parts.append((np.full(len(s), view), np.full(len(s), dy), dx, s))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3])], names=["view", "dy", "dx", "s"])

    sent = pairs.select("view", "dy", "t", "g").mapInArrow(run, "view int, dy int, dx int, s double")
    return sent.groupBy("view", "dy", "dx").agg(F.sum("s").alias("s"))


def correlations(template: DataFrame, px: DataFrame, rows: int, cols: int, reach: tuple[int, int]) -> DataFrame:
    """view, dy, dx, score: the normalised correlation of the template with each view where it lies dy, dx from the middle.

    ``template`` (view, r, c, v) is as large as an image less ``reach`` on each side, its r and c from 0.  A view that
    is flat under the template scores 0.
    """
    n = (rows - 2 * reach[0]) * (cols - 2 * reach[1])
    mean = template.groupBy("view").agg(F.avg("v").alias("_m"))
    centred = template.join(F.broadcast(mean), "view").withColumn("v", F.col("v") - F.col("_m"))  # a row for each view
    power = centred.groupBy("view").agg(F.sum(F.col("v") * F.col("v")).alias("tt"))
    moved = _lines(centred, "t").withColumn("dy", F.explode(F.sequence(F.lit(-reach[0]), F.lit(reach[0])))).withColumn("r", (F.col("r") + reach[0] + F.col("dy")).cast("int"))
    numerators = _products(moved.join(_lines(px, "g"), ["view", "r"]), circular=False)
    table = px.select(*CELL, F.col("v").cast("double").alias("p"), (F.col("v") * F.col("v")).cast("double").alias("q"))
    for by, order in (("r", "c"), ("c", "r")):
        w = Window.partitionBy("view", by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        table = table.withColumns({a: F.sum(a).over(w) for a in "pq"})
    corners = F.array(*(F.struct(F.lit(a * (rows - 2 * reach[0]) - 1).alias("r"), F.lit(b * (cols - 2 * reach[1]) - 1).alias("c"), F.lit(1.0 if a == b else -1.0).alias("w")) for a in (0, 1) for b in (0, 1)))
    at = numerators.select("view", "dy", "dx", F.explode(corners).alias("_k"))
    at = at.select("view", "dy", "dx", (F.col("dy") + reach[0] + F.col("_k.r")).cast("int").alias("r"), (F.col("dx") + reach[1] + F.col("_k.c")).cast("int").alias("c"), F.col("_k.w").alias("w"))
    sums = at.join(table, CELL).groupBy("view", "dy", "dx").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("q")).alias("q"))
    spread = F.greatest(F.col("q") - F.col("p") * F.col("p") / n, F.lit(0.0))
    score = F.when(spread * F.col("tt") > 1e-12 * F.greatest(F.lit(1.0), F.col("q") * F.col("tt")), F.col("s") / F.sqrt(spread * F.col("tt"))).otherwise(0.0)
    return numerators.join(sums, ["view", "dy", "dx"]).join(F.broadcast(power), "view").select("view", "dy", "dx", score.alias("score"))


def whole_shifts(reference: DataFrame, px: DataFrame, rows: int, cols: int) -> DataFrame:
    """view, dy, dx: whole pixels that move each view onto its reference, by the peak of their circular correlation."""
    flat = []
    for d in (reference, px):
        mean = d.groupBy("view").agg(F.avg("v").alias("_m"))
        flat.append(d.join(F.broadcast(mean), "view").withColumn("v", F.col("v") - F.col("_m")))  # a row for each view
    moved = _lines(flat[0], "t").withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("r", F.pmod(F.col("r") + F.col("dy"), F.lit(rows)).cast("int"))
    sums = _products(moved.join(_lines(flat[1], "g"), ["view", "r"]), circular=True)
    # a view that lies d further on is moved back by d
    back = {a: F.when(F.pmod(-F.col(a), F.lit(n)) > n // 2, F.pmod(-F.col(a), F.lit(n)) - n).otherwise(F.pmod(-F.col(a), F.lit(n))) for a, n in (("dy", rows), ("dx", cols))}
    order = F.struct(F.round(F.abs("s"), 9).alias("s"), -F.pmod(-F.col("dy"), F.lit(rows)).alias("a"), -F.pmod(-F.col("dx"), F.lit(cols)).alias("b"))
    return sums.groupBy("view").agg(F.max_by(F.struct(back["dy"].cast("double").alias("dy"), back["dx"].cast("double").alias("dx")), order).alias("m")).select("view", "m.dy", "m.dx")


def _cropped(px: DataFrame, rows: int, cols: int, half: tuple[int, int], origin: tuple[int, int]) -> DataFrame:
    out = px
    for axis, h, o in (("r", half[0], origin[0]), ("c", half[1], origin[1])):
        out = out.where(F.col(axis).between(o - h, o + h)).withColumn(axis, (F.col(axis) - (o - h)).cast("int"))
    return out.select(*CELL, F.col("v").cast("double").alias("v"))


def shifts(reference: DataFrame, px: DataFrame, rows: int, cols: int, resolution: float = 0.05, reach: int = 20, half: int = 210, border: int = 20) -> DataFrame:
    """view, dy, dx: what moves each view onto its reference.

    Both are cut to a square ``border`` off the frame; the template is the reference's middle, up to ``half`` to each
    side.  Each round scores a grid of fractions, each by its best whole shift within ``reach``, and goes on between the
    best one's neighbours, until the grid is finer than ``resolution``.  Images too small for that get whole shifts.
    """
    if not 0 < resolution < 0.5:
        raise ValueError("the resolution must lie between 0 and 0.5")
    spark, middle = px.sparkSession, [math.floor((n + 1) / 2 + 0.5) - 1 for n in (rows, cols)]
    edge = min(middle) + 1 - border
    if edge <= 0:
        return whole_shifts(reference, px, rows, cols)
    size, side = 2 * edge + 1, min(half, max(edge - reach, edge // 2))
    span = min(reach, edge - side)
    template = _cropped(reference, rows, cols, (side, side), tuple(middle))
    square = cut(_cropped(px, rows, cols, (side + span,) * 2, tuple(middle)) if side + span == edge else _cropped(px, rows, cols, (edge, edge), tuple(middle)), spark)
    views = sorted(r.view for r in square.select("view").distinct().collect())  # of the microscope
    best, width = {v: (-0.5, -0.5) for v in views}, 1.0

    def scored(candidates: dict[int, list[tuple[float, float]]]) -> dict[int, tuple]:
        """For each view the best candidate's number and whole shift; rows first decide ties."""
        count = max(len(c) for c in candidates.values())
        rows_ = [(v * count + k, v, float(y), float(x)) for v, c in candidates.items() for k, (y, x) in enumerate(c)]
        numbered = F.broadcast(spark.createDataFrame(rows_, "copy int, view int, dy double, dx double"))
        copies = square.join(numbered, "view").select(F.col("copy").alias("view"), "r", "c", "v")
        turned = lines.fourier_shift(copies, numbered.select(F.col("copy").alias("view"), "dy", "dx"), size, size)
        inner = turned.where(F.col("r").between(edge - side - span, edge + side + span) & F.col("c").between(edge - side - span, edge + side + span))
        inner = inner.withColumns({a: (F.col(a) - (edge - side - span)).cast("int") for a in "rc"})
        own = template.join(numbered, "view").select(F.col("copy").alias("view"), "r", "c", "v")
        score = correlations(own, cut(inner, spark), 2 * (side + span) + 1, 2 * (side + span) + 1, (span, span))
        top = score.join(numbered.select(F.col("copy").alias("view"), F.col("view").alias("of")), "view")
        order = F.struct(F.round("score", 12).alias("s"), -F.col("view").alias("k"), -F.col("dx").alias("x"), -F.col("dy").alias("y"))
        found = top.groupBy("of").agg(F.max_by(F.struct("view", "dy", "dx"), order).alias("m")).collect()  # a row for each view
        return {r.of: (r.m.view % count, r.m.dy, r.m.dx) for r in found}

    for _ in range(abs(math.floor(math.log(resolution) / math.log(SPLIT)))):
        width /= SPLIT
        grid = {v: [(y + width * (r + 0.5), x + width * (c + 0.5)) for c in range(SPLIT) for r in range(SPLIT)] for v, (y, x) in best.items()}
        found = scored(grid)
        best = {v: tuple(p - width / 2 for p in grid[v][found[v][0]]) for v in views}
    last = {v: [tuple(p + width / 2 for p in best[v])] for v in views}
    return spark.createDataFrame([(v, last[v][0][0] - dy, last[v][0][1] - dx) for v, (_, dy, dx) in scored(last).items()], "view int, dy double, dx double")


def register_frames(frames: DataFrame, rows: int, cols: int, **how) -> tuple[DataFrame, DataFrame]:
    """Aligned frames and shifts (frame, view, dy, dx): each frame (from 0) registered to the mean of those before it."""
    spark = frames.sparkSession
    numbers = sorted(r.frame for r in frames.select("frame").distinct().collect())  # repeats of an exposure

    def at(n: int) -> DataFrame:
        """One frame of all views; absent pixels are 0."""
        cells = frames.select("view").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
        return cells.join(frames.where(F.col("frame") == n).select(*CELL, "v"), CELL, "left").select(*CELL, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))

    aligned = cut(at(numbers[0]), spark).withColumn("frame", F.lit(numbers[0]))
    moves = aligned.select("frame", "view").distinct().select("frame", "view", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    for n in numbers[1:]:
        mean = cut(aligned.groupBy(*CELL).agg(F.avg("v").alias("v")), spark)
        frame = cut(at(n), spark)
        found = cut(shifts(mean, frame, rows, cols, **how), spark)
        moves = moves.unionByName(found.select(F.lit(n).alias("frame"), "view", "dy", "dx"))
        aligned = aligned.unionByName(cut(lines.fourier_shift(frame, found, rows, cols), spark).withColumn("frame", F.lit(n)))
    return aligned.select("frame", *CELL, "v"), moves
