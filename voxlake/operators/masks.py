"""Where the particle is: masks, centres and backgrounds of dense images (view, r, c, v), all views at once.

A mask is a relation of cells (view, r, c).  Everything is composed of histograms, components, line filters and cell
sends; what differs between views (thresholds, centres, shifts) is a table with a row for each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate, lines, morphology
from .fill import fill_region
from .iterate import cut
from .shape import disk, spread

CELL = ["view", "r", "c"]
CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
#: The frame around an image in which its mask is grown, and the radii it is widened and narrowed by.
FRAME, WIDEN, NARROW = 64, 10, 12


def _within(mask: DataFrame, rows: int, cols: int, margin: int = 0) -> DataFrame:
    return mask.where(F.col("r").between(-margin, rows - 1 + margin) & F.col("c").between(-margin, cols - 1 + margin))


def _octagon_lines(radius: int) -> list[list[tuple[int, int]]]:
    """Lines whose sum stands for a disk."""
    straight, diagonal = morphology.OCTAGONS[radius]
    steps = (((1, 0), straight), ((0, 1), straight), ((1, 1), diagonal), ((1, -1), diagonal))
    return [[(a * k, b * k) for k in range(-half, half + 1)] for (a, b), half in steps]


def widened(mask: DataFrame, radius: int, rows: int, cols: int, margin: int = 0) -> DataFrame:
    """Dilation by a disk, line after line; a line may leave the frame and come back."""
    for line in _octagon_lines(radius):
        mask = spread(mask.select(*CELL), line, ["r", "c"], ["r", "c"]).distinct()
    return _within(mask, rows, cols, margin)


def narrowed(mask: DataFrame, radius: int) -> DataFrame:
    """Erosion by a disk; outside the frame nothing is in the mask."""
    for line in _octagon_lines(radius):
        votes = spread(mask.select(*CELL), line, ["r", "c"], ["r", "c"]).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
        mask = votes.where(F.col("_n") == len(line)).select(*CELL)
    return mask


def grown(mask: DataFrame, half_width: float, rows: int, cols: int, margin: int = 0, threshold: float = 0.1) -> DataFrame:
    """Cells where the mask, blurred by a Gaussian that is 1 in its middle and a half at ``half_width``, is above ``threshold``.

    Sends end where a cell's share is under 1e-18.
    """
    reach = math.ceil(half_width * math.sqrt(60))
    out = mask.select(*CELL).withColumn("v", F.lit(1.0))
    for axis in "rc":
        out = out.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        share = F.pow(F.lit(2.0), -(F.col("_d") * F.col("_d")) / (half_width * half_width))
        out = out.withColumns({axis: (F.col(axis) + F.col("_d")).cast("int"), "v": F.col("v") * share}).drop("_d")
        out = _within(out, rows, cols, margin).groupBy(*CELL).agg(F.sum("v").alias("v"))
    return out.where(F.col("v") > threshold).select(*CELL)


def holes_filled(mask: DataFrame, frame: DataFrame, rows: int, cols: int) -> DataFrame:
    """``mask`` and the cells of ``frame`` (all cells of each view) that the frame's border doesn't reach past it."""
    rest = frame.select(*CELL).join(mask, CELL, "left_anti")
    named = morphology.components(rest, ["r", "c"], full=False)
    edge = F.col("r").isin(0, rows - 1) | F.col("c").isin(0, cols - 1)
    open_ = named.where(edge).select("view", "comp").distinct()
    return mask.select(*CELL).unionByName(named.join(open_, ["view", "comp"], "left_anti").select(*CELL))


def above(px: DataFrame, levels: DataFrame, factor: float = 1.0) -> DataFrame:
    """Cells over their view's threshold times ``factor``; ``levels`` has a row for each view."""
    return px.join(F.broadcast(levels), "view").where(F.col("v") > F.col("threshold") * factor).select(*CELL)


def bright_parts(px: DataFrame, half: int, scale: float, least: int, rows: int, cols: int) -> DataFrame:
    """Components of at least ``least`` cells over ``scale`` of Otsu's threshold in the smoothed image."""
    smooth = cut(morphology.edge_preserving(px, half, rows, cols), px.sparkSession)
    return morphology.large_components(above(smooth, aggregate.otsu_scaled(smooth, by=["view"]), scale), ["r", "c"], least)


def background(px: DataFrame, least: int, rows: int, cols: int) -> DataFrame:
    """Cells that are far from any particle, for the noise's constant part."""
    part = grown(widened(bright_parts(px, 3, 0.9, least, rows, cols), 20, rows, cols), 3.0, rows, cols)
    return px.select(*CELL).join(part, CELL, "left_anti")


def blob_mask(px: DataFrame, rows: int, cols: int, scale: float = 0.9) -> DataFrame:
    """Blurred, cut at Otsu's threshold, opened, closed, filled and dilated; outside the frame is empty."""
    smooth = cut(lines.gaussian(px, 2.0, rows, cols, border="symmetric"), px.sparkSession)
    finite = smooth.where(~F.isnan("v") & (F.abs("v") < float("inf")))
    mask = above(smooth, aggregate.otsu_range(finite, by=["view"]), scale)
    for grow, times in ((False, 2), (True, 2), (True, 4), (False, 4)):
        for _ in range(times):
            mask = morphology.dilate(mask, CROSS, ["r", "c"], [rows, cols]) if grow else morphology.erode(mask, CROSS, ["r", "c"], [rows, cols], outside=False)
        mask = cut(mask, px.sparkSession)
    mask = holes_filled(mask, px, rows, cols)
    for _ in range(3):
        mask = morphology.dilate(mask, CROSS, ["r", "c"], [rows, cols])
    return mask


def centres(px: DataFrame, size: int, rows: int, cols: int, sigma: float = 8.0) -> DataFrame:
    """view, cr, cc from 0: centre of the largest bright part of each view, moved so that a crop of ``size`` stays inside."""
    smooth = lines.gaussian(px, sigma, rows, cols, border="symmetric").withColumnRenamed("v", "_s")
    lit = cut(px.select(*CELL, F.col("v").cast("double").alias("_v")).join(smooth, CELL).where("_v <> 0").select(*CELL, F.col("_s").alias("v")), px.sparkSession)
    levels = aggregate.otsu_range(lit, by=["view"])
    largest = morphology.largest_component(above(lit, levels), ["r", "c"])
    weight = lit.join(largest, CELL).join(F.broadcast(levels), "view").select(*CELL, (F.col("v") - F.col("threshold")).alias("w"))
    found = weight.groupBy("view").agg(*((F.sum(F.col(a) * F.col("w")) / F.sum("w")).alias(f"c{a}") for a in "rc"))
    half = math.floor(size / 2 + 0.5)
    inside = lambda a, n: F.least(F.greatest(F.coalesce(f"c{a}", F.lit((n - 1) / 2)), F.lit(half - 1.0)), F.lit(n - half - 1.0)).alias(f"c{a}")
    return px.select("view").distinct().join(found, "view", "left").select("view", inside("r", rows), inside("c", cols))


def mass_shift(px: DataFrame, mask: DataFrame, rows: int, cols: int, whole: bool) -> DataFrame:
    """view, dy, dx: from the centre of what the mask shows to the middle, in whole pixels or not."""
    shown = px.join(mask.select(*CELL).withColumn("_in", F.lit(1)), CELL, "left").withColumn("v", F.when(F.col("_in") == 1, F.col("v")).otherwise(0.0))
    at = aggregate.centroid(shown, rows, cols)
    by = [F.floor(F.lit((n + 1) / 2 + 0.5)) - F.col(c) for n, c in ((rows, "cr"), (cols, "cc"))]
    return at.select("view", *((F.floor(d + 0.5).cast("int") if whole else d).alias(a) for d, a in zip(by, ("dy", "dx"))))


def rolled(px: DataFrame, shifts: DataFrame, rows: int, cols: int) -> DataFrame:
    """Each view rolled by its whole dy, dx."""
    out = px.join(F.broadcast(shifts), "view")  # a row for each view
    return out.select("view", F.pmod(F.col("r") + F.col("dy"), F.lit(rows)).cast("int").alias("r"), F.pmod(F.col("c") + F.col("dx"), F.lit(cols)).cast("int").alias("c"), "v")


def low_passed(px: DataFrame, rows: int, cols: int) -> DataFrame:
    """As a rotation by nothing leaves an image: in a frame of twice its size that a low order statistic fills, without
    the frame's highest frequencies."""
    rank = F.greatest(F.lit(1), F.round(F.col("n") / 128))
    base = aggregate.kth(px.withColumn("v", F.col("v").cast("double")), "v", rank, ["view"]).withColumnRenamed("v", "_b")
    out = px.join(F.broadcast(base), "view").withColumn("v", F.col("v") - F.col("_b")).drop("_b")
    for axis, n in (("r", rows), ("c", cols)):
        out = lines.along(out.select(*CELL, "v"), axis, lines.without_highest(n))
    return out.join(F.broadcast(base), "view").select(*CELL, (F.col("v") + F.col("_b")).alias("v"))


def first_mask(px: DataFrame, rows: int, cols: int, least: int = 3000, scale: float = 0.6) -> DataFrame:
    return widened(bright_parts(px, 2, scale, least, rows, cols), 6, rows, cols)


def second_mask(shifted: DataFrame, rows: int, cols: int, scale: float = 0.9, least: int = 10000) -> DataFrame:
    """The large bright parts of a centred image, grown and smoothed in a wider frame."""
    mask = grown(bright_parts(shifted, 2, scale, least, rows, cols), 5.0, rows, cols, FRAME)
    return _within(narrowed(widened(mask, WIDEN, rows, cols, FRAME), NARROW), rows, cols)


def centred(px: DataFrame, rows: int, cols: int, scale: float = 0.9, least: tuple[int, int] = (3000, 10000)) -> dict[str, DataFrame]:
    """image (low passed), first (mask), shifted (rolled to the middle), mask (there), before (the mask where the image
    was) and aligned (what the mask shows, with its centre of mass in the middle)."""
    spark = px.sparkSession
    image = cut(low_passed(px.select(*CELL, F.col("v").cast("double").alias("v")), rows, cols), spark)
    first = cut(first_mask(image, rows, cols, least[0]), spark)
    whole = cut(mass_shift(image, first, rows, cols, whole=True), spark)
    shifted = cut(rolled(image, whole, rows, cols), spark)
    mask = cut(second_mask(shifted, rows, cols, scale, least[1]), spark)
    back = mask.join(F.broadcast(whole), "view").select("view", (F.col("r") - F.col("dy")).alias("r"), (F.col("c") - F.col("dx")).alias("c"))
    part = cut(mass_shift(shifted, mask, rows, cols, whole=False), spark)
    shown = shifted.join(mask.withColumn("_in", F.lit(1)), CELL, "left").select(*CELL, F.when(F.col("_in") == 1, F.col("v")).otherwise(0.0).alias("v"))
    moved = lines.fourier_shift(shown, part, rows, cols).join(mask.withColumn("_in", F.lit(1)), CELL, "left")
    aligned = moved.select(*CELL, F.when(F.col("_in") == 1, F.col("v")).otherwise(0.0).alias("v"))
    return {"image": image, "first": first, "shifted": shifted, "mask": mask, "before": _within(back, rows, cols), "aligned": cut(aligned, spark)}


def opened(px: DataFrame, radius: int, rows: int, cols: int) -> DataFrame:
    """Grey opening with a disk; where no octagon stands for it, over all its offsets, the edge repeated."""
    if radius in morphology.OCTAGONS:
        return morphology.disk_opening(px, radius, rows, cols)
    for f in (F.min, F.max):
        sent = spread(morphology.padded(px.select(*CELL, "v"), radius, rows, cols), disk(radius), ["r", "c"], ["r", "c"])
        px = _within(sent, rows, cols).groupBy(*CELL).agg(f("v").alias("v"))
    return px


def smooth_background(px: DataFrame, radius: int, rows: int, cols: int) -> DataFrame:
    """Opening with a disk between two blurs."""
    blurred = cut(lines.gaussian(px.select(*CELL, "v"), 5.0, rows, cols, 10), px.sparkSession)
    return lines.gaussian(cut(opened(blurred, radius, rows, cols), px.sparkSession), 15.0, rows, cols, 30)


def minus(px: DataFrame, other: DataFrame) -> DataFrame:
    """The difference, not below 0."""
    both = px.select(*CELL, "v").join(other.select(*CELL, F.col("v").alias("_b")), CELL)
    return both.select(*CELL, F.greatest(F.col("v") - F.col("_b"), F.lit(0.0)).alias("v"))


def without_background(px: DataFrame, rows: int, cols: int, radius: int = 140, scale: float = 0.9, least: tuple[int, int] = (3000, 10000)) -> dict[str, DataFrame]:
    """As ``centred``, of the images without their background: it is filled in from around the particle, whose place
    is found without the smooth background."""
    flat = cut(minus(px, smooth_background(px, radius, rows, cols)), px.sparkSession)
    place = centred(flat, rows, cols, scale, least)["before"]
    return centred(cut(minus(px, fill_region(px, place, rows, cols)), px.sparkSession), rows, cols, scale, least)
