"""Masks as presence rows: dilation, erosion, components, supports; sliding windows over images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut
from .shape import ball_offsets, element, spread


def dilate(mask: DataFrame, offsets: list[tuple[int, ...]], axes: list[str], sizes: list[int]) -> DataFrame:
    """Cells that an offset of the mask reaches, inside the frame; outside counts as empty."""
    keys = [c for c in mask.columns if c not in axes]
    out = spread(mask, offsets, axes, axes)
    for a, n in zip(axes, sizes):
        out = out.where(F.col(a).between(0, n - 1))
    return out.select(*keys, *axes).distinct()


def erode(mask: DataFrame, offsets: list[tuple[int, ...]], axes: list[str], sizes: list[int], outside: bool = True) -> DataFrame:
    """Cells whose every offset is in the mask or, with ``outside``, beyond the frame.

    Each mask cell votes for the cells that need it; a cell stays if it has all the votes it needs, which the distance
    to the frame's edge tells without looking at cells outside.
    """
    keys = [c for c in mask.columns if c not in axes]
    votes = spread(mask, [tuple(-x for x in o) for o in offsets], axes, axes).groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("_n"))
    need = sum((F.when(_inside(o, axes, sizes), 1).otherwise(0) for o in offsets), F.lit(0)) if outside else F.lit(len(offsets))
    return mask.join(votes, [*keys, *axes]).where(F.col("_n") == need).select(*keys, *axes)


def _inside(offset, axes, sizes):
    ok = F.lit(True)
    for a, x, n in zip(axes, offset, sizes):
        if x:
            ok = ok & (F.col(a) + x).between(0, n - 1)
    return ok


def dilate_ball(mask: DataFrame, distance: int, axes: list[str], sizes: list[int]) -> DataFrame:
    """Cells within a Euclidean distance of the mask."""
    return dilate(mask, ball_offsets(distance, slack=0.0, axes=len(axes)), axes, sizes)


def components(mask: DataFrame, axes: list[str], full: bool = True) -> DataFrame:
    """``mask`` with comp, the least cell number of each component; full connectivity, or faces only.

    Cells of a run start with its least label; labels spread to neighbours and then jump to their label's label, so
    paths halve each round.
    """
    spark = mask.sparkSession
    keys = [c for c in mask.columns if c not in axes]
    near = [o for o in ball_offsets(1, slack=1.0 if full else 0.0, axes=len(axes)) if any(o)]
    name = F.lit(0).cast("long")
    for a in axes:
        name = name * 65536 + F.col(a)
    state = mask.select(*keys, *axes, name.alias("cell"), name.alias("comp"))
    for a in reversed(axes):  # runs along lines have one label from the start
        line = [*keys, *(b for b in axes if b != a)]
        state = state.withColumn("_run", F.col(a) - F.row_number().over(Window.partitionBy(*line).orderBy(a)))
        state = state.withColumn("comp", F.min("comp").over(Window.partitionBy(*line, "_run"))).drop("_run")
    state = cut(state, spark)
    moves = [tuple(o) for o in near]
    while True:
        sent = spread(state.select(*keys, *axes, "comp"), moves, axes, axes).groupBy(*keys, *axes).agg(F.min("comp").alias("_m"))
        step = state.join(sent, [*keys, *axes], "left").select(*keys, *axes, "cell", F.col("comp").alias("_old"), F.least("comp", F.coalesce("_m", "comp")).alias("comp"))
        over = state.select(*keys, F.col("cell").alias("comp"), F.col("comp").alias("_c"))
        nxt = cut(step.join(over, [*keys, "comp"], "left").select(*keys, *axes, "cell", "_old", F.least("comp", F.coalesce("_c", "comp")).alias("comp")), spark)
        state = nxt.drop("_old")
        if nxt.where("_old <> comp").isEmpty():
            return state.drop("cell")


def large_components(mask: DataFrame, axes: list[str], least: int, full: bool = True) -> DataFrame:
    """Cells of components with at least ``least`` cells; sizes are joined back, so a large one isn't gathered."""
    labelled = components(mask, axes, full)
    keys = [c for c in mask.columns if c not in axes]
    sizes = labelled.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return labelled.join(sizes, [*keys, "comp"], "left_semi").drop("comp")


def largest_component(mask: DataFrame, axes: list[str], full: bool = False) -> DataFrame:
    labelled = components(mask, axes, full)
    keys = [c for c in mask.columns if c not in axes]
    sizes = labelled.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy(*keys).agg(F.min_by("comp", F.struct(-F.col("n"), F.col("comp"))).alias("comp")) if keys else sizes.agg(F.min_by("comp", F.struct(-F.col("n"), F.col("comp"))).alias("comp"))
    return labelled.join(top, [*keys, "comp"], "left_semi").drop("comp")


def box_mean(df: DataFrame, half: int, axes: list[str], sizes: list[int]) -> DataFrame:
    """Mean over a box, axis by axis, edges repeated; a dense grid.

    A cell at an edge stands for all the cells beyond it, so its weight in a window is the count of those.
    """
    others = lambda a: [c for c in df.columns if c not in (a, "v")]
    for a, n in zip(axes, sizes):
        w = Window.partitionBy(*others(a)).orderBy(a).rowsBetween(-half, half)
        whole = Window.partitionBy(*others(a)).orderBy(a).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low, high = F.greatest(F.lit(0), half - F.col(a)), F.greatest(F.lit(0), F.col(a) + half - (n - 1))
        df = df.withColumn("v", (F.sum("v").over(w) + low * F.first("v").over(whole) + high * F.last("v").over(whole)) / float(2 * half + 1))
    return df


def line_opening(df: DataFrame, half: int, axis: str, by: list[str]) -> DataFrame:
    """Grey opening along a line: least, then greatest, over 2 half + 1 cells, windows cut at the border."""
    w = Window.partitionBy(*by).orderBy(axis).rowsBetween(-half, half)
    return df.withColumn("v", F.min("v").over(w)).withColumn("v", F.max("v").over(w))


#: Radius of a disk, and half lengths of the straight and diagonal lines whose sum stands for it.
OCTAGONS = {6: (3, 1), 10: (5, 2), 12: (5, 3), 20: (9, 5), 140: (61, 39)}


def padded(df: DataFrame, extent: int, rows: int, columns: int) -> DataFrame:
    """An image with its edge repeated ``extent`` times on every side."""
    for axis, n in (("r", rows), ("c", columns)):
        first = F.when(F.col(axis) == 0, -extent).otherwise(F.col(axis))
        last = F.when(F.col(axis) == n - 1, n - 1 + extent).otherwise(F.col(axis))
        df = df.withColumn(axis, F.explode(F.sequence(first, last)))
    return df


def octagon_opening(df: DataFrame, straight: int, diagonal: int, rows: int, columns: int) -> DataFrame:
    """Grey opening of dense images with an octagon, the sum of four lines: rows, columns and both diagonals.

    Outside the image is +inf for the least, and the repeated edge of the eroded image for the greatest.  Each line is
    a window over the padded image.
    """
    extent = straight + 2 * diagonal
    inside = F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1)
    out, kind = df.select("view", "r", "c", F.col("v").cast("double").alias("v")), df.schema["v"].dataType
    for f in (F.min, F.max):
        out = padded(out, extent, rows, columns)
        if f is F.min:
            out = out.withColumn("v", F.when(inside, F.col("v")).otherwise(F.lit(float("inf"))))
        out = out.withColumns({"_p": F.col("r") - F.col("c"), "_q": F.col("r") + F.col("c")})
        for axis, by, half in (("c", ["view", "r"], straight), ("r", ["view", "c"], straight), ("r", ["view", "_p"], diagonal), ("r", ["view", "_q"], diagonal)):
            out = out.withColumn("v", f("v").over(Window.partitionBy(*by).orderBy(axis).rowsBetween(-half, half)))
        out = out.where(inside).drop("_p", "_q")
    return out.withColumn("v", F.col("v").cast(kind))


def disk_opening(df: DataFrame, radius: int, rows: int, columns: int) -> DataFrame:
    """Opening with the octagon that stands for a disk of one of the radii in ``OCTAGONS``."""
    return octagon_opening(df, *OCTAGONS[radius], rows, columns)


def edge_preserving(df: DataFrame, half: int, rows: int, columns: int) -> DataFrame:
    """Each pixel takes the mean of the window (of those that hold it) with the least variance; first by column, then row.

    Pixels nearer than 2 half to the border, some of whose windows leave the image, stay as they are.
    """
    offs = [(r, c) for r in range(-half, half + 1) for c in range(-half, half + 1)]
    sent = spread(df, offs, ["r", "c"], ["r", "c"])
    stats = sent.groupBy("view", "r", "c").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offs))
    seen = spread(stats.withColumns({"_r": F.col("r"), "_c": F.col("c")}), offs, ["r", "c"], ["r", "c"])
    seen = seen.where(F.col("r").between(2 * half, rows - 1 - 2 * half) & F.col("c").between(2 * half, columns - 1 - 2 * half))
    best = seen.groupBy("view", "r", "c").agg(F.min_by("m", F.struct(F.round("s", 9), "_c", "_r")).alias("v"))
    return df.select("view", "r", "c", F.col("v").alias("_v")).join(best, ["view", "r", "c"], "left").select("view", "r", "c", F.coalesce("v", "_v").alias("v"))


def tight_support(df: DataFrame, sizes: list[int], threshold_factor: float = 0.9125, half: int = 4, small: int = 3, ball: int = 7, least: int = 27, eroded: int = 13) -> DataFrame:
    """Cells of the tight support: box mean, Otsu's threshold times a factor, dilations, small parts removed, erosion."""
    from .aggregate import otsu_scaled

    axes = ["i", "j", "k"]
    smooth = box_mean(df.withColumn("v", F.col("v").cast("double")), half, axes, sizes)
    t = otsu_scaled(smooth)
    mask = smooth.crossJoin(F.broadcast(t)).where(F.col("v") > F.col("threshold") * threshold_factor).select(*axes)  # one row
    mask = dilate_ball(dilate(mask, element(small), axes, sizes), ball, axes, sizes)
    mask = large_components(mask, axes, least)
    return erode(mask, element(eroded), axes, sizes)
