"""The preprocessing stages as single steps, each a function of tables (or of one image, for kernels)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregate, blocks, images, lines, masks, matching, registration, select, shape
from ..operators.fill import fill_region


def step_01_register_frames(frames: DataFrame, rows: int, cols: int) -> DataFrame:
    """frame, view, dy, dx."""
    return registration.register_frames(frames, rows, cols)[1]


def step_02_correct_scan_drift(frames: DataFrame, rows: int, cols: int) -> DataFrame:
    aligned, moves = registration.register_frames(frames, rows, cols)
    return blocks.drift_corrected(aggregate.frame_sum(aligned), moves, rows, cols)


def step_03_crop_fixed_center(px: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    return shape.crop_at(px, centres, size)


def step_04_estimate_dark_current(px: DataFrame, rows: int, cols: int, floor: float = 1000.0) -> DataFrame:
    """The least value of the blurred images (and frames), where pixels up to ``floor`` count as bright."""
    smooth = lines.gaussian(px.withColumn("v", fn.dark_floor(F.col("v").cast("double"), floor)), 6.0, rows, cols, 12)
    return smooth.groupBy("view").agg(F.min("v").alias("dark"))


def step_05_subtract_dark_current(px: DataFrame, dark: DataFrame) -> DataFrame:
    return px.join(dark, "view").withColumn("v", fn.subtract_dark(F.col("v"), F.col("dark"))).drop("dark")


def step_06_estimate_noise_parameters(frames: DataFrame, rows: int, cols: int, least: int = 3000) -> DataFrame:
    """view, alpha, sigma2 from blocks of pixels, the constant part from where the first frame has no particle."""
    first = frames.where("frame = 0").select("view", "r", "c", F.col("v").cast("double").alias("v"))
    return aggregate.background_noise(frames, masks.background(first, least, rows, cols))


def step_07_sum_frames(frames: DataFrame) -> DataFrame:
    return aggregate.frame_sum(frames, clamp=True)


def step_08_average_noise_parameters(noise: DataFrame) -> DataFrame:
    return aggregate.average_noise(noise)


def step_09_forward_vst(px: DataFrame, alpha: float, sigma: float, mean: float = 0.0) -> DataFrame:
    return px.withColumn("v", fn.vst_forward(F.col("v"), F.lit(alpha), F.lit(sigma), F.lit(mean)))


def _ends(px: DataFrame) -> DataFrame:
    return px.groupBy("view").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def step_10_scale_vst(px: DataFrame) -> DataFrame:
    return px.join(_ends(px), "view").withColumn("v", fn.to_unit(F.col("v"), F.col("lo"), F.col("hi")))


def step_11_12_block_matching(px: DataFrame, sigma: float, rows: int, cols: int) -> DataFrame:
    """Hard threshold, then Wiener."""
    return matching.denoise(px, sigma, rows, cols)


def step_13_unscale_vst(px: DataFrame) -> DataFrame:
    return px.withColumn("v", fn.from_unit(F.col("v"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def step_14_inverse_vst(px: DataFrame, sigma: float, rows: int, cols: int) -> DataFrame:
    table = images.inverse_table(sigma)
    return blocks.map_images(px, lambda a: images.inverse_vst(a, sigma, table), rows, cols)


def step_15_restore_intensity(px: DataFrame, before: DataFrame) -> DataFrame:
    both = px.join(before.withColumnRenamed("v", "_b"), ["view", "r", "c"])
    k = both.groupBy("view").agg(aggregate.best_scale(F.col("v"), F.col("_b")).alias("_k"))
    return px.join(k, "view").withColumn("v", F.col("v") * F.col("_k")).drop("_k")


def step_16_17_smooth_background(px: DataFrame, disk: int, rows: int, cols: int) -> DataFrame:
    """Opening with a disk between two blurs, subtracted."""
    return masks.minus(px, masks.smooth_background(px, disk, rows, cols))


def step_18_19_mask_and_centre(px: DataFrame, rows: int, cols: int, least: int = 3000) -> DataFrame:
    return step_25_integer_com(px, rows, cols, least)


def step_20_21_subpixel_centre(px: DataFrame, rows: int, cols: int, scale: float = 0.9, least: tuple[int, int] = (3000, 10000)) -> DataFrame:
    return step_27_subpixel_com(px, rows, cols, scale, least)


def step_22_laplacian_background(px: DataFrame, mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """Filled where ``mask`` (view, r, c) is."""
    return fill_region(px, mask, rows, cols)


def step_23_subtract(px: DataFrame, background: DataFrame) -> DataFrame:
    both = px.join(background.withColumnRenamed("v", "_b"), ["view", "r", "c"])
    return both.select("view", "r", "c", fn.clamp_zero(F.col("v") - F.col("_b")).alias("v"))


def _as_image(px: DataFrame, mask: DataFrame) -> DataFrame:
    """view, r, c, v: 1 inside the mask."""
    marked = px.select(*masks.CELL).join(mask.withColumn("_in", F.lit(1.0)), masks.CELL, "left")
    return marked.select(*masks.CELL, F.coalesce("_in", F.lit(0.0)).alias("v"))


def step_24_initial_mask(px: DataFrame, rows: int, cols: int, least: int = 3000) -> DataFrame:
    """view, r, c, v: 1 inside the mask."""
    return _as_image(px, masks.first_mask(masks.low_passed(px, rows, cols), rows, cols, least))


def step_25_integer_com(px: DataFrame, rows: int, cols: int, least: int = 3000) -> DataFrame:
    """The images, rolled so that their particle is in the middle."""
    image = masks.low_passed(px, rows, cols)
    first = masks.first_mask(image, rows, cols, least)
    return masks.rolled(image, masks.mass_shift(image, first, rows, cols, whole=True), rows, cols)


def step_26_refined_mask(px: DataFrame, rows: int, cols: int, scale: float = 0.9, least: tuple[int, int] = (3000, 10000)) -> DataFrame:
    """view, r, c, v: 1 inside the mask of the centred image."""
    return _as_image(px, masks.centred(px, rows, cols, scale, least)["mask"])


def step_27_subpixel_com(px: DataFrame, rows: int, cols: int, scale: float = 0.9, least: tuple[int, int] = (3000, 10000)) -> DataFrame:
    """The masked images with their centre of mass in the middle."""
    return masks.centred(px, rows, cols, scale, least)["aligned"]


def step_28_transpose_image(px: DataFrame) -> DataFrame:
    return shape.transpose(px)


def step_29_normalize_intensity(px: DataFrame) -> DataFrame:
    return aggregate.normalise(px)


def step_30_estimate_commonline(px: DataFrame, rows: int, cols: int, start: float = -5.0, stop: float = 5.0, step: float = 0.1) -> DataFrame:
    """angle, score: for each angle, how far the views' lines (sums over rows) are from their mean line."""
    import numpy as np
    import pyarrow as pa

    angles = [start + k * step for k in range(int(np.floor((stop - start) / step + 0.5)) + 1)]

    def lines(key, got):
        image = blocks.image_of(got, rows, cols)
        found = np.array([images.rotate(image, a).sum(axis=0) for a in angles])
        k, c = np.indices(found.shape)
        return pa.table({"angle": np.array(angles)[k.ravel()], "c": pa.array(c.ravel(), pa.int32()), "v": found.ravel()})

    turned = px.select("view", "r", "c", "v").groupBy("view").applyInArrow(lines, "angle double, c int, v double")
    means = turned.groupBy("angle", "c").agg(F.avg("v").alias("m"))
    return turned.join(means, ["angle", "c"]).groupBy("angle").agg(F.sum(F.abs(F.col("v") - F.col("m"))).alias("score"))


def step_30_31_common_line(scores: DataFrame) -> DataFrame:
    """view, angle: the least score (view, angle, score)."""
    return select.best(scores, ["view"], "score", "angle")


def step_32_select_views(px: DataFrame, **options) -> DataFrame:
    return shape.select_views(px, **options)


def step_33_final_crop(px: DataFrame, rows: int, cols: int, size: int) -> DataFrame:
    return shape.crop_or_pad(px, {"r": (rows, size), "c": (cols, size)})


def step_34_make_angle_table(angles: DataFrame) -> DataFrame:
    return shape.angle_table(angles)


def step_35_make_support(spark, size: int) -> DataFrame:
    return shape.sphere_support(spark, size)
