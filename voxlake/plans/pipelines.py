"""Compositions: preprocessing, reconstruction, tracing, classification, refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregate, blocks, cluster, fits, images, lines, masks, matching, neighbours, project, registration, select, shape, stabilise, tomography
from ..operators.iterate import cut
from ..sources import adapters


@dataclass(frozen=True)
class Preprocess:
    """Sizes of the frames and of the result, and the stages' parameters; ``least`` are the pixels of the two masks."""

    rows: int
    cols: int
    size: int
    disk: int = 140
    mask_scale: float = 0.9
    least: tuple[int, int] = (3000, 10000)
    dark_least: float = 1000.0
    factor: float = 1.0
    denoise: bool = True


def noise_of(frames: DataFrame, config: Preprocess) -> tuple[DataFrame, DataFrame]:
    """``frames`` without their view's dark current, and alpha and sigma2 of each view."""
    spark, n = frames.sparkSession, (config.rows, config.cols)
    level = frames.withColumn("v", fn.dark_floor(F.col("v"), config.dark_least))
    each = level.select(F.col("frame").alias("_f"), F.col("view").alias("_v"), "r", "c", "v").withColumn("view", (F.col("_v") * 65536 + F.col("_f")).cast("int"))
    smooth = lines.gaussian(each.select("view", "r", "c", "v"), 6.0, *n, 12)
    dark = smooth.groupBy(F.shiftright("view", 16).alias("view")).agg(F.min("v").alias("dark"))
    clean = cut(frames.join(F.broadcast(dark), "view").withColumn("v", fn.subtract_dark(F.col("v"), F.col("dark"))).drop("dark"), spark)  # a row for each view
    empty = masks.background(clean.where("frame = 0").select("view", "r", "c", "v"), config.least[0], *n)
    return clean, cut(aggregate.background_noise(clean, empty), spark)


def preprocess(frames: DataFrame, angles: DataFrame, config: Preprocess) -> dict[str, DataFrame]:
    """frames (frame, view, r, c, v) to projections, angles, masks and noise, a table for each member: dark current and
    noise, registration, denoising, background, centring, transposed and brought to the first view's intensity."""
    spark, n = frames.sparkSession, (config.rows, config.cols)
    frames, noise = noise_of(frames.withColumn("v", F.col("v").cast("double")), config)
    aligned, moves = registration.register_frames(frames, *n)
    summed = blocks.drift_corrected(aggregate.frame_sum(aligned), moves, *n)
    if config.denoise:
        mean = aggregate.average_noise(noise).first()
        alpha, sigma = float(mean["alpha"] or 1.0), float(mean["sigma2"] or 0.0) ** 0.5
        summed = denoised(summed, alpha, sigma, *n, config.factor)
    summed = cut(summed, spark)
    found = masks.without_background(summed, *n, config.disk, config.mask_scale, config.least)
    flat, mask = (shape.transpose(found[k]) for k in ("aligned", "mask"))
    window = {"r": (config.cols, config.size), "c": (config.rows, config.size)}
    out = shape.crop_or_pad(aggregate.normalise(cut(flat, spark)), window)
    return {"projections": cut(out, spark), "angles": shape.angle_table(angles), "noise": noise, "masks": shape.crop_or_pad(mask, window).select("view", "r", "c")}


def denoised(px: DataFrame, alpha: float, sigma: float, rows: int, cols: int, factor: float = 1.0) -> DataFrame:
    """``px`` (view, r, c, v) stabilised, scaled to [0.15, 0.85], matched by blocks, and back, with the intensity that
    fits the input best; views without any contrast are only cut off at 0.

    The table of the inverse is made for this sigma; it reaches over the greatest value of all views, and a value meets
    its segment by a join.
    """
    spark, s = px.sparkSession, sigma / alpha
    plus = px.select(F.col("view").cast("int").alias("view"), "r", "c", F.greatest(F.col("v"), F.lit(0.0)).alias("given"))
    stable = cut(plus.withColumn("v", 2 * F.sqrt(F.col("given") / alpha + 0.375 + s * s)), spark)
    ends = cut(stable.groupBy("view").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("given").alias("most")), spark)
    wide = ends.where("hi > lo")
    scaled = stable.join(F.broadcast(wide), "view").withColumn("v", (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 0.7 + 0.15)  # a row for each view
    noise = wide.select("view", (0.96 * 0.7 * factor / (F.col("hi") - F.col("lo"))).alias("sigma"))
    clean = matching.denoise(scaled, noise, rows, cols).join(F.broadcast(wide), "view")
    back = clean.select("view", "r", "c", ((F.col("v") - 0.15) / 0.7 * (F.col("hi") - F.col("lo")) + F.col("lo")).alias("v"))
    most = float(ends.agg(F.max("most")).first()[0] or 0.0) / alpha
    e, m = images.inverse_table(s, highest=max(50.0, most * 1.2))
    curve = spark.createDataFrame([(float(x), float(y)) for x, y in zip(e, m)], "x double, y double")
    curves = wide.select("view").crossJoin(F.broadcast(curve))  # some hundred points
    v = F.col("v")
    found = F.when(v < float(e[0]), 0.0).when(v > float(e[-1]), v * v / 4 - 1 / 8 - s * s).otherwise(F.col("y"))
    out = stabilise.interpolated(back, curves, ["view"]).withColumn("out", found).join(plus, ["view", "r", "c"])
    out = cut(out.select("view", "r", "c", "out", "given"), spark)
    best = out.groupBy("view").agg((F.sum(F.col("out") * F.col("given")) / F.nullif(F.sum(F.col("out") * F.col("out")), F.lit(0.0))).alias("k"))
    done = out.join(F.broadcast(best), "view").select("view", "r", "c", (F.col("out") * F.coalesce("k", F.lit(1.0))).alias("v"))
    return done.unionByName(plus.join(F.broadcast(ends.where("hi <= lo")), "view", "left_semi").select("view", "r", "c", F.col("given").alias("v")))


def small_reconstruction(spark: SparkSession, sf_dir: str, rounds: int = 6) -> DataFrame:
    """i, j, k, v: cells above 0 of the volume that the pixel adapter's seven views give."""
    volume, _ = tomography.reconstruct(adapters.pixels(spark, sf_dir), adapters.angles(spark), 16, rounds, block=8, thick=8)
    return volume.withColumn("v", F.round("v", 6))


def trace(cells: DataFrame, size: int, threshold: float, least_distance: float, support: DataFrame | None = None, most: int = 100_000, factor: int = 3) -> DataFrame:
    """atom_id, x, y, z, v: local maxima of the volume made ``factor`` times finer, refined to a fraction of a cell,
    thinned to a distance, inside the support; places and ``least_distance`` are in cells of the volume."""
    spark = cells.sparkSession
    fine_size = size * factor
    fine = cut(blocks.upsample_cells(cells, {a: size for a in "ijk"}, factor), spark) if factor > 1 else cells
    tops = select.local_maxima(fine, threshold, most)
    ids = cut(tops.select((F.col("i").cast("long") * fine_size * fine_size + F.col("j") * fine_size + F.col("k")).alias("peak_id"), "i", "j", "k", "v"), spark)
    found = fits.refine_peaks(ids, fine).where("flag = 0").join(ids.select("peak_id", "v"), "peak_id").withColumnRenamed("peak_id", "atom_id").drop("flag")
    found = found.withColumns({a: (F.col(a) - (fine_size - 1) / 2) / factor + (size - 1) / 2 for a in "xyz"})
    kept = select.greedy_min_distance(cut(found, spark), least_distance).where("flag = 0").drop("flag")
    if support is not None:
        kept = neighbours.inside_mask(kept.withColumns({a: F.col(a) + 1 for a in "xyz"}), support).withColumns({a: F.col(a) - 1 for a in "xyz"})
    return kept


def _by_intensity(box: DataFrame, kinds: int, seed: int | None) -> DataFrame:
    """atom_id, label (from 1, in order of the mean intensity): k-means, then the boundaries that part classes best."""
    sums = cut(aggregate.box_sum(box), box.sparkSession)
    labelled, _ = cluster.kmeans(sums, "intensity", kinds) if seed is None else cluster.seeded_kmeans(sums, "intensity", kinds, seed)
    ends = cluster.refine_boundaries(sums, "intensity", kinds)
    if len(ends) == kinds - 1:
        labelled = cluster.classify_by_boundaries(sums, "intensity", ends)
    return cut(cluster.order_labels(labelled, "intensity").select("atom_id", "label"), box.sparkSession)


def classify(atoms: DataFrame, cells: DataFrame, size: int, kinds: int, half: int = 1, radius: float | None = None, background: float | None = None, seed: int | None = None) -> DataFrame:
    """``atoms`` with species 1..kinds: classes of the boxes' intensity, then by the mean boxes of the neighbourhood.

    With ``background`` there is one class more at first, the faintest, of what may be no atoms; those whose box is
    nearer to that constant than to the mean box of the next class go, and the rest are classified anew.
    """
    spark = atoms.sparkSession
    box = cut(project.box_samples(atoms.select("atom_id", *"xyz"), cells, shape.ball_offsets(half), size), spark)
    labels = _by_intensity(box, kinds + (background is not None), seed)
    if background is not None:
        faint = cluster.mean_box(box, labels.where("label = 2")).select("off_id", "v")
        real = cut(cluster.atom_or_not(box, faint, background).where("is_atom").select("atom_id"), spark)
        box = cut(box.join(real, "atom_id", "left_semi"), spark)
        labels = _by_intensity(box, kinds, seed)
    species = labels.select("atom_id", F.col("label").alias("species"))
    if radius:
        local = cluster.local_reclassify(atoms.drop("species").join(species.withColumn("species", F.col("species") - 1), "atom_id"), box, radius, kinds)
        species = local.select("atom_id", (F.col("label") + 1).alias("species"))
    return atoms.drop("species").join(species, "atom_id")


def refine(atoms: DataFrame, measured: DataFrame, angles: DataFrame, size: int, height: dict, width: dict, rounds: int = 5, step: float = 0.1, most: float = 1.0) -> tuple[DataFrame, list[float]]:
    """Positions moved down the gradient of the squared difference of projections, at most ``most`` from where they began.

    A view's gradient is turned back by its three angles.
    """
    spark = atoms.sparkSession
    now, errors = cut(atoms.withColumns({f"{a}0": F.col(a) for a in "xyz"}), spark), []
    for _ in range(rounds):
        at = project.view_positions(now.select("atom_id", "species", *"xyz"), angles)
        model = cut(project.combined(project.splat(at, height, width, size)), spark)
        fit = project.scale_to(model, measured).first()
        errors.append(float(fit["error"]))
        res = model.join(measured.withColumnRenamed("v", "_y"), ["view", "r", "c"], "full").na.fill(0.0, ["v", "_y"]).select("view", "r", "c", (F.col("v") - F.col("_y") / (fit["scale"] or 1.0)).alias("v"))
        g = project.position_gradient(at, res, height, width, size).join(F.broadcast(angles.select("view", "phi", "theta", "psi")), "view")  # a row for each view
        back = [F.col("gx"), F.col("gy"), F.lit(0.0)]
        for axis, angle in (((0, 0, 1), "phi"), ((0, 1, 0), "theta"), ((1, 0, 0), "psi")):
            back = fn.rotated(fn.axis_rotation(axis, -F.col(angle)), *back)
        moved = g.groupBy("atom_id").agg(*(F.avg(v).alias(f"m{a}") for v, a in zip(back, "xyz")))
        nxt = now.join(moved, "atom_id", "left").na.fill(0.0, ["mx", "my", "mz"])
        for a in "xyz":
            nxt = nxt.withColumn(a, F.greatest(F.col(f"{a}0") - most, F.least(F.col(f"{a}0") + most, F.col(a) - step * F.col(f"m{a}"))))
        now = cut(nxt.drop("mx", "my", "mz"), spark)
    return now.drop("x0", "y0", "z0"), errors


def refine_all(atoms: DataFrame, measured: DataFrame, angles: DataFrame, size: int, height: dict, width: dict, bounds: dict, rounds: int = 10, inner: int = 10, step: float = 0.1, most: float = 1.0) -> dict:
    """``rounds`` times: heights and widths by bounded least squares, then down their gradient, then positions.

    ``bounds`` has (least, greatest) of "height" and "width"; heights are relative to the first species'.  Returns the
    model (DataFrame), height, width, and the errors of each step in order.
    """
    species, history = sorted(height), []
    now = atoms
    for _ in range(rounds):
        at = cut(project.view_positions(now.select("atom_id", "species", *"xyz"), angles), atoms.sparkSession)
        stats, last = project.parameter_stats(at, measured, size, species)
        start = np.array([height[s] / height[species[0]] for s in species] + [width[s] for s in species])
        n = len(species)
        low, high = (np.array([1.0] + [bounds["height"][k]] * (n - 1) + [bounds["width"][k]] * n) for k in (0, 1))
        found, _ = project.bounded_least_squares(stats, start, low, high, rounds=inner)
        history.append(("least squares", last["error"]))
        height, width = dict(zip(species, found[:n].tolist())), dict(zip(species, found[n:].tolist()))
        height, width, errors = project.descend_heights_widths(at, measured, height, width, size, inner)
        history += [("heights and widths", e) for e in errors]
        now, errors = refine(now, measured, angles, size, height, width, inner, step, most)
        history += [("positions", e) for e in errors]
    return {"model": now, "height": height, "width": width, "history": history}
