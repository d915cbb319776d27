"""Histograms, thresholds, moments, normalisation and comparison.

Each aggregates partially before its shuffle; what is ordered afterwards is a table of bins, never the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _beside(df: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``few``, which has a row for each group, or one."""
    return df.join(F.broadcast(few), by) if by else df.crossJoin(F.broadcast(few))


def otsu(df: DataFrame, value: str = "v", bins: int = 256, by: list[str] = ()) -> DataFrame:
    """threshold (and ``by``): one more than the first bin with the largest between-class variance; values in unit-wide
    bins from 0.

    A constant image separates nothing and has a null threshold; a constant group has no row.
    """
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(value))).cast("int")
    counts = df.groupBy(*by, bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return _best_split(counts, by).select(*by, (F.col("b") + 1).alias("threshold"))


def _best_split(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """b of the best split of a table (b, n) of at most a few hundred bins, or one row of null; or of each group's."""
    every = Window.partitionBy(*by)
    w = every.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    m = F.col("n") * (F.col("b") + 1)
    at = counts.select(*by, "b", F.sum("n").over(w).alias("w"), F.sum(m).over(w).alias("m"), F.sum("n").over(every).alias("wt"), F.sum(m).over(every).alias("mt")).where("w < wt")
    gap = F.col("mt").cast("double") * F.col("w") - F.col("m").cast("double") * F.col("wt")
    score = gap * gap / (F.col("w").cast("double") * (F.col("wt") - F.col("w")))
    return at.groupBy(*by).agg(F.max_by(F.col("b"), F.struct(score.alias("s"), (-F.col("b")).alias("o"))).alias("b"))


def otsu_scaled(df: DataFrame, value: str = "v", by: list[str] = ()) -> DataFrame:
    """threshold on the data's scale, of values stretched to 0..255; 0 if nothing is positive."""
    top = df.groupBy(*by).agg(F.max(value).alias("_top"))
    scaled = _beside(df, top, by).where("_top > 0").select(*by, (F.col(value) * 255.0 / F.col("_top")).alias("v"))
    return _beside(otsu(scaled, by=by), top, by).select(*by, F.when(F.col("_top") > 0, F.col("threshold") * F.col("_top") / 255.0).otherwise(0.0).alias("threshold"))


def otsu_range(df: DataFrame, value: str = "v", bins: int = 256, by: list[str] = ()) -> DataFrame:
    """threshold: left edge of the best of ``bins`` equal bins between the least and greatest value."""
    ends = df.groupBy(*by).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))).cast("int")
    counts = _beside(df, ends, by).where("_hi > _lo").groupBy(*by, b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return _beside(_best_split(counts, by), ends, by).select(*by, (F.col("_lo") + F.col("b") * (F.col("_hi") - F.col("_lo")) / bins).alias("threshold"))


def histogram(df: DataFrame, value: str, bins: int, by: list[str] = ()) -> DataFrame:
    """bin, n (and ``by``) of equal bins between the least and greatest value; the last is closed."""
    ends = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))))).otherwise(0).cast("int")
    return df.crossJoin(F.broadcast(ends)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row


def class_histograms(df: DataFrame, value: str, bins: int, by: str, centres_as_edges: bool = False) -> DataFrame:
    """``by``, bin, n: each class on the bins of all; with ``centres_as_edges`` a class's bins lie between the centres
    of those, so there is one less and what is outside the first and last centre isn't counted."""
    if not centres_as_edges:
        return histogram(df, value, bins, [by])
    ends = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    at = (F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")) - 0.5
    b = F.when(at == bins - 1, bins - 2).otherwise(F.floor(at)).cast("int")
    return df.crossJoin(F.broadcast(ends)).where("_hi > _lo").select(by, b.alias("bin")).where(F.col("bin").between(0, bins - 2)).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))  # one row


def box_sum(box: DataFrame) -> DataFrame:
    return box.groupBy("atom_id").agg(F.sum("v").alias("intensity"))


def relabel_by_mean(df: DataFrame, label: str, value: str) -> DataFrame:
    """``df`` with labels renumbered from 0 in order of their mean."""
    means = df.groupBy(label).agg(F.avg(value).alias("_m"))
    order = means.select(label, (F.row_number().over(Window.orderBy("_m", label)) - 1).cast("int").alias("_new"))
    return df.join(order, label).drop(label).withColumnRenamed("_new", label)


def centroid(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """view, cr, cc: intensity-weighted centre from 1; the middle of an image without intensity."""
    s = F.sum("v").cast("double")
    out = df.groupBy("view").agg(s.alias("_s"), F.sum((F.col("r") + 1) * F.col("v")).cast("double").alias("_r"), F.sum((F.col("c") + 1) * F.col("v")).cast("double").alias("_c"))
    mid = lambda n: F.lit((n + 1) / 2)
    safe = F.when(F.col("_s") != 0, F.col("_s"))
    return out.select("view", F.coalesce(F.col("_r") / safe, mid(rows)).alias("cr"), F.coalesce(F.col("_c") / safe, mid(cols)).alias("cc"))


def normalise(df: DataFrame, total: float | None = None) -> DataFrame:
    """Values scaled so that each view sums to the first view's total, or ``total``; a view that sums to 0 is 0.

    Sums are joined back by view, so a view's pixels needn't meet in one task.
    """
    sums = df.groupBy("view").agg(F.sum("v").cast("double").alias("_s"))
    aim = sums.agg(F.min_by("_s", "view").alias("_t")) if total is None else None
    out = df.join(sums, "view")
    out = out.crossJoin(F.broadcast(aim)) if aim is not None else out.withColumn("_t", F.lit(total))  # one row
    return out.withColumn("v", F.when(F.col("_s") == 0, 0.0).otherwise(F.col("v") * F.col("_t") / F.when(F.col("_s") != 0, F.col("_s")))).drop("_s", "_t")


def r_factors(a: DataFrame, b: DataFrame, on: list[str], by: str = "view") -> DataFrame:
    """view, r1, r2: sum |a - b| / sum |a| and the same of squares, under a root; cells that one lacks are 0."""
    j = a.select(*on, F.col("v").cast("double").alias("_a")).join(b.select(*on, F.col("v").cast("double").alias("_b")), on, "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    d = x - y
    g = j.groupBy(by).agg(F.sum(F.abs(d)).alias("d1"), F.sum(F.abs(x)).alias("s1"), F.sum(d * d).alias("d2"), F.sum(x * x).alias("s2"))
    return g.select(by, (F.col("d1") / F.when(F.col("s1") != 0, F.col("s1"))).alias("r1"), F.sqrt(F.col("d2") / F.when(F.col("s2") != 0, F.col("s2"))).alias("r2"))


def best_scale(p: Column, y: Column) -> Column:
    """Factor of p that fits y best, as an aggregate."""
    return F.sum(p * y) / F.sum(p * p)


def projection_max(df: DataFrame, along: str) -> DataFrame:
    return df.groupBy(*[a for a in "ijk" if a != along]).agg(F.max("v").alias("v"))


def middle_slice(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.where(F.col(axis) == size // 2).drop(axis)


def finite_range(df: DataFrame, value: str = "v", default=(0.0, 1.0)) -> DataFrame:
    """lo, hi over finite values; the default if there are none; hi is lo + 1 if they are equal."""
    x = F.col(value).cast("double")
    fine = ~F.isnan(x) & (F.abs(x) != float("inf"))
    g = df.where(fine).agg(F.coalesce(F.min(x), F.lit(default[0])).alias("lo"), F.coalesce(F.max(x), F.lit(default[1])).alias("hi"))
    return g.select("lo", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))


def compare(a: DataFrame, b: DataFrame, on: list[str], atol: float = 1e-6, rtol: float = 1e-6) -> DataFrame:
    """max_abs, mean_abs, rmse, max_rel, corr, allclose of two tables of cells."""
    j = a.select(*on, F.col("v").cast("double").alias("_a")).join(b.select(*on, F.col("v").cast("double").alias("_b")), on, "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    d = F.abs(x - y)
    return j.agg(
        F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(d / F.greatest(F.abs(x), F.lit(1e-12))).alias("max_rel"),
        F.corr(x, y).alias("corr"), F.bool_and(d <= atol + rtol * F.abs(x)).alias("allclose"))


def frame_sum(df: DataFrame, clamp: bool = False) -> DataFrame:
    v = F.greatest(F.col("v"), F.lit(0)) if clamp else F.col("v")
    return df.groupBy("view", "r", "c").agg(F.sum(v).alias("v"))


def binned_phases(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """frame, view, phase, r, c, v: every second pixel of the image rolled back by 0 or 1 rows (2 in ``phase``) and columns.

    With an odd number of rows or columns the last pixel of a rolled image is the first of the image.
    """
    places = []
    for axis, n in (("r", rows), ("c", cols)):
        own = F.struct((F.col(axis) % 2).cast("int").alias("p"), F.floor(F.col(axis) / 2).cast("int").alias("at"))
        wrapped = F.struct(F.lit(1).alias("p"), F.lit(n // 2).alias("at"))
        places.append(F.when((F.col(axis) == 0) & F.lit(n % 2 == 1), F.array(own, wrapped)).otherwise(F.array(own)))
    out = df.withColumn("_r", F.explode(places[0])).withColumn("_c", F.explode(places[1]))
    return out.select("frame", "view", (2 * F.col("_r.p") + F.col("_c.p")).alias("phase"), F.col("_r.at").alias("r"), F.col("_c.at").alias("c"), "v")


def noise_parameters(df: DataFrame) -> DataFrame:
    """view, alpha, sigma2: gain and constant part of the noise from the mean and variance of each pixel over frames.

    alpha solves sum(var * mean) / (alpha * sum(mean^2)) = 1 on pixels above the least mean; sigma2 is what is left.
    """
    px = df.groupBy("view", "r", "c").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    least = px.groupBy("view").agg(F.min("m").alias("_least"))
    px = px.join(least, "view").where("m > _least AND s IS NOT NULL")
    g = px.groupBy("view").agg((F.sum(F.col("s") * F.col("m")) / F.sum(F.col("m") * F.col("m"))).alias("alpha"), F.avg("s").alias("_s"), F.avg("m").alias("_m"))
    return g.select("view", "alpha", F.greatest(F.lit(0.0), F.col("_s") - F.col("alpha") * F.col("_m")).alias("sigma2"))


def background_noise(frames: DataFrame, background: DataFrame) -> DataFrame:
    """view, alpha, sigma2 as ``noise_parameters``, from blocks of 2 x 2 pixels over all frames, with the constant part
    from where ``background`` (view, r, c) has no particle.

    A block's pixels weigh by how many of them are background; 0 after that isn't counted.
    """
    block = [F.floor(F.col(a) / 2).cast("int").alias(f"_{a}") for a in "rc"]
    px = frames.select("view", *block, F.col("v").cast("double").alias("v"))
    means = px.groupBy("view", "_r", "_c").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    least = means.groupBy("view").agg(F.min("m").alias("_least"))
    gain = means.join(least, "view").where("m > _least AND s IS NOT NULL").groupBy("view").agg((F.sum(F.col("s") * F.col("m")) / F.sum(F.col("m") * F.col("m"))).alias("alpha"))
    weight = background.groupBy("view", *block).agg((F.count(F.lit(1)) / 4).alias("_w"))
    rest = px.join(weight, ["view", "_r", "_c"]).withColumn("v", F.col("v") * F.col("_w")).where("v <> 0").groupBy("view").agg(F.avg("v").alias("_m"), F.var_samp("v").alias("_s"))
    out = gain.join(rest, "view", "left")
    return out.select("view", "alpha", F.greatest(F.lit(0.0), F.coalesce("_s", F.lit(0.0)) - F.col("alpha") * F.coalesce("_m", F.lit(0.0))).alias("sigma2"))


def average_noise(df: DataFrame) -> DataFrame:
    """alpha, sigma2 averaged over views whose sigma isn't 0."""
    use = F.col("sigma2") != 0
    return df.agg(F.avg(F.when(use, F.col("alpha"))).alias("alpha"), F.avg(F.when(use, F.col("sigma2"))).alias("sigma2"))


def kth(df: DataFrame, value: str, k: Column, by: list[str]) -> DataFrame:
    """The k-th least value of each group (from 1; ``k`` may use the group's count ``n``), by counting equal values."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_upto", F.sum("_k").over(w)).withColumn("n", F.sum("_k").over(Window.partitionBy(*by)))
    return run.where(F.col("_upto") >= k).groupBy(*by).agg(F.min(value).alias(value))


def first_differences(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("diff", F.col(value) - F.lag(value).over(w)).where("diff IS NOT NULL").select(by, order, "diff")


def dark_fit(df: DataFrame, most: tuple[float, float] = (1.0, 1.5), unit: float = 1e4) -> tuple[float, float, float]:
    """a, b and the sum of squares of dark = a unit / cos(theta) + b unit with 0 <= a, b <= ``most``.

    Two unknowns: the best is the free one if it is inside, else the best of the four sides.
    """
    r = dark_fit_sums(df).crossJoin(df.agg(F.sum(F.col("dark") * F.col("dark")).alias("yy"))).first()  # one row each
    n, su, suu, sy, suy, yy = ((r[c] or 0.0) for c in ("n", "su", "suu", "sy", "suy", "yy"))
    cost = lambda a, b: yy - 2 * (a * suy + b * sy) + a * a * suu + 2 * a * b * su + b * b * n
    top = [x * unit for x in most]
    det = suu * n - su * su
    found = []
    if det > 1e-12 * max(1.0, suu * n):
        free = ((suy * n - sy * su) / det, (sy * suu - suy * su) / det)
        if all(0 <= x <= t for x, t in zip(free, top)):
            found.append(free)
    clip = lambda x, t: min(max(x, 0.0), t)
    if not found:
        found = [(a, clip((sy - a * su) / n if n else 0.0, top[1])) for a in (0.0, top[0])] + [(clip((suy - b * su) / suu if suu else 0.0, top[0]), b) for b in (0.0, top[1])]
    a, b = min(found, key=lambda p: cost(*p))
    return a / unit, b / unit, max(0.0, cost(a, b))


def dark_fit_sums(df: DataFrame) -> DataFrame:
    """Normal-equation sums of dark = a / cos(theta) + b (columns theta in degrees, dark)."""
    u = 1 / F.cos(F.radians("theta"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(u).alias("su"), F.sum(u * u).alias("suu"), F.sum("dark").alias("sy"), F.sum(u * F.col("dark")).alias("suy"))
