"""Gather by corners, splat of atoms to projections, and the sums that fitting needs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import axis_rotation, form_factor, half_away, rotated


def gather(points: DataFrame, cells: DataFrame, axes: dict[str, tuple[str, int]], key: str = "id", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """key, v: multilinear interpolation at ``points`` ({coordinate: (cell axis, size)}, from 0), of one or more values.

    Each point meets its 2^n corners by an equi-join; outside the grid, and for coordinates that aren't finite, it is 0;
    the last sample is exact.
    """
    inside = F.lit(True)
    for p, (_, n) in axes.items():
        inside = inside & F.col(p).isNotNull() & ~F.isnan(p) & (F.col(p) >= 0) & (F.col(p) <= n - 1)
    corners, w = points.where(inside).select(key, *axes), F.lit(1.0)
    for p, (a, n) in axes.items():
        corners = corners.withColumn(f"_{a}", F.least(F.floor(p), F.lit(max(0, n - 2))).cast("int"))
        corners = corners.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1))))
        part = F.col(p) - F.col(f"_{a}")
        corners = corners.withColumn(f"_w{a}", F.when(F.col("_d") == 1, part).otherwise(1 - part)).withColumn(a, F.col(f"_{a}") + F.col("_d")).drop("_d")
        w = w * F.col(f"_w{a}")
    corners = corners.withColumn("_w", w).where("_w <> 0")
    got = corners.join(cells, [a for a, _ in axes.values()]).groupBy(key).agg(*(F.sum(F.col("_w") * F.col(v)).alias(v) for v in values))
    return points.select(key).join(got, key, "left").select(key, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def gather_complex(points: DataFrame, cells: DataFrame, axes: dict[str, tuple[str, int]], key: str = "id") -> DataFrame:
    """key, re, im: as ``gather`` for cells with a real and an imaginary part."""
    return gather(points, cells, axes, key, ("re", "im"))


def mean_form_factor(coefficients: DataFrame, rows: int, cols: int, resolution: float) -> DataFrame:
    """r, c, v: the mean over the elements of ``coefficients`` (z, a1-a3 ... d1-d3) of the form factor at each frequency.

    ``resolution`` is the size of a pixel; the middle of an axis of n is the rounded half (to even) of n + 1, from 1.
    """
    from .shape import grid

    cells = grid(coefficients.sparkSession, {"r": (0, rows - 1), "c": (0, cols - 1)})
    q = F.sqrt(sum((((F.col(a) + 1 - int(np.rint((n + 1) / 2))) / (n * resolution)) ** 2 for a, n in (("r", rows), ("c", cols))), F.lit(0.0)))
    value = form_factor(q, *([F.col(f"{k}{i}") for i in (1, 2, 3)] for k in "abcd"))
    return cells.crossJoin(F.broadcast(coefficients)).groupBy("r", "c").agg(F.avg(value).alias("v"))  # a row for each element


def box_samples(atoms: DataFrame, cells: DataFrame, offsets: list[tuple[int, int, int]], size: int) -> DataFrame:
    """atom_id, off_id, v: intensities at offsets around each atom."""
    items = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(float(x)).alias(a) for x, a in zip(o, "xyz"))) for n, o in enumerate(offsets)))
    pts = atoms.withColumn("_o", F.explode(items)).select("atom_id", F.col("_o.n").alias("off_id"), *((F.col(a) + F.col(f"_o.{a}")).alias(a) for a in "xyz"))
    pts = pts.withColumn("id", F.struct("atom_id", "off_id"))
    return gather(pts, cells, {a: (i, size) for a, i in zip("xyz", "ijk")}).select("id.atom_id", "id.off_id", "v")


def view_positions(atoms: DataFrame, angles: DataFrame) -> DataFrame:
    """Each atom in each view, turned by phi about z, theta about y, psi about x; ``angles`` has a row for each view."""
    at = atoms.crossJoin(F.broadcast(angles))  # a row for each view of the microscope
    p = [F.col(a) for a in "xyz"]
    for axis, angle in (((1, 0, 0), "psi"), ((0, 1, 0), "theta"), ((0, 0, 1), "phi")):
        p = rotated(axis_rotation(axis, F.col(angle)), *p)
    return at.select("atom_id", "species", "view", *(c.alias(a) for c, a in zip(p, "xyz")))


def splat(at: DataFrame, height: dict[int, float], width: dict[int, float], size: int, patch: int = 4, scale: float = 1.0, power: bool = False) -> DataFrame:
    """view, r, c, species, v: Gaussians of the atoms summed on pixels, the beam's direction integrated out; with
    ``power`` each times its squared distance.

    Each atom is sent to its (2 patch + 1)^2 pixels and summed there before the shuffle; pixels outside are left out.
    """
    mid = size // 2
    h = F.element_at(F.create_map(*(F.lit(x) for kv in height.items() for x in kv)), F.col("species"))
    b = F.element_at(F.create_map(*(F.lit(x) for kv in width.items() for x in kv)), F.col("species"))
    at = at.withColumns({"_h": h, "_b": b, "_px": F.col("x") * scale, "_py": F.col("y") * scale})
    at = at.withColumns({"_rx": half_away(F.col("_px")), "_ry": half_away(F.col("_py"))})
    span = F.sequence(F.lit(-patch), F.lit(patch))
    at = at.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    dx, dy = F.col("_rx") + F.col("_dx") - F.col("_px"), F.col("_ry") + F.col("_dy") - F.col("_py")
    v = F.col("_h") * F.sqrt(F.lit(math.pi) / F.col("_b")) * F.exp(-F.col("_b") * (dx * dx + dy * dy)) * (dx * dx + dy * dy if power else F.lit(1.0))
    at = at.select("view", (F.col("_rx") + F.col("_dx") + mid).cast("int").alias("r"), (F.col("_ry") + F.col("_dy") + mid).cast("int").alias("c"), "species", v.alias("v"))
    return at.where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)).groupBy("view", "r", "c", "species").agg(F.sum("v").alias("v"))


def parameter_planes(at: DataFrame, height: dict[int, float], width: dict[int, float], size: int, patch: int = 4) -> DataFrame:
    """view, r, c and for each species s: h<s>, b<s>, the derivatives of the projection by its height and width."""
    species = sorted(height)
    unit = {s: 1.0 for s in species}
    planes = splat(at, unit, width, size, patch)
    moments = splat(at, unit, width, size, patch, power=True)
    both = planes.join(moments.withColumnRenamed("v", "_m"), ["view", "r", "c", "species"])
    # d/db of sqrt(pi / b) exp(-b d^2) is -(d^2 + 1 / (2 b)) times it
    of = lambda s, c: F.sum(F.when(F.col("species") == s, c).otherwise(0.0))
    return both.groupBy("view", "r", "c").agg(*(of(s, F.col("v")).alias(f"h{s}") for s in species), *(of(s, -F.lit(height[s]) * (F.col("_m") + F.col("v") / (2 * width[s]))).alias(f"b{s}") for s in species))


def parameter_stats(at: DataFrame, measured: DataFrame, size: int, species: list[int], patch: int = 4):
    """A function of (heights, widths) for ``bounded_least_squares``: sums over all pixels of the residual with the best
    overall scale, one row to the driver; and a dictionary that holds the last scale and error."""
    last: dict[str, float] = {}
    y = measured.select("view", "r", "c", F.col("v").cast("double").alias("_y"))

    def stats(p):
        n = len(species)
        height, width = dict(zip(species, map(float, p[:n]))), dict(zip(species, map(float, p[n:])))
        planes = parameter_planes(at, height, width, size, patch).join(y, ["view", "r", "c"], "full").na.fill(0.0)
        model = sum((F.col(f"h{s}") * height[s] for s in species), F.lit(0.0))
        rows = planes.withColumn("_p", model)
        scale = rows.agg((F.sum(F.col("_p") * F.col("_y")) / F.sum(F.col("_p") * F.col("_p"))).alias("k")).first()["k"] or 1.0
        columns = rows.select((F.col("_p") * scale - F.col("_y")).alias("res"), *((F.col(f"{a}{s}") * scale).alias(f"j{k}") for k, (a, s) in enumerate((a, s) for a in "hb" for s in species)), "_p", "_y")
        along = [F.sum(F.col(f"j{k}") * F.col("_p")).alias(f"m{k}") for k in range(2 * n)]
        more = columns.agg((F.sum(F.abs("res")) / F.sum(F.abs("_y"))).alias("error"), F.sum(F.col("_p") * F.col("_p")).alias("mm"), *along)
        got = residual_sums(columns, 2 * n).crossJoin(more).first()  # one row each
        last.update(scale=float(scale), error=float(got["error"] or 0.0))
        jj = np.zeros((2 * n, 2 * n))
        for a in range(2 * n):
            for b in range(a, 2 * n):
                jj[a, b] = jj[b, a] = got[f"jj{a}_{b}"] or 0.0
        if got["mm"]:  # what the best scale takes up of a change isn't seen
            along = np.array([got[f"m{k}"] or 0.0 for k in range(2 * n)])
            jj -= np.outer(along, along) / got["mm"]
        return got["rr"] or 0.0, np.array([got[f"jr{k}"] or 0.0 for k in range(2 * n)]), jj

    return stats, last


def descend_heights_widths(at: DataFrame, measured: DataFrame, height: dict[int, float], width: dict[int, float], size: int, rounds: int = 10, step: float = 1.0, patch: int = 4) -> tuple[dict, dict, list[float]]:
    """Heights and widths after ``rounds`` gradient steps, and each round's error.

    A species' step is over its atoms, the views and the pixels; heights are relative to the first species', and
    neither falls below 0.
    """
    species = sorted(height)
    counts = {r["species"]: r["n"] for r in at.groupBy("species").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each species
    stats, last = parameter_stats(at, measured, size, species, patch)
    h, b, errors = np.array([height[s] for s in species]), np.array([width[s] for s in species]), []
    h = h / h[0]
    for _ in range(rounds):
        _, g, jj = stats(np.concatenate([h, b]))
        errors.append(last["error"])
        power = np.where(np.diag(jj) > 1e-9 * np.diag(jj).max(), np.diag(jj), np.inf)  # a change that the scale takes up is no step
        active = np.array([counts.get(s, 0) > 0 for s in species])
        h = np.where(active, np.maximum(h - step * 0.5 * g[: len(h)] / power[: len(h)], 0.0), h)
        b = np.where(active, np.maximum(b - step * 0.5 * g[len(h) :] / power[len(h) :], 1e-6), b)
        h = h / h[0] if h[0] > 0 else h
    return dict(zip(species, h.tolist())), dict(zip(species, b.tolist())), errors


def combined(planes: DataFrame) -> DataFrame:
    return planes.groupBy("view", "r", "c").agg(F.sum("v").alias("v"))


def scale_to(p: DataFrame, y: DataFrame) -> DataFrame:
    """scale, error: factor of p that fits y best, and sum |difference| / sum |y| with it."""
    j = p.select("view", "r", "c", F.col("v").cast("double").alias("_p")).join(y.select("view", "r", "c", F.col("v").cast("double").alias("_y")), ["view", "r", "c"], "full").na.fill(0.0, ["_p", "_y"])
    s = j.agg((F.sum(F.col("_p") * F.col("_y")) / F.sum(F.col("_p") * F.col("_p"))).alias("scale"))
    out = j.crossJoin(F.broadcast(s))  # one row
    return out.groupBy("scale").agg((F.sum(F.abs(F.col("_p") * F.col("scale") - F.col("_y"))) / F.sum(F.abs(F.col("_y")))).alias("error"))


def residual_sums(columns: DataFrame, parameters: int) -> DataFrame:
    """rr, jr0.., jj0_0..: what a least-squares step needs of residuals ``res`` and derivatives ``j0..``; one row."""
    j = [F.col(f"j{n}") for n in range(parameters)]
    return columns.agg(F.sum(F.col("res") * F.col("res")).alias("rr"), *(F.sum(x * F.col("res")).alias(f"jr{n}") for n, x in enumerate(j)), *(F.sum(a * b).alias(f"jj{m}_{n}") for m, a in enumerate(j) for n, b in enumerate(j) if n >= m))


def _in_radius(g: np.ndarray, h: np.ndarray, radius: float) -> tuple[np.ndarray, bool]:
    """Where g s + s h s / 2 is least in a ball, and whether h is positive definite."""
    e, u = np.linalg.eigh(h)
    b, scale = u.T @ g, max(np.abs(e).max(), 1e-300)
    definite = bool(e[0] > 1e-14 * scale)
    if definite and np.linalg.norm(b / e) <= radius:
        return -u @ (b / e), True
    low = max(0.0, -e[0])
    near = np.abs(e + low) <= 1e-14 * scale
    if not definite and np.abs(b[near]).max(initial=0.0) <= 1e-14 * np.linalg.norm(b):
        rest = np.where(near, 0.0, -b / np.where(near, 1.0, e + low))
        if (left := radius**2 - rest @ rest) >= 0:  # the least eigenvalue's direction leads to the rim
            return u @ (rest + np.eye(len(g))[0] * np.sqrt(left)), False
    high = low + np.linalg.norm(b) / radius + 1e-300
    for _ in range(200):  # the shift whose step ends on the rim
        mid = (low + high) / 2
        if np.linalg.norm(b / np.maximum(e + mid, 1e-300)) > radius:
            low = mid
        else:
            high = mid
        if high - low <= 1e-15 * high:
            break
    return -u @ (b / np.maximum(e + high, 1e-300)), definite


def bounded_least_squares(stats, start, low, high, rounds: int = 400, tolerance: float = 1e-12, radius: float = 10.0) -> tuple[np.ndarray, float]:
    """Minimises residuals within bounds; ``stats(p)`` returns (sum r^2, J^T r, J^T J), for instance from ``residual_sums``.

    A trust region in coordinates that are scaled by the way to the bound which the gradient points at.  A round takes
    the best by the model of three steps: the region's minimiser, its reflection at the first bound it meets, and
    steepest descent; all stop short of the bounds, so every point that ``stats`` sees lies strictly between them.
    The region doubles after a step to its rim that gains three quarters of what the model says, and shrinks to a quarter
    after one that gains less than a quarter.  It ends when the scaled gradient is under ``tolerance``, when a step
    vanishes, after ``rounds``, or after 100 evaluations a parameter (derivatives counted as one each).  Parameters
    whose bounds are equal stay there.
    """
    low, high = (np.broadcast_to(np.asarray(x, float), np.shape(start)) for x in (low, high))
    whole = np.clip(np.asarray(start, float), low, high)
    free = high > low
    if not free.any():
        return whole, float(stats(whole)[0])
    lo, hi, count = low[free], high[free], int(free.sum())

    def at(x):
        p = whole.copy()
        p[free] = x
        value, g, h = stats(p)
        return float(value), np.asarray(g, float)[free], np.asarray(h, float)[np.ix_(free, free)]

    def inside(x):
        gap = np.minimum(1e-10 * np.maximum(1.0, np.abs(x)), np.where(np.isfinite(hi - lo), (hi - lo) / 4, np.inf))
        return np.clip(x, lo + gap, hi - gap)

    def reach(x, s):
        """How many times s fits between the bounds, and the first parameter to meet one."""
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(s > 0, (hi - x) / s, np.where(s < 0, (lo - x) / s, np.inf))
        return float(t.min()), int(t.argmin())

    x = inside(whole[free])
    value, g, h = at(x)
    used, length = count + 1, np.inf
    for n in range(rounds):
        to = np.where(g < 0, hi, lo)
        bounded = np.isfinite(to)
        way = np.where(bounded, np.abs(x - np.where(bounded, to, 0.0)), 1.0)
        if np.abs(way * g).max() < tolerance or (n > 1 and length < np.finfo(float).eps) or used > 100 * count:
            break
        d = np.sqrt(way)
        sg, sh = d * g, d[:, None] * h * d + np.diag(np.where(bounded, np.abs(g), 0.0))
        model = lambda s: sg @ s + s @ sh @ s / 2
        keep = max(0.95, 1 - np.abs(way * g).max())
        short = lambda s, start, most: min(most, keep * reach(start, d * s)[0])
        full, _ = _in_radius(sg, sh, radius)
        steps = [full * short(full, x, 1.0)]
        first, hit = reach(x, d * full)
        if first < 1 and np.linalg.norm(first * full) < 0.9 * radius:
            edge, back = first * full, full.copy()
            back[hit] = -back[hit]
            bend, slope = back @ sh @ back, (sg + sh @ edge) @ back
            rim = (-(edge @ back) + np.sqrt((edge @ back) ** 2 + (back @ back) * (radius**2 - edge @ edge))) / (back @ back)
            far = min(rim, -slope / bend) if bend > 0 else rim
            if far > 0:
                steps.append(edge + back * short(back, np.clip(x + d * edge, lo, hi), far))
        bend, norm = sg @ sh @ sg, np.linalg.norm(sg)
        down = -sg * min(radius / norm, sg @ sg / bend if bend > 0 else np.inf)
        steps.append(down * short(down, x, 1.0))
        step = min(steps, key=model)
        length, new = float(np.linalg.norm(step)), inside(x + d * step)
        got = at(new)
        used += count + 1
        gain = (got[0] - value) / 2 + step @ (np.where(bounded, np.abs(g), 0.0) * step) / 2
        said = model(step)
        ratio = gain / said if said else 0.0
        if ratio >= 0.75 and length >= 0.9 * radius:
            radius *= 2
        elif ratio <= 0.25:
            radius = min(radius, length) / 4
        if got[0] < value:
            x, (value, g, h) = new, got
    whole[free] = x
    return whole, value


def position_gradient(at: DataFrame, residual: DataFrame, height: dict[int, float], width: dict[int, float], size: int, patch: int = 4) -> DataFrame:
    """atom_id, gx, gy (of each view's frame): gradient of half the squared residual, gathered from each atom's patch."""
    mid = size // 2
    h = F.element_at(F.create_map(*(F.lit(x) for kv in height.items() for x in kv)), F.col("species"))
    b = F.element_at(F.create_map(*(F.lit(x) for kv in width.items() for x in kv)), F.col("species"))
    at = at.withColumns({"_h": h, "_b": b, "_rx": half_away(F.col("x")), "_ry": half_away(F.col("y"))})
    span = F.sequence(F.lit(-patch), F.lit(patch))
    at = at.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    dx, dy = F.col("_rx") + F.col("_dx") - F.col("x"), F.col("_ry") + F.col("_dy") - F.col("y")
    e = F.col("_h") * F.sqrt(F.lit(math.pi) / F.col("_b")) * F.exp(-F.col("_b") * (dx * dx + dy * dy)) * 2 * F.col("_b")
    at = at.select("atom_id", "view", (F.col("_rx") + F.col("_dx") + mid).cast("int").alias("r"), (F.col("_ry") + F.col("_dy") + mid).cast("int").alias("c"), (e * dx).alias("ex"), (e * dy).alias("ey"))
    return at.join(residual.select("view", "r", "c", F.col("v").alias("res")), ["view", "r", "c"]).groupBy("atom_id", "view").agg(F.sum(F.col("ex") * F.col("res")).alias("gx"), F.sum(F.col("ey") * F.col("res")).alias("gy"))
