"""Column functions: rounding, clamping, variance stabilising, form factors, rotations, stationary points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Half away from zero, exactly: the part behind the point of a double is itself a double; integers."""
    whole = F.floor(F.abs(x))
    return (F.signum(x) * (whole + F.when(F.abs(x) - whole >= 0.5, 1).otherwise(0))).cast("long")


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def half_even(x: Column) -> Column:
    return F.rint(x)


def nan_to_zero(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(0.0))


def clamp_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("double"))


def dark_floor(x: Column, least: float = 1000.0, instead: float = 1e10) -> Column:
    """Values up to ``least`` stand for no measurement."""
    return F.when(x <= least, F.lit(instead)).otherwise(x)


def subtract_dark(x: Column, dark: Column, least: float = -1000.0) -> Column:
    """Difference; far below zero becomes zero."""
    return F.when(x - dark < least, F.lit(0.0)).otherwise(x - dark)


def vst_forward(x: Column, alpha: Column, sigma: Column, mean: Column) -> Column:
    """Generalised Anscombe transform of Poisson noise of gain alpha with Gaussian noise sigma."""
    return 2 / alpha * F.sqrt(F.greatest(F.lit(0.0), alpha * x + 0.375 * alpha * alpha + sigma * sigma - alpha * mean))


def to_unit(x: Column, low: Column, high: Column, start: float = 0.15, stop: float = 0.85) -> Column:
    return (x - low) / (high - low) * (stop - start) + start


def from_unit(y: Column, low: Column, high: Column, start: float = 0.15, stop: float = 0.85) -> Column:
    return (y - start) / (stop - start) * (high - low) + low


def form_factor(q: Column, a: list, b: list, c: list, d: list) -> Column:
    """Electron form factor: three Lorentzians a / (q^2 + b) and three Gaussians c exp(-d q^2)."""
    q2 = q * q
    a, b, c, d = ([x if isinstance(x, Column) else F.lit(x) for x in part] for part in (a, b, c, d))
    return sum((x / (q2 + y) for x, y in zip(a, b)), F.lit(0.0)) + sum((x * F.exp(-y * q2) for x, y in zip(c, d)), F.lit(0.0))


def axis_rotation(axis: tuple[float, float, float], degrees: Column) -> list[list[Column]]:
    """3 x 3 columns that turn coordinates about ``axis``; a positive angle turns the axes, so signs are those of -angle."""
    n = math.sqrt(sum(x * x for x in axis))
    u = [x / n for x in axis]
    t = -F.radians(degrees)
    c, s = F.cos(t), F.sin(t)
    skew = [[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]]
    return [[(c if i == j else F.lit(0.0)) + (1 - c) * (u[i] * u[j]) + s * float(skew[i][j]) for j in range(3)] for i in range(3)]


def rotated(m: list[list[Column]], x: Column, y: Column, z: Column) -> list[Column]:
    return [row[0] * x + row[1] * y + row[2] * z for row in m]


def gauss3(x: Column, y: Column, z: Column, height: float, widths: tuple[float, float, float], centre=(0.0, 0.0, 0.0)) -> Column:
    """Gaussian with an axis-aligned covariance; turn the coordinates first for another."""
    return F.lit(height) * F.exp(-sum(((v - c) * (v - c) / (2 * w * w) for v, c, w in zip((x, y, z), centre, widths)), F.lit(0.0)))


def gauss3_turned(x: Column, y: Column, z: Column, height: float, spreads: tuple[float, float, float], degrees: tuple[float, float, float], centre=(0.0, 0.0, 0.0), floor: float = 0.0) -> Column:
    """floor + height exp(-sum u^2 / spread), where u is the place turned about z, then y, then z."""
    u = [v - c for v, c in zip((x, y, z), centre)]
    for axis, angle in zip(((0, 0, 1), (0, 1, 0), (0, 0, 1)), degrees):
        u = rotated(axis_rotation(axis, F.lit(float(angle))), *u)
    return F.lit(floor) + F.lit(height) * F.exp(-sum((v * v / w for v, w in zip(u, spreads)), F.lit(0.0)))


def ordered_sum(values: Column) -> Column:
    """Sum of an array of doubles in a fixed order, so that its last bits don't depend on how rows were dealt.

    Fixed values: under 44 values one after another; otherwise every fourth value in one of four lanes, which are then
    added; from 89000 on blocks of 4096 that are summed so and added one after another.
    """
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    lanes = lambda a: fold(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: fold(F.filter(a, lambda _, i: i % 4 == k))))
    one = lambda a: F.when(F.size(a) < 44, fold(a)).otherwise(lanes(a))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(values) - 1), F.lit(4096))
    return F.when(F.size(values) < 89000, one(values)).otherwise(fold(F.transform(starts, lambda s: one(F.slice(values, s + 1, 4096)))))


def ordered_mean(values: Column) -> Column:
    return ordered_sum(values) / F.size(values)


def ordered_variance(values: Column, mean: Column) -> Column:
    """About ``mean``, over one less than the number of values (1 at least)."""
    return ordered_sum(F.transform(values, lambda v: (v - mean) * (v - mean))) / F.greatest(F.lit(1), F.size(values) - 1)


def stationary_point(g: list[Column], h: dict[str, Column]) -> tuple[list[Column], Column]:
    """Where g + H d = 0, each part clamped to 0.5, and whether H is that of a maximum.

    ``h`` holds xx, yy, zz, xy, xz, yz.  A maximum has a negative trace part, a positive minor and a negative determinant.
    """
    xx, yy, zz, xy, xz, yz = (h[k] for k in ("xx", "yy", "zz", "xy", "xz", "yz"))
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    safe = F.when(det == 0, F.lit(None)).otherwise(det)
    dx = -((yy * zz - yz * yz) * g[0] + (xz * yz - xy * zz) * g[1] + (xy * yz - xz * yy) * g[2]) / safe
    dy = -((xz * yz - xy * zz) * g[0] + (xx * zz - xz * xz) * g[1] + (xy * xz - xx * yz) * g[2]) / safe
    dz = -((xy * yz - xz * yy) * g[0] + (xy * xz - xx * yz) * g[1] + (xx * yy - xy * xy) * g[2]) / safe
    top = (xx < 0) & (xx * yy - xy * xy > 0) & (det < 0)
    return [F.greatest(F.lit(-0.5), F.least(F.lit(0.5), v)) for v in (dx, dy, dz)], top
