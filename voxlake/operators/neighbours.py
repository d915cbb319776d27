"""Joins within a radius, by cells, and the statistics on them.

Points are hashed to cells as wide as the radius; one side is repeated over the 27 cells around it, and the join is on
the cell.  Every point meets only its surroundings, so the join grows with the points at a given density.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import stored
from .shape import ball_offsets, spread

AROUND = [o for o in ball_offsets(1, slack=1.0)]


def _cells(df: DataFrame, width: float) -> DataFrame:
    return df.withColumns({f"_{a}": F.floor(F.col(a) / width).cast("int") for a in "xyz"})


def pairs(df: DataFrame, radius: float, carry: list[str] = (), coincident: bool = False) -> DataFrame:
    """a, b, d, dx, dy, dz (and ``carry`` of both as a_*, b_*) of ordered pairs with 0 < d < radius; with ``coincident``
    also those of two atoms at one place."""
    keep = ["atom_id", "x", "y", "z", *carry]
    left = _cells(df.select(*keep), radius)
    left = left.select(*(F.col(c).alias(f"a_{c}") for c in keep), "_x", "_y", "_z")
    right = spread(_cells(df.select(*keep), radius), AROUND, ["_x", "_y", "_z"], ["_x", "_y", "_z"])
    right = right.select(*(F.col(c).alias(f"b_{c}") for c in keep), "_x", "_y", "_z")
    j = left.join(right, ["_x", "_y", "_z"])
    delta = {f"d{a}": F.col(f"b_{a}") - F.col(f"a_{a}") for a in "xyz"}
    j = j.withColumns(delta).withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    apart = F.col("a_atom_id") != F.col("b_atom_id") if coincident else F.col("d") > 0
    return j.where(apart & (F.col("d") < radius)).select(F.col("a_atom_id").alias("a"), F.col("b_atom_id").alias("b"), "d", "dx", "dy", "dz", *(f"{s}_{c}" for s in "ab" for c in carry))


def bounding_box(df: DataFrame) -> DataFrame:
    """One row: least coordinates and extents."""
    return df.agg(*(F.min(a).alias(f"{a}0") for a in "xyz"), *((F.max(a) - F.min(a)).alias(f"{a}w") for a in "xyz"))


def periodic_images(df: DataFrame, radius: float) -> DataFrame:
    """Rows of all images of the box's periodic cell that are nearer than ``radius`` to it."""
    inner = df.crossJoin(F.broadcast(bounding_box(df)))  # one row
    images = spread(inner.withColumns({f"_{a}": F.lit(0) for a in "xyz"}), AROUND, ["_x", "_y", "_z"], ["_x", "_y", "_z"])
    images = images.withColumns({a: F.col(a) + F.col(f"_{a}") * F.col(f"{a}w") for a in "xyz"})
    near = F.lit(True)
    for a in "xyz":
        near = near & (F.col(a) >= F.col(f"{a}0") - radius) & (F.col(a) <= F.col(f"{a}0") + F.col(f"{a}w") + radius)
    return images.where(near)


def periodic_pairs(df: DataFrame, radius: float, carry: list[str] = ()) -> DataFrame:
    """As ``pairs``, in the box's periodic cell: b may be any image of an atom, a is in the cell."""
    keep = ["atom_id", *carry]
    images = periodic_images(df, radius)
    left = _cells(df, radius).select(*(F.col(c).alias(f"a_{c}") for c in [*keep, *"xyz"]), "_x", "_y", "_z")
    right = spread(_cells(images.select(*keep, *"xyz"), radius), AROUND, ["_x", "_y", "_z"], ["_x", "_y", "_z"])
    right = right.select(*(F.col(c).alias(f"b_{c}") for c in [*keep, *"xyz"]), "_x", "_y", "_z")
    j = left.join(right, ["_x", "_y", "_z"]).withColumns({f"d{a}": F.col(f"b_{a}") - F.col(f"a_{a}") for a in "xyz"})
    j = j.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return j.where((F.col("d") > 0) & (F.col("d") < radius)).select(F.col("a_atom_id").alias("a"), F.col("b_atom_id").alias("b"), "d", "dx", "dy", "dz", *(f"{s}_{c}" for s in "ab" for c in carry))


def neighbour_count(df: DataFrame, radius: float) -> DataFrame:
    n = pairs(df, radius).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return df.select("atom_id").join(n, F.col("atom_id") == F.col("a"), "left").select("atom_id", F.coalesce("n", F.lit(0)).alias("n"))


def matched(df: DataFrame, other: DataFrame, radius: float) -> DataFrame:
    """Atoms of ``df`` with one of ``other`` within ``radius`` (closed); a semi join on cells."""
    left = _cells(df, max(radius, 1e-12))
    right = spread(_cells(other.select(*"xyz"), max(radius, 1e-12)), AROUND, ["_x", "_y", "_z"], ["_x", "_y", "_z"]).select(*(F.col(a).alias(f"o{a}") for a in "xyz"), "_x", "_y", "_z")
    d2 = sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in "xyz"), F.lit(0.0))
    on = (left["_x"] == right["_x"]) & (left["_y"] == right["_y"]) & (left["_z"] == right["_z"]) & (d2 <= radius * radius)
    return left.join(right, on, "left_semi").drop("_x", "_y", "_z")


def inside_mask(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Atoms whose rounded position (half even, from 1) is a cell of ``mask`` (i, j, k)."""
    at = df.withColumns({n: (F.rint(a) - 1).cast("int") for n, a in zip("ijk", "xyz")})
    return at.join(mask.select("i", "j", "k"), ["i", "j", "k"], "left_semi").drop("i", "j", "k")


def inside_eroded(df: DataFrame, mask: DataFrame, offsets: list[tuple[int, int, int]], sizes: tuple[int, int, int]) -> DataFrame:
    """Atoms inside the mask eroded by ``offsets``, without building it.

    An atom whose own cell lies outside the volume is not inside; offsets that lead outside don't count against one.
    """
    at = df.select("atom_id", *((F.rint(a) - 1).cast("int").alias(n) for n, a in zip("ijk", "xyz")))
    for n, size in zip("ijk", sizes):
        at = at.where(F.col(n).between(0, size - 1))
    probes = spread(at, offsets, ["i", "j", "k"], ["i", "j", "k"])
    out = F.lit(False)
    for n, size in zip("ijk", sizes):
        out = out | (F.col(n) < 0) | (F.col(n) >= size)
    hit = probes.join(mask.select("i", "j", "k").distinct().withColumn("_hit", F.lit(True)), ["i", "j", "k"], "left")
    good = hit.groupBy("atom_id").agg(F.bool_and(F.coalesce("_hit", F.lit(False)) | out).alias("_in")).where("_in").select("atom_id")
    return df.join(good, "atom_id", "left_semi")


def short_range_order(df: DataFrame, radius: float, periodic: bool = False) -> DataFrame:
    """ti, tj, n, alpha of each pair of species: 1 - (share of tj around ti) / (share of tj)."""
    p = (periodic_pairs if periodic else pairs)(df, radius, ["species"])
    counts = p.groupBy(F.col("a_species").alias("ti"), F.col("b_species").alias("tj")).agg(F.count(F.lit(1)).alias("n"))
    kinds = df.groupBy("species").agg(F.count(F.lit(1)).alias("k"))
    total = kinds.agg(F.sum("k").alias("t"))
    share = kinds.crossJoin(F.broadcast(total)).select(F.col("species").alias("tj"), (F.col("k") / F.col("t")).alias("x"))  # one row
    around = F.sum("n").over(Window.partitionBy("ti"))
    return counts.withColumn("_n", around).join(share, "tj").select("ti", "tj", "n", (1 - F.col("n") / F.col("_n") / F.col("x")).alias("alpha"))


def symmetric_order(alpha: DataFrame) -> DataFrame:
    """ti, tj, alpha: mean with the transpose, times three."""
    t = alpha.select(F.col("ti").alias("tj"), F.col("tj").alias("ti"), F.col("alpha").alias("_t"))
    return alpha.join(t, ["ti", "tj"]).select("ti", "tj", ((F.col("alpha") + F.col("_t")) / 2 * 3).alias("alpha"))


def radial_counts(df: DataFrame, low: float, high: float, width: float, periodic: bool = False) -> DataFrame:
    """bin, n of ordered pairs by distance."""
    p = (periodic_pairs if periodic else pairs)(df, high)
    bins = int((high - low) / width)
    return p.where(F.col("d") >= low).select(F.floor((F.col("d") - low) / width).cast("int").alias("bin")).where(F.col("bin") < bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def radial_distribution(df: DataFrame, low: float, high: float, width: float, periodic: bool = True) -> DataFrame:
    """r, g: counts over the shell's volume and mean density, smoothed by a Gaussian of one bin."""
    bins = int((high - low) / width)
    spark = df.sparkSession
    counts = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(radial_counts(df, low, high, width, periodic), "bin", "left")
    box = bounding_box(df).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("atoms"))))  # one row each
    r0, r1 = low + F.col("bin") * width, low + (F.col("bin") + 1) * width
    shell = 4 / 3 * math.pi * (r1 * r1 * r1 - r0 * r0 * r0)
    density = F.col("atoms") / (F.col("xw") * F.col("yw") * F.col("zw"))
    g = counts.crossJoin(F.broadcast(box)).select("bin", (F.coalesce("n", F.lit(0)) / (shell * density * F.col("atoms"))).alias("g"))  # one row
    taps = [math.exp(-t * t / 2) for t in range(-4, 5)]
    w = Window.orderBy("bin")
    smooth = sum((F.lit(x / sum(taps)) * F.coalesce(F.lag("g", -t).over(w), F.col("g")) for t, x in zip(range(-4, 5), taps)), F.lit(0.0))
    return g.select((low + (F.col("bin") + 0.5) * width).alias("r"), smooth.alias("g"))


def _harmonics(l: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):  # noqa: E741
    """Real spherical harmonics of the directions u, v, w, a row for each m, by the associated Legendre recurrence."""
    cos_m, sin_m = [np.ones_like(u)], [np.zeros_like(u)]
    for _ in range(l):
        cos_m.append(cos_m[-1] * u - sin_m[-1] * v)
        sin_m.append(sin_m[-1] * u + cos_m[-2] * v)
    for m in range(l + 1):
        # polynomial coefficients of d^m P_l / dw^m
        poly = _legendre(l)
        for _ in range(m):
            poly = [i * c for i, c in enumerate(poly)][1:]
        norm = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - m) / math.factorial(l + m)) * (math.sqrt(2) if m else 1)
        value = np.full_like(u, poly[-1] * norm)
        for c in reversed(poly[:-1]):
            value *= w
            if c:
                value += c * norm
        yield value * cos_m[m]
        if m:
            yield value * sin_m[m]


def _legendre(n: int) -> list[float]:
    a, b = [1.0], [0.0, 1.0]
    if n == 0:
        return a
    for k in range(1, n):
        c = [0.0] + [(2 * k + 1) / (k + 1) * x for x in b]
        for i, x in enumerate(a):
            c[i] -= k / (k + 1) * x
        a, b = b, c
    return b


def bond_order(df: DataFrame, radius: float, ls: tuple[int, ...] = (4, 6), periodic: bool = True) -> DataFrame:
    """atom_id, q4, q6: bond-orientational order averaged over an atom and its neighbours; 0 without neighbours.

    Both averages are sums over balls (``balls.near_sums``): of harmonics of the directions, then of the neighbours' averages.
    In a periodic cell an atom is a neighbour by each of its images that is near.
    """
    from . import balls

    atoms = df.select("atom_id", *"xyz")
    images = periodic_images(atoms, radius) if periodic else atoms
    names = [f"{l}" for l in ls for _ in range(2 * l + 1)]
    n = len(names)

    def of(u, v, w):
        return np.vstack([np.ones_like(u), *(row for l in ls for row in _harmonics(l, u, v, w))])

    zero = F.array_repeat(F.lit(0.0), n + 1)
    own = balls.near_sums(atoms.withColumn("v", zero), images.select(*"xyz", F.lit(None).cast("array<double>").alias("v")), radius, of=of)
    count = F.col("v")[0]
    mean = F.transform(F.slice("v", 2, n), lambda x: F.when(count > 0, x / count).otherwise(0.0))
    own = stored(own.select("atom_id", *"xyz", F.concat(F.array(F.lit(1.0)), mean).alias("v")))  # with the atom itself, counted first
    hood = balls.near_sums(own, periodic_images(own, radius) if periodic else own, radius)
    norms = [F.sqrt(4 * math.pi / (2 * l + 1) * sum(((F.col("v")[k + 1] / count) * (F.col("v")[k + 1] / count) for k, of_l in enumerate(names) if of_l == f"{l}"), F.lit(0.0))).alias(f"q{l}") for l in ls]
    return hood.select("atom_id", *norms)
