"""Crops, pads, shifts, view selection and offset tables over long image and volume tables.

All but the offset tables are projections and filters, so they stay in one stage and their bounds reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def centre_start(large: int, small: int) -> int:
    """First index of the window of ``small`` in ``large`` that puts the centre index (n + 1) / 2, half up, on itself."""
    return (large + 2) // 2 - (small + 2) // 2


def window_of(large: int, small: int) -> tuple[int, int]:
    """First and last index, from 1, of the embedded window."""
    start = centre_start(large, small)
    return start + 1, start + small


def crop(df: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """Keeps the central window of each axis: {axis: (size, new size)}; indices start at 0 again."""
    for axis, (n, m) in sizes.items():
        at = centre_start(n, m)
        df = df.where(F.col(axis).between(at, at + m - 1)).withColumn(axis, F.col(axis) - at)
    return df


def pad(df: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """Shifts indices into a larger frame; absent cells are zero."""
    return df.withColumns({axis: F.col(axis) + centre_start(m, n) for axis, (n, m) in sizes.items()})


def crop_or_pad(df: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """To a new size about the floor centre: cells outside go, absent cells are zero."""
    for axis, (n, m) in sizes.items():
        df = df.withColumn(axis, F.col(axis) + (m // 2 - n // 2)).where(F.col(axis).between(0, m - 1))
    return df


def crop_at(df: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """A window of ``size`` about each view's centre (view, cr, cc; from 0); outside the image there are no rows.

    ``centres`` has a row for each view; Spark broadcasts it only while it is small.
    """
    df = df.join(centres, "view")
    for axis, centre in (("r", "cr"), ("c", "cc")):
        df = df.withColumn(axis, (F.col(axis) - (F.floor(F.col(centre) + 1.5) - 1 - size // 2)).cast("int"))
    return df.where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)).drop("cr", "cc")


def select_views(df: DataFrame, drop: list[int] = (), keep: list[int] | None = None, trim: bool = False) -> DataFrame:
    """Views without ``drop``, only ``keep`` if given; ``trim`` leaves out the first and last if there are over two."""
    if drop:
        df = df.where(~F.col("view").isin(list(drop)))
    if keep is not None:
        return df.where(F.col("view").isin(list(keep)))
    if trim:
        ends = df.agg(F.min("view").alias("_lo"), F.max("view").alias("_hi"), F.count_distinct("view").alias("_n"))
        df = df.crossJoin(F.broadcast(ends)).where("_n <= 2 OR (view > _lo AND view < _hi)").drop("_lo", "_hi", "_n")  # one row
    return df


def shift(df: DataFrame, by: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """Integer shift; what leaves the frame goes."""
    for axis, s in by.items():
        df = df.withColumn(axis, F.col(axis) + s).where(F.col(axis).between(0, sizes[axis] - 1))
    return df


def roll(df: DataFrame, by: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    return df.withColumns({axis: F.pmod(F.col(axis) + s, F.lit(sizes[axis])).cast("int") for axis, s in by.items()})


def transpose(df: DataFrame, a: str = "r", b: str = "c") -> DataFrame:
    return df.select(*(F.col({a: b, b: a}.get(c, c)).alias(c) for c in df.columns))


def drop_first(df: DataFrame, axes: list[str]) -> DataFrame:
    for axis in axes:
        df = df.where(F.col(axis) >= 1)
    return df


def grid(spark: SparkSession, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Every cell of a box, from ranges of a size the caller names."""
    df = None
    for axis, (lo, hi) in spans.items():
        one = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(axis))
        df = one if df is None else df.crossJoin(one)
    return df


def sphere_support(spark: SparkSession, size: int) -> DataFrame:
    """Cells with distance from the middle size / 2 of at most size / 2."""
    half = size / 2
    inside = sum(((F.col(a) - half) * (F.col(a) - half) for a in "ijk"), F.lit(0.0)) <= half * half
    return grid(spark, {a: (0, size - 1) for a in "ijk"}).where(inside)


def ball_offsets(radius: int, slack: float = 0.5, axes: int = 3) -> list[tuple[int, ...]]:
    """Offsets within radius + slack, in order; a small list for broadcasting as literals."""
    from itertools import product

    return [o for o in product(range(-radius, radius + 1), repeat=axes) if sum(x * x for x in o) <= (radius + slack) ** 2]


def box_offsets(size: int) -> list[tuple[int, int, int]]:
    """Offsets of a cube of ``size`` within size / 2 of its middle."""
    half = (size - 1) // 2
    return [o for o in ball_offsets(half, slack=half) if sum(x * x for x in o) <= (size / 2) ** 2 and max(map(abs, o)) <= half]


def element(n: int) -> list[tuple[int, int, int]]:
    """Spherical structuring element of diameter ``n``; an even one lies on half integers and is anchored past the middle."""
    from itertools import product

    mid = (n - 1) / 2
    return [tuple(int(x - n // 2) for x in p) for p in product(range(n), repeat=3) if sum((x - mid) ** 2 for x in p) <= (n / 2) ** 2]


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets of a Euclidean disk."""
    return ball_offsets(radius, slack=0.0, axes=2)


def angle_table(df: DataFrame) -> DataFrame:
    """view, theta to the three-angle form [0, theta, 0]; a table with all three angles stays, any other is refused."""
    have = [c for c in ("phi", "theta", "psi") if c in df.columns]
    if len(have) == 3:
        return df.select("view", *have)
    if have != ["theta"]:
        raise ValueError(f"angles need theta alone or phi, theta and psi, not {have}")
    return df.select("view", F.lit(0.0).alias("phi"), "theta", F.lit(0.0).alias("psi"))


def border(df: DataFrame, margin: float, size: int) -> DataFrame:
    """Atoms at least ``margin`` inside on each axis; the upper bound follows the first axis."""
    ok = F.lit(True)
    for a in "xyz":
        ok = ok & (F.col(a) >= margin) & (F.col(a) <= size - margin)
    return df.where(ok)


def offsets_frame(spark: SparkSession, offsets: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    return spark.createDataFrame(offsets, ", ".join(f"{n} int" for n in names))


def spread(df: DataFrame, offsets: list[tuple[int, ...]], axes: list[str], names: list[str]) -> DataFrame:
    """Each row once for each offset, with the shifted indices as ``names``; a generator, not a join."""
    items = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(o, names))) for o in offsets))
    df = df.withColumn("_o", F.explode(items))
    return df.withColumns({n: (F.col(a) + F.col(f"_o.{n}")).cast("int") for a, n in zip(axes, names)}).drop("_o")
