"""Reconstruction of a volume from tilted projections, as exchanges between slabs, views and blocks.

A volume is a relation of cells (i, j, k, v), projections one of pixels (view, r, c, v); absent rows are 0.  The
transform of the padded volume never exists in one place: planes of the volume are transformed by themselves, each sends
every slab of the spectrum its rows, and a slab finishes the third axis.  Slabs answer for the points of all views'
slices that fall between their rows, a view's answers meet in one task and become a projection.  On the way back the
volume is cut into blocks; a block receives the tiles of each view that its shadow touches, and sums over views in
place.  So a task holds a plane, a slab, an image or a block, whatever the volume.

Angles are phi, theta, psi in degrees about the third, second and first axis; the middle of an axis of n is n // 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import forget, stored
from .shape import centre_start

PIXELS, CELLS = "view int, r int, c int, v double", "i int, j int, k int, v double"


def view_rotation(phi: float, theta: float, psi: float) -> np.ndarray:
    """From volume to view."""
    out = np.eye(3)
    for (a, b), degrees in zip(((0, 1), (2, 0), (1, 2)), (phi, theta, psi)):
        t, one = np.radians(degrees), np.eye(3)
        one[[a, b], [a, b]], one[a, b], one[b, a] = np.cos(t), -np.sin(t), np.sin(t)
        out = out @ one
    return out.T


def turns_of(angles: DataFrame) -> dict[int, np.ndarray]:
    """Rotation of each view of ``angles`` (view, phi, theta, psi), which has a row for each view of the microscope."""
    rows = angles.select("view", "phi", "theta", "psi").collect()
    turns = {r.view: view_rotation(r.phi, r.theta, r.psi) for r in rows}
    if len(turns) < len(rows) or not turns:
        raise ValueError("angles need one row for each view")
    return turns


# back-projection
def _shadows(spark, turns: dict[int, np.ndarray], size: int, block: int) -> DataFrame:
    """block, view, tr, tc: tiles of each view that the cells of a block can fall on; a block's shadow is a rectangle."""
    per_axis, mid, half = -(-size // block), size // 2, (block - 1) / 2
    rows = [(v, *(float(x) for x in t[:2].ravel())) for v, t in turns.items()]
    views = spark.createDataFrame(rows, "view int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    at = spark.range(per_axis**3).withColumnRenamed("id", "block")
    out = at.crossJoin(F.broadcast(views))  # a row for each view
    centre = [(F.floor(F.col("block") / per_axis**p) % per_axis) * block + half - mid for p in (2, 1, 0)]
    for tile, m in (("tr", "a"), ("tc", "b")):
        middle = sum((F.col(f"{m}{n}") * c for n, c in enumerate(centre)), F.lit(0.0)) + mid
        reach = sum((F.abs(F.col(f"{m}{n}")) * half for n in range(3)), F.lit(1e-6))
        low, high = F.greatest(F.floor(middle - reach), F.lit(0)), F.least(F.floor(middle + reach) + 1, F.lit(size - 1))
        out = out.withColumns({"_low": low, "_high": high}).where("_low <= _high")
        out = out.withColumn(tile, F.explode(F.sequence(F.floor(F.col("_low") / block), F.floor(F.col("_high") / block)))).drop("_low", "_high")
    return out.select("block", "view", "tr", "tc")


def back_project(pixels: DataFrame, turns: dict[int, np.ndarray], size: int, block: int = 16) -> DataFrame:
    """i, j, k, v: for each cell the sum over views of the bilinear value where it falls; cells that fall on no
    projection are left out.

    Pixels are packed by tiles of ``block``, tiles go to the blocks of cells that they may be seen from.
    """
    packed = pixels.where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)).withColumns({"tr": F.floor(F.col("r") / block), "tc": F.floor(F.col("c") / block)})
    packed = packed.groupBy("view", "tr", "tc").agg(*(F.collect_list(F.col(x).cast(t)).alias(x) for x, t in (("r", "int"), ("c", "int"), ("v", "double"))))  # a tile is bounded
    sent = _shadows(pixels.sparkSession, turns, size, block).join(packed, ["view", "tr", "tc"], "left").select("block", "view", "r", "c", "v")
    per_axis, mid = -(-size // block), size // 2

    def run(key, got):
        number = key[0].as_py()
        first = np.array([number // per_axis**2, number // per_axis % per_axis, number % per_axis]) * block
        cells = np.indices((block,) * 3).reshape(3, -1) + first[:, None]
        cells = cells[:, (cells < size).all(axis=0)]
        total, hit = np.zeros(cells.shape[1]), np.zeros(cells.shape[1], bool)
        tiles: dict[int, list] = {}
        for row in got.select(["view", "r", "c", "v"]).to_pylist():
            tiles.setdefault(row["view"], []).append([np.array(row[x] or [], t) for x, t in (("r", int), ("c", int), ("v", float))])
        for view in sorted(tiles):
            x, y = turns[view][:2] @ (cells - mid) + mid
            inside = np.flatnonzero((x >= 0) & (x <= size - 1) & (y >= 0) & (y <= size - 1))
            if not len(inside):
                continue
            hit[inside] = True
            x, y = x[inside], y[inside]
            lx, ly = (np.minimum(np.floor(a), max(0, size - 2)).astype(int) for a in (x, y))
            low, high = (lx.min(), ly.min()), (lx.max(), ly.max())
            shadow = np.zeros((high[0] - low[0] + 2, high[1] - low[1] + 2))
            for r, c, v in tiles[view]:
                near = (r >= low[0]) & (r <= high[0] + 1) & (c >= low[1]) & (c <= high[1] + 1)
                shadow[r[near] - low[0], c[near] - low[1]] = v[near]
            px, py = x - lx, y - ly
            for dx, wx in ((0, 1 - px), (1, px)):
                for dy, wy in ((0, 1 - py), (1, py)):
                    total[inside] += wx * wy * shadow[lx - low[0] + dx, ly - low[1] + dy]
        return pa.table({**{a: pa.array(c[hit], pa.int32()) for a, c in zip("ijk", cells)}, "v": total[hit]})

    return sent.groupBy("block").applyInArrow(run, CELLS)


# the padded volume's transform
def _centred(a: np.ndarray, axes, transform) -> np.ndarray:
    return np.fft.fftshift(transform(np.fft.ifftshift(a, axes), axes=axes), axes)


def _slabs(cells: DataFrame, size: int, big: int, thick: int) -> DataFrame:
    """slab, i, rows: the rows of the transform of plane i that slab number ``slab`` needs, with one row over."""
    start = centre_start(big, size)

    def run(key, got):
        plane = np.zeros((big, big), complex)
        plane[got.column("j").to_numpy() + start, got.column("k").to_numpy() + start] = got.column("v").to_numpy()
        plane = _centred(plane, (0, 1), np.fft.fftn)
        numbers = range(-(-big // thick))
        return pa.table({"slab": pa.array(numbers, pa.int32()), "i": pa.array([key[0].as_py()] * len(numbers), pa.int32()), "rows": [plane[s * thick : s * thick + thick + 1].tobytes() for s in numbers]})

    inside = F.lit(True)
    for a in "ijk":
        inside = inside & F.col(a).between(0, size - 1)
    planes = cells.where(inside).select(*(F.col(a).cast("int").alias(a) for a in "ijk"), F.col("v").cast("double").alias("v"))
    return planes.groupBy("i").applyInArrow(run, "slab int, i int, rows binary")


def _whole(got: pa.Table, size: int, big: int) -> np.ndarray:
    """A slab of the spectrum: all of the first and third axis, its own rows and one over of the second."""
    start, rows = centre_start(big, size), [np.frombuffer(b, complex).reshape(-1, big) for b in got.column("rows").to_pylist()]
    slab = np.zeros((big, len(rows[0]), big), complex)
    slab[got.column("i").to_numpy() + start] = rows
    return _centred(slab, (0,), np.fft.fftn)


def spectrum(cells: DataFrame, size: int, big: int, thick: int = 4) -> DataFrame:
    """i, j, k, re, im: the centred transform of the volume in the middle of a cube of ``big``."""

    def run(key, got):
        slab = _whole(got, size, big)[:, :thick]
        i, j, k = np.indices(slab.shape)
        return pa.table({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel() + key[0].as_py() * thick, pa.int32()), "k": pa.array(k.ravel(), pa.int32()), "re": slab.real.ravel(), "im": slab.imag.ravel()})

    return _slabs(cells, size, big, thick).groupBy("slab").applyInArrow(run, "i int, j int, k int, re double, im double")


def _slices(cells: DataFrame, turns: dict[int, np.ndarray], size: int, big: int, thick: int) -> DataFrame:
    """view, at, z: places (r big + c) and complex values of each view's slice that a slab answers for."""
    mid = big // 2
    p = np.arange(big) - mid

    def run(key, got):
        slab, first = _whole(got, size, big), key[0].as_py() * thick
        out = []
        for view, turn in turns.items():
            # place of point (p, q) of the slice along each axis; the second says which slab has it
            x, y, z = (turn[0, a] * p[:, None] + turn[1, a] * p[None, :] + mid for a in range(3))
            low = np.minimum(np.floor(y), big - 2)
            r, c = np.nonzero((low >= first) & (low < first + thick) & (x >= 0) & (x <= big - 1) & (y >= 0) & (y <= big - 1) & (z >= 0) & (z <= big - 1))
            if not len(r):
                continue
            at = [a[r, c] for a in (x, y, z)]
            cell = [np.minimum(np.floor(a), big - 2).astype(int) for a in at]
            part = [a - b for a, b in zip(at, cell)]
            value = np.zeros(len(r), complex)
            for corner in np.ndindex(2, 2, 2):
                w = np.prod([f if d else 1 - f for d, f in zip(corner, part)], axis=0)
                value += w * slab[cell[0] + corner[0], cell[1] - first + corner[1], cell[2] + corner[2]]
            out.append((view, (r * big + c).astype(np.int32).tobytes(), value.tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["view", "at", "z"])

    return _slabs(cells, size, big, thick).groupBy("slab").applyInArrow(run, "view int, at binary, z binary")


def project(cells: DataFrame, turns: dict[int, np.ndarray], size: int, oversampling: float = 3, thick: int = 4) -> DataFrame:
    """view, r, c, v: projections of the volume by the slices of its padded transform."""
    big = round(size * oversampling)
    start = centre_start(big, size)

    def run(key, got):
        plane = np.zeros(big * big, complex)
        for at, z in zip(got.column("at").to_pylist(), got.column("z").to_pylist()):
            plane[np.frombuffer(at, np.int32)] = np.frombuffer(z, complex)
        image = _centred(plane.reshape(big, big), (0, 1), np.fft.ifftn).real[start : start + size, start : start + size]
        r, c = np.indices(image.shape)
        return pa.table({"view": pa.array([key[0].as_py()] * image.size, pa.int32()), "r": pa.array(r.ravel(), pa.int32()), "c": pa.array(c.ravel(), pa.int32()), "v": image.ravel()})

    return _slices(cells, turns, size, big, thick).groupBy("view").applyInArrow(run, PIXELS)


def reconstruct(pixels: DataFrame, angles: DataFrame, size: int, rounds: int = 200, oversampling: float = 3, step: float = 2.0, thick: int = 4, block: int = 16) -> tuple[DataFrame, list[float]]:
    """Cells above 0 of the volume whose slices meet the projections, and each round's error: the mean over views of
    the share of a projection's intensity that is missed.

    A round projects the volume, carries the differences back, moves by step / views / size and cuts at 0; its tables
    are written and the last round's are dropped.
    """
    turns = turns_of(angles)
    measured = stored(pixels.select(*(F.col(a).cast("int").alias(a) for a in ("view", "r", "c")), F.col("v").cast("double").alias("v")).where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)))
    unknown = measured.select("view").distinct().where(~F.col("view").isin(list(turns))).limit(1).collect()
    if unknown:
        raise ValueError(f"view {unknown[0].view} has no angles")
    power = measured.groupBy("view").agg(F.greatest(F.sum(F.abs("v")), F.lit(1e-12)).alias("power"))
    volume, errors = None, []
    for _ in range(rounds):
        differences = measured.withColumn("v", -F.col("v"))
        if volume is not None:
            differences = differences.unionByName(project(volume, turns, size, oversampling, thick)).groupBy("view", "r", "c").agg(F.sum("v").alias("v"))
        miss = stored(differences)
        share = miss.groupBy("view").agg(F.sum(F.abs("v")).alias("m")).join(power, "view")
        errors.append(float(share.agg(F.avg(F.col("m") / F.col("power"))).first()[0] or 0.0))
        moves = back_project(miss, turns, size, block).withColumn("v", F.col("v") * (-step / len(turns) / size))
        cells = moves if volume is None else volume.unionByName(moves)
        after = stored(cells.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).where("v > 0"))
        forget(volume, miss)
        volume = after
    forget(measured)
    return volume, errors
