"""Linear maps along one axis of images: filters, Fourier shifts and the rotation frame's low pass.

A separable filter is two such maps.  A task gets whole lines of the axis, many at once, so an image is never in one
place; absent rows are 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def along(df: DataFrame, axis: str, weights: np.ndarray | Callable[[float], np.ndarray], by: str | None = None) -> DataFrame:
    """``df`` (integer keys, ``axis``, v) with each line's values multiplied by a matrix (new length, length).

    With ``by``, a column that is the same for a whole line, ``weights`` is a function of its value.
    """
    keys = [c for c in df.columns if c not in (axis, "v", by)]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ", ".join([*(f"{k} int" for k in keys), *([f"{by} double"] if by else []), f"{axis} int", "v double"])

    def run(key, got):
        places = np.column_stack([got.column(k).to_numpy() for k in keys])
        lines, first, of = np.unique(places, axis=0, return_index=True, return_inverse=True)
        given = got.column(by).to_numpy()[first] if by else np.zeros(len(lines))
        out, chosen = [], []
        for value in np.unique(given):
            matrix = weights(float(value)) if by else weights
            some = np.flatnonzero(given == value)
            place = np.full(len(lines), -1)
            place[some] = np.arange(len(some))
            rows = np.flatnonzero(place[of.ravel()] >= 0)
            dense = np.zeros((len(some), matrix.shape[1]))
            dense[place[of.ravel()[rows]], got.column(axis).to_numpy()[rows]] = got.column("v").to_numpy()[rows]
            out.append(dense @ matrix.T)
            chosen.append(some)
        made, order = np.concatenate(out), np.concatenate(chosen)
        line, step = np.indices(made.shape)
        line = order[line.ravel()]
        columns = {k: pa.array(lines[line, n], pa.int32()) for n, k in enumerate(keys)}
        return pa.table({**columns, **({by: given[line]} if by else {}), axis: pa.array(step.ravel(), pa.int32()), "v": made.ravel()})

    rows = df.select(*(F.col(c).cast("int").alias(c) for c in (*keys, axis)), F.col("v").cast("double").alias("v"), *([F.col(by).cast("double").alias(by)] if by else []))
    return rows.withColumn("_task", F.pmod(F.xxhash64(*keys), F.lit(tasks))).groupBy("_task").applyInArrow(run, kind).select(*df.columns)


def gaussian_weights(n: int, sigma: float, radius: int | None = None, border: str = "edge") -> np.ndarray:
    """Taps up to ``radius`` (four sigma) to each side; beyond the border the edge is repeated (edge) or mirrored (symmetric)."""
    radius = int(4 * sigma + 0.5) if radius is None else radius
    taps = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    source = np.pad(np.arange(n), radius, mode=border)
    out = np.zeros((n, n))
    for k, w in enumerate(taps / taps.sum()):
        np.add.at(out, (np.arange(n), source[k : k + n]), w)
    return out


def gaussian(df: DataFrame, sigma: float, rows: int, cols: int, radius: int | None = None, border: str = "edge") -> DataFrame:
    for axis, n in (("r", rows), ("c", cols)):
        df = along(df, axis, gaussian_weights(n, sigma, radius, border))
    return df


def without_highest(n: int) -> np.ndarray:
    """Of a line in a zero frame of twice its length, without that frame's highest frequency."""
    sign = np.where(np.arange(n) % 2, -1.0, 1.0)
    return np.eye(n) - np.outer(sign, sign) / (2 * n)


def shift_weights(n: int, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary part of a circular shift by ``distance``; only the highest frequency of an even line has the latter."""
    k = np.fft.fftfreq(n)
    full = np.fft.ifft(np.exp(-2j * np.pi * k * distance)[:, None] * np.fft.fft(np.eye(n), axis=0), axis=0)
    return full.real, full.imag


def fourier_shift(df: DataFrame, shifts: DataFrame, rows: int, cols: int) -> DataFrame:
    """view, r, c, v: each view circularly shifted by its dy and dx (``shifts``: view, dy, dx; a row for each view).

    The real part of two complex maps, one after the other.
    """
    both = None
    for part, sign in ((0, 1.0), (1, -1.0)):
        out = df.select("view", "r", "c", "v")
        for axis, n, name in (("r", rows, "dy"), ("c", cols, "dx")):
            out = out.join(F.broadcast(shifts.select("view", name)), "view")
            out = along(out, axis, lambda d, n=n, part=part: shift_weights(n, d)[part], by=name).drop(name)
        out = out.withColumn("v", sign * F.col("v"))
        both = out if both is None else both.unionByName(out)
    return both.groupBy("view", "r", "c").agg(F.sum("v").alias("v"))
