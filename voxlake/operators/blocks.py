"""Long tables to arrays at the edge of a kernel, one image or volume a task, and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

IMAGE = "view int, r int, c int, v double"


def image_of(table: pa.Table, rows: int, cols: int, value: str = "v") -> np.ndarray:
    out = np.zeros((rows, cols))
    out[table.column("r").to_numpy(), table.column("c").to_numpy()] = table.column(value).to_numpy()
    return out


def rows_of(view: int, image: np.ndarray) -> pa.Table:
    r, c = np.indices(image.shape)
    return pa.table({"view": pa.array(np.full(image.size, view), pa.int32()), "r": pa.array(r.ravel(), pa.int32()), "c": pa.array(c.ravel(), pa.int32()), "v": pa.array(image.ravel().astype(float))})


def map_images(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], rows: int, cols: int) -> DataFrame:
    """``kernel`` on each view's image; an image is bounded by the detector, whatever the number of views."""

    def run(key, got):
        return rows_of(key[0].as_py(), kernel(image_of(got, rows, cols)))

    return df.select("view", "r", "c", "v").groupBy("view").applyInArrow(run, IMAGE)


def filter_images(df: DataFrame, response: DataFrame, rows: int, cols: int) -> DataFrame:
    """Each image filtered in Fourier space by ``response`` (r, c, v; centred), for instance a mean form factor."""
    from .images import apply_filter

    centred = np.zeros((rows, cols))
    for r in response.select("r", "c", "v").toLocalIterator():  # one image
        centred[r["r"], r["c"]] = r["v"]
    return map_images(df, lambda a: apply_filter(a, centred), rows, cols)


def drift_corrected(summed: DataFrame, moves: DataFrame, rows: int, cols: int) -> DataFrame:
    """The sums of aligned frames, resampled along a line that undoes the mean drift while a frame was scanned.

    ``moves`` (frame, view, dy, dx) are the frames' shifts; the mean of their steps is that from the first to the last.
    """
    from pyspark.sql import functions as F

    from .images import along_drift

    ends = {a: (F.max_by(a, "frame") - F.min_by(a, "frame")) / F.greatest(F.lit(1), F.max("frame") - F.min("frame")) for a in ("dy", "dx")}
    steps = moves.groupBy("view").agg(*(v.alias(a) for a, v in ends.items()))

    def run(key, got):
        dy, dx = (got.column(a)[0].as_py() for a in ("dy", "dx"))
        return rows_of(key[0].as_py(), along_drift(image_of(got, rows, cols), dy, dx))

    return summed.select("view", "r", "c", "v").join(F.broadcast(steps), "view").groupBy("view").applyInArrow(run, IMAGE)  # a row for each view


def view_values(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, float]], rows: int, cols: int, names: list[str]) -> DataFrame:
    """One row of numbers for each view."""

    def run(key, got):
        out = kernel(image_of(got, rows, cols))
        return pa.table({"view": pa.array([key[0].as_py()], pa.int32()), **{n: pa.array([float(out[n])]) for n in names}})

    return df.select("view", "r", "c", "v").groupBy("view").applyInArrow(run, "view int, " + ", ".join(f"{n} double" for n in names))


def upsample_cells(cells: DataFrame, sizes: dict[str, int], factor: int = 3) -> DataFrame:
    """i, j, k, v of a dense volume on a grid ``factor`` times finer, by not-a-knot splines along one axis after another.

    A task gets whole lines of an axis, so a volume is never in one place; absent cells and NaN are 0.
    """
    from pyspark.sql import functions as F

    from .images import spline_weights

    out = cells.select(*sizes, F.nanvl(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ", ".join(f"{a} int" for a in sizes) + ", v double"

    def along(axis: str, n: int, others: list[str], weights: np.ndarray):
        def run(key, got):
            places = np.column_stack([got.column(a).to_numpy() for a in others])
            lines, of = np.unique(places, axis=0, return_inverse=True)
            dense = np.zeros((len(lines), n))
            dense[of.ravel(), got.column(axis).to_numpy()] = got.column("v").to_numpy()
            fine = dense @ weights.T
            at, step = np.indices(fine.shape)
            columns = {axis: step.ravel(), **{a: lines[at.ravel(), k] for k, a in enumerate(others)}}
            return pa.table({**{a: pa.array(columns[a], pa.int32()) for a in sizes}, "v": fine.ravel()})

        return run

    for axis, n in sizes.items():
        others = [a for a in sizes if a != axis]
        out = out.withColumn("_task", F.pmod(F.xxhash64(*others), F.lit(tasks))).groupBy("_task").applyInArrow(along(axis, n, others, spline_weights(n, factor)), kind)
    return out
