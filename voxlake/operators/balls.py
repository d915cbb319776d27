"""Sums over the balls around points, without a row for any pair.

Targets lie in cells as wide as the radius, and a cell that holds much of them in several parts; sources go to every part of
the 27 cells around theirs.  A task reads a part's targets and then lets its sources pass by, batch by batch, so what is
shuffled grows with the points, also where all lie near each other; only the arithmetic grows with the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import AROUND
from .shape import spread

SHARES = 32  # a part holds about this share of all targets at most
BLOCK, RUN, WIDE = 64, 32, 1024  # targets of a block, sources of a block, sources measured at once
MANY = 65_536  # targets that are dealt out in finer tasks
AT = "atom_id long, x double, y double, z double, v array<double>"
SCHEMA = pa.schema([("atom_id", pa.int64()), *((a, pa.float64()) for a in "xyz"), ("v", pa.list_(pa.float64()))])
KEY = ["_x", "_y", "_z", "_part"]


def limit_of(radius: float) -> float:
    """Least number whose root isn't below ``radius``."""
    at = radius * radius
    while at and math.sqrt(at) >= radius:
        at = math.nextafter(at, 0.0)
    while math.sqrt(at) < radius:
        at = math.nextafter(at, math.inf)
    return at


def places(batch) -> np.ndarray:
    return np.column_stack([batch.column(a).to_numpy(zero_copy_only=False) for a in "xyz"]).astype(float)


def numbers(batch) -> np.ndarray:
    """The arrays v as a matrix."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(batch.num_rows, -1) if len(flat) else np.zeros((batch.num_rows, 0))


def batch_of(ids: np.ndarray, at: np.ndarray, v: np.ndarray):
    lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel()))
    return pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(at[:, k])) for k in range(3)), lists], schema=SCHEMA)


def _squares(d: list[np.ndarray]) -> np.ndarray:
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def by_place(at: np.ndarray) -> np.ndarray:
    """An order in which blocks of ``RUN`` points lie together: halved along the longest side until no more than that are left."""
    out, todo = [], [np.arange(len(at))]
    while todo:
        rows = todo.pop()
        if len(rows) <= RUN:
            out.append(rows)
            continue
        side = np.ptp(at[rows], axis=0)
        half = (len(rows) // 2 + RUN - 1) // RUN * RUN  # blocks stay whole
        rows = rows[np.argpartition(at[rows, int(np.argmax(side))], half)] if half < len(rows) else rows
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out)


def at_most_near(at: np.ndarray, source: np.ndarray, limit: float) -> np.ndarray:
    """For each target a bound on how many sources are near it: those near the box of its block."""
    out = np.empty(len(at))
    for i in range(0, len(at), RUN):
        a = at[i : i + RUN]
        gap = np.maximum(np.maximum(source - a.max(0), a.min(0) - source), 0)
        out[i : i + RUN] = len(source) - np.count_nonzero(_squares(list(gap.T)) >= limit)
    return out


def add_near(at: np.ndarray, out: np.ndarray, source: np.ndarray, values: np.ndarray | None, limit: float, of=None) -> None:
    """Adds to each row of ``out`` the ``values`` of sources at a squared distance over 0 and below ``limit``; with ``of``, the
    rows that it gives for the directions to them.

    Both sides are taken by blocks of neighbours in their order.  Rounding keeps order, so a block's box tells exactly
    which sources are all too far, and which are all inside and enter by their sum.  The others are measured in memory
    that is used again: getting it anew costs more than the arithmetic.
    """
    if not len(at) or not len(source):
        return
    starts = np.arange(0, len(source), RUN)
    low, high = np.minimum.reduceat(source, starts), np.maximum.reduceat(source, starts)
    sums = None if of else np.add.reduceat(values, starts)
    w = 0 if of else values.shape[1]
    axes, picked = np.ascontiguousarray(source.T), np.empty((WIDE, w))
    room = np.empty((2, BLOCK * WIDE))
    for i in range(0, len(at), BLOCK):
        a = at[i : i + BLOCK]
        lo, hi = a.min(0), a.max(0)
        gap, far = np.maximum(np.maximum(low - hi, lo - high), 0), np.maximum(high - lo, hi - low)
        least, most = _squares(list(gap.T)), _squares(list(far.T))
        if not of:
            inside = (least > 0) & (most < limit)
            out[i : i + BLOCK, :w] += sums[inside].sum(0)
            near = np.flatnonzero(~(least >= limit) & ~inside)
        else:
            near = np.flatnonzero(~(least >= limit))
        rows = (near[:, None] * RUN + np.arange(RUN)).ravel()
        rows = rows[rows < len(source)]
        for j in range(0, len(rows), WIDE):
            part = rows[j : j + WIDE]
            s, d = (x[: len(a) * len(part)].reshape(len(a), len(part)) for x in room)
            for k in range(3):
                np.subtract(axes[k, part], a[:, k, None], out=d)
                np.multiply(d, d, out=d if k else s)
                if k:
                    np.add(s, d, out=s)
            hit = (s > 0) & (s < limit)
            if not of:
                d[:] = hit
                out[i : i + BLOCK, :w] += d @ np.take(values, part, axis=0, out=picked[: len(part)], mode="clip")
            elif (n := hit.sum(1)).any():
                p, q = np.nonzero(hit)
                r = np.sqrt(s[hit])
                each = of(*((axes[k, part[q]] - a[p, k]) / r for k in range(3)))
                some = np.flatnonzero(n)
                out[i + some, : len(each)] += np.add.reduceat(each, (np.cumsum(n) - n)[some], axis=1).T


def _order(width: float) -> Column:
    """Neighbours in space mostly follow each other in this order of a cell and of the 27 around one."""
    code = sum((F.pmod(F.col(f"_{a}"), F.lit(3)).cast("long") * 4096 * 3**k for k, a in enumerate("xyz")), F.lit(0).cast("long"))
    for k, a in enumerate("xyz"):
        step = F.least(F.lit(15), F.floor((F.col(a) / width - F.col(f"_{a}")) * 16).cast("int"))
        for bit in range(4):
            code = code + F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1)), 3 * bit + k)
    return code


def near_sums(targets: DataFrame, sources: DataFrame, radius: float, values=None, of=None) -> DataFrame:
    """``targets`` (atom_id, x, y, z, v) with the first numbers of v raised by what the sources nearer than ``radius``, but
    not at the same place, sum to.

    A source (x, y, z, v) counts with its v, or what ``values`` makes of a matrix of them; with ``of`` what that gives, a row
    for each sum, for arrays of the directions to sources.  Points without finite coordinates are near nothing.
    """
    spark = targets.sparkSession
    finite = sum((F.abs(F.col(a)) for a in "xyz"), F.lit(0.0)) < float("inf")
    cells = {f"_{a}": F.when(finite, F.floor(F.col(a) / radius)).otherwise(0).cast("int") for a in "xyz"}
    t = targets.select("atom_id", *"xyz", "v").withColumns(cells)
    counts = t.groupBy("_x", "_y", "_z").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    crowded = [tuple(r) for r in counts.where(F.col("n") * SHARES > total).select("_x", "_y", "_z", F.ceil(F.col("n") * SHARES / F.lit(total)).cast("int")).collect()]  # fewer than SHARES
    parts = F.broadcast(spark.createDataFrame(crowded, "_x int, _y int, _z int, _parts int"))
    n_parts = F.coalesce("_parts", F.lit(1))
    t = t.join(parts, ["_x", "_y", "_z"], "left").withColumn("_part", F.pmod(F.xxhash64("atom_id"), n_parts).cast("int"))
    t = t.select(*KEY, F.lit(0).alias("_side"), F.when(finite, _order(radius)).otherwise(0).alias("_code"), "atom_id", *"xyz", "v")
    s = sources.select(*"xyz", "v").where(finite).withColumns(cells).withColumn("_code", _order(radius))
    s = spread(s, AROUND, ["_x", "_y", "_z"], ["_x", "_y", "_z"]).join(parts, ["_x", "_y", "_z"], "left")
    s = s.withColumn("_part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    s = s.select(*KEY, F.lit(1).alias("_side"), "_code", F.lit(None).cast("long").alias("atom_id"), *"xyz", "v")
    limit = limit_of(radius)

    def run(batches):
        key, held, at, out = None, [], None, None

        def whole():
            ids, at, out = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = by_place(at)
            return ids[order], at[order], out[order]

        for b in batches:
            keys = np.column_stack([b.column(k).to_numpy() for k in [*KEY, "_side"]])
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else []
            start = 0
            for end in ends:
                now, side, piece = tuple(keys[start, :4].tolist()), keys[start, 4], b.slice(start, end - start)
                start = end
                if now != key:
                    if held:
                        ids, at, out = whole() if at is None else (ids, at, out)
                        yield batch_of(ids, at, out)
                    key, held, at = now, [], None
                if side == 0:
                    held.append((piece.column("atom_id").to_numpy(), places(piece), numbers(piece)))
                elif held:
                    if at is None:
                        ids, at, out = whole()
                    v = None if of else numbers(piece)
                    add_near(at, out, places(piece), values(v) if values and not of else v, limit, of)
        if held:
            yield batch_of(*(whole() if at is None else (ids, at, out)))

    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * SHARES if total > MANY else 1)
    return t.unionByName(s).repartition(tasks, *KEY).sortWithinPartitions(*KEY, "_side", "_code").mapInArrow(run, AT)
