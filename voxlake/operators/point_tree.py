"""Points in a tree of blocks: runs of a space-filling order, as tables that a search joins level by level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut
from .neighbours import bounding_box

LEAF, FAN = 256, 64  # points of a leaf, blocks of a node
BITS = 20  # of a coordinate in the order
NODE = "node long, box array<double>, one array<double>, kids array<long>, inside array<double>"
SCHEMA = pa.schema([("node", pa.int64()), ("box", pa.list_(pa.float64())), ("one", pa.list_(pa.float64())), ("kids", pa.list_(pa.int64())), ("inside", pa.list_(pa.float64()))])


def xyz_of(t, names=("x", "y", "z")) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)


def order_of(xyz: np.ndarray, low: np.ndarray, width: float) -> np.ndarray:
    """Place along the order that takes a bit of each coordinate in turn."""
    steps = np.clip((xyz - low) / width * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    code = np.zeros(len(xyz), np.int64)
    for bit in range(BITS):
        for axis in range(3):
            code |= ((steps[:, axis] >> bit) & 1) << (3 * bit + axis)
    return code


def _each(children: str, k: int):
    """The k-th of every child's box numbers."""
    return F.transform(children, lambda c: c["box"][k])


def levels(points: DataFrame) -> list[DataFrame]:
    """Tables of nodes, leaves first; the last has at most FAN rows.

    A node has its points' box (least, then largest coordinates), one of its points, and what is inside: a leaf's points,
    or of each child nine numbers, its box and its point.  Leaves are runs of LEAF points, however dense they lie; points
    at one place count once.
    """
    spark = points.sparkSession
    box = bounding_box(points).first()
    if box["x0"] is None:
        return [spark.createDataFrame([], NODE)]
    low, width = np.array([box[f"{a}0"] for a in "xyz"]), max(box[f"{a}w"] for a in "xyz") or 1.0
    leaf, fan = LEAF, FAN

    def coded(batches):
        for b in batches:
            yield pa.record_batch([*(b.column(a) for a in "xyz"), pa.array(order_of(xyz_of(b), low, width))], names=[*"xyz", "code"])

    def packed(batches):
        part, n, rest = TaskContext.get().partitionId() << 33, 0, np.empty((0, 3))

        def rows(blocks):
            boxes = [np.concatenate([b.min(0), b.max(0)]) for b in blocks]
            ids = np.arange(n, n + len(blocks)) + part
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(v, SCHEMA.field(k).type) for k, v in (("box", boxes), ("one", [b[len(b) // 2] for b in blocks]), ("kids", [[]] * len(blocks)), ("inside", [b.ravel() for b in blocks])))], schema=SCHEMA)

        for b in batches:
            rest = np.vstack([rest, xyz_of(b)])
            full = len(rest) // leaf
            if full:
                yield rows(np.split(rest[: full * leaf], full))
                n, rest = n + full, rest[full * leaf :]
        if len(rest):
            yield rows([rest])

    dealt = points.select(*"xyz").distinct().mapInArrow(coded, "x double, y double, z double, code long")
    out = [cut(dealt.repartitionByRange("code", *"xyz").sortWithinPartitions("code", *"xyz").mapInArrow(packed, NODE), spark)]
    while True:
        nodes, last = out[-1].agg(F.count(F.lit(1)), F.max(F.col("node").bitwiseAND((1 << 33) - 1))).first()
        if nodes <= fan:
            return out
        part, number = F.shiftright("node", 33), F.col("node").bitwiseAND((1 << 33) - 1)
        # within a partition of the order while it has several nodes, then across partitions
        up = F.shiftleft(part, 33) + F.floor(number / fan) if last else F.shiftleft(F.floor(part / fan).cast("long"), 33)
        child = F.struct("node", "box", "one")
        groups = out[-1].groupBy(up.cast("long").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))  # at most FAN rows each
        ends = [(F.array_min if k < 3 else F.array_max)(_each("c", k)) for k in range(6)]
        inner = groups.select(
            F.col("up").alias("node"), F.array(*ends).alias("box"), F.col("c")[F.floor(F.size("c") / 2).cast("int")]["one"].alias("one"),
            F.transform("c", lambda c: c["node"]).alias("kids"), F.flatten(F.transform("c", lambda c: F.concat(c["box"], c["one"]))).alias("inside"),
        )
        out.append(cut(inner, spark))
