"""Best-fit packing of token sequences with certified bin counts.

Documents are cut into pieces of at most ``capacity`` ids, and the pieces of a partition packed by best-fit
decreasing.  Dual feasible functions give a lower bound of the bins that any packing of them needs; a partition that
meets it is certified and stays.  The others have a gap: all their pieces are dealt anew among fewer partitions and packed
again, until the count meets the bound over all pieces or a round saves nothing.  If the count is still over that bound,
as when each partition ends in a bin that is not full, bins that are not full are exchanged among all partitions likewise,
until several rounds in succession save nothing.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, no_cycles, written
from .word_tokens import SLICE, engine, ship

#: Pieces that one task packs at once, and exchanges in succession that may save nothing before bins that are not full stay.
PER_TASK, PATIENCE = 100_000, 6


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; one pass, no shuffle."""
    shipped = ship(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    @no_cycles
    def run(batches):
        coder = None
        for batch in batches:
            coder = coder or engine(path, shipped.value)
            end = np.array([end_id], "<u4")
            for part in doc_slices(batch, SLICE):
                ids, ends = coder.encode(part.column("text"))
                rows, at = [], 0
                for doc, to in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                    raw = np.concatenate([ids[at:to], end])
                    at = to
                    for k, cut in enumerate(range(0, len(raw), capacity)):
                        some = raw[cut : cut + capacity]
                        rows.append((doc, k, cut, len(some), zlib.crc32(some)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray) -> int:
    """Bins that pieces need at least; ``counts[n]`` of them have length n, up to the capacity.

    Two families of dual feasible functions, over all their parameters.  The first drops lengths under a threshold t
    and rounds those over capacity - t up to the capacity; the second scales lengths to multiples of capacity / k.
    """
    cap = len(counts) - 1
    size = np.arange(cap + 1)
    weight = counts * size
    total = int(weight.sum())
    best = -(-total // cap)
    from_top = np.cumsum(counts[::-1])[::-1]
    sums = np.concatenate([[0], np.cumsum(weight)])
    t = np.arange(1, cap // 2 + 1)
    over = from_top[np.minimum(cap - t + 1, cap)]
    middle = sums[cap - t + 1] - sums[t]
    best = max(best, int((over + -(-middle // cap)).max(initial=0)))
    for k in range(1, 100):
        scaled = size * (k + 1)
        f = np.where(scaled % cap == 0, size * k, scaled // cap * cap)
        best = max(best, -(-int((counts * f).sum()) // (cap * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin; longest first, each into the fullest bin that takes it.

    A bit for each room that some bin has left finds the tightest in one step, so time follows the pieces.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, fills = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            stack = by_room[room]
            at = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            at, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = at, fills[at]
        fills[at] += n
        room -= n
        if room:
            by_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _round(rows: DataFrame, parts: int, number: int, capacity: int) -> DataFrame:
    """``rows`` with sequence_id, offset, fill of the sequence and bound of its partition."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long, gap long"
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset", "fill", "gap"))])

    def run(batches):
        got = pa.Table.from_batches(list(batches), schema=pa.schema(list(schema)[:5]))
        if got.num_rows:
            lengths = got.column("length").to_numpy()
            bins, offsets, fills = best_fit(lengths, capacity)
            gap = len(fills) - lower_bound(np.bincount(lengths, minlength=capacity + 1))
            base = (number << 44) + (TaskContext.get().partitionId() << 24)  # a task has far fewer than 2^24 bins
            more = [pa.array(x, pa.int64()) for x in (base + bins, offsets, fills[bins], np.full(len(bins), gap))]
            yield from pa.Table.from_arrays([*got.columns, *more], schema=schema).to_batches(max_chunksize=20_000)

    rows = rows.select(*COLUMNS)
    dealt = rows.repartition(parts, F.xxhash64("doc_id", "piece", F.lit(number))) if parts > 1 else rows.repartition(1)
    return dealt.sortWithinPartitions("length", "doc_id", "piece", "start").mapInArrow(run, kind)


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, per_task: int = PER_TASK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences and least_sequences of each piece of
    ``docs`` (doc_id, text).

    The last two are the same in every row: how many sequences there are, and the lower bound of any packing.  Where they
    differ, the rounds ended without reaching the bound.  The attribute ``certificate`` holds both as well.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, path, end_id, capacity), spark)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most one row for each length up to the capacity
        histogram[r["length"]] = r["count"]
    need, parts = lower_bound(histogram), max(2, -(-int(histogram.sum()) // per_task))
    count = lambda df: df.where("offset = 0").count()
    packed = written(_round(rows, parts, 0, capacity), spark)
    out, used, number = [], count(packed), 0
    for open_bins, patience in ((F.col("gap") > 0, 1), (F.col("fill") < capacity, PATIENCE)):
        vain = 0
        while used > need and vain < patience:
            loose = packed.where(open_bins)
            n_loose, tasks = loose.agg(F.count(F.lit(1)), F.count_distinct(F.shiftright("sequence_id", 24))).first()
            if tasks < 2:  # alone it would be packed as it is
                break
            number += 1
            parts = 1 if n_loose <= per_task else max(2, -(-n_loose // per_task))
            again = written(_round(loose, parts, number, capacity), spark)
            saved = count(loose) - count(again)
            vain = 0 if saved > 0 else vain + 1
            if saved > 0 or saved == 0 and vain < patience:
                out.append(packed.where(~open_bins))
                packed, used = again, used - saved
            if saved <= 0 and parts == 1:
                break
        for part in out:
            packed = packed.unionByName(part)
        out = []
    out = packed.select(*COLUMNS, "sequence_id", "offset", F.lit(int(used)).cast("long").alias("n_sequences"), F.lit(int(need)).cast("long").alias("least_sequences"))
    out.certificate = (used, need)
    return out
