"""Vector code compression: product codes whose codebooks are trained by exponion search.

A vector becomes integers, is cut into equal parts, and each part gets the number of the nearest of its position's
entries.  Each round assigns all vectors and moves every entry to the floored mean of its parts.  An assignment starts
at the entry that the part had before: no entry that is as near can be over twice that distance from it, so only the
entries of its neighbour list, sorted by distance, inside that radius are measured.  Distances are squares of integers
and exact, so the radius is too, and of equally near entries the one with the least number wins.

Vectors lie packed in blocks with their codes; a round reads the blocks, writes them with new codes, and sums entries
in the tasks, so that a task sends each entry's sums once.  Only codebooks come to the driver and go back.

Defined results: rows whose vector is null or empty, has null or non-finite components, or a component over 2^52, are
dropped, and so are those whose length isn't that of the kept vector with the least vec_id, or isn't a multiple of the
parts.  A null vec_id comes after all others; rows with equal ids go by their vectors.  Fewer kept rows than entries
make that many entries.  Where an error doesn't fit a long it is null.  Without a kept row the result is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined_back, written

#: Bytes of a block's integers, rows measured at once, and the largest component.
BLOCK_BYTES, TILE, LARGEST = 1 << 20, 512, 1 << 52
#: Integers up to which products in double precision are exact, and the half of a sum that is added by itself.
EXACT, HALF = 1 << 52, 31
LONG = (1 << 63) - 1


class Book:
    """The entries of one part: integers, and for each entry the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.squares = (entries * entries).sum(axis=1)
        between = self.squares[:, None] + self.squares - 2 * (entries @ entries.T)
        self.near = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.near, axis=1)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each row of ``x``, its squared distance, and the number of distances measured."""
        gap = x - self.entries[before]
        least = (gap * gap).sum(axis=1)
        code, measured = before.astype(np.int64), len(x)
        for entry in np.unique(before).tolist():
            rows = np.flatnonzero(before == entry)
            # an entry as near as ``least`` is within twice its root of the start
            width = np.searchsorted(self.far[entry], 4 * least[rows], side="right")
            rows = rows[np.argsort(width, kind="stable")]
            width.sort()
            for at in range(0, len(rows), TILE):
                some, n = rows[at : at + TILE], int(width[min(at + TILE, len(rows)) - 1])
                others = self.near[entry, :n]
                d = (x[some] * x[some]).sum(axis=1)[:, None] + self.squares[others] - 2 * (x[some] @ self.entries[others].T)
                best = d.min(axis=1)
                code[some] = np.where(d == best[:, None], others, len(self.entries)).min(axis=1)
                least[some] = best
                measured += d.size
        return code, least, measured


class Codebooks:
    """Entries of all parts; their size is entries times dimensions, whatever the data."""

    def __init__(self, entries: list[list[list[int]]]):
        """``entries``: integers by part, entry and position."""
        self.entries = entries
        self.parts, self.k = len(entries), len(entries[0])
        self.width = len(entries[0][0])
        self.largest = max(abs(v) for part in entries for entry in part for v in entry)

    def books(self, largest: int) -> tuple[list[Book], type]:
        """In double precision if all distances to components up to ``largest`` are exact in it, else Python's integers."""
        reach = 4 * self.width * max(1, largest, self.largest) ** 2
        kind = np.float64 if reach < EXACT else object
        return [Book(np.array(part, dtype=object).astype(kind)) for part in self.entries], kind

    def text(self) -> str:
        return ",".join(str(v) for part in self.entries for entry in part for v in entry)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Integer vectors of rows of codes."""
        return np.concatenate([np.array(part, dtype=np.int64)[codes[:, p]] for p, part in enumerate(self.entries)], axis=1)


def usable(column: str):
    """Whether a vector has no null, non-finite or too large component."""
    fits = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(F.floor(x.cast("double") * 1024.0).cast("double")) <= float(LARGEST)), F.lit(False)))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & fits, F.lit(False))


def integers(v: pa.ListArray, dim: int) -> np.ndarray:
    return np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 1024.0).astype(np.int64).reshape(-1, dim)


def blocks(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """ids, labels and packed integers of some vectors each; the integers are as wide as they need."""
    label = f"array<{kind}>"

    def run(batches):
        for batch in batches:
            step = max(1, BLOCK_BYTES // (8 * dim))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                x = integers(some.column("v"), dim)
                size = next(b for b in (2, 4, 8) if np.abs(x).max() < 1 << (8 * b - 1))
                lists = [pa.ListArray.from_arrays([0, some.num_rows], some.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x.astype(f"i{size}").tobytes()]), pa.array([size], pa.int32()), pa.array([None], pa.binary())], names=["ids", "labels", "x", "size", "codes"])

    return rows.mapInArrow(run, f"ids array<long>, labels {label}, x binary, size int, codes binary")


def _unpacked(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray | None]:
    return np.frombuffer(row["x"], f"i{row['size']}").reshape(-1, dim), row["codes"]


def _assigned(x: np.ndarray, codes: bytes | None, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column a part; without earlier codes the search starts at entry 0."""
    before = np.zeros((len(x), books.parts), np.uint16) if codes is None else np.frombuffer(codes, np.uint16).reshape(len(x), books.parts)
    made, kind = books.books(int(np.abs(x).max()))
    code, error = np.empty((len(x), books.parts), np.int64), np.empty((len(x), books.parts), object)
    for p, book in enumerate(made):
        code[:, p], error[:, p], _ = book.assign(x[:, p * books.width : (p + 1) * books.width].astype(kind), before[:, p])
    return code, error


def _rounded(stored: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """The blocks with new codes."""
    shipped = stored.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                x, codes = _unpacked({c: one.column(c)[0].as_py() for c in ("x", "size", "codes")}, dim)
                code, _ = _assigned(x, codes, shipped.value)
                yield one.set_column(4, "codes", pa.array([code.astype(np.uint16).tobytes()], pa.binary()))

    return stored.mapInArrow(run, stored.schema)


def _moved(stored: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """Each entry at the floored mean of its parts; unused ones stay."""
    parts, k, width = books.parts, books.k, books.width

    def run(batches):
        sums, counts = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x, codes = _unpacked(row, dim)
                codes = np.frombuffer(codes, np.uint16).reshape(len(x), parts)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, first = np.unique(codes[order, p], return_index=True)
                    # a block has few rows, so halves of its sums fit
                    low, high = x[order, p * width : (p + 1) * width].astype(np.int64) & ((1 << HALF) - 1), x[order, p * width : (p + 1) * width].astype(np.int64) >> HALF
                    sums[p, used] += np.add.reduceat(high, first).astype(object) * (1 << HALF) + np.add.reduceat(low, first)
                    counts[p, used] += np.diff(np.append(first, len(order)))
        hit = np.argwhere(counts > 0)
        flat = sums[hit[:, 0], hit[:, 1]]
        rows = (hit[:, 0] * k + hit[:, 1]).tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(rows, np.int64), width), pa.int64()), pa.array(np.tile(np.arange(width), len(rows)), pa.int32()),
            pa.array([int(v) >> HALF for v in flat.ravel()], pa.int64()), pa.array([int(v) & ((1 << HALF) - 1) for v in flat.ravel()], pa.int64()),
            pa.array(np.repeat(counts[hit[:, 0], hit[:, 1]], width), pa.int64()),
        ], names=["entry", "at", "high", "low", "n"])

    sent = stored.select("x", "size", "codes").mapInArrow(run, "entry long, at int, high long, low long, n long")
    found = sent.groupBy("entry", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect()  # entries times dimensions
    entries = [[list(e) for e in part] for part in books.entries]
    for r in found:
        entries[r.entry // k][r.entry % k][r.at] = ((r.high << HALF) + r.low) // r.n
    return Codebooks(entries)


def train(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[Codebooks, DataFrame, int] | None:
    """Codebooks after ``rounds`` rounds, the written blocks with the codes of the last of them, and the dimension."""
    spark = rows.sparkSession
    if not 0 < entries <= 1 << 16:
        raise ValueError("a code has 16 bits")
    kept = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(column).alias("v")).where(usable("v"))
    by = [F.asc_nulls_last("id"), F.asc("v")]
    first = kept.orderBy(*by).limit(1).select(F.size("v").alias("n")).first()
    if first is None or first.n % parts:
        return None
    dim = first.n
    kept = kept.where(F.size("v") == dim)
    start = integers(kept.orderBy(*by).limit(entries).select("v").toArrow().column("v").combine_chunks(), dim)  # bounded by entries
    width = dim // parts
    books = Codebooks([start[:, p * width : (p + 1) * width].tolist() for p in range(parts)])
    stored = written(blocks(kept, dim, rows.schema[label].dataType.simpleString()), spark)
    for _ in range(rounds):
        after = written(_rounded(stored, books, dim), spark)
        dropped(stored)
        stored, books = after, _moved(after, books, dim)
    return books, stored, dim


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of ``rows``; a code has two hex digits a
    part, or four with over 256 entries."""
    spark = rows.sparkSession
    kind = rows.schema[label].dataType.simpleString()
    trained = train(rows, parts, entries, rounds, key, column, label)
    if trained is None:
        return spark.createDataFrame([], f"{key} long, code string, error long, label_error long, codebooks_sha256 string")
    books, stored, dim = trained
    shipped = spark.sparkContext.broadcast(books)
    digits = ">u1" if books.k <= 256 else ">u2"

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k] for c in batch.schema.names}
                x, codes = _unpacked({c: one[c].as_py() for c in ("x", "size", "codes")}, dim)
                code, error = _assigned(x, codes, shipped.value)
                total = [int(e) for e in error.sum(axis=1)]
                raw = code.astype(digits).tobytes()
                wide = len(raw) // len(x)
                yield pa.RecordBatch.from_arrays([
                    one["ids"].values, pa.array([raw[i : i + wide].hex() for i in range(0, len(raw), wide)], pa.string()),
                    pa.array([e if e <= LONG else None for e in total], pa.int64()), one["labels"].values,
                ], names=["id", "code", "error", "label"])

    coded = written(stored.mapInArrow(run, f"id long, code string, error long, label {kind}"), spark)
    dropped(stored)
    groups = written(coded.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error"), F.count(F.lit(1)).alias("size")), spark)
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    out = joined_back(coded, groups, ["label"], "size")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
