"""What the operators of this package share: reading, shared folders, caches, word arrays."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a worker's table of known answers before it starts afresh.
CACHE_LIMIT = 150_000
#: Bytes of text that a kernel turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the folder that driver and executors share.

    It is the one in ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process, as in tests,
    a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voxlake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Lets Spark delete an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, any executor can read it."""
    path, before = shared_dir(spark), spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Groups that are joined back by broadcast, at most.
HOT_GROUPS = 1000


def joined_back(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group; null keys are equal.

    ``groups`` is a written table with a row for each group and its number of rows in ``size``.  Groups with over a
    thousandth of all rows, of which there are at most ``HOT_GROUPS``, are broadcast, so that their rows stay where
    they are; the others meet in a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    groups = groups.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, (rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys))
    hot = F.col(size) > total // HOT_GROUPS
    near = rows.join(F.broadcast(groups.where(hot)), same)
    far = rows.join(F.broadcast(groups.where(hot).select(*(f"_{k}" for k in keys))), same, "left_anti").join(groups.where(~hot), same)
    return near.unionByName(far).drop(*(f"_{k}" for k in keys))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES):
    """Parts of a batch with about ``limit`` bytes of the column ``text`` each; one text is never cut."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
    marks = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


_OWN: dict = {}


def only_mine(key, make):
    """The worker's object ``key``, made at first use.  What another operator left in the worker goes before that."""
    if key not in _OWN:
        _OWN.clear()
        gc.collect()
        trim()
        _OWN[key] = make()
    return _OWN[key]


def no_cycles(kernel):
    """``kernel`` (a generator function that makes no cyclic garbage) without Python's search for such garbage, which
    would walk all caches again and again; at its end the worker's free memory goes back."""

    @functools.wraps(kernel)
    def run(*args):
        gc.disable()
        try:
            yield from kernel(*args)
        finally:
            gc.enable()
            trim()

    return run


def trim() -> None:
    """Returns a worker's free memory to the system: workers outlive their task, and the next may be another's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    return x ^ (x >> np.uint64(29))


SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
UPPER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)
#: Bytes that are hashed at once, and bytes of a word that is hashed by itself.
BLOCK, LONG_WORD = 1 << 17, 1 << 16


class WordHash:
    """64-bit hash of words: random values of their bytes times powers of an odd number, summed modulo 2^64."""

    def __init__(self, seed: int, lower: bool):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.seed, self.lower = seed, lower
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        if lower:
            self.values = self.values[UPPER]
        odd = int(rng.integers(0, 1 << 64, 1, np.uint64)[0]) & ~7 | 5  # powers of 5 modulo 8 have the longest period
        self.up = np.cumprod(np.append(np.uint64(1), np.full(BLOCK, odd, np.uint64)), dtype=np.uint64)
        self.down = np.cumprod(np.append(np.uint64(1), np.full(BLOCK, pow(odd, -1, 1 << 64), np.uint64)), dtype=np.uint64)

    def __call__(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        long = np.flatnonzero(ends - starts > LONG_WORD)
        for i in long.tolist():
            word = flat[starts[i] : ends[i]]
            out[i] = xxhash.xxh3_64_intdigest((UPPER[word] if self.lower else word).tobytes(), self.seed)
        stops = [*long.tolist(), len(starts)]
        at, k = 0, 0
        while at < len(starts):
            if at == stops[k]:
                at, k = at + 1, k + 1
                continue
            base = int(starts[at])
            to = min(int(np.searchsorted(ends, base + BLOCK, side="right")), stops[k])
            s, e = starts[at:to] - base, ends[at:to] - base
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(self.values[flat[base : base + len(sums) - 1]] * self.up[: len(sums) - 1], out=sums[1:])
            out[at:to] = mix((sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64) * M2)
            at = to
        return out


EXACT, EXACT_TOO, LOWERED = WordHash(1, False), WordHash(2, False), WordHash(3, True)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings as they lie in memory, and where each text ends; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return flat, (offsets - offsets[0])[1:].astype(np.int64)


def hashed_words(texts: pa.Array, *kinds: WordHash) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text, and for each kind the hashes of all words; words are runs without ASCII white space."""
    flat, text_ends = text_bytes(texts)
    if not len(flat):
        return np.zeros(len(texts), np.int64), [np.empty(0, np.uint64) for _ in kinds]
    letter = np.empty(len(flat) + 1, bool)
    letter[:-1], letter[-1] = ~SPACES[flat], False
    fresh = np.append(True, ~letter[:-1])  # a word may begin here: after white space, or where a text begins
    fresh[text_ends[text_ends < len(fresh)]] = True
    starts = np.flatnonzero(letter & fresh)
    ends = np.flatnonzero(letter[:-1] & (fresh[1:] | ~letter[1:])) + 1
    return np.diff(np.searchsorted(starts, text_ends), prepend=0), [kind(flat, starts, ends) for kind in kinds]


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive entries of ``h``; spans are joined by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, part, span = None, 0, h, 1
    while True:
        if length & span:
            tail = part[have : have + n]
            out = tail.copy() if out is None else mix(out * M2 + tail + np.uint64(have))
            have += span
        if have == length:
            return out
        part = mix(part[:-span] * M2 + part[span:] + np.uint64(span))
        span *= 2


def split_by(bucket: np.ndarray, n: int):
    """(bucket, row numbers) for each bucket that has rows; row numbers keep their order."""
    order = np.argsort(bucket.astype(np.uint16 if n < 65536 else np.uint32), kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]
