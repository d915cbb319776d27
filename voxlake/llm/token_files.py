"""Token ids as Arrow files of fixed-size lists.

A shard holds the ids of a range of doc_id, one document after another, cut into sequences of equal length with a
mask that is false on the padding of the last.  It is an Arrow IPC file, whose record batches all hold the same
number of sequences, so a memory-mapped reader finds any sequence or document without copying.  A second small file
has doc_id, start and n_tokens of each document.  Shards are written under another name and then moved, and their
content depends only on their rows, so a task that runs twice does no harm.

Defined results: null texts are empty and hold the end id alone; repeated doc_ids follow one another in order of
text; a null doc_id comes first; an empty table has no shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, no_cycles, partitions, shared_dir
from .word_tokens import SLICE, engine, ship

#: Ids of a sequence, sequences of a record batch, and bytes of text of a shard, about.
LENGTH, ROWS, SHARD_BYTES = 2048, 256, 256 << 20


def open_store(uri: str):
    """File system and path of a URI; also those that pyarrow reaches by a client library."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, uri: str, dtype: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.store, self.path = open_store(uri)
        self.length, self.rows = length, rows
        kind = pa.from_numpy_dtype(dtype)
        self.kinds = (pa.list_(kind, length), pa.list_(pa.bool_(), length))
        self.schema = pa.schema([pa.field("ids", self.kinds[0]), pa.field("mask", self.kinds[1])])
        self.out = self.store.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.dtype, self.waiting, self.have, self.total = dtype, [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.have += len(ids)
        self.total += len(ids)
        size = self.length * self.rows
        if self.have >= size:
            flat = np.concatenate(self.waiting)
            for i in range(0, len(flat) - size + 1, size):
                self._put(flat[i : i + size], size)
            rest = len(flat) % size
            self.waiting, self.have = [flat[len(flat) - rest :].copy()], rest

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.kinds[0]), pa.FixedSizeListArray.from_arrays(mask, type=self.kinds[1])], schema=self.schema))

    def close(self) -> None:
        if self.have:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._put(padded, len(flat))
        self.writer.close()
        self.out.close()


class ShardReader:
    """Sequences and documents of a shard; arrays are views of the file where its store can be mapped."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = open_store(uri)
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.batches = self.file.num_record_batches
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.batches else 1
        self.at, self.flat = -1, None

    def _flat(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.file.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)
        return self.flat

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self.file.get_batch(i // self.rows), i % self.rows
        span = slice(row * self.length, (row + 1) * self.length)
        return batch.column("ids").values.to_numpy(zero_copy_only=True)[span], batch.column("mask").values.to_numpy(zero_copy_only=False)[span]

    def tokens(self, start: int, n: int) -> list[np.ndarray]:
        """The ids from ``start`` on, as views of the batches that hold them."""
        size, out = self.length * self.rows, []
        while n > 0:
            part = self._flat(start // size)[start % size : start % size + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out


def write_tokens(docs: DataFrame, path: str, end_id: int, uri: str, shards: int | None = None) -> list[tuple[int, int, int]]:
    """Writes shards of ``docs`` (doc_id, text) under ``uri``; returns (shard, documents, ids) of each in order.

    Rows are dealt by ranges of doc_id, so a hot range is cut like any other; only equal doc_ids stay together.  The
    number of shards follows the texts' bytes.
    """
    spark = docs.sparkSession
    if shards is None:
        shards = max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    shipped = ship(spark, path)
    schema = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    @no_cycles
    def run(batches):
        coder, shard = None, TaskContext.get().partitionId()
        suffix = f".{TaskContext.get().taskAttemptId()}.tmp"
        docs_seen = 0
        for batch in batches:
            for part in doc_slices(batch, SLICE):
                if coder is None:
                    coder = engine(path, shipped.value)
                    writer = ShardWriter(f"{uri}/tokens-{shard}.arrow{suffix}", coder.dtype)
                    index_out = writer.store.open_output_stream(f"{writer.path}.docs")
                    index = pa.ipc.new_file(index_out, index_schema)
                ids, ends = coder.encode(part.column("text"))
                ends += np.arange(1, len(ends) + 1)  # with the end ids
                starts = np.append(0, ends[:-1])
                flat = np.full(len(ids) + len(ends), end_id, coder.dtype)
                real = np.ones(len(flat), bool)
                real[ends - 1] = False
                flat[real] = ids
                index.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(starts + writer.total, pa.int64()), pa.array(ends - starts, pa.int64())], schema=index_schema))
                writer.add(flat)
                docs_seen += part.num_rows
        if coder is not None:
            writer.close()
            index.close()
            index_out.close()
            final = writer.path.removesuffix(suffix)
            writer.store.move(writer.path, final)
            writer.store.move(f"{writer.path}.docs", f"{final}.docs")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([docs_seen], pa.int64()), pa.array([writer.total], pa.int64())], schema=schema)

    store, folder = open_store(uri)
    store.create_dir(folder, recursive=True)
    dealt = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    found = dealt.mapInArrow(run, "shard long, n_docs long, n_ids long").collect()  # a row for each shard
    return sorted((r.shard, r.n_docs, r.n_ids) for r in found)


def read_digests(spark, uri: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files."""
    bases = np.cumsum([0, *(n for _, _, n in shards)]).tolist()
    rows = [(s, b) for (s, _, _), b in zip(shards, bases)]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns)):
                reader = ShardReader(f"{uri}/tokens-{shard}.arrow")
                store, path = open_store(f"{uri}/tokens-{shard}.arrow.docs")
                with store.open_input_file(path) as source, pa.ipc.open_file(source) as index:
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        sums = []
                        for start, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist()):
                            crc = 0
                            for ids in reader.tokens(start, n):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(part.column("start").to_numpy() + base, pa.int64()), part.column("n_tokens"), pa.array(sums, pa.int64())], schema=schema)

    listed = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)), F.col("shard"))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the tokens of ``docs`` in the shared folder and returns what the files hold of each document."""
    uri = shared_dir(docs.sparkSession)
    return read_digests(docs.sparkSession, uri, write_tokens(docs, path, end_id, uri))
