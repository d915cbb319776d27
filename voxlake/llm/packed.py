"""Exchange of packed messages between chunks of documents and buckets of keys.

Documents are dealt to chunks by a hash of doc_id.  A chunk turns its texts into keys, keeps one message for each
distinct key, and sends each bucket its messages as a few arrays in one row; a bucket settles what its keys have in
common over all chunks and answers each chunk in one row.  So a key that a third of all documents hold is one message
a chunk, and a shuffle carries arrays instead of a row for each key.  The chunks' texts are shuffled once: every step
that reads them starts from the same exchange, which Spark reuses.  All steps depend on their input alone, so a lost
executor's part is computed again with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, trim

#: Text of a chunk, about, and chunks up to which each gets a partition of its own; more are dealt by hash.
CHUNK_BYTES, EVEN = 32 << 20, 4096
#: The column that a document's chunk is in; a name that no table is likely to have.
CHUNK = "__chunk"
MESSAGE = "bucket long, chunk long, a binary, b binary, c binary, d binary"
MESSAGE_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in "abcd")])
LAST = np.iinfo(np.int64).max


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of ``n`` hash partitions, in order, so that chunks fill partitions evenly."""
    found: dict[int, int] = {}
    size = 16 * n + 64
    while len(found) < n:
        rows = spark.range(size).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
        found = {r.p: r.id for r in rows.collect()}  # n rows
        size *= 4
    return [found[p] for p in range(n)]


class Chunks:
    """``docs`` with a column ``chunk``, and the bucket keys that go with it."""

    def __init__(self, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES):
        spark = docs.sparkSession
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(partitions(spark), -(-total // chunk_bytes))
        self.keys = even_keys(spark, self.n) if self.n <= EVEN else list(range(self.n))
        self.docs = docs.withColumn(CHUNK, self.place(F.col("doc_id"))).repartition(self.n, CHUNK)

    def place(self, doc_id: Column) -> Column:
        """The chunk of a doc_id."""
        place = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(LAST))), F.lit(self.n))
        return F.element_at(F.array(*(F.lit(k) for k in self.keys)), (place + 1).cast("int")).cast("long") if self.n <= EVEN else place

    def send(self, make: Callable[[pa.Table], list[list]]) -> DataFrame:
        """Messages of each chunk; ``make`` gets its documents and returns [bucket number, a, b, c, d] lists."""
        keys = self.keys

        def run(key, docs):
            return trimmed(message_table(make(in_order(docs)), keys, key[0].as_py()))

        return self.docs.groupBy(CHUNK).applyInArrow(run, MESSAGE)

    def send_after(self, answers: DataFrame, make: Callable[[pa.Table, list[dict]], list[list]]) -> DataFrame:
        keys = self.keys

        def run(key, docs, got):
            return trimmed(message_table(make(in_order(docs), answer_rows(got)) if docs.num_rows else [], keys, key[0].as_py()))

        return self.docs.groupBy(CHUNK).cogroup(answers.groupBy("chunk")).applyInArrow(run, MESSAGE)

    def settle(self, messages: DataFrame, judge: Callable[[list[dict]], list[tuple]]) -> DataFrame:
        """Answers; ``judge`` gets a bucket's messages in order of chunk and returns (message number, a, b, c, d)."""

        def run(key, got):
            got = got.sort_by("chunk")
            chunks = got.column("chunk").to_pylist()
            out = [[key[0].as_py(), chunks[i], *(None if x is None else np.ascontiguousarray(x).tobytes() for x in rest), *[None] * (4 - len(rest))] for i, *rest in judge(answer_rows(got))]
            return trimmed(rows_table(out))

        answers = messages.repartition(self.n, "bucket").groupBy("bucket").applyInArrow(run, MESSAGE)
        return answers.repartition(self.n, "chunk")

    def receive(self, answers: DataFrame, make: Callable[[pa.Table, list[dict]], pa.Table], kind: str) -> DataFrame:
        def run(key, docs, got):
            return trimmed(make(in_order(docs), answer_rows(got)))

        return self.docs.groupBy(CHUNK).cogroup(answers.groupBy("chunk")).applyInArrow(run, kind)


def trimmed(out: pa.Table) -> pa.Table:
    trim()
    return out


def in_order(docs: pa.Table) -> pa.Table:
    """By doc_id, then text; a null doc_id last."""
    docs = docs.combine_chunks()
    order = pc.sort_indices(docs.column("doc_id"), null_placement="at_end").to_numpy().copy()
    ids = ids_of(docs)[order]
    ties = np.flatnonzero(ids[1:] == ids[:-1])
    if len(ties):
        texts = docs.column("text")
        spans = np.split(ties, np.flatnonzero(np.diff(ties) > 1) + 1)
        for s in spans:
            rows = order[s[0] : s[-1] + 2]
            order[s[0] : s[-1] + 2] = sorted(rows.tolist(), key=lambda i: texts[i].as_py() or "")
    return docs.take(pa.array(order))


def ids_of(docs: pa.Table) -> np.ndarray:
    return pc.fill_null(docs.column("doc_id").cast(pa.int64()), LAST).to_numpy()


def rows_table(rows: list[list]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, MESSAGE_SCHEMA)], schema=MESSAGE_SCHEMA)


def message_table(messages: list[list], keys: list[int], chunk: int) -> pa.Table:
    return rows_table([[keys[b], chunk, *(None if x is None else np.ascontiguousarray(x).tobytes() for x in rest), *[None] * (4 - len(rest))] for b, *rest in messages])


def answer_rows(got: pa.Table) -> list[dict]:
    return got.to_pylist()


def array(blob: bytes | None, dtype) -> np.ndarray:
    return np.frombuffer(blob or b"", dtype=dtype)


def shared_flags(messages: list[dict]) -> list[tuple]:
    """For messages of distinct keys a (64 bit) and b, whether a chunk has the key more than once: for each message,
    packed bits of the keys that are in two chunks or more than once in one."""
    keys = [array(m["a"], np.uint64) for m in messages]
    sizes = [len(k) for k in keys]
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    twice = np.concatenate([np.unpackbits(array(m["b"], np.uint8), count=n) for m, n in zip(messages, sizes)]).astype(bool)
    order = np.argsort(flat)
    s = flat[order]
    same = s[1:] == s[:-1]
    common = np.zeros(len(flat), bool)
    common[1:] |= same
    common[:-1] |= same
    flags = twice.copy()
    flags[order] |= common
    ends = np.cumsum([0, *sizes])
    return [(i, np.packbits(flags[ends[i] : ends[i + 1]])) for i in range(len(messages))]
