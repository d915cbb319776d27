"""Target-distribution importance resampling over hashed word runs.

A text's features are its single words and pairs of neighbouring words; each falls into one of ``buckets`` by its
crc32.  Texts are read once and leave packed streams of 16-bit bucket numbers with the documents' offsets, as a table.
A stream's counts come from sorting it and taking its run lengths, and are summed over all streams.  From the counts of
raw and target texts each bucket has a gain; a document's weight is the mean of its features' gains, gathered from its
stream.  Weights with a Gumbel number that the document's id fixes are scores, and the highest scores are drawn, which
is sampling without replacement in proportion to exp(weight).

The crc of a pair follows from those of its words, because a checksum is linear: the first one's is carried over the
second one's length by tables.

Ranks come from a sort by ranges: each partition numbers its own rows, and the partitions' sizes say what comes before.

Defined results: a null or empty text has no features, weight 0 and no rank; a null doc_id hashes as nothing and comes
last of equal scores; equal rows are each scored, equal scores of one id keep any order; with an empty target all
gains follow from its zero counts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, dropped, no_cycles, partitions, written
from .plain_words import plain_words

#: Bytes of the longest word whose crc comes from tables, and bytes of a stream's texts.
TABLED, STREAM_BYTES = 64, 2 << 20
STREAM = "ids array<long>, words array<long>, stream binary"


def byte_table() -> np.ndarray:
    """What the low byte of a crc register does."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


STEP = byte_table()


def carry_tables() -> np.ndarray:
    """[length, which byte, its value]: the register after as many zero bytes."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(TABLED):
        now = STEP[now & 255] ^ (now >> 8)
        out.append(now)
    return np.array(out)


CARRY = carry_tables().ravel()
SPACE = np.uint32(zlib.crc32(b" "))


def carried(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    base = length.astype(np.int64) * 1024
    out = CARRY[base + (crc & 255)]
    for j in (1, 2, 3):
        out ^= CARRY[base + 256 * j + ((crc >> np.uint32(8 * j)) & 255)]
    return out


def word_crcs(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word, byte by byte over all words that are long enough."""
    size = ends - starts
    order = np.argsort(np.minimum(size, TABLED + 1).astype(np.uint8), kind="stable")[::-1]
    ordered = size[order]
    long = int((ordered > TABLED).sum())
    at, reg = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    left = len(order) - np.cumsum(np.bincount(np.minimum(size, TABLED + 1), minlength=TABLED + 2))
    for k in range(TABLED):
        m = int(left[k])  # words of over k bytes
        if m <= long:
            break
        some = reg[long:m]
        reg[long:m] = STEP[(some ^ flat[at[long:m] + k]) & 255] ^ (some >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~reg
    for i in order[:long].tolist():
        out[i] = zlib.crc32(flat[starts[i] : ends[i]])
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the bucket of each feature: word, pair, word, pair, ... word."""
    flat, starts, ends, counts = plain_words(texts)
    last = np.cumsum(counts)[counts > 0] - 1
    alone = np.delete(np.arange(len(starts)), last)  # words with one after them
    crc = word_crcs(flat, starts, ends)
    first, size = carried(crc[alone], np.ones(len(alone), np.int64)) ^ SPACE, (ends - starts)[alone + 1]
    pair = carried(first, np.minimum(size, TABLED)) ^ crc[alone + 1]
    for i in np.flatnonzero(size > TABLED).tolist():
        pair[i] = zlib.crc32(flat[starts[alone[i] + 1] : ends[alone[i] + 1]], int(first[i]))
    place = 2 * np.arange(len(starts)) - np.repeat(np.arange(len(last)), counts[counts > 0])
    out = np.empty(2 * len(starts) - len(last), np.uint16)
    out[place] = crc % np.uint32(buckets)
    out[place[alone] + 1] = pair % np.uint32(buckets)
    return counts, out


def streams(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed bucket streams of some documents each, with their ids and numbers of words."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket number has 16 bits")
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("stream", pa.binary())])

    @no_cycles
    def run(batches):
        for batch in batches:
            for some in doc_slices(batch, STREAM_BYTES):
                counts, stream = features(some.column("text"), buckets)
                one = [[some.column("id").to_pylist()], [counts], [stream.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, schema)], schema=schema)

    return rows.mapInArrow(run, STREAM)


def bucket_counts(stored: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket, over all streams."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column("stream"):
                s = np.sort(np.frombuffer(blob.as_buffer(), np.uint16))
                ends = np.append(np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)) if len(s) else np.zeros(0, np.int64)
                total[s[ends - 1]] += np.diff(ends, prepend=0)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["bucket", "n"])

    sums = stored.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r.bucket: r.n for r in sums.collect()}  # at most one row a bucket
    return [found.get(b, 0) for b in range(buckets)]


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is among the target's features, each bucket counted once more."""
    s, t, n = float(sum(raw)), float(sum(target)), float(len(raw))
    return np.array([math.floor(1000.0 * math.log(((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)))) for a, b in zip(raw, target)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def scores(stored: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, words, n_features, weight and score of each document of the streams."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "words", "n_features", "weight", "score")])

    def run(batches):
        for batch in batches:
            for ids, words, blob in zip(*(batch.column(c) for c in ("ids", "words", "stream"))):
                ids, words = ids.values, words.values.to_numpy()
                size = np.maximum(2 * words - 1, 0)
                full = size > 0
                weight = np.zeros(len(size), np.int64)
                if full.any():
                    offsets = (np.cumsum(size) - size)[full]
                    weight[full] = np.add.reduceat(gain[np.frombuffer(blob.as_buffer(), np.uint16)], offsets) // size[full]
                luck = np.array([gumbel(d, seed) for d in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (words, size, weight, weight + luck))], schema=schema)

    return stored.mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` (a written table) with rank 1, 2, 3, ... in ``order``; equal rows fall apart by where they stand."""
    spark = rows.sparkSession
    order = [*order, F.col("__place")]
    placed = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = written(placed.drop("__place").withColumn("__at", F.monotonically_increasing_id()), spark)
    part = F.shiftright("__at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before = zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0))
    lookup = spark.createDataFrame(list(before), "__part long, __before long")
    return placed.join(F.broadcast(lookup), part == F.col("__part")).withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__before", "__at")


def importance(docs: DataFrame, target: DataFrame, buckets: int = 10000, seed: int = 7, least_words: int = 20, percent: int = 25) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs``; ``percent`` of those with at least
    ``least_words`` words are drawn and have a rank."""
    spark = docs.sparkSession
    raw = written(streams(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), buckets), spark)
    aim = written(streams(target.select(F.lit(None).cast("long").alias("id"), "text"), buckets), spark)
    gain = gains(bucket_counts(raw, buckets), bucket_counts(aim, buckets))
    scored = written(scores(raw, gain, seed), spark)
    dropped(raw, aim)
    enough = F.col("words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    out = ranked(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")])
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs``, where doc_id is a key."""
    return docs.join(importance(docs, target, **how).where("rank IS NOT NULL").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
