"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of fixed size.  The distinct blocks are dealt by their content, sorted and numbered:
equal blocks get one integer, different ones different integers.  Then adjacent names are paired and the distinct
pairs named in the same way, until each text has a single name.  With the text's length it is an identity that
two texts share only if all their bytes are equal.

Blocks travel once, to be named.  Their names find the way back by a 64-bit key of the block; the names table shows
whether any key belongs to two blocks, and if so the join is by the blocks themselves.  So no result rests on a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_back, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a block.
BLOCK = 4096


def folded(text: Column) -> Column:
    """``text`` with only A-Z lower-cased; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def route_key(block: Column) -> Column:
    return F.xxhash64(block)


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """A number for each row of ``distinct``, by its place in the sorted partition it was dealt to."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block: int = BLOCK, key=route_key) -> DataFrame:
    """rid, doc_id, n_bytes, text_sha256 and name for each row of ``docs`` (doc_id, text).

    Rows with equal n_bytes and name, and no others, have equal texts after ``folded``.  rid tells repeated rows apart.
    """
    spark = docs.sparkSession
    raw = docs.select("doc_id", F.encode(folded(F.col("text")), "UTF-8").alias("raw"))

    def cut(f):
        count = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: f(F.substring(F.col("raw"), i * block + 1, F.lit(block))))

    rows = written(raw.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("text_sha256"), cut(key).alias("keys")).withColumn("rid", F.monotonically_increasing_id()), spark)
    blocks = raw.select(F.explode(cut(lambda b: b)).alias("block"))
    names = _named(blocks.groupBy("block").agg(F.lit(0).alias("one")), ["block"])
    names = written(names.select(key(F.col("block")).alias("key"), "name"), spark)
    at = rows.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    if names.groupBy("key").count().where("count > 1").isEmpty():
        placed = at.join(names, "key").select("rid", "n", "pos", "name")
    else:
        placed = _placed_by_bytes(docs, rows, block, key)
    level = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    done, left = [], placed
    while level > 1:
        left = written(left, spark)
        done.append(left.where("n = 1").select("rid", "name"))
        pairs = left.where("n > 1").groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"), F.shiftright(F.first("n") + 1, 1).alias("n"))
        pairs = written(pairs, spark)
        named = written(_named(pairs.groupBy("a", "b").agg(F.lit(0).alias("one")), ["a", "b"]).drop("one"), spark)
        left = pairs.join(named, ["a", "b"]).select("rid", "n", "pos", "name")
        level = (level + 1) // 2
    name = left.select("rid", "name")
    for part in done:
        name = name.unionByName(part)
    return rows.drop("keys").join(name, "rid")


def _placed_by_bytes(docs: DataFrame, rows: DataFrame, block: int, key) -> DataFrame:
    """Names joined by the blocks' bytes, for when two different blocks have the same key."""
    spark = docs.sparkSession
    raw = docs.select("doc_id", F.encode(folded(F.col("text")), "UTF-8").alias("raw"))
    raw = raw.withColumn("text_sha256", F.sha2("raw", 256)).dropDuplicates(["text_sha256", "raw"])
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block)).cast("int")
    pieces = raw.select("text_sha256", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("raw"), i * block + 1, F.lit(block)))).alias("pos", "block"))
    names = written(_named(pieces.groupBy("block").agg(F.lit(0).alias("one")), ["block"]).drop("one"), spark)
    return rows.select("rid", F.size("keys").alias("n"), "text_sha256").join(pieces.join(names, "block"), "text_sha256").select("rid", "n", "pos", "name")


def exact_dedup(docs: DataFrame, block: int = BLOCK, key=route_key) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the row with the
    largest doc_id stays, a null doc_id counting as smallest; of repeated rows with that doc_id just one is kept.
    Groups are counted before they are shuffled; the rows of very large ones aren't shuffled to be joined back.
    """
    ident = written(identities(docs, block, key), docs.sparkSession)
    groups = ident.groupBy("n_bytes", "name").agg(F.max(F.struct(F.col("doc_id"), F.col("rid"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = joined_back(ident, written(groups, docs.sparkSession), ["n_bytes", "name"], "group_size")
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    kept = written(exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("__sha")), docs.sparkSession)
    out = docs.withColumn("__sha", F.sha2(F.encode(folded(F.col("text")), "UTF-8"), 256))
    both = out["doc_id"].eqNullSafe(kept["doc_id"]) & (out["__sha"] == kept["__sha"])
    out = out.join(kept, both, "left_semi")
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():  # rows with one doc_id and one text
        out = out.dropDuplicates(["doc_id", "__sha"])
    return out.drop("__sha")
