"""Local maxima, greedy dedup, order statistics over candidates, set operations on masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import forget, stored
from .neighbours import AROUND, _cells
from .shape import spread

FEW = 20_000  # atoms that are sent to every task with the cells around them

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def local_maxima(df: DataFrame, threshold: float, top: int | None = None) -> DataFrame:
    """i, j, k, v of cells above the threshold that no face neighbour exceeds; plateaus stay; ties in order of (i, j, k).

    Neighbours are sent to the cell they touch and reduced to their maximum there, so it is one shuffle.
    """
    own = df.select("i", "j", "k", F.col("v").alias("_own"), F.lit(None).cast(df.schema["v"].dataType).alias("_n"))
    sent = spread(df.select("i", "j", "k", "v"), FACES, ["i", "j", "k"], ["i", "j", "k"]).select("i", "j", "k", F.lit(None).cast(df.schema["v"].dataType).alias("_own"), F.col("v").alias("_n"))
    g = own.unionByName(sent).groupBy("i", "j", "k").agg(F.max("_own").alias("v"), F.max("_n").alias("_m"))
    out = g.where((F.col("v") > threshold) & (F.col("_m").isNull() | (F.col("v") >= F.col("_m")))).drop("_m")
    return out.orderBy(F.desc("v"), "i", "j", "k").limit(top) if top else out


def greedy_min_distance(df: DataFrame, radius: float, value: str = "v") -> DataFrame:
    """``df`` with flag 0 for accepted atoms and -3 for those nearer than ``radius`` to an accepted one of higher rank.

    Rank is by value (null last), then atom_id; of two atoms at one place the second is rejected.  Rounds accept what has nothing undecided
    above it and reject what is near those; that ends in the result of the sequential loop, and rejected atoms block nothing.
    Atoms of one half cell are all near each other, so only the first of each may be accepted: a round compares the
    undecided with at most eight of each cell around them, and no pair is kept.  An atom without finite coordinates is near nothing.
    """
    spark, cell, half = df.sparkSession, ["_x", "_y", "_z"], ["_hx", "_hy", "_hz"]
    rank = lambda p: F.struct(F.col(f"{p}v"), (-F.col(f"{p}id")).alias("o"))
    finite = sum((F.abs(F.col(a)) for a in "xyz"), F.lit(0.0)) < float("inf")
    atoms = df.select(F.col("atom_id").alias("id"), *"xyz", F.col(value).alias("v"))
    lone = stored(atoms.where(~F.coalesce(finite, F.lit(False))).select("id"))
    left = _cells(atoms.where(finite), radius).withColumns({f"_h{a}": F.floor(F.col(a) / (radius / 2)).cast("int") for a in "xyz"})
    left, taken = stored(left), [lone]

    def around(few: DataFrame, n: int) -> DataFrame:
        """Atoms as t_*, in each of the 27 cells around theirs."""
        out = spread(few, AROUND, cell, cell).select(*cell, *(F.col(c).alias(f"t_{c}") for c in ("id", *"xyz", "v")))
        return F.broadcast(out) if n <= FEW else out.hint("merge")

    d = F.sqrt(sum(((F.col(f"t_{a}") - F.col(a)) * (F.col(f"t_{a}") - F.col(a)) for a in "xyz"), F.lit(0.0)))
    near = lambda few: [*(left[c] == few[c] for c in cell), d < radius]
    while not left.isEmpty():
        first = F.max(F.struct("v", (-F.col("id")).alias("o"), *"xyz", *cell)).alias("t")
        tops = stored(left.groupBy(*half).agg(first).select((-F.col("t.o")).alias("id"), *(f"t.{c}" for c in ("x", "y", "z", "v", *cell))))
        few = around(tops, tops.count())
        blocked = left.join(few, [*near(few), rank("") > rank("t_")]).select(F.col("t_id").alias("id")).distinct()
        new = stored(tops.join(blocked, "id", "left_anti"))
        few = around(new, new.count())
        rest = stored(left.join(few, near(few), "left_anti"))
        forget(tops, left)
        left, taken = rest, [*taken, new]
    accepted = spark.read.schema(lone.schema).parquet(*(t.stored_at for t in taken))
    accepted = accepted.select(F.col("id").alias("atom_id"), F.lit(0).alias("flag"))
    return df.drop("flag").join(accepted, "atom_id", "left").withColumn("flag", F.coalesce("flag", F.lit(-3)))


def best(df: DataFrame, by: list[str], score: str, order: str, largest: bool = False) -> DataFrame:
    """The ``order`` of each group's least (or largest) score; the first order wins ties."""
    key = F.struct((-F.col(score) if largest else F.col(score)).alias("s"), F.col(order).alias("o"))
    return df.groupBy(*by).agg(F.min(key).alias("_m")).select(*by, F.col("_m.o").alias(order), (-F.col("_m.s") if largest else F.col("_m.s")).alias(score))


def above_least(df: DataFrame, value: str) -> DataFrame:
    least = df.agg(F.min(value).alias("_least"))
    return df.crossJoin(F.broadcast(least)).where(F.col(value) > F.col("_least")).drop("_least")  # one row


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi")


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def kept_by_either(df: DataFrame, first: DataFrame, second: DataFrame, key: str = "atom_id") -> DataFrame:
    return df.join(first.select(key).union(second.select(key)).distinct(), key, "left_semi")
