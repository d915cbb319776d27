"""Voronoi indices: an atom's cell is cut by the planes halfway to other atoms, a task for each block of atoms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import point_tree
from .iterate import cut
from .neighbours import AROUND, _cells, bounding_box
from .point_tree import xyz_of
from .shape import spread

FAR = 1e5  # a corner so many times farther than the points counts as at infinity
FEW = 1000  # so few cells go down the tree at once
MOST = 50_000  # points that a block of atoms meets in one task


class Cell:
    """Convex cell about the origin: corners, the three planes that meet at each, and the points that made the planes.

    The first six planes are a far box; a face that meets it goes to infinity.
    """

    def __init__(self, size: float):
        self.points = 2 * size * np.vstack([np.eye(3), -np.eye(3)])
        signs = np.array(list(np.ndindex(2, 2, 2)))
        self.corners = size * (1.0 - 2 * signs)
        self.planes = signs * 3 + np.arange(3)

    def reach(self) -> float:
        """Twice the farthest corner: no point beyond cuts the cell."""
        return 2 * float(np.sqrt((self.corners**2).sum(1).max()))

    def cutting(self, near: np.ndarray) -> np.ndarray:
        """Those of ``near`` whose plane cuts off a corner; the others never will, as the cell only shrinks."""
        over = self.corners @ near.T - (near**2).sum(1) / 2
        slack = 1e-11 * (np.sqrt((self.corners**2).sum(1))[:, None] + np.sqrt((near**2).sum(1))) * np.sqrt((near**2).sum(1))
        return near[(over > slack).any(axis=0)]

    def clip(self, near: np.ndarray) -> Cell:
        """Cut by all of ``near``, the nearest first."""
        near = near[np.argsort((near**2).sum(1), kind="stable")]
        for part in (near[:32], near[32:]):
            part = self.cutting(part)
            while len(part):
                self._cut(part[0])
                part = self.cutting(part[1:])
        return self

    def _cut(self, p: np.ndarray) -> None:
        length = np.sqrt(p @ p)
        over = self.corners @ (p / length) - length / 2
        off = over > 1e-11 * (np.sqrt((self.corners**2).sum(1)) + length)
        edges = {}
        for k, (a, b, c) in enumerate(self.planes.tolist()):
            for e in ((a, b), (a, c), (b, c)):
                edges.setdefault(e if e[0] < e[1] else e[::-1], []).append(k)
        new = len(self.points)
        self.points = np.vstack([self.points, p])
        split = [(e, *(ks if off[ks[1]] else ks[::-1])) for e, ks in edges.items() if len(ks) == 2 and off[ks[0]] != off[ks[1]]]
        planes = np.array([[*e, new] for e, _, _ in split], dtype=np.int64).reshape(-1, 3)
        keep, drop = (np.array([s[n] for s in split], dtype=np.int64) for n in (1, 2))
        t = np.clip(over[keep] / (over[keep] - over[drop]), 0, 1)[:, None]
        corners = self.corners[keep] + t * (self.corners[drop] - self.corners[keep])
        m = self.points[planes]
        lengths = np.sqrt((m**2).sum(2))
        unit = m / lengths[..., None]
        sharp = np.abs(np.linalg.det(unit)) > 1e-6
        if sharp.any():
            corners[sharp] = np.linalg.solve(unit[sharp], lengths[sharp][..., None] / 2)[..., 0]
        self.corners, self.planes = np.vstack([self.corners[~off], corners]), np.vstack([self.planes[~off], planes])

    def makers(self) -> np.ndarray:
        """Points whose planes bound the cell."""
        used = np.unique(self.planes)
        return self.points[used[used >= 6]]

    def sides(self) -> list[int]:
        """Corners of each face; corners that coincide are one, and faces that go to infinity are left out."""
        out = []
        for k in np.unique(self.planes[self.planes >= 6]):
            on = (self.planes == k).any(axis=1)
            if (self.planes[on] < 6).any():
                continue
            left, n = self.corners[on], 0
            while len(left):
                gap = np.sqrt(((left - left[0]) ** 2).sum(1))
                left, n = left[gap > 1e-8 * np.sqrt((left[0] ** 2).sum())], n + 1
            if n >= 3:
                out.append(n)
        return out


def face_sides(neighbours: np.ndarray) -> list[int]:
    """Number of corners of each bounded face of the cell about the origin, by all the neighbours given."""
    near = neighbours[(neighbours**2).sum(1) > 0]
    if not len(near):
        return []
    return Cell(FAR * float(np.abs(near).max())).clip(near).sides()


SCHEMA = "atom_id long, n3 long, n4 long, n5 long, n6 long"
#: A cell on its way: points whose planes bound it and corners, both from its atom, and nodes that may still cut it.
OPEN = "atom_id long, x double, y double, z double, makers array<double>, corners array<double>, nodes array<long>"
KINDS = pa.schema([("atom_id", pa.int64()), *((a, pa.float64()) for a in "xyz"), ("makers", pa.list_(pa.float64())), ("corners", pa.list_(pa.float64())), ("nodes", pa.list_(pa.int64()))])
FOUND = pa.schema([("atom_id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("found", pa.list_(pa.float64()))])


def _table(ids: list[int], sides: list[list[int]]) -> pa.Table:
    return pa.table({"atom_id": pa.array(ids, pa.int64()), **{f"n{n}": pa.array([s.count(n) for s in sides], pa.int64()) for n in (3, 4, 5, 6)}})


def _triples(flat) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, 3)


def _may_cut(corners: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each box (rows of ``low`` and ``high``, from the atom): whether a point of it may cut off a corner.

    A point p cuts off a corner c where c p > p p / 2; over a box that is greatest at the corner, clamped to the box.
    """
    best = np.clip(corners[:, None], low, high)
    over = (corners[:, None] * best - best * best / 2).sum(2)
    nearest = np.sqrt((np.clip(0.0, low, high) ** 2).sum(1))
    return (over > 1e-11 * np.sqrt((corners**2).sum(1))[:, None] * nearest).any(axis=0)


def voronoi_indices(df: DataFrame, radius: float | None = None, periodic: bool = False) -> DataFrame:
    """atom_id, n3, n4, n5, n6: bounded faces of each atom's cell by their sides, a row for every atom.

    A cell is done when nothing beyond the radius can cut it, which is when the radius is over twice its farthest corner.
    The radius doubles once; the others, and blocks with more than MOST points around them, go down a tree of blocks of
    points.  So ``radius`` is where this starts and changes no result.  Faces that go to infinity are not counted, as in
    the model; atoms at one place have the same cell; atoms without a place have no row.
    """
    spark = df.sparkSession
    atoms = cut(df.select("atom_id", *(F.col(a).cast("double").alias(a) for a in "xyz")).dropna(subset=[*"xyz"]), spark)
    box = bounding_box(atoms).first()
    n = atoms.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    widths = [box[f"{a}w"] for a in "xyz"]
    extent = float(np.sqrt(sum(w * w for w in widths))) or 1.0
    points = atoms.select(*"xyz")
    if periodic:  # a cell lies within half a box of its atom, so one layer of images holds all that cut it
        points = spread(points.withColumns({f"_{a}": F.lit(0) for a in "xyz"}), AROUND, ["_x", "_y", "_z"], ["_x", "_y", "_z"])
        points = points.select(*((F.col(a) + F.col(f"_{a}") * F.lit(w)).alias(a) for a, w in zip("xyz", widths)))
    points = points.distinct()
    size = FAR * extent * (2 if periodic else 1)
    radius = radius or 2 * (float(np.prod([max(w, 1e-3 * extent) for w in widths])) / n) ** (1 / 3)
    done, waiting = [], atoms.withColumn("makers", F.lit(None).cast("array<double>"))
    for _ in range(2):
        if n > FEW and radius < extent:
            got = cut(_in_blocks(waiting.drop("makers"), points, radius, size), spark)
            done.append(got.where("makers IS NULL").drop("makers"))
            left = got.where("makers IS NOT NULL").select("atom_id", "makers")
            waiting = cut(waiting.drop("makers").join(left, "atom_id"), spark)
            n, radius = waiting.count(), radius * 2
    out = _down_the_tree(waiting, point_tree.levels(points), size) if n else spark.createDataFrame([], SCHEMA)
    for d in done:
        out = out.unionByName(d)
    return out


def _in_blocks(atoms: DataFrame, points: DataFrame, radius: float, size: float) -> DataFrame:
    """Rows of SCHEMA and makers: null for cells that points within ``radius`` close, what bounds them so far for others.

    A block meets the points of the 27 blocks around; where it or they hold more than MOST, its cells stay as they are.
    """
    cell, block, place = ["_x", "_y", "_z"], ["bx", "by", "bz"], ["px", "py", "pz"]
    own = _cells(atoms, radius).withColumnsRenamed(dict(zip(cell, block)))
    wanted = spread(own.select(*block).distinct(), AROUND, block, ["_i", "_j", "_k"])
    around = _cells(points, radius).select(*(F.col(a).alias(p) for a, p in zip("xyz", place)), *(F.col(c).alias(n) for c, n in zip(cell, ("_i", "_j", "_k"))))
    around = around.join(wanted, ["_i", "_j", "_k"]).select(*place, *block)
    counts = [t.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select(*block) for t in (own, around)]
    heavy = cut(counts[0].union(counts[1]).distinct(), atoms.sparkSession)
    schema = f"{SCHEMA}, makers array<double>"

    def run(left, right):
        near, ids, sides, makers = xyz_of(right, place), [], [], []
        for a, at in zip(left.column("atom_id").to_pylist(), xyz_of(left)):
            d = near - at
            far = (d**2).sum(1)
            c = Cell(size).clip(d[(far > 0) & (far < radius * radius)])
            closed = c.reach() < radius
            ids.append(a)
            sides.append(c.sides() if closed else [])
            makers.append(None if closed else c.makers().ravel())
        return _table(ids, sides).append_column("makers", pa.array(makers, pa.list_(pa.float64())))

    light = [t.join(heavy, block, "left_anti") for t in (own, around)]
    here = [F.col(b).alias(f"_{b}") for b in block]  # names of its own, as both sides come from the same atoms
    out = light[0].groupBy(*block).cogroup(light[1].select(*place, *here).groupBy(*(f"_{b}" for b in block))).applyInArrow(run, schema)
    untouched = own.join(heavy, block, "left_semi").select("atom_id", *(F.lit(0).cast("long").alias(f"n{n}") for n in (3, 4, 5, 6)), F.array().cast("array<double>").alias("makers"))
    return out.unionByName(untouched)


def _down_the_tree(atoms: DataFrame, levels: list[DataFrame], size: float) -> DataFrame:
    """Rows of the cells (atom_id, x, y, z, makers) cut by all points of the tree.

    Each round joins cells with the nodes that may still cut them.  A pair's task cuts the cell by the children's one
    points, or by a leaf's points, and names the children whose boxes may cut what is left; a cell's findings then meet
    it again in one small group.  So a task holds a cell and a node, whatever the number of points or cells.
    """
    top = [r["node"] for r in levels[-1].select("node").collect()]  # at most FAN

    def begin(batches):
        for b in batches:
            made = [Cell(size).clip(_triples(m)) for m in (v or [] for v in b.column("makers").to_pylist())]
            yield _open_rows(b.column("atom_id"), xyz_of(b), made, [top] * len(made))

    def meet(batches):
        for b in batches:
            ids, nodes, found = [], [], []
            at, lists = xyz_of(b), {c: b.column(c) for c in ("makers", "corners", "box", "kids", "inside")}
            for k, a in enumerate(b.column("atom_id").to_pylist()):
                corners, box, inside = (lists[c][k].values.to_numpy() for c in ("corners", "box", "inside"))
                corners, box = corners.reshape(-1, 3), box.reshape(2, 1, 3) - at[k]
                if not _may_cut(corners, *box).any():
                    continue
                kids = lists["kids"][k].values.to_numpy()
                boxes = inside.reshape(-1, 9) - np.tile(at[k], 3) if len(kids) else None
                near = boxes[:, 6:] if len(kids) else inside.reshape(-1, 3) - at[k]
                near = near[(near**2).sum(1) > 0]
                cell = Cell(size)
                cell.corners = corners
                cutting, new = cell.cutting(near), np.empty((0, 3))
                if len(cutting):
                    old = lists["makers"][k].values.to_numpy().reshape(-1, 3)
                    cell = Cell(size).clip(np.vstack([old, cutting]))
                    new, corners = cell.makers(), cell.corners
                if len(kids):
                    kids = kids[_may_cut(corners, boxes[:, :3], boxes[:, 3:6])]
                ids.append(a)
                nodes.append(kids)
                found.append(new.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, FOUND.field("nodes").type), pa.array(found, FOUND.field("found").type)], schema=FOUND)

    def gathered(last: bool):
        def run(left, right):
            made, nodes = [], []
            found = [_triples(v) for v in right.column("found").to_pylist() if v]
            for makers in left.column("makers").to_pylist():
                every = np.unique(np.vstack([_triples(makers), *found]), axis=0)
                made.append(Cell(size).clip(every))
                nodes.append(sorted({n for v in right.column("nodes").to_pylist() for n in v}))
            if last:
                return _table(left.column("atom_id").to_pylist(), [c.sides() for c in made])
            return pa.Table.from_batches([_open_rows(left.column("atom_id"), xyz_of(left), made, nodes)])

        return run

    spark = atoms.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work: partitions aren't to be joined up
    by_atom = lambda df: df.repartition(tasks, "atom_id").groupBy("atom_id")
    cells = cut(atoms.repartition(tasks, "atom_id").mapInArrow(begin, OPEN), spark)
    for nodes in reversed(levels):
        last = nodes is levels[0]
        pairs = cells.withColumn("node", F.explode("nodes")).drop("nodes").join(nodes.drop("one"), "node")
        met = pairs.mapInArrow(meet, "atom_id long, nodes array<long>, found array<double>")
        cells = cut(by_atom(cells).cogroup(by_atom(met)).applyInArrow(gathered(last), SCHEMA if last else OPEN), spark)
    return cells


def _open_rows(ids, at: np.ndarray, made: list[Cell], nodes: list) -> pa.RecordBatch:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    columns = [ids, *(pa.array(at[:, k]) for k in range(3)), *(pa.array([v.ravel() for v in part], pa.list_(pa.float64())) for part in ([c.makers() for c in made], [c.corners for c in made]))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(nodes, pa.list_(pa.int64()))], schema=KINDS)


def index_fractions(indices: DataFrame) -> DataFrame:
    """index, n, fraction, most frequent first."""
    name = F.format_string("<%d,%d,%d,%d>", "n3", "n4", "n5", "n6")
    counts = indices.groupBy(name.alias("index")).agg(F.count(F.lit(1)).alias("n"))
    total = indices.agg(F.count(F.lit(1)).alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("index", "n", (F.col("n") / F.col("_t")).alias("fraction")).orderBy(F.desc("n"), "index")  # one row
