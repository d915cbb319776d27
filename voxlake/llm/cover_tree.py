"""Embedding near-dedup by dual traversal of cover trees.

Vectors are scaled to length one, so that a cosine is a distance.  The top of a cover tree, nested levels of centres
with halving radii, is built on a bounded sample; every vector is then indexed under its nearest centre of the lowest
such level, and each cell gets its true covering radius.  Cells are cut into blocks, and block pairs of cells that are
too far apart for any link are pruned.  The levels below are built block by block: a node's children are a net of its
vectors at half its level's radius, its own centre first, down to single vectors or equal directions.  A task gets
the trees of two blocks and descends both: a pair of nodes is dropped when their covering radii prove that nothing in
it links, counted whole when they prove that all of it does, and split into the pairs of their children otherwise.
Children are kept in order of their distance from the node's centre, so tiles of them that the triangle inequality
parts aren't even measured.  What is left at the leaves is compared by cosine in double precision.

Tasks return a count for each vector and a spanning forest of what links, never the pairs.

Defined results: null vectors, null or non-finite components, zero vectors and vectors of another length link with
nothing; equal vectors are one point with a count; rows with one vec_id are vectors of their own; a row with a null
vec_id links like any other, but never names a component, and its ``kept`` is null; a component of such rows alone has
a null component_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined_back, partitions, trim, written
from .components import components

#: Rows that the top of the tree is built on, its centres at most, points of a block, and children of a tile.
SAMPLE, CENTRES, BLOCK, TILE = 4096, 256, 8192, 512
#: Slack for rounding in bounds (a distance is a root, so it is coarser than a cosine); pairs within it are split.
SLACK = 1e-6


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, or None if it links with nothing."""
    out = []
    for x in column:
        v = x.values
        if v is None or v.null_count or not len(v):
            out.append(None)
            continue
        v = v.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover(x: np.ndarray, radius: float, most: int, start: list[int] = ()) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres among the rows of ``x``, ``start`` first, so that every row is within ``radius`` of one; None if that
    takes over ``most``.  Also the nearest centre of each row and the distance to it."""
    centres, best, of = [], np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    queue = list(start)
    while True:
        if queue:
            c = queue.pop(0)
        else:
            c = int(best.argmax())
            if best[c] <= radius:
                return centres, of, best
        if len(centres) >= most:
            return None
        d = distances(x, x[c : c + 1])[:, 0]
        near = d < best
        of[near], best[near] = len(centres), d[near]
        centres.append(c)


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x``, the first one first, over ``radius`` apart and such that every row is within it of one; and the
    nearest of them for each row."""
    chosen = np.zeros(1, np.int64)
    for at in range(0, len(x), TILE):
        rows = np.arange(at, min(at + TILE, len(x)))
        far = np.ones(len(rows), bool)
        for k in range(0, len(chosen), 8 * TILE):
            far &= (distances(x[rows], x[chosen[k : k + 8 * TILE]]) > radius).all(axis=1)
        rows = rows[far]
        apart, more = distances(x[rows], x[rows]) > radius, []
        left = np.ones(len(rows), bool)
        for i in range(len(rows)):
            if left[i]:
                more.append(rows[i])
                left &= apart[i]
        chosen = np.append(chosen, np.array(more, np.int64))
    of = np.empty(len(x), np.int64)
    for at in range(0, len(x), TILE):
        of[at : at + TILE] = (x[at : at + TILE] @ x[chosen].T).argmax(axis=1)
    of[chosen] = np.arange(len(chosen))
    return chosen, of


class Tree:
    """Nodes as arrays: covering radius, first and one past the last child, place and end of its points; a node's
    centre is its first point, ``far`` the distance from its parent's, and points lie in order of the tree.

    Children come as the one with the parent's centre, those of several points, and single points, each by ``far``.
    """

    FIELDS = (("radius", np.float64), ("first", np.int64), ("stop", np.int64), ("low", np.int64), ("high", np.int64), ("far", np.float64))

    def __init__(self, nodes: np.ndarray):
        for i, (name, kind) in enumerate(self.FIELDS):
            setattr(self, name, nodes[i].astype(kind))
        self.leaf = self.first == self.stop
        #: Nodes that a node is split into, from ``start`` on: its children, or a leaf itself.
        self.kids = np.where(self.leaf, 1, self.stop - self.first)
        self.start = np.where(self.leaf, np.arange(len(self.leaf)), self.first)

    @classmethod
    def plant(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of the rows of ``x`` and the order in which it has them."""
        order = np.arange(len(x))
        nodes = [[0.0, 0, 0, 0, len(x), 0.0]]
        levels, at = [2.0], 0
        while at < len(nodes):
            node, level = nodes[at], levels[at]
            low, high = node[3], node[4]
            rows = order[low:high]
            far = distances(x[rows], x[rows[:1]])[:, 0] if high - low > 1 else np.zeros(1)
            node[0] = float(far.max())
            node[1] = node[2] = len(nodes)
            if node[0] > SLACK:
                while level >= node[0]:
                    level /= 2
                chosen, of = net(x[rows], level)
                alone = np.bincount(of, minlength=len(chosen)) == 1
                alone[0] = False  # the node's own centre stays first
                by_far = np.lexsort((far[chosen], np.arange(len(chosen)) > 0, alone))
                rank = np.empty(len(chosen), np.int64)
                rank[by_far] = np.arange(len(chosen))
                centre = np.ones(len(rows), bool)
                centre[chosen] = False
                place = np.lexsort((centre, rank[of]))
                order[low:high] = rows[place]
                ends = low + np.cumsum(np.bincount(rank[of], minlength=len(chosen)))
                nodes += [[0.0, 0, 0, a, b, f] for a, b, f in zip([low, *ends[:-1].tolist()], ends.tolist(), far[chosen[by_far]].tolist())]
                levels += [level] * len(chosen)
                node[2] = len(nodes)
            at += 1
        return cls(np.array(nodes, np.float64).T), order

    def blob(self) -> bytes:
        return np.array([getattr(self, name) for name, _ in self.FIELDS], np.float64).tobytes()

    @classmethod
    def read(cls, blob: bytes) -> Tree:
        return cls(np.frombuffer(blob, np.float64).reshape(len(cls.FIELDS), -1))


class Joined:
    """Counts and a forest over the points of two blocks."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold
        self.reach = math.sqrt(2.0 - 2.0 * threshold)
        self.counts = np.zeros(len(weights), np.int64)
        self.label = np.arange(len(weights))
        #: Node pairs that were skipped in tiles, whose distance was measured, that the radii let stay; vector pairs compared.
        self.skipped = self.measured = self.survived = self.compared = 0

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            for _ in range(64):  # follow labels to their roots
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))

    def whole(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Everything in ``a`` links with everything in ``b``."""
        if same:
            self.counts[a] += self.weights[a].sum() - self.weights[a]
        else:
            self.counts[a] += self.weights[b].sum()
            self.counts[b] += self.weights[a].sum()
        rest = np.concatenate([a, b])
        self.union(rest, np.full(len(rest), rest[0]))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> None:
        """Single links."""
        np.add.at(self.counts, left, self.weights[right])
        np.add.at(self.counts, right, self.weights[left])
        self.union(left, right)

    def leaves(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for i in range(0, len(a), 1024):
            some = a[i : i + 1024]
            r, c = np.nonzero(x[some] @ x[b].T >= self.threshold)
            left, right = some[r], b[c]
            keep = left < right if same else np.ones(len(left), bool)
            self.pairs(left[keep], right[keep])
            self.compared += len(some) * len(b)

    def descend(self, x: np.ndarray, one: Tree, two: Tree, shift: int) -> None:
        """Joins the points of ``one``, which come first, and those of ``two``, from row ``shift`` on; the same tree
        twice, with no shift, joins its points with one another."""
        same = one is two
        stack, waiting = [], []
        singles: list[tuple[np.ndarray, np.ndarray]] = []

        def sort_out(m: np.ndarray, n: np.ndarray, d: np.ndarray) -> None:
            """Settles what bounds settle of node pairs, and puts the others where they are split."""
            near = d <= one.radius[m] + two.radius[n] + self.reach + SLACK
            self.measured += len(d)
            self.survived += int(near.sum())
            m, n, d = m[near], n[near], d[near]
            own = (m == n) & same
            ends = one.leaf[m] & two.leaf[n]
            alone = ends & ~own & (one.high[m] - one.low[m] == 1) & (two.high[n] - two.low[n] == 1)
            singles.append((one.low[m[alone]], two.low[n[alone]] + shift))
            linked = ~alone & (np.where(own, 0.0, d) + one.radius[m] + two.radius[n] <= self.reach - SLACK)
            for i in np.flatnonzero(linked).tolist():
                self.whole(np.arange(one.low[m[i]], one.high[m[i]]), np.arange(two.low[n[i]], two.high[n[i]]) + shift, bool(own[i]))
            for i in np.flatnonzero(ends & ~alone & ~linked).tolist():
                self.leaves(x, np.arange(one.low[m[i]], one.high[m[i]]), np.arange(two.low[n[i]], two.high[n[i]]) + shift, bool(own[i]))
            split = ~ends & ~linked
            many = split & (own | (one.kids[m] * two.kids[n] >= 8 * TILE))
            stack.extend(zip(m[many].tolist(), n[many].tolist()))
            few = split & ~many
            if few.any():
                waiting.append((m[few], n[few]))

        sort_out(np.zeros(1, np.int64), np.zeros(1, np.int64), distances(x[:1], x[shift : shift + 1])[0])
        while stack or waiting:
            if waiting:
                m, n = (np.concatenate(c) for c in zip(*waiting))
                waiting.clear()
                sizes = one.kids[m] * two.kids[n]
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (64 * TILE))) + 1
                for u, v, size in zip(np.split(m, cuts), np.split(n, cuts), np.split(sizes, cuts)):
                    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    u, v = np.repeat(u, size), np.repeat(v, size)
                    u, v = one.start[u] + k // two.kids[v], two.start[v] + k % two.kids[v]
                    sort_out(u, v, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x[one.low[u]], x[two.low[v] + shift]))))
                continue
            p, q = stack.pop()
            alike = same and p == q
            left, right = one.start[p] + np.arange(one.kids[p]), two.start[q] + np.arange(two.kids[q])
            base = float(distances(x[one.low[p]][None], x[two.low[q] + shift][None])[0, 0])
            for i in range(0, len(left), TILE):
                a = left[i : i + TILE]
                for j in range(i if alike else 0, len(right), TILE):
                    b = right[j : j + TILE]
                    if self._parted(one, two, a, b, base):
                        self.skipped += len(a) * len(b)
                        continue
                    cosine = x[one.low[a]] @ x[two.low[b] + shift].T
                    ra, rb = one.radius[a], two.radius[b]
                    span = ra[0] + rb[0] if (ra == ra[0]).all() and (rb == rb[0]).all() else ra[:, None] + rb
                    span = np.minimum(span + (self.reach + SLACK), 2.0)
                    r, c = np.nonzero(cosine >= 1.0 - 0.5 * span * span - SLACK * SLACK)
                    if alike and i == j:
                        r, c = r[r <= c], c[r <= c]
                    self.measured += cosine.size - len(r)
                    sort_out(a[r], b[c], np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine[r, c])))
        for left, right in singles:
            for k in range(0, len(left), 8192):
                l, r = left[k : k + 8192], right[k : k + 8192]
                hit = np.einsum("ij,ij->i", x[l], x[r]) >= self.threshold
                self.compared += len(l)
                self.pairs(l[hit], r[hit])

    def _parted(self, one: Tree, two: Tree, a: np.ndarray, b: np.ndarray, base: float) -> bool:
        """Whether distances from the parents' centres, ``base`` apart, keep all of ``a`` from all of ``b``."""
        fa, fb = one.far[a], two.far[b]
        gap = max(base - fa.max() - fb.max(), fa.min() - fb.max() - base, fb.min() - fa.max() - base)
        return gap > one.radius[a].max() + two.radius[b].max() + self.reach + SLACK


def top_cells(sample: np.ndarray) -> np.ndarray:
    """Centres of the lowest level of the tree's top: radii halve while a level has at most ``CENTRES`` centres."""
    centres, radius = [0], 2.0
    while radius > 1e-6:
        found = cover(sample, radius / 2, CENTRES, centres)
        if found is None:
            break
        centres, radius = found[0], radius / 2
    return sample[centres]


def points(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, k1 and k2 (128 bits of the vector, null if it links with nothing), its length and its doubles as bytes."""
    schema = pa.schema([(key, pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for v in vectors(batch.column(column)):
                if v is None:
                    out.append((None, None, None, None))
                else:
                    raw = v.tobytes()
                    k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist()
                    out.append((k1, k2, len(v), raw))
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    return rows.select(key, column).mapInArrow(run, f"{key} long, k1 long, k2 long, dim int, v binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def linked(reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """id, n (weight of the points that link with it) and root (a point of its tree) for parts of ``reps``
    (id, weight, v), to be summed and joined."""
    spark = reps.sparkSession
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "id long, n long, root long")
    centres = unit(_matrix(sample.column("v"), dim)[:SAMPLE])
    centres = top_cells(centres)
    shipped = spark.sparkContext.broadcast(centres)
    total = reps.count()
    size = max(512, min(BLOCK, -(-total // 6)))
    schema = pa.schema([("id", pa.int64()), ("weight", pa.int64()), ("v", pa.binary()), ("cell", pa.int32()), ("far", pa.float64())])

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                d = distances(unit(_matrix(part.column("v"), dim)), shipped.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("weight"), part.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell], pa.float64())], schema=schema)

    placed = written(reps.select("id", "weight", "v").mapInArrow(place, "id long, weight long, v binary, cell int, far double"), spark)
    cells = {r["cell"]: (r["far"], r["n"]) for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}  # at most CENTRES rows
    # a large cell is cut into blocks from ``base`` on; small cells that follow one another share a block
    spans, base, fill = {}, 0, 0
    for c in sorted(cells, key=lambda c: distances(centres[c : c + 1], centres[:1])[0, 0]):
        parts = -(-cells[c][1] // size)
        if fill and (parts > 1 or fill + cells[c][1] > size):
            base, fill = base + 1, 0
        spans[c] = (base, parts)
        base, fill = (base + parts, 0) if parts > 1 else (base, fill + cells[c][1])
    reach = math.sqrt(2.0 - 2.0 * threshold)
    gap = distances(centres, centres)
    meets = [(c, d) for c in cells for d in cells if gap[c, d] <= cells[c][0] + cells[d][0] + reach + SLACK]
    lookup = spark.createDataFrame([(c, b, p) for c, (b, p) in spans.items()], "cell int, base int, parts int")
    partners = spark.createDataFrame([(c, *spans[d]) for c, d in meets], "cell int, other int, others int")
    # block pairs are made where they are used: a row for each block, turned into a row for each partner
    own = lookup.select("cell", F.explode(F.sequence("base", F.col("base") + F.col("parts") - 1)).alias("lo")).repartition("lo")
    pairs = own.join(F.broadcast(partners), "cell").where(F.col("lo") < F.col("other") + F.col("others"))
    pairs = pairs.select("lo", F.explode(F.sequence(F.greatest("lo", "other"), F.col("other") + F.col("others") - 1)).alias("hi")).distinct()
    blocks = placed.join(F.broadcast(lookup), "cell").withColumn("block", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).select("block", "id", "weight", "v")

    def plant(key, got):
        got = got.sort_by("id")
        x = unit(_matrix(got.column("v"), dim))
        tree, order = Tree.plant(x)
        packed = [got.column(c).to_numpy()[order].tobytes() for c in ("id", "weight")]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": [packed[0]], "weights": [packed[1]], "x": [x[order].tobytes()], "nodes": [tree.blob()]})

    planted = written(blocks.groupBy("block").applyInArrow(plant, "block int, ids binary, weights binary, x binary, nodes binary"), spark)

    def run(key, got):
        got = got.sort_by("block")
        ids, weights = (np.concatenate([np.frombuffer(b, np.int64) for b in got.column(c).to_pylist()]) for c in ("ids", "weights"))
        x = np.concatenate([np.frombuffer(b, np.float64).reshape(-1, dim) for b in got.column("x").to_pylist()])
        trees = [Tree.read(b) for b in got.column("nodes").to_pylist()]
        joined = Joined(weights, threshold)
        joined.descend(x, trees[0], trees[-1], int(trees[0].high[0]) if len(trees) == 2 else 0)
        hit, label = joined.counts > 0, joined.label
        while (label[label] != label).any():
            label = label[label]
        out = pa.table({"id": pa.array(ids[hit]), "n": pa.array(joined.counts[hit]), "root": pa.array(ids[label[hit]])})
        trim()
        return out

    blocks_in_all = base + (fill > 0)
    tasks = max(partitions(spark), min(blocks_in_all * (blocks_in_all + 1), 16 * partitions(spark)))
    sides = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    found = written(planted.join(sides, "block").repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInArrow(run, "id long, n long, root long"), spark)
    dropped(placed, planted)
    return found


def near_duplicates(rows: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``rows``."""
    spark = rows.sparkSession
    all_points = written(points(rows, key, column), spark)
    # a vector's id is a number of its own: vec_ids may be null or shared
    distinct = all_points.where("k1 IS NOT NULL").groupBy("dim", "k1", "k2").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    reps = written(distinct.withColumn("id", F.monotonically_increasing_id()), spark)
    dims = [r["dim"] for r in reps.select("dim").distinct().collect()]
    found = None
    for dim in dims:
        part = linked(reps.where(F.col("dim") == dim), dim, threshold)
        found = part if found is None else found.unionByName(part)
    found = found if found is not None else spark.createDataFrame([], "id long, n long, root long")
    labels = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    # a component is named after its least vec_id
    members = written(labels.join(reps.select("id", "least"), "id"), spark)
    names = written(members.groupBy("component").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("size")), spark)
    named = joined_back(members.select("id", "component"), names, ["component"], "size").select("id", "name")
    sums = found.groupBy("id").agg(F.sum("n").alias("n")).join(named, "id", "left")
    reps = reps.select("k1", "k2", "id", "least", "weight").join(sums, "id", "left")
    out = all_points.select(key, "k1", "k2").join(reps, ["k1", "k2"], "left")
    component = F.coalesce("name", "least", key)
    links = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    return out.select(key, links.cast("long").alias("n_links"), component.alias("component_id"), (F.col(key) == component).alias("kept"))
