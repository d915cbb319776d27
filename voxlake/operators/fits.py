"""Fits to the neighbourhoods of many places at once.

A neighbourhood is gathered by one equi-join of stencil and cells and becomes a row; from there on a fit needs nothing
else, so all its rounds run where the row lies, thousands of rows in one batch of small systems.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are solved together.
BATCH = 512

#: Exponents of a quartic in three variables, by degree.
MONOMIALS = [(a, b, c) for n in range(5) for a in range(n, -1, -1) for b in range(n - a, -1, -1) for c in [n - a - b]]

#: Parameters of a turned Gaussian: floor + height exp(-sum u^2 / spread), u = the place turned about z, y and z again.
GAUSSIAN = ["floor", "height", "x", "y", "z", "spread1", "spread2", "spread3", "turn1", "turn2", "turn3"]


def neighbourhoods(places: DataFrame, cells: DataFrame, offsets: list[tuple[int, int, int]], key: str) -> DataFrame:
    """key, i, j, k, box: values of the cells at ``offsets`` around each place (i, j, k), in the offsets' order.

    ``box`` is null where a cell is absent, null or NaN.  One row a stencil cell is shuffled.
    """
    at = places.select(key, *(F.col(a).cast("int").alias(f"_{a}") for a in "ijk"))
    items = F.array(*(F.struct(*(F.lit(x).alias(a) for x, a in zip(o, "ijk"))) for o in offsets))
    wanted = at.select(key, *(f"_{a}" for a in "ijk"), F.posexplode(items).alias("_n", "_o"))
    wanted = wanted.select(key, *(f"_{a}" for a in "ijk"), "_n", *((F.col(f"_{a}") + F.col(f"_o.{a}")).alias(a) for a in "ijk"))
    value = F.col("v").cast("double")
    known = cells.where(value.isNotNull() & ~F.isnan(value)).select(*(F.col(a).cast("int").alias(a) for a in "ijk"), value.alias("v"))
    got = wanted.join(known, ["i", "j", "k"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "v"))).alias("_b"))  # bounded by the stencil
    box = F.when(F.size("_b") == len(offsets), F.transform("_b", lambda x: x["v"]))
    return at.join(got.select(key, box.alias("box")), key, "left").select(key, *(F.col(f"_{a}").alias(a) for a in "ijk"), "box")


def _batches(batch: pa.RecordBatch, column: str):
    """Row numbers and arrays (rows, values) of the rows whose list isn't null."""
    lists = batch.column(column)
    rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    for n in range(0, len(rows), BATCH):
        some = rows[n : n + BATCH]
        flat = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
        yield some, flat.reshape(len(some), -1)


def _weighted_solution(a: np.ndarray, b: np.ndarray, ridge: float | None, full: bool) -> np.ndarray:
    if ridge is not None:
        t = a.transpose(0, 2, 1)
        return np.linalg.solve(t @ a + ridge * np.eye(a.shape[2]), t @ b[..., None])[..., 0]
    if not full:
        return (np.linalg.pinv(a) @ b[..., None])[..., 0]
    q, r = np.linalg.qr(a)
    return np.linalg.solve(r, q.transpose(0, 2, 1) @ b[..., None])[..., 0]


def stationary_points(values: np.ndarray, offsets: np.ndarray, radius: int, rounds: int = 14, quiet: int = 7, most: float = 0.5, decay: float = 1.0, ridge: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shifts (rows, 3) from the middle to the maxima of quartics fitted about the shift reached so far, and flags."""
    at, flag = np.zeros((len(values), 3)), np.zeros(len(values), np.int8)
    run, live = np.zeros(len(values), int), np.arange(len(values))
    powers = np.array(MONOMIALS)
    column = {m: n for n, m in enumerate(MONOMIALS)}
    plain = np.prod(offsets[:, None] ** powers[None], axis=2)
    full = np.linalg.matrix_rank(plain) == len(MONOMIALS)  # moving the origin or weighting doesn't change that
    second = np.array([[column[tuple(np.eye(3, dtype=int)[a] + np.eye(3, dtype=int)[b])] for b in range(3)] for a in range(3)])
    first = [column[tuple(e)] for e in np.eye(3, dtype=int)]
    for n in range(rounds + 1):
        if not len(live):
            break
        d = offsets[None] - at[live, None]
        w = np.exp(-decay * (d * d).sum(2) / radius**2)
        to = [d[..., None] ** k if k else np.ones((*d.shape, 1)) for k in range(5)]
        to = np.concatenate(to, axis=3)  # row, cell, axis, power
        basis = to[:, :, 0, powers[:, 0]] * to[:, :, 1, powers[:, 1]] * to[:, :, 2, powers[:, 2]]
        coef = _weighted_solution(basis * w[..., None], values[live] * w, ridge, full)
        h = coef[:, second] * (1 + np.eye(3))
        top = np.linalg.det(h) < 0
        step = np.clip(-np.linalg.solve(np.where(top[:, None, None], h, np.eye(3)), coef[:, first][..., None])[..., 0], -most, most)
        flag[live] = np.where(top, -4 if n == rounds else 0, -1)
        live, step = live[top], step[top]
        at[live] += step
        out = np.abs(at[live]).max(axis=1, initial=0) > radius
        small = np.abs(step).max(axis=1, initial=0) < most
        run[live] = np.where(small, run[live] + 1, 0)
        done = ~out & (run[live] >= quiet)
        flag[live[out]], flag[live[done]] = -2, 0
        live = live[~out & ~done]
    return at, flag


def refine_peaks(peaks: DataFrame, cells: DataFrame, radius: int = 3, rounds: int = 14, quiet: int = 7, ridge: float | None = None) -> DataFrame:
    """peak_id, x, y, z, flag: maxima near ``peaks`` (peak_id, i, j, k) to a fraction of a cell.

    In each round a quartic is fitted to the ball of ``radius`` around the peak's own cell, weighted around the place
    reached so far, and the place goes to its stationary point, at most half a cell along an axis.  ``quiet`` shorter
    steps one after another end it (flag 0).  Other flags: -1 no maximum, -2 over ``radius`` away or a cell of the ball
    is missing (then the place is the peak's cell), -4 out of rounds.  With ``ridge`` the normal equations are solved,
    with that much on their diagonal, otherwise least squares.  peak_id is unique.
    """
    from .shape import ball_offsets

    offsets = ball_offsets(radius)
    where = np.array(offsets, float)

    def run(batches):
        for batch in batches:
            at = np.column_stack([batch.column(a).to_numpy() for a in "ijk"]).astype(float).reshape(-1, 3)
            flag = np.full(len(at), -2, np.int8)
            for some, values in _batches(batch, "box"):
                shift, flag[some] = stationary_points(values, where, radius, rounds, quiet, ridge=ridge)
                at[some] += shift
            yield pa.RecordBatch.from_pydict({"peak_id": batch.column("peak_id"), **dict(zip("xyz", at.T.copy())), "flag": flag})

    boxes = neighbourhoods(peaks.withColumn("peak_id", F.col("peak_id").cast("long")), cells, offsets, "peak_id")
    return boxes.mapInArrow(run, "peak_id long, x double, y double, z double, flag tinyint")


def _turned(degrees: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotations (rows, 3, 3) about z, then y, then z, and their derivatives by each angle in degrees."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    parts, slopes = [], []
    for n, (a, b) in enumerate(((0, 1), (2, 0), (0, 1))):
        m, d = np.zeros((len(c), 3, 3)), np.zeros((len(c), 3, 3))
        m[:, 3 - a - b, 3 - a - b] = 1
        m[:, a, a] = m[:, b, b] = c[:, n]
        m[:, a, b], m[:, b, a] = s[:, n], -s[:, n]
        d[:, a, a] = d[:, b, b] = -s[:, n]
        d[:, a, b], d[:, b, a] = c[:, n], -c[:, n]
        parts.append(m)
        slopes.append(d * (np.pi / 180))
    one, two, three = parts
    return three @ two @ one, [three @ two @ slopes[0], three @ slopes[1] @ one, slopes[2] @ two @ one]


def turned_gaussian(p: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (rows, cells) and derivatives (rows, cells, 11) of Gaussians with parameters ``p`` (rows, 11)."""
    v = offsets[None] - p[:, None, 2:5]
    turn, slopes = _turned(p[:, 8:])
    u, spread = v @ turn.transpose(0, 2, 1), p[:, None, 5:8]
    e = np.exp(-(u * u / spread).sum(2))
    high = p[:, 1:2] * e
    j = np.empty((*e.shape, 11))
    j[..., 0], j[..., 1] = 1, e
    j[..., 2:5] = 2 * high[..., None] * ((u / spread) @ turn)
    j[..., 5:8] = high[..., None] * (u / spread) ** 2
    for n, d in enumerate(slopes):
        j[..., 8 + n] = -2 * high * (u / spread * (v @ d.transpose(0, 2, 1))).sum(2)
    return p[:, :1] + high, j


def bounded_gaussians(values: np.ndarray, offsets: np.ndarray, start: np.ndarray, fixed: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and sums of squares of bounded fits, damped Gauss-Newton steps of all rows together.

    A parameter at a bound that its step would cross is held for that step; a row is done when its step, or what it
    gains, falls below ``tolerance`` of what there is.
    """
    p = np.clip(start, low, high)
    damp, live = np.full(len(p), 1e-3), np.arange(len(p))
    model, j = turned_gaussian(p, offsets)
    value, eye = ((model - values) ** 2).sum(1), np.eye(p.shape[1])
    t = j.transpose(0, 2, 1)
    g, h = (t @ (model - values)[..., None])[..., 0], t @ j
    for _ in range(rounds):
        if not len(live):
            break
        at, gl, hl = p[live], g[live], h[live]
        held = fixed | ((at <= low) & (gl > 0)) | ((at >= high) & (gl < 0))
        free = ~held
        a = np.where(free[:, :, None] & free[:, None], hl, 0.0)
        size = np.einsum("mkk->mk", a)
        a = a + eye * np.where(held, 1.0, damp[live, None] * np.maximum(size, 1e-12 * size.max(1, keepdims=True)) + 1e-300)[:, None]
        new = np.clip(at - np.linalg.solve(a, np.where(held, 0.0, gl)[..., None])[..., 0], low, high)
        model, j = turned_gaussian(new, offsets)
        cost = ((model - values[live]) ** 2).sum(1)
        better = cost < value[live]
        moved = np.abs(new - at).max(1) <= tolerance * (1 + np.abs(at).max(1))
        done = moved | (better & (value[live] - cost <= tolerance * value[live])) | (damp[live] > 1e12)
        kept = live[better]
        t = j[better].transpose(0, 2, 1)
        p[kept], value[kept] = new[better], cost[better]
        g[kept], h[kept] = (t @ (model[better] - values[kept])[..., None])[..., 0], t @ j[better]
        damp[live] = np.where(better, np.maximum(damp[live] / 5, 1e-14), damp[live] * 5)
        live = live[~done]
    return p, value


def fit_gaussians(atoms: DataFrame, cells: DataFrame, half: int = 3, start: dict[str, float] | None = None, fixed: tuple[str, ...] = (), low: dict[str, float] | None = None, high: dict[str, float] | None = None) -> DataFrame:
    """atom_id, the eleven parameters of ``GAUSSIAN``, and rss: turned Gaussians fitted to balls 2 ``half`` + 1 cells wide.

    ``atoms`` has atom_id and x, y, z in cells; cells within half that of the nearest one count, and x, y, z of the result are in
    cells as well (``low`` and ``high`` of x, y, z are relative to the atom's cell).  Without a ``start`` a fit begins
    at the atom, with the least value as floor, what the greatest is above it as height, and spreads of 1, 1.1 and 1.2
    squared halves, so that no axis is like another.  Cells that are absent, null or NaN count as 0.
    """
    from .shape import box_offsets

    offsets = box_offsets(2 * half + 1)
    where, n = np.array(offsets, float), len(offsets)
    given, least, most = dict(start or {}), dict(low or {}), dict(high or {})
    bound = lambda b, x, spread: np.array([b.get(k, spread if k.startswith("spread") else x) for k in GAUSSIAN], float)
    lows, highs, still = bound(least, -np.inf, 1e-6), bound(most, np.inf, np.inf), np.array([k in fixed for k in GAUSSIAN])

    def run(batches):
        for batch in batches:
            middle = np.column_stack([batch.column(a).to_numpy() for a in "ijk"]).astype(float).reshape(-1, 3)
            place = np.column_stack([batch.column(a).to_numpy() for a in "xyz"]).reshape(-1, 3) - middle
            out, rss = np.zeros((len(middle), 11)), np.zeros(len(middle))
            for some, values in _batches(batch, "box"):
                p = np.zeros((len(some), 11))
                p[:, 0], p[:, 2:5] = values.min(1), place[some]
                p[:, 1] = values.max(1) - p[:, 0]
                p[:, 5:8] = half * half * np.array([1.0, 1.1, 1.2]) / 2
                for k, v in given.items():
                    p[:, GAUSSIAN.index(k)] = v
                out[some], rss[some] = bounded_gaussians(values, where, p, still, lows, highs)
            out[:, 2:5] += middle
            yield pa.RecordBatch.from_pydict({"atom_id": batch.column("atom_id"), **dict(zip(GAUSSIAN, out.T.copy())), "rss": rss})

    at = atoms.select(F.col("atom_id").cast("long").alias("atom_id"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
    at = at.withColumns({i: F.round(a).cast("int") for i, a in zip("ijk", "xyz")})
    value = F.coalesce(F.nanvl(F.col("v").cast("double"), F.lit(0.0)), F.lit(0.0))
    items = F.array(*(F.struct(*(F.lit(x).alias(f"_{a}") for x, a in zip(o, "ijk"))) for o in offsets))
    wanted = at.select("atom_id", F.posexplode(items).alias("_n", "_o"), *"ijk").select("atom_id", "_n", *((F.col(a) + F.col(f"_o._{a}")).alias(a) for a in "ijk"))
    known = cells.select(*(F.col(a).cast("int").alias(a) for a in "ijk"), value.alias("v"))
    got = wanted.join(known, ["i", "j", "k"], "left").groupBy("atom_id").agg(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("_b"))
    boxes = at.join(got.select("atom_id", F.transform("_b", lambda x: x["v"]).alias("box")), "atom_id")
    return boxes.where(F.size("box") == n).mapInArrow(run, "atom_id long, " + ", ".join(f"{k} double" for k in GAUSSIAN) + ", rss double")
