"""Block matching and 3-D filtering of images, by strips of block rows.

Pixels become lines, and a line goes to each strip whose blocks or candidates it is in.  A task has the lines of one
strip, searches for its blocks' matches and gives what they add to pixels; sums over strips make the image.  So a task
holds a strip with its halo, never an image, and one large image is as many tasks as it has strips.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns whose distances are computed together.
COLUMNS = 256


@dataclass(frozen=True)
class Search:
    """Blocks of ``size`` squared; ``most`` matches, a power of two, within ``reach`` and under a mean squared difference."""

    size: int = 8
    reach: int = 50
    most: int = 16
    limit: float = 600 / 255**2
    step: int = 2
    beta: float = 0.2


#: The two stages: hard threshold, then Wiener on larger blocks.
HARD, WIENER = Search(), Search(size=16, limit=400 / 255**2, beta=0.5)


def haar(n: int) -> np.ndarray:
    """Orthonormal Haar matrix of a power of two."""
    if n == 1:
        return np.ones((1, 1))
    half = haar(n // 2)
    return np.vstack([np.kron(half, [1, 1]), np.kron(np.eye(n // 2), [1, -1])]) / np.sqrt(2)


def _dct(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def _fitted(search: Search, rows: int, cols: int) -> Search:
    size = min(search.size, rows, cols)
    return Search(size, search.reach, search.most, search.limit, min(search.step, size), search.beta)


class _Row:
    """Distances of the blocks of one row to those around them, a range of columns at a time."""

    def __init__(self, lines: np.ndarray, row: int, low: int, high: int, search: Search):
        """``lines`` of a strip; blocks at ``row`` meet those at rows ``low`` to ``high`` (excluded), all within the strip."""
        self.lines, self.row, self.low, self.search = lines, row, low, search
        self.width = lines.shape[1] - search.size + 1
        self.side, self.count = min(search.reach, self.width - 1), high - low
        self.first = self.last = 0

    def _compute(self, c: int) -> None:
        n, side = self.search.size, self.side
        self.first, self.last = c, min(self.width, c + COLUMNS)
        own = self.lines[self.row : self.row + n, self.first : self.last + n - 1]
        ends = self.first - side, self.last + n - 1 + side
        pad = max(0, -ends[0]), max(0, ends[1] - self.lines.shape[1])
        near = np.pad(self.lines[self.low : self.low + self.count + n - 1, max(0, ends[0]) : ends[1]], ((0, 0), pad), constant_values=np.inf)
        self.found = np.empty((self.count, 2 * side + 1, self.last - self.first))
        for k in range(self.count):
            shifted = np.lib.stride_tricks.sliding_window_view(near[k : k + n], own.shape[1], axis=1)
            d = ((shifted - own[:, None]) ** 2).sum(axis=0)
            self.found[k] = sum(d[:, m : m + self.last - self.first] for m in range(n))

    def matches(self, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and columns of the block itself and the nearest others under the limit, by distance, then row, then
        column, and their distances; as many as the greatest power of two allows."""
        if not self.first <= c < self.last:
            self._compute(c)
        dist, wide = self.found[:, :, c - self.first].ravel(), 2 * self.side + 1
        own, s = (self.row - self.low) * wide + self.side, self.search
        ids = np.flatnonzero(dist < s.limit * s.size**2)
        ids = ids[ids != own]
        if len(ids) > s.most:
            ids = ids[dist[ids] <= np.partition(dist[ids], s.most - 1)[s.most - 1]]
        ids = np.concatenate([[own], ids[np.argsort(dist[ids], kind="stable")]])[: s.most]
        ids = ids[: 1 << (len(ids).bit_length() - 1)]
        return self.low + ids // wide, c - self.side + ids % wide, dist[ids]


def _block_rows(rows: int, step: int, first: int, last: int) -> list[int]:
    """Rows of reference blocks in a strip: every ``step``-th, and the last possible one."""
    return [r for r in range(first, min(last, rows)) if r % step == 0 or r == rows - 1]


def _strips(df: DataFrame, rows: int, search: Search, height: int, columns: list[str]) -> DataFrame:
    """view, strip, r and each line's c and ``columns`` as arrays; a line goes to all strips that need it."""
    line = df.groupBy("view", "r").agg(F.collect_list(F.struct("c", *columns)).alias("_l"))  # a line of the detector
    last = (rows - search.size) // height
    start = F.floor((F.col("r") - search.reach - search.size + 1) / height)
    stop = F.floor((F.col("r") + search.reach) / height)
    strips = F.sequence(F.greatest(F.lit(0), F.least(F.lit(last), start)), F.greatest(F.lit(0), F.least(F.lit(last), stop)))
    return line.select("view", F.explode(strips.cast("array<int>")).alias("strip"), F.col("r").cast("int").alias("r"), *(F.col(f"_l.{c}").alias(c) for c in ("c", *columns)))


def _dense(got: pa.Table, columns: list[str], top: int, cols: int, rows: int, height: int) -> list[np.ndarray]:
    line = np.repeat(got.column("r").to_numpy(), np.diff(got.column("c").combine_chunks().offsets.to_numpy()))
    at = line - top, got.column("c").combine_chunks().flatten().to_numpy()
    out = []
    for c in columns:
        a = np.zeros((min(height, rows - top), cols))
        a[at] = got.column(c).combine_chunks().flatten().to_numpy()
        out.append(a)
    return out


def matches(df: DataFrame, rows: int, cols: int, search: Search = HARD, height: int = 64) -> DataFrame:
    """view, r, c, rank, mr, mc, d: the matches of each view's reference blocks (first pixel r, c), rank 0 the block
    itself, with the sum of squared differences.  Absent pixels are 0; images are ``rows`` by ``cols``."""
    s = _fitted(search, rows, cols)

    def run(key, got):
        strip = key[1].as_py()
        first, last, tall = strip * height, (strip + 1) * height, rows - s.size + 1
        top = max(0, first - s.reach)
        (lines,) = _dense(got, ["v"], top, cols, rows, height + 2 * s.reach + s.size)
        out = [[] for _ in range(6)]
        for r in _block_rows(tall, s.step, first, last):
            row = _Row(lines, r - top, max(0, r - s.reach) - top, min(tall, r + s.reach + 1) - top, s)
            for c in _block_rows(cols - s.size + 1, s.step, 0, cols):
                mr, mc, d = row.matches(c)
                for k, v in enumerate((np.full(len(d), r), np.full(len(d), c), np.arange(len(d)), mr + top, mc, d)):
                    out[k].append(v)
        whole = [np.concatenate(v) if v else np.zeros(0) for v in out]
        names = ("r", "c", "rank", "mr", "mc")
        return pa.table({"view": pa.array(np.full(len(whole[0]), key[0].as_py()), pa.int32()), **{n: pa.array(v.astype(np.int32)) for n, v in zip(names, whole)}, "d": pa.array(whole[5].astype(float))})

    px = df.select(F.col("view").cast("int").alias("view"), "r", "c", F.col("v").cast("double").alias("v"))
    return _strips(px, rows, s, height, ["v"]).groupBy("view", "strip").applyInArrow(run, "view int, r int, c int, rank int, mr int, mc int, d double")


def _filtered(noisy: np.ndarray, clean: np.ndarray | None, sigma: float, d: np.ndarray) -> tuple[np.ndarray, float, int]:
    """A group of blocks filtered, its weight, and the coefficients that were left."""
    h, n = haar(len(noisy)), len(noisy)
    to = lambda blocks: np.tensordot(h, d @ blocks @ d.T, axes=(1, 0))
    group = to(noisy)
    if clean is None:
        keep = np.abs(group) >= 3.4 * sigma
        if n >= 4:
            keep[0, 0, 0] = True
        left = int(keep.sum()) + (n < 4)
        group, weight = group * keep, 1 / left
    else:
        power = to(clean) ** 2
        shrink = np.divide(power, power + sigma * sigma, out=np.ones_like(power), where=power + sigma * sigma > 0)
        group, weight, left = group * shrink, 1 / max(1e-12, (shrink**2).sum()), group.size
    return np.clip(d.T @ np.tensordot(h.T, group, axes=(1, 0)) @ d, 0, 1), weight, left


def stage(df: DataFrame, rows: int, cols: int, search: Search, pilot: bool = False, height: int = 64, skip: int = 8) -> DataFrame:
    """view, sigma, r, c, v and ``noisy``: one stage for images in 0..1, whose ``sigma`` is a column.

    ``df`` has view, r, c, noisy, sigma, and with ``pilot`` the first stage's v, on which blocks are matched and whose
    power the Wiener filter takes.  Without it, after a block with fewer than ``skip`` coefficients left, the search goes
    on a block further in its row.
    """
    s = _fitted(search, rows, cols)
    columns = ["noisy", "v"] if pilot else ["noisy"]

    def run(key, got):
        strip, sigma = key[1].as_py(), got.column("sigma")[0].as_py()
        first, last, tall, wide = strip * height, (strip + 1) * height, rows - s.size + 1, cols - s.size + 1
        top = max(0, first - s.reach)
        noisy, *more = _dense(got, columns, top, cols, rows, height + 2 * s.reach + s.size)
        guide = more[0] if pilot else noisy
        cut = [np.lib.stride_tricks.sliding_window_view(a, (s.size, s.size)) for a in (noisy, guide)]
        d, taper = _dct(s.size), np.outer(np.kaiser(s.size, s.beta), np.kaiser(s.size, s.beta))
        num, den = np.zeros(noisy.shape), np.zeros(noisy.shape)
        for r in _block_rows(tall, s.step, first, last):
            row, c = _Row(guide, r - top, max(0, r - s.reach) - top, min(tall, r + s.reach + 1) - top, s), 0
            while c < wide:
                mr, mc, _ = row.matches(c)
                blocks, weight, left = _filtered(cut[0][mr, mc], cut[1][mr, mc] if pilot else None, sigma, d)
                for a, b, block in zip(mr.tolist(), mc.tolist(), blocks):
                    num[a : a + s.size, b : b + s.size] += weight * taper * block
                    den[a : a + s.size, b : b + s.size] += weight * taper
                ahead = s.size - 1 if not pilot and left < skip else s.step
                c = wide - 1 if c < wide - 1 < c + ahead else c + max(1, ahead)
        a, b = np.nonzero(den)
        return pa.table({"view": pa.array(np.full(len(a), key[0].as_py()), pa.int32()), "r": pa.array((a + top).astype(np.int32)), "c": pa.array(b.astype(np.int32)), "num": num[a, b], "den": den[a, b]})

    sigmas = df.groupBy("view").agg(F.first("sigma").alias("sigma"))
    sent = _strips(df.select("view", "r", "c", *columns), rows, s, height, columns).join(F.broadcast(sigmas), "view")  # a row for each view
    parts = sent.groupBy("view", "strip").applyInArrow(run, "view int, r int, c int, num double, den double")
    value = parts.groupBy("view", "r", "c").agg((F.sum("num") / F.sum("den")).alias("v"))
    return value.join(df.select("view", "r", "c", "noisy", "sigma"), ["view", "r", "c"])


def denoise(df: DataFrame, sigma: float | DataFrame, rows: int, cols: int, hard: Search = HARD, wiener: Search = WIENER, height: int = 64) -> DataFrame:
    """``df`` (view, r, c, v in 0..1) after both stages; ``sigma`` is a number or a row (view, sigma) for each view.

    Images are whole, ``rows`` by ``cols``.  A noise over 40 / 255 is outside the profile and refused.
    """
    from .iterate import cut

    px = df.select(F.col("view").cast("int").alias("view"), "r", "c", F.col("v").cast("double").alias("noisy"))
    if isinstance(sigma, DataFrame):
        px = px.join(F.broadcast(sigma.select(F.col("view").cast("int").alias("view"), F.col("sigma").cast("double").alias("sigma"))), "view")
        most = sigma.agg(F.max("sigma")).first()[0] or 0.0
    else:
        px, most = px.withColumn("sigma", F.lit(float(sigma))), sigma
    if most * 255 > 40:
        raise ValueError("noise over 40 / 255 is outside the profile")
    first = cut(stage(px, rows, cols, hard, height=height), df.sparkSession)
    return stage(first, rows, cols, wiener, pilot=True, height=height).select("view", "r", "c", "v")
