"""Operators against closed forms and sequential loops."""

import math
import struct
import zlib

import numpy as np
import plain_tomography
import pytest
from pyspark.sql import functions as F

from voxlake.functions import scalar
from voxlake.operators import aggregate, balls, blocks, cluster, fill, fits, images, lines, masks, matching, morphology, neighbours, project, registration, select, shape, stabilise, tomography, voronoi
from voxlake.plans import pipelines, steps
from voxlake.sources import files


def atoms_frame(spark, points, species=None, values=None):
    rows = [(i, *map(float, p), int(species[i]) if species is not None else 0, float(values[i]) if values is not None else 0.0) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "atom_id long, x double, y double, z double, species int, v double")


def fcc(n=4, a=3.5239):
    base = np.array([(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)])
    return np.array([(np.array(c) + b) * a for c in np.ndindex(n, n, n) for b in base])


def test_fcc_neighbours_and_bond_order(spark):
    points = fcc()
    df = atoms_frame(spark, points)
    inside = [i for i, p in enumerate(points) if (p > 3.6).all() and (p < points.max() - 3.6).all()]
    n = {r.atom_id: r.n for r in neighbours.neighbour_count(df, 3.0).collect()}
    assert inside and all(n[i] == 12 for i in inside)
    q = {r.atom_id: r for r in neighbours.bond_order(df, 3.0, periodic=False).collect()}
    core = min(inside, key=lambda i: ((points[i] - points.mean(0)) ** 2).sum())
    own = images.np.linalg.norm(points - points[core], axis=1)
    assert all(n[j] == 12 for j in np.flatnonzero(own < 3.0))
    assert q[core].q4 == pytest.approx(0.190941, abs=1e-5) and q[core].q6 == pytest.approx(0.574524, abs=1e-5)
    alpha = neighbours.short_range_order(df, 3.0).collect()
    assert len(alpha) == 1 and alpha[0].alpha == pytest.approx(0)


def shuffled(spark, run) -> float:
    """MB that ``run`` writes for shuffles."""

    def so_far():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite() / 1e6

    before = so_far()
    run()
    return so_far() - before


def test_bond_order_in_a_crowd(spark):
    """Bonds grow with the square of the atoms, what is shuffled doesn't."""
    rng = np.random.default_rng(6)
    few, many = (atoms_frame(spark, rng.normal(0, 0.5, (n, 3))) for n in (800, 2400))
    took = [shuffled(spark, lambda df=df: neighbours.bond_order(df, 1.0, periodic=False).collect()) for df in (few, many)]
    assert took[1] < 4.5 * took[0]


@pytest.mark.parametrize("periodic", [False, True])
def test_bond_order_is_the_addition_theorem(spark, periodic):
    points = np.random.default_rng(7).uniform(0, 3, (40, 3))
    points[3] = points[2]
    width = np.ptp(points, axis=0) * periodic
    images = np.array([o for o in np.ndindex(3, 3, 3) if periodic or o == (1, 1, 1)]) - 1
    bonds, hoods = [], []
    for p in points:
        d = points[None] + images[:, None] * width - p
        r = np.sqrt((d**2).sum(-1))
        near = (r > 0) & (r < 1.1)
        bonds.append(d[near] / r[near][:, None])
        hoods.append(np.nonzero(near)[1].tolist())
    got = {r.atom_id: r for r in neighbours.bond_order(atoms_frame(spark, points), 1.1, periodic=periodic).collect()}
    assert len(got) == 40
    for a, hood in enumerate(hoods):
        hood = [b for b in (a, *hood) if len(bonds[b])]
        u = np.vstack([bonds[b] for b in hood] or [np.zeros((0, 3))])
        f = np.concatenate([np.full(len(bonds[b]), 1 / len(bonds[b]) / (len(hoods[a]) + 1)) for b in hood] or [np.zeros(0)])
        for l in (4, 6):
            q = f @ np.polynomial.legendre.legval(u @ u.T, [0] * l + [1]) @ f
            assert got[a][f"q{l}"] == pytest.approx(math.sqrt(max(q, 0)), abs=1e-6)


def test_voronoi_of_a_cubic_lattice():
    near = np.array([p for p in np.ndindex(3, 3, 3)], float) - 1
    near = near[(near**2).sum(1) > 0] + 0.0
    assert voronoi.face_sides(near) == [4] * 6


def test_voronoi_cells_are_cut_by_all_that_bound_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    tight = rng.normal(0, 1e-3, (60, 3)) + [2.0, 0, 0]  # near copies: the nearest 40 lie on one side
    around = np.array([(6, 0, 0), (-4, 0, 0), (0, 4, 0), (0, -4, 0), (0, 0, 4), (0, 0, -4)]) + rng.normal(0, 0.1, (6, 3))
    points = np.vstack([[(0, 0, 0)], tight, around])
    # a corner of a cell is as near to its atom as to any other, checked without clipping
    for p in points[:3]:
        cell = voronoi.Cell(1e5).clip((d := points - p)[(d**2).sum(1) > 0])
        real = cell.corners[(cell.planes >= 6).all(axis=1)] + p
        gaps = np.sqrt(((real[:, None] - points[None]) ** 2).sum(2))
        assert len(real) and np.allclose(gaps.min(1), np.sqrt(((real - p) ** 2).sum(1)), rtol=1e-6)
    monkeypatch.setattr(voronoi, "FEW", 5)
    far = np.vstack([points, [(500.0, 500, 500)]])  # nothing within any small radius
    got = {r.atom_id: [r.n3, r.n4, r.n5, r.n6] for r in voronoi.voronoi_indices(atoms_frame(spark, far), 0.5).collect()}
    want = {k: [s.count(n) for n in (3, 4, 5, 6)] for k, s in enumerate(voronoi.face_sides(far - p) for p in far)}
    assert got == want and len(got) == len(far)


@pytest.mark.parametrize("kind", ["ball", "layer", "crystal", "cluster"])
def test_voronoi_goes_down_a_tree(spark, monkeypatch, kind):
    """Cells of a surface, of a tilted layer (all open), of ties and of a crowded block, by a tree of several levels."""
    rng = np.random.default_rng(3)
    if kind == "ball":
        points = rng.normal(size=(150, 3))
    elif kind == "layer":
        points = rng.uniform(0, 10, (60, 2)) @ np.array([[0.6, 0.64, 0.48], [0, 0.6, -0.8]]) + [1, 2, 3]
    elif kind == "crystal":
        points = fcc(2)
        points = np.vstack([points, points[:5]])  # atoms at one place
    else:
        points = np.vstack([rng.normal(0, 0.01, (60, 3)), rng.uniform(-5, 5, (40, 3))])
    for name, v in (("LEAF", 8), ("FAN", 4)):
        monkeypatch.setattr(voronoi.point_tree, name, v)
    monkeypatch.setattr(voronoi, "FEW", 5)
    monkeypatch.setattr(voronoi, "MOST", 40)
    got = {r.atom_id: [r.n3, r.n4, r.n5, r.n6] for r in voronoi.voronoi_indices(atoms_frame(spark, points)).collect()}
    size = voronoi.FAR * float(np.sqrt((np.ptp(points, axis=0) ** 2).sum()))
    want = {}
    for k, p in enumerate(points):
        d = points - p
        sides = voronoi.Cell(size).clip(d[(d**2).sum(1) > 0]).sides()
        want[k] = [sides.count(n) for n in (3, 4, 5, 6)]
    assert got == want


def test_voronoi_of_a_periodic_box(spark):
    points = np.random.default_rng(9).uniform(0, 4, (12, 3))
    got = {r.atom_id: [r.n3, r.n4, r.n5, r.n6] for r in voronoi.voronoi_indices(atoms_frame(spark, points), periodic=True).collect()}
    width = np.ptp(points, axis=0)
    images = np.vstack([points + (np.array(o) - 1) * width for o in np.ndindex(3, 3, 3)])  # an atom's own copy is exactly itself
    want = {k: [s.count(n) for n in (3, 4, 5, 6)] for k, s in enumerate(voronoi.face_sides(images - p) for p in points)}
    assert got == want


def test_point_tree_holds_every_place_once(spark, monkeypatch):
    monkeypatch.setattr(voronoi.point_tree, "LEAF", 8)
    monkeypatch.setattr(voronoi.point_tree, "FAN", 4)
    points = np.round(np.random.default_rng(4).normal(size=(500, 3)), 1)
    points[:200] = points[0]  # a crowded place
    found = voronoi.point_tree.levels(atoms_frame(spark, points))
    tables = [{r.node: r for r in t.collect()} for t in found]
    leaves = [np.reshape(r.inside, (-1, 3)) for r in tables[0].values()]
    assert sorted(map(tuple, np.vstack(leaves))) == sorted(set(map(tuple, points))) and max(map(len, leaves)) <= 8
    assert len(tables) > 2 and len(tables[-1]) <= 4
    for below, above in zip(tables, tables[1:]):
        assert sorted(k for r in above.values() for k in r.kids) == sorted(below)
        for r in above.values():
            assert len(r.kids) <= 4 and np.array_equal(r.inside, np.concatenate([[*below[k].box, *below[k].one] for k in r.kids]))
            assert np.allclose(r.box[:3], np.min([below[k].box[:3] for k in r.kids], 0)) and np.allclose(r.box[3:], np.max([below[k].box[3:] for k in r.kids], 0))
    assert voronoi.point_tree.levels(atoms_frame(spark, points[:0]))[0].count() == 0


def test_greedy_distance_is_the_sequential_loop(spark):
    rng = np.random.default_rng(3)
    points, values = rng.uniform(0, 4, (120, 3)), rng.permutation(120)
    kept = []
    for i in np.argsort(-values):
        if all(((points[i] - points[j]) ** 2).sum() >= 1 for j in kept):
            kept.append(i)
    got = {r.atom_id: r.flag for r in select.greedy_min_distance(atoms_frame(spark, points, values=values), 1.0).collect()}
    assert {i for i, f in got.items() if f == 0} == {int(i) for i in kept} and set(got.values()) == {0, -3}


@pytest.mark.parametrize("few", [20_000, 0])
def test_greedy_distance_in_a_crowd(spark, monkeypatch, few):
    monkeypatch.setattr(select, "FEW", few)
    rng = np.random.default_rng(4)
    points, values = rng.normal(0, 0.7, (2000, 3)), rng.integers(0, 50, 2000)
    points[100:200] = points[0]
    kept = []
    for i in np.lexsort([np.arange(2000), -values]):
        if all(((points[i] - points[j]) ** 2).sum() >= 1 for j in kept):
            kept.append(int(i))
    df, got = atoms_frame(spark, points, values=values), {}
    assert shuffled(spark, lambda: got.update({r.atom_id: r.flag for r in select.greedy_min_distance(df, 1.0).collect()})) < 4  # no pairs
    assert len(got) == 2000 and sorted(i for i, f in got.items() if f == 0) == sorted(kept)
    lost = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, None, 0.0, 0.0, 2.0), (2, float("nan"), 0.0, 0.0, 3.0), (3, 0.5, 0.0, 0.0, None)], "atom_id long, x double, y double, z double, v double")
    assert {r.atom_id: r.flag for r in select.greedy_min_distance(lost, 1.0).collect()} == {0: 0, 1: 0, 2: 0, 3: -3}


def test_atoms_at_one_place_and_outside(spark):
    df = atoms_frame(spark, [(1, 1, 1), (1, 1, 1), (4, 4, 4)], values=[2, 3, 1])
    assert {r.atom_id: r.flag for r in select.greedy_min_distance(df, 0.5).collect()} == {0: -3, 1: 0, 2: 0}
    cube = spark.createDataFrame([(i, j, k) for i in range(5) for j in range(5) for k in range(5)], "i int, j int, k int")
    far = atoms_frame(spark, [(3, 3, 3), (1, 1, 1), (100, 3, 3), (0, 3, 3)])
    assert {r.atom_id for r in neighbours.inside_eroded(far, cube, [(0, 0, 0), *select.FACES], (5, 5, 5)).collect()} == {0, 1}
    box = spark.createDataFrame([(0, 0, 0.0), (1, 0, 4.0), (2, 0, 10.0)], "atom_id long, off_id int, v double")
    got = {r.atom_id: r.label for r in cluster.local_reclassify(atoms_frame(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [0, 1, 0]), box, 2.0, 2).collect()}
    assert got[2] in (0, 1)


def test_rounding_is_exact(spark):
    x = [0.4999999999999, 0.49999999999999994, 0.5, 1e-13, -0.5, 2.5, -2.4999999999999996, 4503599627370497.5]
    r = spark.createDataFrame([(v,) for v in x], "x double").select(scalar.half_up(F.col("x")).alias("u")).collect()
    assert [v.u for v in r] == [0, 0, 1, 0, -1, 3, -2, 4503599627370498]


def test_periodic_pairs_and_matches(spark):
    df = atoms_frame(spark, [(0, 0, 0), (9.9, 0, 0), (10, 10, 10)])
    assert {(r.a, r.b) for r in neighbours.periodic_pairs(df, 0.5).collect()} >= {(0, 1), (1, 0)}
    assert [r.atom_id for r in neighbours.matched(df, df.where("atom_id = 1"), 1e-4).collect()] == [1]


def test_fft_conventions():
    rng = np.random.default_rng(19)
    for shape_ in ((5, 7), (6, 8), (5, 6, 7)):
        a = rng.normal(size=shape_)
        assert np.allclose(images.centred_ifft(images.centred_fft(a)).real, a, atol=1e-13)
    impulse = np.zeros((5, 6, 7))
    impulse[2, 3, 3] = 1
    assert np.allclose(images.centred_fft(impulse), 1)
    a, b = rng.normal(size=(7, 8)), rng.normal(size=(3, 4))
    direct = np.zeros((9, 11))
    for i, j in np.ndindex(3, 4):
        direct[i : i + 7, j : j + 8] += b[i, j] * a
    assert np.allclose(images.convolve_full(a, b), direct, atol=1e-13)
    for axes in ((2,), (0, 0)):
        with pytest.raises(ValueError):
            images.centred_fft(np.ones((2, 3)), axes)


def test_registration_and_resampling():
    y, x = np.mgrid[:64, :64]
    image = np.exp(-((y - 30) ** 2 + (x - 35) ** 2) / 30.0)
    ramp = 2.0 * y[:8, :8] + 3.0 * x[:8, :8]
    assert np.allclose(images.bicubic(ramp, np.array([2.25, 7.0]), np.array([3.5, 7.0])), [2 * 2.25 + 3 * 3.5, 35])
    assert np.allclose(images.spline_weights(8) @ np.arange(8.0) ** 3, ((np.arange(24) - 11.5) / 3 + 3.5) ** 3)
    assert np.abs(images.rotate(images.rotate(image, 20), -20) - image).max() < 0.05
    assert np.allclose(images.rotate(image, 90, 0.0), np.rot90(image))


def plain_stage(image, sigma, s, pilot=None):
    """A stage block after block over the whole image."""
    size = s.size
    guide = image if pilot is None else pilot
    rows, cols = (n - size + 1 for n in image.shape)
    k, x = np.indices((size, size))
    dct = np.where(k == 0, np.sqrt(0.5), 1) * np.cos(np.pi * (2 * x + 1) * k / (2 * size)) * np.sqrt(2 / size)
    num, den = np.zeros(image.shape), np.zeros(image.shape)
    taper = np.outer(np.kaiser(size, s.beta), np.kaiser(size, s.beta))
    cut = lambda a, r, c: a[r : r + size, c : c + size]
    for r in sorted({*range(0, rows, s.step), rows - 1}):
        c = 0
        while c < cols:
            near = [(a, b) for a in range(max(0, r - s.reach), min(rows, r + s.reach + 1)) for b in range(max(0, c - s.reach), min(cols, c + s.reach + 1)) if (a, b) != (r, c)]
            near = sorted((((cut(guide, *o) - cut(guide, r, c)) ** 2).sum(), *o) for o in near)
            at = ([(r, c)] + [o[1:] for o in near if o[0] < s.limit * size**2])[: s.most]
            at = at[: 2 ** int(np.log2(len(at)))]
            h = matching.haar(len(at))
            group = np.einsum("gk,kab->gab", h, [dct @ cut(image, *o) @ dct.T for o in at])
            ahead = s.step
            if pilot is None:
                keep = np.abs(group) >= 3.4 * sigma
                keep[0, 0, 0] |= len(at) >= 4
                left = keep.sum() + (len(at) < 4)
                group, weight = group * keep, 1 / left
                ahead = size - 1 if left < 8 else ahead
            else:
                power = np.einsum("gk,kab->gab", h, [dct @ cut(pilot, *o) @ dct.T for o in at]) ** 2
                group, weight = group * power / (power + sigma**2), 1 / ((power / (power + sigma**2)) ** 2).sum()
            for o, block in zip(at, np.einsum("gk,gab->kab", h, group)):
                cut(num, *o)[:] += weight * taper * np.clip(dct.T @ block @ dct, 0, 1)
                cut(den, *o)[:] += weight * taper
            c = cols - 1 if c < cols - 1 < c + ahead else c + ahead
    return num / den


def test_denoise_and_inverse(spark):
    rng = np.random.default_rng(1)
    clean = np.kron([[0.2, 0.8], [0.6, 0.4]], np.ones((16, 16)))
    noisy = clean + rng.normal(0, 0.05, (2, *clean.shape))
    first, second = matching.Search(step=4, reach=6), matching.Search(size=16, limit=400 / 255**2, beta=0.5, step=4, reach=6)
    sigma = spark.createDataFrame([(1, 0.05), (2, 0.04)], "view int, sigma double")
    got = matching.denoise(pixel_frame(spark, noisy), sigma, 32, 32, first, second, height=5).collect()
    for n, s in enumerate((0.05, 0.04)):
        out = np.zeros(clean.shape)
        for r in (r for r in got if r.view == n + 1):
            out[r.r, r.c] = r.v
        pilot = plain_stage(noisy[n], s, first)
        assert np.allclose(out, plain_stage(noisy[n], s, second, pilot), atol=1e-9)
        assert ((out - clean) ** 2).mean() < 0.3 * ((noisy[n] - clean) ** 2).mean()
    with pytest.raises(ValueError):
        matching.denoise(pixel_frame(spark, noisy), 0.5, 32, 32)
    draws = rng.poisson(20, 200_000) + rng.normal(0, 1.0, 200_000)
    assert images.inverse_vst(images.vst(draws, 1.0).mean(), 1.0) == pytest.approx(20, abs=0.1)
    assert np.allclose(matching.haar(8) @ matching.haar(8).T, np.eye(8))


def test_counts_are_denoised_by_view(spark):
    rng = np.random.default_rng(2)
    clean = 20 + 60 * np.kron([[0.2, 0.8], [0.6, 0.4]], np.ones((12, 12)))
    stack = np.stack([2.0 * rng.poisson(clean), np.full(clean.shape, 7.0)])  # a view without contrast
    stack[1, 0, 0] = 7.0
    rows = pipelines.denoised(pixel_frame(spark, stack), 2.0, 1.0, 24, 24)
    out = dense(rows.withColumn("view", F.col("view") - 1), ["view", "r", "c"], stack.shape)
    assert rows.count() == stack.size and (out[1] == 7).all()
    assert ((out[0] - 2 * clean) ** 2).mean() < 0.3 * ((stack[0] - 2 * clean) ** 2).mean()


def test_blocks_match_far_and_only_like_ones(spark):
    rng = np.random.default_rng(4)
    image = np.kron(rng.uniform(0.1, 0.9, (12, 17)), np.ones((6, 6)))[:70, :100]
    image[8:24, 70:86] = image[40:56, 20:36] = rng.uniform(0.1, 0.9, (16, 16))
    for s in (matching.HARD, matching.WIENER):
        size, found = s.size, {}
        for r in matching.matches(pixel_frame(spark, image[None]), 70, 100, s, height=20).collect():
            found.setdefault((r.r, r.c), []).append((r.rank, (r.mr, r.mc), r.d))
        blocks = np.lib.stride_tricks.sliding_window_view(image, (size, size))
        assert set(found) == {(r, c) for r, c in np.ndindex(blocks.shape[:2]) if (r % 2 == 0 or r == blocks.shape[0] - 1) and (c % 2 == 0 or c == blocks.shape[1] - 1)}
        for r, c in ((8, 70), (40, 20), (0, 0), (50, 80)):
            got = [x[1] for x in sorted(found[r, c])]
            want = sorted((((blocks[a, b] - blocks[r, c]) ** 2).sum(), (a, b) != (r, c), a, b) for a, b in np.ndindex(blocks.shape[:2]) if abs(a - r) <= 50 and abs(b - c) <= 50)
            want = [w[2:] for w in want if w[0] < s.limit * size * size][:16]
            assert got[0] == (r, c) and sorted(got) == sorted(want[: 1 << (len(want).bit_length() - 1)])
            if (r, c) == (8, 70):
                assert (40, 20) in got and all(((blocks[g] - blocks[r, c]) ** 2).mean() < s.limit for g in got)


def cell_frame(spark, volume):
    at = np.argwhere(~np.isnan(volume))
    return spark.createDataFrame([(*map(int, c), float(volume[tuple(c)])) for c in at], "i int, j int, k int, v double")


def plain_peak(volume, start, radius=3, rounds=14, quiet=7):
    """One peak after another, by numpy's own least squares."""
    offs = np.array([o for o in np.ndindex(*[2 * radius + 1] * 3)]) - radius
    offs = offs[(offs**2).sum(1) <= (radius + 0.5) ** 2]
    powers = [(a, b, c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b)]
    at, run = np.zeros(3), 0
    for n in range(rounds + 1):
        d = offs - at
        w = np.exp(-(d**2).sum(1) / radius**2)
        basis = np.stack([d[:, 0] ** a * d[:, 1] ** b * d[:, 2] ** c for a, b, c in powers], axis=1)
        coef = dict(zip(powers, np.linalg.lstsq(basis * w[:, None], volume[tuple((offs + start).T)] * w, rcond=None)[0]))
        g = np.array([coef[1, 0, 0], coef[0, 1, 0], coef[0, 0, 1]])
        h = np.array([[2 * coef[2, 0, 0], coef[1, 1, 0], coef[1, 0, 1]], [coef[1, 1, 0], 2 * coef[0, 2, 0], coef[0, 1, 1]], [coef[1, 0, 1], coef[0, 1, 1], 2 * coef[0, 0, 2]]])
        if np.linalg.det(h) >= 0:
            return start + at, -1
        step = np.clip(-np.linalg.inv(h) @ g, -0.5, 0.5)
        at = at + step
        if np.abs(at).max() > radius:
            return start + at, -2
        run = run + 1 if np.abs(step).max() < 0.5 else 0
        if run == quiet:
            return start + at, 0
    return start + at, -4


def test_peak_refinement(spark):
    rng = np.random.default_rng(3)
    at = np.array([6.3, 5.8, 6.1])
    grid = np.indices((13, 13, 13)).reshape(3, -1).T
    volume = np.exp(-((grid - at) ** 2).sum(1) / 18).reshape(13, 13, 13)
    starts = [(0, 6, 6, 6), (1, 1, 6, 6), (2, 5, 5, 7), (3, 9, 9, 9), (4, 3, 4, 9)]
    kind = "peak_id long, i int, j int, k int"
    for v, how in ((volume, None), (-volume, None), (rng.normal(size=volume.shape), None), (volume + rng.normal(0, 0.05, volume.shape), 0.0)):
        got = {r.peak_id: r for r in fits.refine_peaks(spark.createDataFrame(starts, kind), cell_frame(spark, v), ridge=how).collect()}
        assert len(got) == 5 and (got[1].flag, got[1].x) == (-2, 1.0)  # its ball leaves the volume
        for n, *start in starts[:1] + starts[2:]:
            want, flag = plain_peak(v, np.array(start))
            assert got[n].flag == flag and np.allclose([got[n].x, got[n].y, got[n].z], want, atol=1e-5)
    got = {r.peak_id: r for r in fits.refine_peaks(spark.createDataFrame(starts, kind), cell_frame(spark, volume)).collect()}
    assert got[0].flag == 0 and np.abs(np.array([got[0].x, got[0].y, got[0].z]) - at).max() < 0.02
    hole = volume.copy()
    hole[6, 6, 8] = np.nan
    assert fits.refine_peaks(spark.createDataFrame(starts[:1], kind), cell_frame(spark, hole)).first().flag == -2
    assert fits.refine_peaks(spark.createDataFrame([], kind), cell_frame(spark, volume)).collect() == []


def test_turned_gaussians_are_found(spark):
    rng = np.random.default_rng(8)
    grid = np.indices((20, 20, 20)).reshape(3, -1).T.astype(float)
    true = np.array([[0.2, 3.0, 9.7, 10.2, 9.9, 3.0, 6.0, 11.0, 30.0, 50.0, 20.0]])
    volume = fits.turned_gaussian(true, grid)[0].reshape(20, 20, 20)
    # the model is the column function's
    row = spark.createDataFrame([(11.0, 8.0, 9.0)], "x double, y double, z double")
    value = row.select(scalar.gauss3_turned(F.col("x"), F.col("y"), F.col("z"), 3.0, (3.0, 6.0, 11.0), (30.0, 50.0, 20.0), (9.7, 10.2, 9.9), 0.2)).first()[0]
    assert value == pytest.approx(volume[11, 8, 9])
    p, j = true + rng.normal(0, 0.1, (4, 11)), 1e-6
    for n in range(11):  # derivatives
        more = p.copy()
        more[:, n] += j
        assert np.allclose((fits.turned_gaussian(more, grid[::97])[0] - fits.turned_gaussian(p, grid[::97])[0]) / j, fits.turned_gaussian(p, grid[::97])[1][..., n], atol=1e-4)
    atoms = spark.createDataFrame([(1, 10.0, 10.0, 10.0), (2, 9.6, 10.4, 10.3), (3, 1.0, 1.0, 1.0)], "atom_id long, x double, y double, z double")
    cells = cell_frame(spark, volume)
    got = {r.atom_id: r for r in fits.fit_gaussians(atoms, cells, 4).collect()}
    assert set(got) == {1, 2, 3}
    for n in (1, 2):  # the axes' order and signs are free, the shape isn't
        q = np.array([[got[n][k] for k in fits.GAUSSIAN]])
        assert got[n].rss < 1e-12 and np.allclose(q[0, :5], true[0, :5], atol=1e-5) and np.allclose(sorted(q[0, 5:8]), [3, 6, 11], atol=1e-3)
        assert np.allclose(fits.turned_gaussian(q, grid)[0].reshape(volume.shape), volume, atol=1e-5)
    held = fits.fit_gaussians(atoms.where("atom_id = 1"), cells, 4, {"floor": 0.25}, ("floor",), {"height": 0.0}, {"height": 2.5}).first()
    assert held.floor == 0.25 and held.height == pytest.approx(2.5) and held.rss > 1e-3


def test_peaks_are_sought_in_the_whole_volume(spark):
    from voxlake.plans import catalog
    from voxlake.sources import adapters

    sf = "/root/testdata/sf0.001"
    v = np.zeros((14, 14, 14)) - 1
    for r in adapters.voxels(spark, sf).collect():
        v[r.i + 1, r.j + 1, r.k + 1] = r.v
    near = np.max([np.roll(v, s, a) for a in range(3) for s in (1, -1)], axis=0)
    want = {(i - 1) * 144 + (j - 1) * 12 + k - 1 for i, j, k in np.argwhere((v > 0) & (v >= near))}
    got = {r.peak_id: r.flag for r in catalog.QUERIES["peak_refine"](spark, sf).collect()}
    assert set(got) == want and all(f == -2 for p, f in got.items() if not all(3 <= x <= 8 for x in (p // 144, p // 12 % 12, p % 12)))
    # a slope that leads over the radius away; one that ends inside it, though beyond the first ball's middle
    slope = lambda x: spark.createDataFrame([(*map(int, c), float(-((np.array(c) - (x, 8, 8)) ** 2).sum())) for c in np.ndindex(16, 16, 16) if c[0] >= 2], "i int, j int, k int, v double")
    start = spark.createDataFrame([(1, 5, 8, 8)], "peak_id long, i int, j int, k int")
    assert fits.refine_peaks(start, slope(1.2)).first().flag == -2
    near = fits.refine_peaks(start, slope(3.9)).first()
    assert near.flag == 0 and near.x == pytest.approx(3.9, abs=0.05)


def test_rounding(spark):
    r = spark.createDataFrame([(x,) for x in (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5)], "x double").select("x", scalar.half_up(F.col("x")).alias("u"), scalar.half_away(F.col("x")).alias("a"), scalar.half_even(F.col("x")).alias("e")).orderBy("x").collect()
    assert [x.u for x in r] == [-3, -2, -1, 1, 2, 3] == [x.a for x in r] and [x.e for x in r] == [-2, -2, 0, 0, 2, 2]


def test_components_and_constant_otsu(spark):
    blobs = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 5, 5)], "view int, r int, c int")
    assert morphology.components(blobs, ["r", "c"]).select("comp").distinct().count() == 2
    assert morphology.components(blobs, ["r", "c"], full=False).select("comp").distinct().count() == 3
    assert morphology.largest_component(blobs, ["r", "c"]).count() == 2
    assert aggregate.otsu(spark.createDataFrame([(5.0,)] * 4, "v double")).collect() == [(None,)]


def test_gather_is_exact_on_a_ramp(spark):
    cells = shape.grid(spark, {a: (0, 4) for a in "ijk"}).withColumn("v", F.expr("1.0D * i + 2 * j + 3 * k"))
    pts = spark.createDataFrame([(0, 0.5, 1.25, 2.0), (1, 4.0, 4.0, 4.0), (2, 4.1, 0.0, 0.0), (3, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: r.v for r in project.gather(pts, cells, {a: (i, 5) for a, i in zip("xyz", "ijk")}).collect()}
    assert got == {0: pytest.approx(9.0), 1: pytest.approx(24.0), 2: 0.0, 3: 0.0}


def test_boundaries_and_seeded_kmeans(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, 40) for m in (0, 5, 9)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    a, b = cluster.refine_boundaries(df, "x", 3)
    assert 1 < a < 4.5 or a < 1.5
    assert [r["n"] for r in cluster.classify_by_boundaries(df, "x", [a, b]).groupBy("label").agg(F.count("*").alias("n")).collect()] == [40] * 3
    assert cluster.seeded_kmeans(df, "x", 3)[0].select("label").distinct().count() >= 2


def test_medians_are_exact(spark):
    """Ties, a value that a third of all rows share, classes of even and odd size, and classes that stay empty."""
    rng = np.random.default_rng(6)
    values = np.concatenate([np.full(70, 2.5), np.round(rng.exponential(3, 101), 1), rng.normal(40, 1, 30)])
    rows = [(i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, float("nan"))], "id long, x double")
    for start in (None, [0.0, 0.0, 41.0, 500.0]):
        centres = start or np.linspace(values.min(), values.max(), 4).tolist()
        while True:
            label = np.abs(values[:, None] - np.array(centres)).argmin(1)
            new = [float(np.median(values[label == i])) if (label == i).any() else c for i, c in enumerate(centres)]
            if new == centres:
                break
            centres = new
        got, found = cluster.kmedians(df, "x", 4, start=start)
        assert np.allclose(found, centres, rtol=1e-15)
        assert {r.id: r.label for r in got.where("id >= 0").collect()} == dict(enumerate(label.tolist()))
    none, found = cluster.kmedians(df.where("id = -1"), "x", 3)
    assert found == [] and [r.label for r in none.collect()] == [None]


def test_boundaries_of_many_skewed_values(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 0.3, 1700) for m in (0, 2, 4)] + [[1e4]])  # an outlier 10,000 wide
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    v = np.sort(x)
    s, q = (np.concatenate([[0.0], np.cumsum(y)]) for y in (v, v * v))
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    for k in (3, 4):
        cuts, before = np.linspace(0, len(v), k + 1).astype(int), None
        while before is None or (cuts != before).any():
            before = cuts.copy()
            for j in range(1, k):
                inside = np.arange(cuts[j - 1] + 1, cuts[j + 1])
                cuts[j] = inside[np.argmin(cost(cuts[j - 1], inside) + cost(inside, cuts[j + 1]))]
        want = [v[c - 1] for c in cuts[1:-1]]
        assert cluster.refine_boundaries(df, "x", k) == want == cluster.refine_boundaries(df, "x", k, most=10_000)
    assert 0 < want[0] < 2 < want[1] < 4 < want[2] < 6


def test_local_classes_settle(spark):
    rng = np.random.default_rng(5)
    points, labels, boxes = rng.uniform(0, 6, (150, 3)), rng.integers(0, 3, 150), rng.normal(size=(150, 2))
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    near = (near < 1.8) & (near > 0)  # not the atom itself
    now, seen, counts = labels, {labels.tobytes()}, []
    while True:  # one atom after another
        far = np.full((150, 3), -1.0)
        for i, k in np.ndindex(150, 3):
            if (m := near[i] & (now == k)).any():
                far[i, k] = np.round(np.sqrt(((boxes[i] - boxes[m].mean(0)) ** 2).sum()), 9)
        new = far.argmin(1)
        counts.append(int((new != now).sum()))
        now = new
        if not counts[-1] or now.tobytes() in seen or len(counts) > 5 and len(set(counts[-5:])) == 1:
            break
        seen.add(now.tobytes())
    box = spark.createDataFrame([(i, o, float(boxes[i, o])) for i, o in np.ndindex(150, 2)], "atom_id long, off_id int, v double")
    got = {r.atom_id: r.label for r in cluster.local_reclassify(atoms_frame(spark, points, labels), box, 1.8, 3).collect()}
    assert len(counts) > 5 and [got[i] for i in range(150)] == now.tolist()


@pytest.mark.parametrize("few, long", [(16_384, 4096), (40, 30), (0, 0)])
def test_local_classes_of_odd_boxes(spark, monkeypatch, few, long):
    monkeypatch.setattr(cluster, "FEW", few), monkeypatch.setattr(cluster, "LONG", long)
    rng = np.random.default_rng(8)
    points, labels = rng.uniform(0, 3, (90, 3)).tolist(), rng.integers(0, 3, 90).tolist()
    points[5], points[7], points[8] = points[4], (None, 1.0, 1.0), (float("nan"), 1.0, 1.0)
    labels[11], labels[12] = None, 9  # in no class at first
    v = {(i, o): float(x) for (i, o), x in np.ndenumerate(rng.normal(size=(90, 2)))}
    v |= {(20, 0): float("nan"), (21, 1): float("inf"), (22, 1): float("-inf"), (23, 0): None, (24, 0): None, (24, 1): None}
    del v[25, 0], v[26, 0], v[26, 1]
    df = spark.createDataFrame([(i, *p, k) for i, (p, k) in enumerate(zip(points, labels))], "atom_id long, x double, y double, z double, species int")
    box = spark.createDataFrame([(*k, x) for k, x in v.items()], "atom_id long, off_id int, v double")
    at = np.array([[np.nan if x is None else x for x in p] for p in points])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    near, now, counts, seen = (d < 0.9) & (d > 0), list(labels), [], {tuple(labels)}

    def distance(i, k):
        total = [(v[i, o] - np.mean(m)) ** 2 for o in (0, 1) if v.get((i, o)) is not None and (m := [v[j, o] for j in np.flatnonzero(near[i]) if now[j] == k and v.get((j, o)) is not None])]
        d = round(float(np.sqrt(sum(total))), 9) if total else None
        return (d is not None, np.isnan(d or 0), d, k)

    with np.errstate(invalid="ignore"):
        while True:
            new = [min(distance(i, k) for k in range(3))[-1] for i in range(90)]
            counts.append(sum(a != b for a, b in zip(new, now) if b is not None))
            now = new
            if not counts[-1] or tuple(now) in seen or len(counts) > 5 and len(set(counts[-5:])) == 1:
                break
            seen.add(tuple(now))
    assert {r.atom_id: r.label for r in cluster.local_reclassify(df, box, 0.9, 3).collect()} == dict(enumerate(now))


def test_atoms_out_of_reach_of_changes_keep_their_class():
    rng = np.random.default_rng(31)
    n, limit = 4000, balls.limit_of(1.5)
    at, boxes = rng.normal(0, 0.8, (n, 3)), rng.normal(0, 0.1, (n, 4))
    at[7] = at[8]
    order = balls.by_place(at)
    assert sorted(order.tolist()) == list(range(n))
    at, now = at[order], np.argmax(boxes[:, :3], 1).astype(float)
    marks = np.column_stack([np.ones(n), boxes])
    d = ((at[:, None] - at[None]) ** 2).sum(2)
    near = (d > 0) & (d < 2.25)
    sums = np.zeros((n, 15))
    balls.add_near(at, sums, at, cluster._of_box(np.column_stack([marks, now, np.full(n, np.nan)]), 3), limit)
    assert np.allclose(sums, np.hstack([near @ (marks * (now == k)[:, None]) for k in range(3)]), atol=1e-9)
    best = cluster._nearest_box(sums, marks, 3, 4, 1).astype(float)
    some = rng.permutation(n)[:12]
    some = some[balls.by_place(at[some])]
    many = balls.at_most_near(at, at[some], limit)
    assert (many >= near[:, some].sum(1)).all()
    settled = cluster._settled(sums, marks, best, 3, 4, many, float(np.sqrt((boxes[some] ** 2).sum(1).max())))
    balls.add_near(at, sums, at[some], cluster._of_box(np.column_stack([marks[some], (now[some] + 1) % 3, now[some]]), 3), limit)
    assert 0.3 < settled.mean() < 1 and (cluster._nearest_box(sums, marks, 3, 4, 1) == best)[settled].all()


def test_local_classes_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LONG", 60)
    rng = np.random.default_rng(33)
    n = 500
    points, boxes, now = rng.normal(0, 0.6, (n, 3)), rng.normal(0, 0.2, (n, 3)), rng.integers(0, 3, n)
    points[:20] = points[20:40]  # pairs at one place
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    near, seen, counts = (d > 0) & (d < 2.25), {now.tobytes()}, []
    box = spark.createDataFrame([(i, o, float(x)) for (i, o), x in np.ndenumerate(boxes)], "atom_id long, off_id int, v double")
    df = atoms_frame(spark, points, now.tolist())
    while True:
        means = [(near[:, now == k] @ boxes[now == k]) / near[:, now == k].sum(1)[:, None] for k in range(3)]
        new = np.round(np.sqrt(np.array([((boxes - m) ** 2).sum(1) for m in means])), 9).argmin(0)
        counts.append(int((new != now).sum()))
        now = new
        if not counts[-1] or now.tobytes() in seen or len(counts) > 5 and len(set(counts[-5:])) == 1:
            break
        seen.add(now.tobytes())
    assert {r.atom_id: r.label for r in cluster.local_reclassify(df, box, 1.5, 3).collect()} == dict(enumerate(now.tolist()))


def test_a_round_of_local_classes_is_one_job(spark):
    rng = np.random.default_rng(12)
    df = atoms_frame(spark, rng.normal(0, 1.2, (400, 3)), rng.integers(0, 3, 400).tolist())
    box = spark.createDataFrame([(i, o, float(x)) for (i, o), x in np.ndenumerate(rng.normal(size=(400, 4)))], "atom_id long, off_id int, v double")
    spark.sparkContext.setJobGroup("classes", "classes")
    try:
        cluster.local_reclassify(df, box, 1.5, 3).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("classes")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_bounded_least_squares():
    t = np.linspace(0, 1, 20)
    y = 2 * np.exp(-3 * t)

    def of(model, slopes, low, high):
        def stats(p):
            assert ((p > low) & (p < high) | (np.equal(low, high) & (p == low))).all()  # never at a bound
            r, j = model(p), slopes(p)
            return r @ r, j.T @ r, j.T @ j

        return stats

    def decay(low, high):
        return of(lambda p: p[0] * np.exp(-p[1] * t) - y, lambda p: np.stack([np.exp(-p[1] * t), -p[0] * t * np.exp(-p[1] * t)], axis=1), low, high)

    solve = lambda low, high, start=(1, 1): project.bounded_least_squares(decay(low, high), start, low, high)
    assert np.allclose(solve([0, 0], [5, 5])[0], [2, 3], atol=1e-7)
    assert np.allclose(solve([-np.inf, -np.inf], [np.inf, np.inf])[0], [2, 3], atol=1e-7)
    p, value = solve([0, 0], [5, 2])
    best = lambda b: min((float(((a * np.exp(-b * t) - y) ** 2).sum()), a) for a in [(y * np.exp(-b * t)).sum() / np.exp(-2 * b * t).sum()])
    assert p[1] == pytest.approx(2, abs=1e-6) and p[0] == pytest.approx(best(2)[1], abs=1e-5) and value == pytest.approx(best(2)[0], abs=1e-6)
    p, _ = solve([1.5, 0], [1.5, 5])  # held
    assert p[0] == 1.5 and np.allclose(p[1], min(np.linspace(1, 4, 300_001), key=lambda b: float(((1.5 * np.exp(-b * t) - y) ** 2).sum())), atol=1e-4)
    assert solve([1, 1], [1, 1])[0].tolist() == [1, 1]
    # a bent valley, free and cut off by a bound that the way there meets
    valley = lambda p: np.array([10 * (p[1] - p[0] ** 2), 1 - p[0]])
    slopes = lambda p: np.array([[-20 * p[0], 10.0], [-1.0, 0.0]])
    run = lambda low, high: project.bounded_least_squares(of(valley, slopes, low, high), [-1.2, 1.0], low, high)[0]
    assert np.allclose(run([-5, -5], [5, 5]), [1, 1], atol=1e-6)
    near = min(np.linspace(-1, 0.5, 150_001), key=lambda x: float((valley([x, 0.1]) ** 2).sum() if x * x > 0.1 else (valley([x, x * x]) ** 2).sum()))
    p = project.bounded_least_squares(of(valley, slopes, [-5, -5], [5, 0.1]), [0.0, 0.0], [-5, -5], [5, 0.1])[0]
    assert np.allclose(p, [near, 0.1], atol=1e-3)


def test_reconstruction_error_falls():
    volume = np.zeros((16, 16, 16))
    volume[5:10, 6:11, 7:12] = 1
    degrees = list(range(-70, 71, 10))
    _, errors = plain_tomography.reconstruct(np.array([plain_tomography.turned(volume, d).sum(axis=2) for d in degrees]), degrees, 10)
    assert errors[-1] < 0.5 * errors[0]


def test_reconstruction_of_views_with_three_angles():
    rng = np.random.default_rng(6)
    n, grid = 16, np.indices((16, 16, 16)).reshape(3, -1).T - 8.0
    blob = lambda at: np.exp(-((grid - at) ** 2).sum(1) / 4).reshape(n, n, n)
    at, degrees = np.array([2.0, -1, 3]), rng.uniform(-60, 60, (24, 3))
    turns = [tomography.view_rotation(*a) for a in degrees]
    # a blob's projection is a blob where the view puts it
    r, c = np.indices((n, n)) - 8.0
    views = np.array([np.sqrt(4 * np.pi) * np.exp(-((r - (q := t @ at)[0]) ** 2 + (c - q[1]) ** 2) / 4) for t in turns])
    assert np.abs(plain_tomography.fourier_views(blob(at), turns, 4) - views).max() < 0.05 * views.max()
    assert np.allclose(tomography.view_rotation(0, 30, 0) @ [1, 0, 2], [np.cos(np.pi / 6) - 2 * 0.5, 0, 0.5 + 2 * np.cos(np.pi / 6)])
    volume, errors = plain_tomography.reconstruct(views, degrees)
    assert len(errors) == 200 and errors[-1] < 0.1 and np.corrcoef(volume.ravel(), blob(at).ravel())[0, 1] > 0.95
    for wrong in (degrees[:, :2], degrees[:5], np.zeros((24, 4))):
        with pytest.raises(ValueError):
            plain_tomography.reconstruct(views, wrong, 1)


def test_refinement_lowers_the_error(spark):
    from voxlake.sources import adapters

    angles = adapters.angles(spark)
    points = np.array([(0, 0, 0), (5, 5, 1), (-5, 4, 2.0)])
    truth = atoms_frame(spark, points).select("atom_id", "x", "y", "z", "species")
    h, b = {0: 1.0}, {0: 0.5}
    measured = project.combined(project.splat(project.view_positions(truth, angles), h, b, 32)).cache()
    start = truth.withColumn("x", F.col("x") + 0.3)
    _, errors = pipelines.refine(start, measured, angles, 32, h, b, rounds=3, step=0.08)
    assert errors[-1] < errors[0]


def test_array_files(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    got = files.read_arrays(spark, f"file://{tmp_path}/a.npy", ["view", "r", "c"]).collect()
    assert {(r.view, r.r, r.c): r.v for r in got} == {k: float(v) for k, v in np.ndenumerate(a)}

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    matrix = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 2, 3)) + element(1, b"m") + element(9, np.arange(6.0).tobytes())
    body = element(14, matrix)
    packed = zlib.compress(body)
    raw = b"test".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for content in (body, struct.pack("<II", 15, len(packed)) + packed):
        assert (files.read_mat5(raw + content)["m"] == np.arange(6.0).reshape(2, 3, order="F")).all()
    with pytest.raises(RuntimeError):
        files.decode_array("x.mat", b"\x89HDF\r\n\x1a\n" + b"\0" * 600)
    (tmp_path / "s.xyz").write_text("2\ncomment\nNi 0 0.5 1\nPd 1 2 3\n")
    assert [(r.atom_id, r.element, r.z) for r in files.read_xyz(spark, f"file://{tmp_path}/s.xyz").collect()] == [(0, "Ni", 1.0), (1, "Pd", 3.0)]


def test_stage_checkpoints(spark, tmp_path):
    stages = files.Stages(spark, f"file://{tmp_path}/run", {"a": 1})
    assert stages.write("one", spark.range(3)).count() == 3
    with pytest.raises(Exception):
        stages.write("one", spark.range(3))
    with pytest.raises(ValueError):
        files.Stages(spark, f"file://{tmp_path}/run", {"a": 2}).read("one")
    with pytest.raises(FileNotFoundError):
        stages.read("two")


def test_stream_of_frames(spark, tmp_path):
    from voxlake.streaming import frames

    spark.createDataFrame([(0, 1, 0, 0, 2.0), (1, 1, 0, 0, 3.0)], frames.SCHEMA).write.parquet(f"{tmp_path}/in")
    q = frames.running_sum(frames.frame_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT v FROM sums").collect() == [(5.0,)]


def test_small_pipeline(spark, monkeypatch):
    """All stages but the background's removal, which ``masks`` has by itself and takes minutes on one machine."""
    monkeypatch.setattr(masks, "without_background", lambda px, rows, cols, disk, scale, least: masks.centred(px, rows, cols, scale, least))
    rng = np.random.default_rng(2)
    rows = [(f, v, r, c, float(100 * math.exp(-((r - 22) ** 2 + (c - 26) ** 2) / 60) + rng.poisson(5) + 1)) for f in range(2) for v in (1, 2) for r in range(48) for c in range(48)]
    df = spark.createDataFrame(rows, "frame int, view int, r int, c int, v double")
    angles = spark.createDataFrame([(1, 0.0), (2, 10.0)], "view int, theta double")
    out = pipelines.preprocess(df, angles, pipelines.Preprocess(48, 48, 40, disk=20, least=(20, 20), dark_least=0.0, denoise=False))
    assert out["projections"].count() == 2 * 40 * 40 and out["angles"].columns == ["view", "phi", "theta", "psi"]
    at = out["projections"].groupBy("view").agg(*((F.sum(F.col(a) * F.col("v")) / F.sum("v")).alias(a) for a in "rc"), F.sum("v").alias("s")).orderBy("view").collect()
    assert all(x.r == pytest.approx(20, abs=0.5) and x.c == pytest.approx(20, abs=0.5) for x in at) and at[0].s == pytest.approx(at[1].s, rel=0.05)
    assert out["masks"].count() > 2 * 60 and out["noise"].count() == 2


def disc(n=96, at=(40, 55), radius=20):
    y, x = np.indices((n, n))
    return np.where((y - at[0]) ** 2 + (x - at[1]) ** 2 <= radius**2, 100.0, 0.0)


def mask_array(mask, shape_):
    out = np.zeros(shape_, bool)
    for r in mask.collect():
        out[r.view, r.r, r.c] = True
    return out


def test_particles_are_found_and_centred(spark):
    rng = np.random.default_rng(0)
    discs = [disc(48, (20, 27), 9), disc(48, (26, 21), 7), disc(48, (24, 24), 8)]
    stack = np.array([d + rng.random((48, 48)) for d in discs])
    stack[2] = 0
    px, inside = pixel_frame(spark, stack, 0).cache(), np.array(discs) > 0
    at = {r.view: (r.cr, r.cc) for r in masks.centres(px, 20, 48, 48, 2.0).collect()}
    assert at[0] == pytest.approx((20, 27), abs=0.3) and at[1] == pytest.approx((26, 21), abs=0.3) and at[2] == (23.5, 23.5)
    mask = mask_array(masks.blob_mask(px, 48, 48), stack.shape)
    assert mask[:2][inside[:2]].all() and mask[:2].sum() < 3 * inside[:2].sum() and not mask[2].any()
    out = masks.centred(px.where("view < 2"), 48, 48, 0.9, (20, 20))
    assert mask_array(out["first"], stack.shape)[:2][inside[:2]].mean() > 0.99 and mask_array(out["before"], stack.shape)[:2][inside[:2]].mean() > 0.97
    for r in out["aligned"].groupBy("view").agg(*((F.sum(F.col(a) * F.col("v")) / F.sum("v")).alias(a) for a in "rc")).collect():
        assert (r.r, r.c) == pytest.approx((24, 24), abs=0.2)
    dark = mask_array(masks.background(px, 20, 48, 48), stack.shape)
    assert not dark[:2][inside[:2]].any() and dark[2].all()


def test_line_filters(spark):
    rng = np.random.default_rng(20)
    stack = rng.normal(size=(2, 9, 12))
    px = pixel_frame(spark, stack, 0)
    for sigma, radius, border in ((2.0, None, "symmetric"), (1.5, 3, "edge")):
        got = dense(lines.gaussian(px, sigma, 9, 12, radius, border), ("view", "r", "c"), stack.shape)
        assert np.allclose(got, [images.gaussian(a, sigma, radius, border) for a in stack])
    moves = spark.createDataFrame([(0, 1.25, -0.5), (1, -2.2, 3.0)], "view int, dy double, dx double")
    got = dense(lines.fourier_shift(px, moves, 9, 12), ("view", "r", "c"), stack.shape)
    assert np.allclose(got, [images.fourier_shift(stack[0], 1.25, -0.5), images.fourier_shift(stack[1], -2.2, 3.0)])
    got = dense(masks.low_passed(px, 9, 12), ("view", "r", "c"), stack.shape)
    assert np.allclose(got, [images.rotate(a, 0.0) for a in stack])


def test_octagons_and_holes(spark):
    rng = np.random.default_rng(21)
    mask = np.zeros((1, 30, 30), bool)
    mask[0, 3, 4] = mask[0, 15:24, 10:22] = True
    where = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(mask)], "view int, r int, c int")
    offsets = [(r, c) for r in range(-5, 6) for c in range(-5, 6) if abs(r) + abs(c) <= 8]
    wide = np.array([[any(0 <= r + a < 30 and 0 <= c + b < 30 and mask[0, r + a, c + b] for a, b in offsets) for c in range(30)] for r in range(30)])
    assert (mask_array(masks.widened(where, 6, 30, 30), mask.shape)[0] == wide).all()
    back = spark.createDataFrame([(0, *map(int, p)) for p in np.argwhere(wide)], "view int, r int, c int")
    small = np.array([[all(0 <= r + a < 30 and 0 <= c + b < 30 and wide[r + a, c + b] for a, b in offsets) for c in range(30)] for r in range(30)])
    assert (mask_array(masks.narrowed(back, 6), mask.shape)[0] == small).all()
    ring = np.zeros((1, 12, 12), bool)
    ring[0, 2:9, 2:9], ring[0, 4:7, 4:7], ring[0, 10, 0] = True, False, True
    ring[0, 3, 3] = rng.random() < 0  # a hole that only a corner joins with the next
    full = pixel_frame(spark, np.zeros(ring.shape), 0)
    got = mask_array(masks.holes_filled(spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(ring)], "view int, r int, c int"), full, 12, 12), ring.shape)
    want = ring.copy()
    want[0, 2:9, 2:9] = True
    assert (got == want).all()


def test_filters_and_inside_grids(spark):
    from voxlake.operators.shape import grid

    image = np.random.default_rng(3).normal(size=(8, 8))
    rows = spark.createDataFrame([(1, int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(image)], "view int, r int, c int, v double")
    ones = grid(spark, {"r": (0, 7), "c": (0, 7)}).withColumn("v", F.lit(2.0))
    assert all(r.v == pytest.approx(2 * image[r.r, r.c]) for r in blocks.filter_images(rows, ones, 8, 8).collect())
    low = ones.withColumn("v", F.when((F.col("r") == 4) & (F.col("c") == 4), 1.0).otherwise(0.0))
    assert all(r.v == pytest.approx(image.mean()) for r in blocks.filter_images(rows, low, 8, 8).collect())
    places = np.arange(2, 22) / 3
    assert np.allclose(images.spline_weights(8, inside=True) @ np.arange(8.0) ** 3, places**3)
    assert images.upsample(np.ones((5, 6, 7)), inside=True).shape == (11, 14, 17)


def test_openings_of_images(spark):
    image = np.random.default_rng(7).integers(0, 50, (16, 16)).astype(float)
    rows = spark.createDataFrame([(1, int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(image)], "view int, r int, c int, v double")
    got = np.zeros((16, 16))
    for r in morphology.disk_opening(rows, 6, 16, 16).collect():
        got[r.r, r.c] = r.v
    offsets = [(r, c) for r in range(-5, 6) for c in range(-5, 6) if abs(r) + abs(c) <= 8]
    low = np.array([[min(image[r + a, c + b] for a, b in offsets if 0 <= r + a < 16 and 0 <= c + b < 16) for c in range(16)] for r in range(16)])
    want = np.array([[max(low[min(15, max(0, r + a)), min(15, max(0, c + b))] for a, b in offsets) for c in range(16)] for r in range(16)])
    assert (got == want).all()
    for r in masks.opened(rows, 2, 16, 16).collect():
        assert r.v <= image[r.r, r.c]
    even = pixel_frame(spark, np.full((1, 20, 20), 7.0))
    assert masks.minus(even, masks.smooth_background(even, 6, 20, 20)).agg(F.max("v")).first()[0] < 1e-9


def test_components_by_flood_fill(spark):
    mask = np.random.default_rng(4).random((9, 11)) > 0.5
    where = spark.createDataFrame([(0, *map(int, p)) for p in np.argwhere(mask)], "view int, r int, c int")
    for full in (True, False):
        seen, todo = {}, []
        for start in map(tuple, np.argwhere(mask)):
            todo.append((start, start))
            while todo:
                at, name = todo.pop()
                r, c = at
                if at not in seen and 0 <= r < 9 and 0 <= c < 11 and mask[at]:
                    seen[at] = name
                    todo += [((r + a, c + b), name) for a in (-1, 0, 1) for b in (-1, 0, 1) if full or not (a and b)]
        got = {(r.r, r.c): divmod(r.comp, 65536) for r in morphology.components(where, ["r", "c"], full).collect()}
        assert got == {k: tuple(map(int, v)) for k, v in seen.items()}


def test_binned_phases_of_odd_sizes(spark):
    stack = np.arange(35.0).reshape(1, 5, 7)
    got = {(r.phase, r.r, r.c): r.v for r in aggregate.binned_phases(pixel_frame(spark, stack).withColumn("frame", F.lit(0)), 5, 7).collect()}
    want = {}
    for a in (0, 1):
        for b in (0, 1):
            for (r, c), v in np.ndenumerate(np.roll(stack[0], (-a, -b), (0, 1))[::2, ::2]):
                want[2 * a + b, r, c] = v
    assert got == want


def test_ordered_sums_are_the_fixed_tree(spark):
    rng = np.random.default_rng(9)

    def tree(v):
        if len(v) >= 89000:
            return tree_serial([tree(v[i : i + 4096]) for i in range(0, len(v), 4096)])
        return tree_serial(v) if len(v) < 44 else tree_serial([tree_serial(v[k::4]) for k in range(4)])

    def tree_serial(v):
        total = 0.0
        for x in v:
            total += x
        return total

    rows = [(n, (rng.normal(size=n) * 10.0 ** rng.integers(-8, 8, n)).tolist()) for n in (0, 1, 43, 44, 47, 4097, 90_001)]
    got = {r.n: r.s for r in spark.createDataFrame(rows, "n int, a array<double>").select("n", scalar.ordered_sum(F.col("a")).alias("s")).collect()}
    assert got == {n: tree(v) for n, v in rows}


def test_dark_fit_keeps_its_bounds(spark):
    theta = np.linspace(-60, 60, 9)
    for a, b in ((0.3, 0.7), (1.4, 0.2), (-0.5, 0.4), (0.2, 3.0)):
        dark = a * 1e4 / np.cos(np.radians(theta)) + b * 1e4
        df = spark.createDataFrame([(float(t), float(v)) for t, v in zip(theta, dark)], "theta double, dark double")
        got = aggregate.dark_fit(df)
        ga, gb = np.meshgrid(np.linspace(0, 1, 101), np.linspace(0, 1.5, 151))
        cost = ((ga[..., None] * 1e4 / np.cos(np.radians(theta)) + gb[..., None] * 1e4 - dark) ** 2).sum(-1)
        k = np.unravel_index(cost.argmin(), cost.shape)
        assert got[:2] == pytest.approx((ga[k], gb[k]), abs=0.011) and got[2] <= cost[k] + 1e-3


def test_spectra_and_angles_are_checked(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(5, 6))
    assert np.allclose(images.half_spectrum(a), np.fft.fft2(a)[:, :4]) and np.allclose(images.from_half_spectrum(images.half_spectrum(a), a.shape), a)
    with pytest.raises(ValueError):
        images.half_spectrum(a * 1j)
    still = images.rotate(disc(), 0.0, 0.0)
    assert 0 < np.abs(still - disc()).max() < 2.0
    with pytest.raises(ValueError):
        shape.angle_table(spark.createDataFrame([(1, 2.0, 3.0)], "view int, theta double, phi double"))
    stack = np.arange(24.0).reshape(2, 4, 3)
    np.save(tmp_path / "p.npy", stack)
    np.save(tmp_path / "a.npy", np.array([-10.0, 0.0, 10.0]))
    px, angles = files.read_projections(spark, str(tmp_path / "p.npy"), str(tmp_path / "a.npy"))
    assert px.count() == 24 and sorted((r.view, r.phi, r.theta, r.psi) for r in angles.collect()) == [(0, 0, -10, 0), (1, 0, 0, 0), (2, 0, 10, 0)]
    np.save(tmp_path / "b.npy", np.zeros(2))
    with pytest.raises(ValueError):
        files.read_projections(spark, str(tmp_path / "p.npy"), str(tmp_path / "b.npy"))
    files.convert_arrays(spark, str(tmp_path / "p.npy"), ["r", "c", "view"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("v")).first()[0] == stack.sum()
    files.write_reconstruction(str(tmp_path / "rec"), px, spark.range(1), spark.range(3))
    files.write_refinement(str(tmp_path / "ref"), px, spark.range(1), spark.range(3))
    assert spark.read.csv(str(tmp_path / "rec/iter_timing"), header=True).count() == 3 and spark.read.parquet(str(tmp_path / "ref/err_history")).count() == 3
    z = files.with_coefficients(spark.createDataFrame([(1, 6)], "atom_id long, z int"), spark.createDataFrame([(6, 0.5)], "z int, a1 double")).first()
    assert (z.atom_id, z.a1) == (1, 0.5)


def test_late_steps(spark):
    rows = [(v, int(r), int(c), float(x)) for v in (1, 2) for (r, c), x in np.ndenumerate(disc(48, (20, 26), 9))]
    px = spark.createDataFrame(rows, "view int, r int, c int, v double")
    inside = disc(48, (20, 26), 9) > 0
    assert steps.step_24_initial_mask(px, 48, 48, 20).agg(F.sum("v")).first()[0] >= 2 * inside.sum()
    middle = steps.step_25_integer_com(px, 48, 48, 20).groupBy("view").agg((F.sum(F.col("r") * F.col("v")) / F.sum("v")).alias("m")).collect()
    assert all(m.m == pytest.approx(24, abs=1) for m in middle)
    assert steps.step_26_refined_mask(px, 48, 48, 0.9, (20, 20)).where("v = 1").count() >= 2 * inside.sum()
    aligned = steps.step_27_subpixel_com(px, 48, 48, 0.9, (20, 20)).groupBy("view").agg((F.sum(F.col("c") * F.col("v")) / F.sum("v")).alias("m")).collect()
    assert all(m.m == pytest.approx(24, abs=0.2) for m in aligned)
    scores = steps.step_30_estimate_commonline(px, 48, 48, -2, 2, 1.0).collect()
    assert sorted(r.angle for r in scores) == [-2, -1, 0, 1, 2] and all(abs(r.score) < 1e-6 for r in scores)  # equal views


def blobs(n=16):
    at = np.array([(4.3, 4.1, 5.2), (11.2, 4.4, 10.8), (5.1, 11.3, 9.9), (10.7, 10.6, 4.6)])
    grid = np.stack(np.indices((n, n, n)), axis=-1)
    height = np.array([2.0, 2.0, 4.0, 4.0])
    return at, sum(h * np.exp(-((grid - p) ** 2).sum(-1) / 2.5) for h, p in zip(height, at))


def volume_rows(spark, volume):
    return spark.createDataFrame([(int(i), int(j), int(k), float(v)) for (i, j, k), v in np.ndenumerate(volume)], "i int, j int, k int, v double")


def test_volumes_are_made_finer_in_lines(spark):
    volume = np.random.default_rng(3).normal(size=(5, 6, 7))
    got = np.zeros((15, 18, 21))
    for r in blocks.upsample_cells(volume_rows(spark, volume), {"i": 5, "j": 6, "k": 7}).collect():
        got[r.i, r.j, r.k] = r.v
    assert np.allclose(got, images.upsample(volume))


def test_atoms_are_traced_and_classified(spark):
    at, volume = blobs()
    cells = volume_rows(spark, volume).cache()
    found = pipelines.trace(cells, 16, 1.0, 2.0).collect()
    places = np.array([(r.x, r.y, r.z) for r in found])
    gaps = np.sqrt(((places[:, None] - at[None]) ** 2).sum(2))
    assert len(found) == 4 and gaps.min(0).max() < 0.2
    atoms = atoms_frame(spark, [*map(tuple, at), (8.0, 8.0, 8.0), (2.0, 13.0, 13.0)])
    got = {r.atom_id: r.species for r in pipelines.classify(atoms, cells, 16, 2, background=0.0).collect()}
    assert {k: got[k] for k in range(4)} == {0: 1, 1: 1, 2: 2, 3: 2}
    every = {r.atom_id: r.species for r in pipelines.classify(atoms, cells, 16, 3, radius=9.0).collect()}
    assert set(every) == set(range(6)) and set(every.values()) <= {1, 2, 3}


def test_heights_widths_and_positions_are_refined(spark):
    rng = np.random.default_rng(6)
    places, kinds = rng.uniform(-6, 6, (12, 3)), [0, 1] * 6
    atoms = atoms_frame(spark, places, kinds).cache()
    angles = spark.createDataFrame([(v, 10.0 * v, 25.0 * v, 5.0 * v) for v in range(4)], "view int, phi double, theta double, psi double")
    at = project.view_positions(atoms.select("atom_id", "species", "x", "y", "z"), angles)
    measured = project.combined(project.splat(at, {0: 3.0, 1: 6.0}, {0: 0.5, 1: 0.8}, 32)).cache()
    planes = project.parameter_planes(at, {0: 3.0, 1: 6.0}, {0: 0.5, 1: 0.8}, 32)
    more = project.combined(project.splat(at, {0: 3.0, 1: 6.0}, {0: 0.5, 1: 0.8 + 1e-5}, 32))
    j = planes.join(measured.withColumnRenamed("v", "a"), ["view", "r", "c"]).join(more.withColumnRenamed("v", "b"), ["view", "r", "c"])
    worst = j.agg(F.max(F.abs((F.col("b") - F.col("a")) / 1e-5 - F.col("b1"))), F.max(F.abs(3 * F.col("h0") + 6 * F.col("h1") - F.col("a")))).first()
    assert worst[0] < 1e-3 and worst[1] < 1e-9
    stats, last = project.parameter_stats(at, measured, 32, [0, 1])
    p, value = project.bounded_least_squares(stats, [1, 1.2, 0.6, 0.6], [1, 1, 0.1, 0.1], [1, 3, 2, 2], rounds=12)
    assert p == pytest.approx([1, 2, 0.5, 0.8], abs=1e-3) and last["scale"] == pytest.approx(3, abs=1e-2)
    _, _, errors = project.descend_heights_widths(at, measured, {0: 1.0, 1: 1.7}, {0: 0.5, 1: 0.8}, 32, rounds=4)
    assert errors[-1] < errors[0]
    start = atoms_frame(spark, places + rng.normal(0, 0.1, places.shape), kinds)
    out = pipelines.refine_all(start, measured, angles, 32, {0: 1.0, 1: 1.5}, {0: 0.6, 1: 0.6}, {"height": (1, 3), "width": (0.1, 2)}, rounds=1, inner=3, step=0.05)
    assert out["history"][-1][1] < out["history"][0][1] and out["height"][0] == 1 and out["model"].count() == 12


def pixel_frame(spark, stack, first=1):
    view, r, c = (x.ravel().tolist() for x in np.indices(stack.shape))
    return spark.createDataFrame(list(zip([v + first for v in view], r, c, stack.ravel().tolist())), "view int, r int, c int, v double")


def angle_frame(spark, degrees, first=1):
    return spark.createDataFrame([(n + first, *map(float, row)) for n, row in enumerate(degrees)], "view int, phi double, theta double, psi double")


def dense(rows, columns, shape_):
    out = np.zeros(shape_)
    for r in rows.collect():
        out[tuple(r[c] for c in columns)] += r["v"]
    return out


def test_projection_and_back_projection_are_the_plain_ones(spark):
    rng = np.random.default_rng(17)
    n, degrees = 9, rng.uniform(-70, 70, (5, 3))
    turns = tomography.turns_of(angle_frame(spark, degrees, 0))
    volume, stack = rng.uniform(0, 5, (n, n, n)), rng.uniform(-3, 3, (5, n, n))
    cells = spark.createDataFrame([(*map(int, p), float(volume[p])) for p in np.ndindex(volume.shape)], "i int, j int, k int, v double")
    for oversampling, thick in ((3, 4), (2.2, 7), (3, 100)):
        got = dense(tomography.project(cells, turns, n, oversampling, thick), ("view", "r", "c"), stack.shape)
        assert np.allclose(got, plain_tomography.fourier_views(volume, [turns[v] for v in range(5)], oversampling))
    want = plain_tomography.back_projected(stack, [turns[v] for v in range(5)])
    for block in (2, 4, 16):
        assert np.allclose(dense(tomography.back_project(pixel_frame(spark, stack, 0), turns, n, block), "ijk", volume.shape), want)
    assert not tomography.back_project(pixel_frame(spark, stack, 0).where("false"), turns, n, 4).where("v <> 0").collect()
    assert not tomography.project(cells.where("false"), turns, n).collect()


def test_reconstruction_is_the_plain_one(spark):
    volume = np.zeros((8, 8, 8))
    volume[2:5, 3:6, 2:6] = 1
    degrees = [(3.0 * d, 10.0 * d, -5.0) for d in range(-6, 7, 2)]
    turns = [tomography.view_rotation(*a) for a in degrees]
    stack = plain_tomography.fourier_views(volume, turns, 3)
    want, want_errors = plain_tomography.reconstruct(stack, degrees, 4)
    got, errors = tomography.reconstruct(pixel_frame(spark, stack), angle_frame(spark, degrees), 8, 4, block=5, thick=6)
    assert np.allclose(errors, want_errors) and errors[-1] < 0.7 * errors[0]
    assert np.allclose(dense(got, "ijk", volume.shape), want)
    with pytest.raises(ValueError):
        tomography.reconstruct(pixel_frame(spark, stack), angle_frame(spark, degrees[:3]), 8, 1)
    with pytest.raises(ValueError):
        tomography.turns_of(angle_frame(spark, degrees).unionByName(angle_frame(spark, degrees[:1])))


@pytest.mark.parametrize("tile", [3, 64])
def test_filled_regions_solve_laplaces_equation(spark, monkeypatch, tile):
    monkeypatch.setattr(fill, "TILE", tile)
    rng = np.random.default_rng(18)
    stack = rng.uniform(0, 9, (4, 7, 6))
    mask = rng.random(stack.shape) < 0.5
    mask[2], mask[3] = False, True
    where = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(mask)] + [(0, 99, 0)], "view int, r int, c int")
    got = dense(fill.fill_region(pixel_frame(spark, stack, 0), where, 7, 6, 1e-11), ("view", "r", "c"), stack.shape)
    assert np.array_equal(got[2], stack[2]) and not got[3].any()
    for v in (0, 1):
        a, b = np.eye(42), np.where(mask[v], 0, stack[v]).ravel()
        for r, c in np.argwhere(mask[v]):
            near = [(r + x, c + y) for x, y in fill.SIDES if 0 <= r + x < 7 and 0 <= c + y < 6]
            a[r * 6 + c, r * 6 + c] = len(near)
            for p, q in near:
                a[r * 6 + c, p * 6 + q] = -1
        assert np.allclose(got[v].ravel(), np.linalg.solve(a, b))
    if tile == 3:
        with pytest.raises(ValueError):
            fill.fill_region(pixel_frame(spark, stack, 0), where, 7, 6, 1e-11, rounds=2)


def test_registration(spark):
    rng = np.random.default_rng(3)
    y, x = np.indices((48, 44))
    first = np.exp(-((y - 22) ** 2 + (x - 20) ** 2) / 6) * 50 + np.exp(-((y - 26) ** 2 + (x - 24) ** 2) / 4) * 30
    stack = np.array([first, first[::-1, ::-1]]) + rng.normal(0, 0.01, (2, 48, 44))
    moves = [(1.3, -2.6), (-0.2, 1.45)]
    moved = np.array([images.fourier_shift(a, *m) for a, m in zip(stack, moves)])
    got = {r.view: (r.dy, r.dx) for r in registration.shifts(pixel_frame(spark, stack, 0), pixel_frame(spark, moved, 0), 48, 44, reach=5, border=6).collect()}
    for v in (0, 1):
        assert got[v] == pytest.approx([-d for d in moves[v]], abs=0.06)
    small = pixel_frame(spark, stack[:, 14:30, 10:28], 0)
    rolled = pixel_frame(spark, np.roll(stack[:, 14:30, 10:28], (3, -5), (1, 2)), 0)
    assert {tuple(r)[1:] for r in registration.shifts(small, rolled, 16, 18).collect()} == {(-3.0, 5.0)}
    frames = pixel_frame(spark, stack[:1, 14:30, 10:28], 0).withColumn("frame", F.lit(0)).unionByName(pixel_frame(spark, np.roll(stack[:1, 14:30, 10:28], (0, 2), (1, 2)), 0).withColumn("frame", F.lit(1)))
    aligned, found = registration.register_frames(frames, 16, 18)
    assert sorted((r.frame, r.dy, r.dx) for r in found.collect()) == [(0, 0, 0), (1, 0, -2)]
    assert np.allclose(dense(aligned.where("frame = 1"), ("view", "r", "c"), (1, 16, 18)), stack[:1, 14:30, 10:28])
    with pytest.raises(ValueError):
        registration.shifts(small, small, 16, 18, resolution=0.6)


def test_correlations_are_the_formula(spark):
    rng = np.random.default_rng(4)
    image, template = rng.integers(0, 9, (2, 9, 11)).astype(float), rng.integers(0, 9, (2, 5, 5)).astype(float)
    image[1, :6, :7] = 3  # flat under the template
    got = {(r.view, r.dy, r.dx): r.score for r in registration.correlations(pixel_frame(spark, template, 0), pixel_frame(spark, image, 0), 9, 11, (2, 3)).collect()}
    for v in (0, 1):
        for dy in range(-2, 3):
            for dx in range(-3, 4):
                g = image[v, 2 + dy : 7 + dy, 3 + dx : 8 + dx]
                want = np.corrcoef(g.ravel(), template[v].ravel())[0, 1] if g.std() else 0.0
                assert got[v, dy, dx] == pytest.approx(want)


def test_interpolation_beyond_both_ends(spark):
    rng = np.random.default_rng(5)
    curves = {k: (np.sort(rng.uniform(0, 10, 7)), rng.normal(size=7)) for k in (1, 2)}
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in curves.items() for a, b in zip(x, y)], "view int, x double, y double")
    at = [(k, float(v)) for k in (1, 2, 3) for v in (*rng.uniform(-3, 13, 40), *curves.get(k, ([], []))[0], float("nan"), float("inf"))]
    got = stabilise.interpolated(spark.createDataFrame(at, "view int, v double"), rows, ["view"]).collect()
    assert len(got) == len(at)
    for r in got:
        if r.view == 3 or not np.isfinite(r.v):
            assert r.y is None
            continue
        x, y = curves[r.view]
        k = min(max(int(np.searchsorted(x, r.v, side="right")) - 1, 0), len(x) - 2)
        assert r.y == pytest.approx(y[k] + (r.v - x[k]) * (y[k + 1] - y[k]) / (x[k + 1] - x[k]))
