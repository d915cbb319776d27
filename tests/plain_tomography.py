"""Plain versions of the tomography operators, on arrays."""

from __future__ import annotations

import numpy as np

from voxlake.operators import images, shape
from voxlake.operators.tomography import view_rotation


def angle_rows(degrees, views: int) -> np.ndarray:
    """An angle or three for each view, as rows of phi, theta, psi; one is theta."""
    a = np.asarray(degrees, float).reshape(len(degrees), -1)
    if len(a) != views or a.shape[1] not in (1, 3):
        raise ValueError(f"{a.shape} angles don't fit {views} views")
    return a if a.shape[1] == 3 else np.column_stack([np.zeros(views), a[:, 0], np.zeros(views)])


def interpolated(grid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Multilinear values of ``grid`` at the columns of ``at`` (from 0); outside is 0, the last sample is exact."""
    top = np.array(grid.shape)[:, None] - 1
    inside = ((at >= 0) & (at <= top)).all(axis=0)
    at = at[:, inside]
    low = np.minimum(np.floor(at).astype(int), np.maximum(top - 1, 0))
    part, total = at - low, 0
    for corner in np.ndindex(*(2,) * grid.ndim):
        c = np.array(corner)[:, None]
        total = total + np.where(c, part, 1 - part).prod(axis=0) * grid[tuple(np.minimum(low + c, top))]
    out = np.zeros(len(inside), grid.dtype)
    out[inside] = total
    return out


def fourier_views(volume: np.ndarray, rotations: list[np.ndarray], oversampling: float = 3) -> np.ndarray:
    """Projections of a cube: inverse transforms of slices through the padded volume's transform."""
    n = volume.shape[0]
    big = round(n * oversampling)
    at = slice(shape.centre_start(big, n), shape.centre_start(big, n) + n)
    padded = np.zeros((big,) * 3)
    padded[at, at, at] = volume
    spectrum = images.centred_fft(padded)
    plane = np.vstack([np.indices((big, big)).reshape(2, -1) - big // 2, np.zeros((1, big * big))])
    return np.array([images.centred_ifft(interpolated(spectrum, r.T @ plane + big // 2).reshape(big, big)).real[at, at] for r in rotations])


def back_projected(projections: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """Sum over views of each cell's value where it falls on the projection."""
    n = projections.shape[1]
    cells = np.indices((n,) * 3).reshape(3, -1) - n // 2
    return sum(interpolated(p, r[:2] @ cells + n // 2) for p, r in zip(projections, rotations)).reshape((n,) * 3)


def reconstruct(projections: np.ndarray, degrees, rounds: int = 200, oversampling: float = 3, step: float = 2.0) -> tuple[np.ndarray, list[float]]:
    """Volume whose Fourier slices meet the projections, never below 0, and each round's error: the mean share of the
    projections' intensity that is missed.

    ``degrees`` has an angle (theta) or three (phi, theta, psi) for each view.  A round takes slices of the padded volume's
    transform, carries the differences back along the views, and moves by step / views / size.
    A volume of up to some 128^3 is one task's array; views are what a cluster spreads, see ``small_reconstruction``.
    """
    n = projections.shape[1]
    if projections.shape[2] != n:
        raise ValueError("projections aren't square")
    rotations = [view_rotation(*a) for a in angle_rows(degrees, len(projections))]
    volume, errors, power = np.zeros((n, n, n)), [], np.maximum(1e-12, np.abs(projections).sum(axis=(1, 2)))
    for _ in range(rounds):
        miss = fourier_views(volume, rotations, oversampling) - projections
        errors.append(float((np.abs(miss).sum(axis=(1, 2)) / power).mean()))
        volume = np.maximum(0, volume - step / len(rotations) / n * back_projected(miss, rotations))
    return volume, errors


def turned(volume: np.ndarray, degrees: float) -> np.ndarray:
    """Volume turned about its second axis, trilinear; outside is 0."""
    n = volume.shape[0]
    t, mid = np.radians(degrees), (n - 1) / 2
    i, k = np.meshgrid(np.arange(n) - mid, np.arange(n) - mid, indexing="ij")
    x, z = np.cos(t) * i - np.sin(t) * k + mid, np.sin(t) * i + np.cos(t) * k + mid
    x0, z0 = np.floor(x).astype(int), np.floor(z).astype(int)
    out = np.zeros_like(volume)
    for dx in (0, 1):
        for dz in (0, 1):
            a, b = x0 + dx, z0 + dz
            w = np.where(dx, x - x0, 1 - x + x0) * np.where(dz, z - z0, 1 - z + z0)
            ok = (a >= 0) & (a < n) & (b >= 0) & (b < n)
            out += (w * ok)[:, None, :] * volume[np.clip(a, 0, n - 1), :, np.clip(b, 0, n - 1)].transpose(0, 2, 1)
    return out
