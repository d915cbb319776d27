"""Numpy kernels on single images and volumes: spectra, resampling, filters, denoising.

They are pure functions of arrays; ``blocks`` runs them in Arrow tasks, an image each.
"""

from __future__ import annotations

import numpy as np


# spectra
def centred_fft(a: np.ndarray, axes=None) -> np.ndarray:
    axes = _axes(a, axes)
    return np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(a, axes), axes=axes), axes)


def centred_ifft(a: np.ndarray, axes=None) -> np.ndarray:
    axes = _axes(a, axes)
    return np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(a, axes), axes=axes), axes)


def _axes(a: np.ndarray, axes) -> tuple[int, ...]:
    axes = tuple(range(a.ndim)) if axes is None else tuple(x + a.ndim if x < 0 else x for x in axes)
    if len(set(axes)) != len(axes) or any(not 0 <= x < a.ndim for x in axes):
        raise ValueError(f"axes {axes} don't fit {a.ndim} dimensions")
    return axes


def convolve_full(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shape, axes = [x + y - 1 for x, y in zip(a.shape, b.shape)], tuple(range(a.ndim))
    out = np.fft.ifftn(np.fft.fftn(a, shape, axes) * np.fft.fftn(b, shape, axes), axes=axes)
    return out if np.iscomplexobj(a) or np.iscomplexobj(b) else out.real


def fourier_shift(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    ky, kx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None]
    return np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real


def half_spectrum(a: np.ndarray, axes=None) -> np.ndarray:
    """Spectrum of a real array without the half of the last axis that the other half repeats."""
    if np.iscomplexobj(a):
        raise ValueError("a half spectrum needs real values")
    return np.fft.rfftn(a, axes=_axes(a, axes)).astype(np.complex64 if a.dtype == np.float32 else complex)


def from_half_spectrum(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return np.fft.irfftn(a, shape, axes=tuple(range(-len(shape), 0)))


def apply_filter(image: np.ndarray, response: np.ndarray) -> np.ndarray:
    """``response`` is centred."""
    return centred_ifft(centred_fft(image) * response).real


# resampling
def _keys(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0.0))


def bicubic(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cubic convolution at (rows, cols), from 0; edges are continued by a parabola, outside is 0."""
    p = np.pad(image.astype(float), 2)
    for axis in (0, 1):
        m = np.moveaxis(p, axis, 0)
        for _, edge, step in ((0, 1, 1), (1, -2, -1)):
            m[edge] = 3 * m[edge + step] - 3 * m[edge + 2 * step] + m[edge + 3 * step]
            m[edge - step] = 3 * m[edge] - 3 * m[edge + step] + m[edge + 2 * step]
    inside = (rows >= 0) & (rows <= image.shape[0] - 1) & (cols >= 0) & (cols <= image.shape[1] - 1)
    r, c = np.where(inside, rows, 0.0), np.where(inside, cols, 0.0)
    r0, c0 = np.minimum(np.floor(r), image.shape[0] - 1).astype(int), np.minimum(np.floor(c), image.shape[1] - 1).astype(int)
    out = np.zeros(np.broadcast(rows, cols).shape)
    for i in range(-1, 3):
        wr, ri = _keys(r - r0 - i), np.clip(r0 + i + 2, 0, p.shape[0] - 1)
        for j in range(-1, 3):
            out += wr * _keys(c - c0 - j) * p[ri, np.clip(c0 + j + 2, 0, p.shape[1] - 1)]
    return np.where(inside, out, 0.0)


def along_drift(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Resampled where a steady drift by dy, dx a frame put each scan line."""
    n = image.shape[0]
    r, c = np.meshgrid(np.arange(n, dtype=float), np.arange(image.shape[1], dtype=float), indexing="ij")
    return bicubic(image, r - dy / (n - dy) * r, c - dx / (n - dx) * r)


def spline_weights(n: int, factor: int = 3, inside: bool = False) -> np.ndarray:
    """(factor * n, n) weights of a not-a-knot cubic spline at a grid centred on the samples; with ``inside`` the grid
    begins one step before the second sample and ends at the last one."""
    x, t = np.arange(n, dtype=float), (np.arange(factor * n) - (factor * n - 1) / 2) / factor + (n - 1) / 2
    if inside:
        t = np.arange(factor - 1, factor * (n - 1) + 1) / factor
    if n < 4:
        return np.array([[np.prod([(u - x[m]) / (x[k] - x[m]) for m in range(n) if m != k]) for k in range(n)] for u in t])
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2], b[i, i - 1 : i + 2] = (1, 4, 1), (6, -12, 6)
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    m = np.linalg.solve(a, b)
    i = np.clip(np.floor(t).astype(int), 0, n - 2)
    u = (t - i)[:, None]
    e = np.eye(n)
    return (1 - u) * e[i] + u * e[i + 1] + ((1 - u) ** 3 - (1 - u)) / 6 * m[i] + (u**3 - u) / 6 * m[i + 1]


def upsample(volume: np.ndarray, factor: int = 3, inside: bool = False) -> np.ndarray:
    """Cubic-spline upsampling along every axis; NaN counts as 0."""
    out = np.nan_to_num(volume.astype(float))
    for axis in range(out.ndim):
        out = np.moveaxis(np.tensordot(spline_weights(out.shape[axis], factor, inside), out, axes=(1, axis)), 0, axis)
    return out


def rotate(image: np.ndarray, degrees: float, background: float | None = None) -> np.ndarray:
    """Rotation about the middle as three Fourier shears, on a frame padded with the background (default: a low
    order statistic of the image).  A rotation by nothing passes through that frame as well, as in the model: it loses
    the highest frequencies of either axis."""
    if background is None:
        v = np.sort(image, axis=None)
        background = float(v[max(0, round(v.size / 128) - 1)])
    if abs(np.sin(np.radians(degrees))) < 1e-15:
        rows, cols = image.shape
        frame = np.full((2 * rows, 2 * cols), background)
        inside = np.s_[rows // 2 - 1 : rows // 2 - 1 + rows, cols // 2 - 1 : cols // 2 - 1 + cols]
        frame[inside] = image
        spectrum = np.fft.fft2(frame)
        spectrum[rows, :], spectrum[:, cols] = 0, 0
        return np.fft.ifft2(spectrum).real[inside]
    turns = int(np.rint(degrees / 90.0))
    image, rest = np.rot90(image, turns % 4), np.radians(degrees - 90.0 * turns)
    pad = [(n // 2, n // 2) for n in image.shape]
    p = np.pad(image - background, pad)
    cy, cx = (p.shape[0] - 1) / 2, (p.shape[1] - 1) / 2
    a, b = -np.tan(rest / 2), np.sin(rest)
    y, x = np.arange(p.shape[0]) - cy, np.arange(p.shape[1]) - cx
    kx, ky = np.fft.fftfreq(p.shape[1]), np.fft.fftfreq(p.shape[0])
    for axis, k, along in ((1, kx, -a * y), (0, ky, -b * x), (1, kx, -a * y)):
        phase = np.exp(-2j * np.pi * (np.outer(along, k) if axis == 1 else np.outer(k, along)))
        p = np.fft.ifft(np.fft.fft(p, axis=axis) * phase, axis=axis).real
    return p[pad[0][0] : pad[0][0] + image.shape[0], pad[1][0] : pad[1][0] + image.shape[1]] + background


def common_line_scores(image: np.ndarray, degrees: list[float], mean_line: np.ndarray) -> list[float]:
    return [float(np.abs(rotate(image, d).sum(axis=0) - mean_line).sum()) for d in degrees]


# filters
def gaussian(image: np.ndarray, sigma: float, radius: int | None = None, border: str = "edge") -> np.ndarray:
    """Separable Gaussian with ``radius`` taps to each side; the border is repeated (edge) or mirrored (symmetric)."""
    radius = int(4 * sigma + 0.5) if radius is None else radius
    w = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    w /= w.sum()
    out = image.astype(float)
    for axis in range(out.ndim):
        p = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in range(out.ndim)], mode=border)
        out = sum(x * np.take(p, range(i, i + out.shape[axis]), axis=axis) for i, x in enumerate(w))
    return out


# variance stabilisation
def vst(x, sigma: float):
    """Anscombe transform for unit gain."""
    return 2 * np.sqrt(np.maximum(0.0, x + 0.375 + sigma * sigma))


def inverse_table(sigma: float, highest: float = 500.0, n: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(expected transform, mean) pairs, from Poisson sums with Gaussian noise by quadrature."""
    nodes, weights = np.polynomial.hermite_e.hermegauss(41)
    weights = weights / weights.sum()
    means = np.concatenate([[0.0], np.geomspace(1e-3, highest, n)])
    top = int(highest + 10 * np.sqrt(highest) + 20)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    counts = np.arange(top + 1)
    values = vst(counts[:, None] + sigma * nodes[None], sigma) @ weights
    out = [values[0]]
    for m in means[1:]:
        p = np.exp(counts * np.log(m) - m - logs)
        out.append(float((p * values).sum()))
    return np.array(out), means


def inverse_vst(d, sigma: float, table=None, alpha: float = 1.0, mean: float = 0.0):
    """Exact unbiased inverse: a table of expected transforms, its asymptote above, 0 below; then gain and offset.

    ``sigma`` is in units of the gain.  The table is computed for this sigma rather than read between stored ones.
    """
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    e, m = table or inverse_table(sigma)
    d = np.asarray(d, float)
    out = np.where(d < e[0], 0.0, np.where(d > e[-1], (d / 2) ** 2 - 1 / 8 - sigma * sigma, np.interp(d, e, m)))
    return out * alpha + mean
