"""Per-frame pixel kernels in numpy, run by Spark tasks over batches of frames."""

from __future__ import annotations

import numpy as np


def normalize(image: np.ndarray) -> np.ndarray:
    """Values brought to 0-1; a constant image becomes NaN, as 0/0 does."""
    x = image.astype(float) - image.min()
    with np.errstate(invalid="ignore"):
        return x / x.max()


def rescale_uint8(image: np.ndarray) -> np.ndarray:
    """0-255 by minimum and maximum, truncated; a constant image becomes 0."""
    low, high = float(image.min()), float(image.max())
    return np.zeros(image.shape, np.uint8) if high <= low else np.floor((image - low) / (high - low) * 255).astype(np.uint8)


def box_mean_std(image: np.ndarray, w: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Sums over 2w x 2w pixels by summed-area tables, over a mirrored margin, divided by (2w + 1) squared."""
    wide = np.pad(image.astype(float), w, "reflect" if min(image.shape) > 1 else "edge")

    def sums(a):
        t = a.cumsum(0).cumsum(1)
        return t[: -2 * w, : -2 * w] + t[2 * w :, 2 * w :] - t[: -2 * w, 2 * w :] - t[2 * w :, : -2 * w]

    area = (2.0 * w + 1) ** 2
    mean = sums(wide) / area
    with np.errstate(invalid="ignore"):
        return mean, np.sqrt(sums(wide**2) / area - mean**2)


def _spread(std: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (std - np.nanmin(std)) / (np.nanmax(std) - np.nanmin(std))


def _rank_window(image: np.ndarray, w: int, pick) -> np.ndarray:
    """Minimum or maximum over w x w pixels inside the image."""
    out = np.empty(image.shape, float)
    a, b = w // 2, w - w // 2
    for axis in (0, 1):
        src = (image if axis == 0 else out).astype(float)
        res = np.empty(image.shape, float)
        n = image.shape[axis]
        for i in range(n):
            part = np.take(src, range(max(0, i - a), min(n, i + b)), axis=axis)
            if axis == 0:
                res[i] = pick(part, axis=0)
            else:
                res[:, i] = pick(part, axis=1)
        out = res
    return out


def threshold(image: np.ndarray, technique: str, **p) -> np.ndarray:
    """The threshold surface of a technique; parameters by the names of the published methods, defaults as published."""
    g = p.get
    w = int(g("window_size", 15))
    x = image.astype(float)
    mean, std = box_mean_std(x, w)
    with np.errstate(all="ignore"):
        if technique == "sauvola":
            return mean * (1 + g("k", 0.5) * (std / g("r", 128.0) - 1))
        if technique == "phansalkar":
            m, s = box_mean_std(normalize(x), w)
            t = m * (1 + g("p", 2.0) * np.exp(-g("q", 10.0) * m) + g("k", 0.25) * (s / g("r", 0.5) - 1))
            return t * (x.max() - x.min()) + x.min()
        if technique == "wolf":
            a = g("a", 0.5)
            return (1 - a) * mean + a * x.min() + a * (std / np.nanmax(std)) * (mean - x.min())
        if technique == "nick":
            total = (x**2).sum()
            return mean + g("k", -0.1) * np.sqrt((total - mean**2) / x.size)
        if technique == "bataineh":
            return mean - (mean**2 - std) / ((x.mean() + std) * (std + _spread(std)))
        if technique == "feng":
            low = _rank_window(x, w, np.min)
            wide = _rank_window(np.nan_to_num(box_mean_std(x, int(g("window_size2", 30)))[1]).clip(0, 255).astype(np.uint8), int(g("window_size2", 30)), np.max)
            ratio = (std / wide) ** g("gamma", 2.0)
            return (1 - g("a1", 0.12)) * mean + g("k1", 0.25) * ratio * (std / wide) * (mean - low) + g("k2", 0.04) * ratio * low
        if technique == "experimental_thresholding":
            si = shape_index(x, g("gaussian_sigma", 3.0))
            bell = np.exp(-((si - g("target", -0.5)) ** 2) / g("quotient", 1.2)) + g("shift", 0.2)
            return bell * mean * ((x.mean() + std) * (std + _spread(std))) / (mean**2 - std)
    raise ValueError(f"unknown thresholding technique {technique!r}")


TECHNIQUES = ("sauvola", "phansalkar", "wolf", "nick", "bataineh", "feng", "experimental_thresholding")


def binarize(image: np.ndarray, technique: str, **p) -> np.ndarray:
    """Dark foreground: below the threshold; an undefined threshold is background."""
    t = threshold(image, technique, **p)
    return np.where(np.isnan(t), False, image < t)


def gaussian(image: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian over a mirrored margin that repeats the border pixel."""
    r = int(truncate * sigma + 0.5)
    if r < 1:
        return image.astype(float)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = image.astype(float)
    for axis in (0, 1):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
        n = out.shape[axis]
        out = sum(c * np.take(wide, range(i, i + n), axis=axis) for i, c in enumerate(k))
    return out


def shape_index(image: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """2/pi * arctan of sum over difference of the Hessian's eigenvalues of the smoothed image; flat places are NaN."""
    s = gaussian(image, sigma)
    gy, gx = np.gradient(s)
    (yy, xy), (_, xx) = np.gradient(gy), np.gradient(gx)
    half, root = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    with np.errstate(all="ignore"):
        return 2 / np.pi * np.arctan(2 * half / -(2 * root))


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components numbered from 1 in row-major order of their first pixel; 0 is background."""
    h, w = mask.shape
    m = mask.astype(bool)
    lab = np.where(m, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        p = np.pad(np.where(m, lab, big), 1, constant_values=big)
        low = np.minimum.reduce([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        new = np.where(m, low, 0)
        flat = new.ravel()
        jump = np.where(m.ravel(), flat[np.maximum(flat - 1, 0)], 0)  # follow the smallest pixel's own label
        new = jump.reshape(h, w)
        if np.array_equal(new, lab):
            break
        lab = new
    ids = np.unique(lab[m]) if m.any() else np.empty(0, int)
    return np.where(m, np.searchsorted(ids, lab) + 1, 0), ids.size


def remove_small(mask: np.ndarray, least: int) -> np.ndarray:
    lab, n = label(mask)
    return mask & (np.bincount(lab.ravel(), minlength=n + 1) >= least)[lab]


def clean_up(mask: np.ndarray, calibration: float, sigma_um: float = 0.075, cut: float = 0.5, hole_um2: float = 1.0) -> np.ndarray:
    """Smoothed by a Gaussian, then holes below the given area filled."""
    m = gaussian(mask.astype(float), sigma_um / calibration) > cut
    return ~remove_small(~m, int(hole_um2 / calibration**2))


def remove_border_artifacts(mask: np.ndarray, border_px: float) -> np.ndarray:
    """Without the components that touch the border and whose centre lies within ``border_px`` of it."""
    lab, n = label(mask)
    h, w = mask.shape
    out = mask.copy()
    edge = np.unique(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))
    for k in edge[edge > 0]:
        y, x = np.nonzero(lab == k)
        cy, cx = y.mean(), x.mean()
        if cy < border_px or cx < border_px or cy > h - border_px or cx > w - border_px:
            out[y, x] = False
    return out


def thin(mask: np.ndarray) -> np.ndarray:
    """Two-pass parallel thinning to lines of one pixel (Zhang and Suen)."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        gone = False
        for step in (0, 1):
            n, ne, e, se = m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:]
            s, sw, w, nw = m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]
            ring = [n, ne, e, se, s, sw, w, nw]
            count = sum(r.astype(int) for r in ring)
            turns = sum((~a & b).astype(int) for a, b in zip(ring, ring[1:] + ring[:1]))
            keep1 = ~(n & e & s) if step == 0 else ~(n & e & w)
            keep2 = ~(e & s & w) if step == 0 else ~(n & s & w)
            drop = m[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (turns == 1) & keep1 & keep2
            if drop.any():
                gone = True
                m[1:-1, 1:-1] &= ~drop
        if not gone:
            return m[1:-1, 1:-1]


#: fixed values: direction of each neighbour bit as (dy, dx)
DIRECTIONS = {2: (-1, 0), 1: (-1, -1), 128: (0, -1), 64: (1, -1), 32: (1, 0), 16: (1, 1), 8: (0, 1), 4: (-1, 1)}


def neighbours(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pixel of the mask, how many neighbours are set and the bits of their directions."""
    m = mask.astype(bool)
    p = np.pad(m, 1).astype(int)
    h, w = m.shape
    shifted = {b: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for b, (dy, dx) in DIRECTIONS.items()}
    return sum(shifted.values()) * m, sum(b * s for b, s in shifted.items()) * m
