"""Geometry: closed forms as columns, and small numpy kernels for grouped functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rotated(point: list[Column], axis: tuple[float, float, float], angle: float) -> list[Column]:
    """PRJ-20: a point turned about an axis through the origin, by the Rodrigues formula."""
    n = math.sqrt(sum(a * a for a in axis))
    k = [a / n for a in axis]
    cos, sin = math.cos(angle), math.sin(angle)
    dot = sum(F.lit(a) * p for a, p in zip(k, point, strict=True))
    out = []
    for i in range(3):
        a, b = (i + 1) % 3, (i + 2) % 3
        cross = F.lit(k[a]) * point[b] - F.lit(k[b]) * point[a]
        out.append(point[i] * F.lit(cos) + cross * F.lit(sin) + F.lit(k[i] * (1 - cos)) * dot)
    return out


def rotation_toward(points: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """PRJ-20: points turned so that the direction source becomes the direction target."""
    a, b = source / np.linalg.norm(source), target / np.linalg.norm(target)
    v, c = np.cross(a, b), float(a @ b)
    if np.linalg.norm(v) < 1e-12:
        if c > 0:
            return points.copy()
        other = np.eye(3)[np.argmin(np.abs(a))]
        v = np.cross(a, other)
        v /= np.linalg.norm(v)
        return points @ (2 * np.outer(v, v) - np.eye(3)).T
    m = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return points @ (np.eye(3) + m + m @ m / (1 + c)).T


def superpose(moving: np.ndarray, fixed: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """MAT-7: rotation, translation and RMSD of the best superposition (x R + t), by the Kabsch method."""
    w = np.ones(len(moving)) if weights is None else weights
    w = w / w.sum()
    cm, cf = w @ moving, w @ fixed
    u, _, vt = np.linalg.svd((moving - cm).T @ (w[:, None] * (fixed - cf)))
    sign = np.sign(np.linalg.det(u @ vt)) or 1.0
    r = u @ np.diag([1.0, 1.0, sign]) @ vt
    t = cf - cm @ r
    gap = moving @ r + t - fixed
    return r, t, float(np.sqrt(w @ (gap**2).sum(axis=1)))


def pruned_superposition(moving: np.ndarray, fixed: np.ndarray, cutoff: float = 2.0, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, float]:
    """MAT-8: superposition that drops points farther apart than the cutoff, again until none changes; RMSD over all points."""
    keep = np.ones(len(moving), dtype=bool)
    r, t, _ = superpose(moving, fixed)
    for _ in range(rounds):
        near = np.linalg.norm(moving @ r + t - fixed, axis=1) <= cutoff
        if near.sum() < 3 or np.array_equal(near, keep):
            break
        keep = near
        r, t, _ = superpose(moving[keep], fixed[keep])
    return r, t, float(np.sqrt(((moving @ r + t - fixed) ** 2).sum(axis=1).mean()))


def fit_circle(points: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """AGG-22: centre, radius and plane coordinates of the circle through points projected on their principal plane (Gauss-Newton)."""
    centred = points - points.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    flat = centred @ vt[:2].T
    c, r = flat.mean(axis=0), float(np.linalg.norm(flat - flat.mean(axis=0), axis=1).mean())
    for _ in range(100):
        d = np.linalg.norm(flat - c, axis=1)
        d = np.where(d == 0, 1e-12, d)
        jacobian = np.column_stack([-(flat - c) / d[:, None], -np.ones(len(flat))])
        step = np.linalg.lstsq(jacobian, -(d - r), rcond=None)[0]
        c, r = c + step[:2], r + float(step[2])
        if np.abs(step).max() < 1e-10:
            break
    return c, abs(r), flat


def core_residues(median: np.ndarray, spread: np.ndarray, least: int = 5, steps: int = 100) -> np.ndarray:
    """MAT-9: residues that are confident and steady over the models.

    A grid of a confidence quantile and a spread limit is searched for the best composite of confidence, steadiness and size,
    among cores of 20 to 70 % of the residues; without one, the most confident 40 %.
    """
    relative = spread / np.maximum(median, 1e-9)
    qs, ss = np.quantile(median, np.linspace(0, 1, steps)), np.quantile(relative, np.linspace(0, 1, steps))
    best, score = None, -np.inf
    steady = relative[None, :] <= np.unique(ss)[:, None]
    for q in np.unique(qs):
        cores = steady & (median >= q)[None, :]
        n = cores.sum(axis=1)
        share = n / len(median)
        value = (cores @ median) / np.maximum(n, 1) / 100 - (cores @ relative) / np.maximum(n, 1) + 0.5 * (1 - np.abs(share - 0.45) / 0.45)
        value[(n < least) | (share < 0.2) | (share > 0.7)] = -np.inf
        k = int(value.argmax())
        if value[k] > score:
            best, score = cores[k], value[k]
    if best is None:
        best = median >= np.quantile(median, 0.6)
    return np.flatnonzero(best)


def backbone_mesh(ca: np.ndarray, radius: float = 2.0, around: int = 4) -> np.ndarray:
    """MAT-14: points of a tube about the chain of CA atoms."""
    if len(ca) < 2:
        return ca.copy()
    direction = np.diff(ca, axis=0)
    direction = np.vstack([direction, direction[-1]])
    direction /= np.maximum(np.linalg.norm(direction, axis=1, keepdims=True), 1e-9)
    other = np.where(np.abs(direction[:, :1]) < 0.9, [[1.0, 0, 0]], [[0, 1.0, 0]])
    u = np.cross(direction, other)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = np.cross(direction, u)
    angles = 2 * np.pi * np.arange(around) / around
    ring = radius * (np.cos(angles)[None, :, None] * u[:, None, :] + np.sin(angles)[None, :, None] * v[:, None, :])
    return (ca[:, None, :] + ring).reshape(-1, 3)
