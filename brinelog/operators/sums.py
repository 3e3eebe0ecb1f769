"""Gaussian sums over the points within reach of places on the sphere, without a step for each pair.

Points lie in a tree of cells. Where a whole cell lies within a place's reach, its points count as they are and their weights are summed over
a few Chebyshev nodes instead, as many as keep the error of each point's weight below 1e-15; a cell that lies outside adds nothing; one that the
reach cuts is taken apart, down to its points. So a place costs as many steps as there are points along the edge of its reach, and some for what
lies inside, whatever lies there."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

RADIUS_KM = 6371.0
LEAF, PAIRS = 64, 1 << 16
FLAT = 0.1  # radians from the middle within which a cell is flat enough for nodes


class Cell(NamedTuple):
    centre: np.ndarray
    radius: float  # chord from the centre that holds all points
    count: int
    nodes: np.ndarray
    weights: np.ndarray
    parts: list[Cell]  # none: the nodes are the points


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    phi, lam = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], axis=1)


def squared_km(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Squares of the great circle distances between unit vectors, from sin(angle / 2) ** 2; short ones by the series of arcsin(x) ** 2."""
    a = np.square(v[:, 0, None] - u[:, 0])
    a += np.square(v[:, 1, None] - u[:, 1])
    a += np.square(v[:, 2, None] - u[:, 2])
    a *= 0.25
    if a.size and a.max() > 1e-3:
        return np.square(2 * RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a))))
    return (4 * RADIUS_KM**2) * a * (1 + a * (1 / 3 + a * (8 / 45 + a * (4 / 35 + a * (128 / 1575)))))


def terms(half: float) -> int:
    """Nodes along a side of `half` standard deviations that keep the error of a Gaussian below 1e-15."""
    m, error = 1, half
    while error > 1e-15:
        m += 1
        error *= half / 2 / math.sqrt(m)
    return m


def basis(x: np.ndarray, m: int) -> np.ndarray:
    """The m Chebyshev nodes' polynomials at x in -1..1."""
    angle = np.arccos(np.clip(x, -1.0, 1.0))
    k = np.arange(m)
    share = np.cos(k * (math.pi * (k[:, None] + 0.5) / m)) * (2 / m)
    share[:, 0] /= 2
    return share @ np.cos(k[:, None] * angle)


def tree(u: np.ndarray, sigma: float) -> Cell:
    middle = u.mean(0)
    length = float(np.linalg.norm(middle))
    middle = middle / length if length > 1e-9 else u[0]
    east = np.cross(np.eye(3)[np.argmin(np.abs(middle))], middle)
    east /= np.linalg.norm(east)
    north = np.cross(middle, east)
    flat = np.stack([u @ east, u @ north], axis=1)
    even = bool((u @ middle).min() > math.cos(FLAT))
    lifted = lambda p: p[:, :1] * east + p[:, 1:] * north + np.sqrt(np.maximum(0.0, 1 - np.square(p).sum(1)))[:, None] * middle

    def cell(own: np.ndarray) -> Cell:
        p, at = flat[own], u[own]
        low, high = p.min(0), p.max(0)
        mid, half = (low + high) / 2, (high - low) / 2
        centre = lifted(mid[None])[0] if even else at.mean(0)
        radius = float(np.sqrt(np.square(at - centre).sum(1).max()))
        side = (p > mid) @ np.array([1, 2])
        if len(own) <= LEAF or (side == side[0]).all():
            return Cell(centre, radius, len(own), at, np.ones(len(own)), [])
        parts = [cell(own[side == k]) for k in range(4) if (side == k).any()]
        m = [terms(h * RADIUS_KM / sigma) for h in half] if even else [len(own), 1]
        if m[0] * m[1] >= len(own):
            return Cell(centre, radius, len(own), at, np.ones(len(own)), parts)
        x, y = (basis((p[:, k] - mid[k]) / (half[k] or 1.0), m[k]) for k in (0, 1))
        nodes = [mid[k] + half[k] * np.cos(math.pi * (np.arange(m[k]) + 0.5) / m[k]) for k in (0, 1)]
        grid = np.stack(np.meshgrid(*nodes, indexing="ij"), axis=-1).reshape(-1, 2)
        return Cell(centre, radius, len(own), lifted(grid), (x @ y.T).ravel(), parts)

    return cell(np.arange(len(u)))


def near_sums(lat: np.ndarray, lon: np.ndarray, p_lat: np.ndarray, p_lon: np.ndarray, sigma: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place the sum of exp(-0.5 (km / sigma) ** 2) over the points (p_lat, p_lon) within `reach` km, and their number."""
    weight, count = np.zeros(len(lat)), np.zeros(len(lat), np.int64)
    if not len(lat) or not len(p_lat):
        return weight, count
    v = unit(lat, lon)
    chord = 2 * math.sin(min(math.pi, reach / RADIUS_KM) / 2)

    def added(at: Cell, rows: np.ndarray, cut: bool) -> None:
        step = max(1, PAIRS // len(at.nodes))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            km2 = squared_km(v[some], at.nodes)
            worth = np.exp(km2 * (-0.5 / sigma**2))
            if cut:
                near = km2 <= reach * reach
                count[some] += near.sum(1)
                worth *= near
            weight[some] += worth @ at.weights

    open_ = [(tree(unit(p_lat, p_lon), sigma), np.arange(len(lat)))]
    while open_:
        at, rows = open_.pop()
        far = np.sqrt(np.square(v[rows] - at.centre).sum(1))
        inside = far + at.radius < chord * (1 - 1e-9)
        if inside.any():
            whole = rows[inside]
            count[whole] += at.count
            added(at, whole, False)
        rows = rows[~inside & (far - at.radius <= chord * (1 + 1e-9))]
        if len(rows) and at.parts:
            open_ += [(part, rows) for part in at.parts]
        elif len(rows):
            added(at, rows, True)
    return weight, count
