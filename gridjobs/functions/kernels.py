"""Array helpers that run inside grouped maps; pure functions, numpy only."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence

import numpy as np

NEIGHBOURS = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, -1), (1, 0), (1, 1))}


def edges_2d(i: np.ndarray, j: np.ndarray, nx: int, ny: int, connectivity: int, wrap: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of neighbouring cells, each pair once or more; cells must be distinct."""
    code = i.astype(np.int64) * ny + j
    order = np.argsort(code)
    known = code[order]
    a, b = [], []
    for di, dj in NEIGHBOURS[connectivity]:
        ni, nj = i + di, j + dj
        if wrap:
            ni, nj = ni % nx, nj % ny
            inside = np.ones(len(i), bool)
        else:
            inside = (ni < nx) & (nj >= 0) & (nj < ny)
        want = ni.astype(np.int64) * ny + nj
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        hit = inside & (known[at] == want)
        a.append(np.nonzero(hit)[0])
        b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest vertex reachable over the edges."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        if (pa == pb).all():
            return parent
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def label_2d(i: np.ndarray, j: np.ndarray, nx: int, ny: int, connectivity: int, wrap: bool) -> np.ndarray:
    """For each cell the smallest i * ny + j of its component."""
    code = i.astype(np.int64) * ny + j
    order = np.argsort(code)
    a, b = edges_2d(i[order], j[order], nx, ny, connectivity, wrap)
    out = np.empty(len(i), np.int64)
    out[order] = code[order][smallest_reachable(len(i), a, b)]
    return out


def grow(
    i: np.ndarray, j: np.ndarray, seed: np.ndarray, selected: np.ndarray, nx: int, ny: int, connectivity: int, wrap: bool, max_passes: int | None = None, told: Mapping[tuple[int, int], tuple[int, int]] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(label, pass) of cells grown from seeds: raster sweeps with immediate updates until nothing changes.

    A selected cell without a label takes the label of its labelled neighbours if they have only one between them. Labels never
    change and never go, so a cell is decided at the first visit that sees a label: it takes the only one, or else stays open for
    good. Visits are events (pass, cell) of a heap, in the order of the sweeps; a cell sees a neighbour's label in the same pass if
    the neighbour comes first in raster order, else in the next. Seeds have pass 0, open cells label and pass -1. ``told`` holds
    (pass, label) of cells outside, as known so far.
    """
    cells = list(zip(i.tolist(), j.tolist(), strict=True))
    known = dict(told or {}) | {c: (0, s) for c, s in zip(cells, seed.tolist(), strict=True) if s >= 0}
    waiting = {c for c, s, on in zip(cells, seed.tolist(), selected.tolist(), strict=True) if s < 0 and on}
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])

    def around(c):
        x, y = c
        return [((x + a) % nx, (y + b) % ny) if wrap else (x + a, y + b) for a, b in steps]

    def seen(by, c):
        return max(1, known[by][0] + (by > c))

    events = [(seen(n, c), c) for c in waiting for n in around(c) if n in known]
    heapq.heapify(events)
    while events:
        at, c = heapq.heappop(events)
        if max_passes is not None and at > max_passes:
            break
        if c not in waiting:
            continue
        waiting.discard(c)
        near = around(c)
        labels = {known[n][1] for n in near if n in known and seen(n, c) <= at}
        if len(labels) == 1:
            known[c] = (at, labels.pop())
            for n in near:
                if n in waiting:
                    heapq.heappush(events, (seen(c, n), n))
    got = np.array([known.get(c, (-1, -1)) for c in cells], np.int64).reshape(-1, 2)
    return got[:, 1], got[:, 0]


class Masked2D:
    """Sparse cells of one group: their field moves, dense neighbours hold 1, empty ones 0."""

    def __init__(self, i: np.ndarray, j: np.ndarray, dense_near: np.ndarray, in_grid: np.ndarray, weight: np.ndarray, nx: int, ny: int, wrap: bool):
        n = len(i)
        code = i.astype(np.int64) * ny + j
        order = np.argsort(code)
        known = code[order]
        self.near = np.full((4, n), n)
        for k, (di, dj) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1))):
            ni, nj = i + di, j + dj
            if wrap:
                ni, nj = ni % nx, nj % ny
            inside = (ni >= 0) & (ni < nx) & (nj >= 0) & (nj < ny)
            want = ni.astype(np.int64) * ny + nj
            at = np.minimum(np.searchsorted(known, want), n - 1)
            hit = inside & (known[at] == want)
            self.near[k, hit] = order[at[hit]]
        self.dense_near, self.in_grid, self.weight = dense_near.astype(float), in_grid.astype(float), weight
        self.c = np.zeros(n + 1)

    def step(self, beta: float, own: np.ndarray | None = None) -> float:
        """One update of all cells; the largest change before clipping, of those in ``own`` if given."""
        c = self.c
        lap = c[self.near].sum(0) + self.dense_near - self.in_grid * c[:-1]
        change = beta * self.weight * lap
        c[:-1] = np.clip(c[:-1] + change, 0.0, 1.0)
        return float(np.abs(change if own is None else change[own]).max(initial=0.0))


def diffuse_3d(field: np.ndarray, beta: float, iters: int, known: np.ndarray | None = None, clip: bool = True) -> np.ndarray:
    """Six-neighbour diffusion on a periodic lattice; known cells are reset to their value after each step."""
    c = field.copy()
    for _ in range(iters):
        lap = sum(np.roll(c, s, a) for a in range(3) for s in (1, -1)) - 6.0 * c
        c = c + beta * lap
        if known is not None:
            c[known] = field[known]
        if clip:
            np.clip(c, 0.0, 1.0, out=c)
    return c


def grouped_sums(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, weight of each, their sums): the sum of weighted distances from each (x, y) to the points of each label, a row a label."""
    order = np.argsort(label, kind="stable")
    px, py, label, weight = px[order], py[order], label[order], weight[order]
    start = np.nonzero(np.append(True, label[1:] != label[:-1]))[0]
    sums = np.empty((len(start), len(x)))
    block = max(1, 1_000_000 // len(px))
    for at in range(0, len(x), block):
        dx, dy = x[at : at + block, None] - px[None], y[at : at + block, None] - py[None]
        dx *= dx
        dy *= dy
        dx += dy
        np.sqrt(dx, out=dx)
        dx *= weight
        sums[:, at : at + block] = np.add.reduceat(dx, start, 1).T
    return label[start], np.add.reduceat(weight, start), sums


#: Terms of a series of distances in each of two conjugate coordinates, and their factors: those of (1 + z) ** 0.5, times binomials.
TERMS = 17
_ROOT = np.cumprod([1.0, *((1.5 - n) / n for n in range(1, TERMS))])
_CHOOSE = np.array([[math.comb(n, k) for k in range(TERMS)] for n in range(TERMS)], float)
_FAR = np.array([[_ROOT[i + p] * _CHOOSE[i + p, i] if i + p < TERMS else 0.0 for p in range(TERMS)] for i in range(TERMS)])


def _powers(z: np.ndarray) -> np.ndarray:
    return np.vander(z, TERMS, increasing=True)


def packed_series(m: np.ndarray) -> bytes:
    """A series as bytes: it equals its conjugate transposed, so real parts from the diagonal up and imaginary ones below say all."""
    return (np.triu(m.real) + np.tril(m.imag, -1)).tobytes()


def _series(data: Sequence[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(data)).reshape(-1, TERMS, TERMS)
    up, low = np.triu(m, 1), np.tril(m, -1)
    return up + up.transpose(0, 2, 1) + m * np.eye(TERMS) + 1j * (low - low.transpose(0, 2, 1))


def series_of(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of z ** p * conj(z) ** q of points around the middle of their cell, in sides of the cell."""
    v = _powers(z)
    return (v.T * weight) @ v.conj()


def _quarter(i: int, j: int) -> np.ndarray:
    """Powers of a parent's coordinate from those of its quarter (i, j): row r, column n holds what the r-th gives to the n-th."""
    by = (2 * i - 1 + 1j * (2 * j - 1)) / 4
    return np.array([[_CHOOSE[n, r] * by ** (n - r) / 2**r if n >= r else 0.0 for n in range(TERMS)] for r in range(TERMS)])


_QUARTERS = {(i, j): _quarter(i, j) for i in (0, 1) for j in (0, 1)}


def series_shift(data: bytes, i: int, j: int, up: bool) -> np.ndarray:
    """A quarter's sums as its parent's (``up``), or a parent's series as that of its quarter."""
    b, m = _QUARTERS[int(i), int(j)], _series([data])[0]
    return b.T @ m @ b.conj() if up else b @ m @ b.conj().T


def series_sum(data: bytes) -> np.ndarray:
    return _series([data])[0]


def series_far(data: Sequence[bytes], lv: np.ndarray, i: np.ndarray, j: np.ndarray, to_lv: int, to_i: int, to_j: int) -> np.ndarray:
    """Sums of distances to the points of far cells, each as a series around the middle of another cell; lengths are in sides of the root.

    |w + t - s| = |w| |1 + (t - s) / w|, and |1 + u| is the product of (1 + u) ** 0.5 and its conjugate.
    """
    side, own = 0.5**lv, 0.5**to_lv
    w = (to_i + 0.5) * own - (i + 0.5) * side + 1j * ((to_j + 0.5) * own - (j + 0.5) * side)
    a = _FAR * _powers(own / w)[:, :, None] * _powers(-side / w)[:, None]
    return a @ (_series(data) * np.abs(w)[:, None, None]) @ a.conj().transpose(0, 2, 1)


def series_read(data: bytes, z: np.ndarray) -> np.ndarray:
    """A series' value at points z."""
    v = _powers(z)
    return ((v @ _series([data])[0]) * v.conj()).sum(1).real
