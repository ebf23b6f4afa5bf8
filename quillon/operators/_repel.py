"""Sums over all pairs of points of a plane, of q = 1 / (1 + squared distance).

Points are sorted into boxes halved level by level.  A pair of boxes of a level
is added up point by point if they hold few points, through the values of q
between NODES * NODES Chebyshev nodes of either box where these represent q,
and through the boxes' quarters otherwise.  No pair is left out: what nodes
stand for is off by some 1e-10 of itself.
"""

from __future__ import annotations

import numpy as np

#: Chebyshev nodes a side of a box, and the least rate at which q converges in
#: them: errors fall as RATE ** -NODES.
NODES, RATE = 12, 7.0

#: Pairs of points up to which a pair of boxes is added up point by point: where
#: nodes would do, and where quarters would have to.
FEW, MANY = 2048, 8192

DEPTH = 30

_K = np.arange(NODES)
_AT = np.cos((2 * _K + 1) * np.pi / (2 * NODES))
_TO = np.cos(np.outer(_K, np.arccos(_AT))) * (np.where(_K, 2, 1) / NODES)[:, None]


def _weights(t: np.ndarray) -> np.ndarray:
    """Of each node in the polynomial through the nodes, at t from -1 to 1."""
    return np.cos(np.arccos(np.clip(t, -1, 1))[:, None] * _K) @ _TO


def _rate(ox, oy, half: float):
    """How fast q converges in the nodes of boxes so many widths apart: its poles
    are at a distance of i * sqrt(1 + squared distance in the other direction)."""

    def one(o, other):
        z = np.maximum(2 * o - 1, 0) + 1j * np.sqrt(half**-2.0 + np.maximum(2 * other - 2, 0) ** 2)
        return np.abs(z + np.sqrt(z - 1) * np.sqrt(z + 1))

    return np.minimum(one(ox, oy), one(oy, ox))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _spread(code: np.ndarray) -> np.ndarray:
    """A zero before each of the 31 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        code = (code | (code << shift)) & mask
    return code


def _through_nodes(out, each, y, start, size, xy, low, half, a, b, rows_of) -> None:
    """Adds what the boxes b send to the boxes a of the same place in the lists."""
    used, place = np.unique(np.r_[a, b], return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    rows, sizes = _ranges(start[used], size[used]), size[used]
    t = (y[rows] - low - np.repeat(xy[used] * 2 + 1, sizes, 0) * half) / half
    wx, wy, ends = _weights(t[:, 0]), _weights(t[:, 1]), np.cumsum(sizes)
    sent = np.empty((len(used), 3, NODES * NODES))
    charged = (each[rows][:, :, None] * wx[:, None]).reshape(len(rows), -1)
    for k, (lo, hi) in enumerate(zip(ends - sizes, ends)):
        sent[k] = (charged[lo:hi].T @ wy[lo:hi]).reshape(3, -1)
    got = np.zeros((2, len(used), 3, NODES * NODES))
    far = xy[used[a]] - xy[used[b]]
    kind = far[:, 0] * (1 << 32) + far[:, 1]
    order = np.argsort(kind, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        dx, dy = (((_AT[:, None] - _AT + 2 * o) * half) ** 2 for o in far[part[0]])
        q = (1 / ((1 + dx)[:, None, :, None] + dy[:, None])).reshape(NODES * NODES, -1)
        m = sent[b[part]].reshape(-1, NODES * NODES)
        got[0, a[part]] += (m @ q.T).reshape(len(part), 3, -1)
        got[1, a[part]] += (m @ (q * q).T).reshape(len(part), 3, -1)
    for k in np.unique(a):
        lo, hi = np.clip(rows_of, start[used[k]], start[used[k]] + sizes[k]) - start[used[k]] + ends[k] - sizes[k]
        g = (wx[lo:hi] @ got[:, k].reshape(6, NODES, NODES).transpose(1, 0, 2).reshape(NODES, -1)).reshape(hi - lo, 6, NODES)
        out[rows[lo:hi]] += np.einsum("rcm,rm->rc", g, wy[lo:hi])
    own = used[a[a == b]]
    rows = _ranges(start[own], size[own])
    out[rows] -= np.column_stack([each[rows], each[rows]])  # a row is no other of its own


def _by_points(out, each, y, start, size, a, b, rows_of) -> None:
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    for lo, hi in zip(first, np.r_[first[1:], len(a)]):
        own = slice(*np.clip(rows_of, start[a[lo]], start[a[lo]] + size[a[lo]]))
        others = _ranges(start[b[lo:hi]], size[b[lo:hi]])
        step = max(1, (1 << 16) // (own.stop - own.start))
        for at in range(0, len(others), step):
            j = others[at : at + step]
            q, dy = y[own, :1] - y[j, 0], y[own, 1:] - y[j, 1]
            q *= q
            dy *= dy
            q += dy
            q += 1
            np.reciprocal(q, out=q)
            self = np.flatnonzero((j >= own.start) & (j < own.stop))
            q[j[self] - own.start, self] = 0
            out[own, :3] += q @ each[j]
            q *= q
            out[own, 3:] += q @ each[j]


def repulsion(y: np.ndarray, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a share of y: its number, and the sums over all other rows
    of q, q * y, q * q and q * q * y.  Shares are ranges in the order of boxes."""
    n, low = len(y), y.min(0)
    side = max(float((y.max(0) - low).max()), 1e-30) * (1 + 1e-12)
    cell = np.minimum(((y - low) * (2.0**DEPTH / side)).astype(np.int64), (1 << DEPTH) - 1)
    code = _spread(cell[:, 0]) << 1 | _spread(cell[:, 1])
    order = np.argsort(code, kind="stable")
    y, cell, code = y[order], cell[order], code[order]
    each, out = np.column_stack([np.ones(n), y]), np.zeros((n, 6))
    rows_of = np.array([n * share // shares, n * (share + 1) // shares])
    start, a, b = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(DEPTH + 1):
        size, xy, half = np.diff(start, append=n), cell[start] >> (DEPTH - level), side / 2 ** (level + 1)
        asked = (start[a] < rows_of[1]) & (start[a] + size[a] > rows_of[0])
        a, b = a[asked], b[asked]
        ox, oy = np.abs(xy[a] - xy[b]).T
        pairs, near = size[a] * size[b], _rate(ox, oy, half) < RATE
        points = pairs <= np.where(near, MANY, FEW) if level < DEPTH else near | (pairs <= FEW)
        nodes, split = ~points & ~near, ~points & near
        if points.any():
            _by_points(out, each, y, start, size, a[points], b[points], rows_of)
        if nodes.any():
            _through_nodes(out, each, y, start, size, xy, low, half, a[nodes], b[nodes], rows_of)
        if not split.any():
            break
        below = np.flatnonzero(np.diff(code >> 2 * (DEPTH - level - 1), prepend=-1))
        child = np.searchsorted(below, start)
        many = np.diff(child, append=len(below))
        a, b = a[split], b[split]
        quarters = many[a]
        left, b = _ranges(child[a], quarters), np.repeat(b, quarters)
        a, b, start = np.repeat(left, many[b]), _ranges(child[b], many[b]), below
    return order[slice(*rows_of)], out[slice(*rows_of)]
