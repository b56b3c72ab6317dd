"""Delaunay triangulation of one block of points: incremental insertion with exact predicates.

Points go in along a space-filling curve. The conflict region of a point is found by a walk
and a flood, and is replaced by a fan around the point. The outside is covered by triangles
with the vertex ``OUT``, one for every hull edge. Signs of determinants come from doubles
where an error bound allows, and from fractions where not. Of equal points the first is the
vertex. Points exactly on a circle do not conflict, so ties depend on the order along the
curve only.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

OUT = -1


def _exact_orient(ax, ay, bx, by, cx, cy) -> int:
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (d > 0) - (d < 0)


def orient(ax, ay, bx, by, cx, cy) -> int:
    """1 if a, b, c turn left, -1 if right, 0 if on a line."""
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    d = left - right
    if abs(d) > 4e-16 * (abs(left) + abs(right)):
        return 1 if d > 0 else -1
    return _exact_orient(ax, ay, bx, by, cx, cy)


def _exact_circle(ax, ay, bx, by, cx, cy, px, py) -> int:
    px, py = Fraction(px), Fraction(py)
    ax, bx, cx = (Fraction(v) - px for v in (ax, bx, cx))
    ay, by, cy = (Fraction(v) - py for v in (ay, by, cy))
    d = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    return (d > 0) - (d < 0)


def in_circle(ax, ay, bx, by, cx, cy, px, py) -> int:
    """1 if p lies inside the circle of the left-turning a, b, c; 0 if on it."""
    adx, ady, bdx, bdy, cdx, cdy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    bc1, bc2, ca1, ca2, ab1, ab2 = bdx * cdy, cdx * bdy, cdx * ady, adx * cdy, adx * bdy, bdx * ady
    a2, b2, c2 = adx * adx + ady * ady, bdx * bdx + bdy * bdy, cdx * cdx + cdy * cdy
    d = a2 * (bc1 - bc2) + b2 * (ca1 - ca2) + c2 * (ab1 - ab2)
    size = a2 * (abs(bc1) + abs(bc2)) + b2 * (abs(ca1) + abs(ca2)) + c2 * (abs(ab1) + abs(ab2))
    if abs(d) > 1.2e-15 * size:
        return 1 if d > 0 else -1
    return _exact_circle(ax, ay, bx, by, cx, cy, px, py)


def curve_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order along a Morton curve of 16 bits a side."""

    def spread(v):
        lo, hi = v.min(), v.max()
        g = ((v - lo) / (hi - lo if hi > lo else 1.0) * 65535).astype(np.uint64)
        for s, m in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            g = (g | (g << np.uint64(s))) & np.uint64(m)
        return g

    return np.argsort(spread(x) | (spread(y) << np.uint64(1)), kind="stable")


class Mesh:
    """Triangles as flat lists: corners ``v`` and, opposite each corner, neighbours ``n``."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x.tolist(), y.tolist()
        self.v: list[int] = []
        self.n: list[int] = []
        self.free: list[int] = []
        self.last = 0
        self.line: list[int] | None = None  # the points, if all lie on a line
        seen: dict[tuple[float, float], int] = {}
        for i, p in enumerate(zip(self.x, self.y, strict=True)):
            seen.setdefault(p, i)
        keep = np.array(sorted(seen.values()), np.int64)
        order = keep[curve_order(x[keep], y[keep])].tolist() if len(keep) else []
        self._build(order)

    def _build(self, order: list[int]) -> None:
        x, y = self.x, self.y
        third = None
        if len(order) > 2:
            a, b = order[0], order[1]
            third = next((k for k in range(2, len(order)) if orient(x[a], y[a], x[b], y[b], x[order[k]], y[order[k]])), None)
        if third is None:
            self.line = sorted(order, key=lambda i: (x[i], y[i]))
            return
        c = order[third]
        if orient(x[a], y[a], x[b], y[b], x[c], y[c]) < 0:
            a, b = b, a
        self.v = [a, b, c, b, a, OUT, c, b, OUT, a, c, OUT]
        self.n = [2, 3, 1, 3, 2, 0, 1, 3, 0, 2, 1, 0]
        for k, p in enumerate(order[2:], 2):
            if k != third:
                self._insert(p)

    def _conflict(self, t: int, px: float, py: float) -> bool:
        v, x, y = self.v, self.x, self.y
        a, b, c = v[3 * t], v[3 * t + 1], v[3 * t + 2]
        if a >= 0 and b >= 0 and c >= 0:
            return in_circle(x[a], y[a], x[b], y[b], x[c], y[c], px, py) > 0
        if a == OUT:
            a, b = b, c
        elif b == OUT:
            a, b = c, a
        side = orient(x[a], y[a], x[b], y[b], px, py)
        if side:
            return side > 0
        return (px - x[a]) * (px - x[b]) + (py - y[a]) * (py - y[b]) < 0

    def _locate(self, px: float, py: float) -> int:
        v, n, x, y, t, came = self.v, self.n, self.x, self.y, self.last, -1
        while True:
            b = 3 * t
            corners = v[b : b + 3]
            if OUT in corners:
                if self._conflict(t, px, py):
                    return t
                t, came = n[b + corners.index(OUT)], t
                continue
            for i in range(3):
                nb = n[b + i]
                if nb == came:
                    continue
                p, q = corners[(i + 1) % 3], corners[(i + 2) % 3]
                if orient(x[p], y[p], x[q], y[q], px, py) < 0:
                    t, came = nb, t
                    break
            else:
                return t

    def _insert(self, p: int) -> None:
        v, n = self.v, self.n
        px, py = self.x[p], self.y[p]
        first = self._locate(px, py)
        hit, stack, rim = {first: True}, [first], []
        while stack:
            t = stack.pop()
            for i in range(3):
                nb = n[3 * t + i]
                if nb not in hit:
                    hit[nb] = self._conflict(nb, px, py)
                    if hit[nb]:
                        stack.append(nb)
                if not hit[nb]:
                    rim.append((v[3 * t + (i + 1) % 3], v[3 * t + (i + 2) % 3], nb, t))
        holes = [t for t, bad in hit.items() if bad]
        start, end = {}, {}
        slots = holes[: len(rim)]
        self.free += holes[len(rim) :]
        while len(slots) < len(rim):
            if self.free:
                slots.append(self.free.pop())
            else:
                slots.append(len(v) // 3)
                v += [0, 0, 0]
                n += [0, 0, 0]
        links = []
        for (a, b, nb, old), t in zip(rim, slots, strict=True):
            # the neighbour's side that looked at the old triangle across (a, b)
            k = 3 * nb
            side = next(j for j in range(3) if n[k + j] == old and v[k + j] != a and v[k + j] != b)
            links.append((k + side, t))
            start[a], end[b] = t, t
        for (a, b, nb, _), t in zip(rim, slots, strict=True):
            v[3 * t : 3 * t + 3] = (a, b, p)
            n[3 * t : 3 * t + 3] = (start[b], end[a], nb)
        for k, t in links:
            n[k] = t
        self.last = slots[0]

    def triangles(self) -> np.ndarray:
        """Corners of the real triangles, left-turning."""
        if not self.v:
            return np.zeros((0, 3), np.int64)
        t = np.array(self.v, np.int64).reshape(-1, 3)
        live = np.ones(len(t), bool)
        live[self.free] = False
        return t[live & (t >= 0).all(1)]

    def edges(self) -> np.ndarray:
        """Distinct edges (u, v), u < v, in order; along the line if there is no triangle."""
        if self.line is not None:
            e = np.array([self.line[:-1], self.line[1:]], np.int64).T.reshape(-1, 2)
        else:
            t = self.triangles()
            e = np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]])
        e = np.sort(e, axis=1)
        return np.unique(e, axis=0) if len(e) else np.zeros((0, 2), np.int64)


def delaunay_edges(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return Mesh(np.asarray(x, float), np.asarray(y, float)).edges()
