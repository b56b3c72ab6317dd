"""Incremental DBSCAN over one session: exact inserts, and deletes either exact or grow-only.

A grow-only delete takes the point out of later searches and nothing else: neighbours keep
their counts and core flags, and clusters stay joined. It drifts from the exact state, which
is what it is there to show.
"""

from __future__ import annotations

import time
from collections import Counter
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dbscan:
    """Points, neighbour counts (without the point itself), core flags and a union of cores."""

    def __init__(self, eps: float, min_pts: int, exact: bool = True):
        self.eps, self.min_pts, self.exact = eps, min_pts, exact
        self.at: dict[int, tuple[float, float]] = {}
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.count: dict[int, int] = {}
        self.core: set[int] = set()
        self.up: dict[int, int] = {}
        self.next_id = 0

    def cell(self, p):
        return floor(p[0] / self.eps), floor(p[1] / self.eps)

    def near(self, p, but: int | None = None) -> list[int]:
        cx, cy = self.cell(p)
        out = []
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                for k in self.cells.get((cx + i, cy + j), ()):
                    q = self.at[k]
                    if k != but and (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 <= self.eps * self.eps:
                        out.append(k)
        return sorted(out)

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def insert(self, x: float, y: float, key: int | None = None) -> None:
        k = self.next_id if key is None else key
        self.next_id = max(self.next_id, k + 1)
        near = self.near((x, y))
        self.at[k] = (x, y)
        self.cells.setdefault(self.cell((x, y)), set()).add(k)
        self.up[k], self.count[k] = k, len(near)
        grown = [k]
        for n in near:
            self.count[n] += 1
            grown.append(n)
        fresh = [n for n in grown if n not in self.core and self.count[n] + 1 >= self.min_pts]
        self.core |= set(fresh)
        for n in fresh:
            for m in self.near(self.at[n], n):
                if m in self.core:
                    self.join(n, m)

    def nearest(self, x: float, y: float) -> int | None:
        """The nearest point, of equally near ones the first: rings of cells outwards, until no
        farther ring can hold a nearer one, or the rings are more than the cells in use."""
        def distance(k):
            return (self.at[k][0] - x) ** 2 + (self.at[k][1] - y) ** 2, k

        cx, cy = self.cell((x, y))
        best, ring = None, 0
        while self.at and 8 * ring * ring <= len(self.cells) + 8:
            spots = {(cx + i, cy + j) for i in range(-ring, ring + 1) for j in ((-ring, ring) if abs(i) < ring else range(-ring, ring + 1))}
            found = min((distance(k) for spot in spots for k in self.cells.get(spot, ())), default=None)
            best = min((b for b in (best, found) if b is not None), default=None)
            if best is not None and best[0] < (ring * self.eps) ** 2:
                return best[1]
            ring += 1
        return min(map(distance, self.at), default=(None, None))[1]

    def delete(self, x: float, y: float) -> int | None:
        k = self.nearest(x, y)
        if k is None:
            return None
        p = self.at[k]
        self.cells[self.cell(p)].discard(k)
        if not self.cells[self.cell(p)]:
            del self.cells[self.cell(p)]
        if not self.exact:
            del self.at[k]
            return k
        near = self.near(p, k)
        lost = {n for n in [k] if n in self.core}
        touched = {self.find(n) for n in [k, *near] if n in self.core}
        for n in near:
            self.count[n] -= 1
            if n in self.core and self.count[n] + 1 < self.min_pts:
                lost.add(n)
        self.core -= lost
        if touched:  # the clusters that lost something are joined afresh
            members = [m for m in self.up if self.find(m) in touched]
            for m in members:
                self.up[m] = m
        del self.at[k], self.count[k], self.up[k]
        if touched:
            for m in members:
                if m in self.core:
                    for n in self.near(self.at[m], m):
                        if n in self.core:
                            self.join(m, n)
        return k

    def move(self, x: float, y: float, nx: float, ny: float) -> None:
        k = self.delete(x, y)
        if k is not None:
            self.insert(nx, ny, k if self.exact else None)

    def labels(self) -> dict[int, int]:
        """Cluster of every point: cores by component in order of first sight, border points by
        their smallest core neighbour, others -1."""
        number: dict[int, int] = {}
        out = {k: number.setdefault(self.find(k), len(number)) for k in sorted(self.at) if k in self.core}
        for k in self.at:
            if k not in self.core:
                out[k] = next((out[n] for n in self.near(self.at[k], k) if n in self.core), -1)
        return out

    def play(self, op, x, y, nx, ny) -> None:
        if op == "insert":
            self.insert(x, y)
        elif op in ("delete", "remove"):
            self.delete(x, y)
        elif op == "move":
            self.move(x, y, nx, ny)


def agreement(a: list[int], b: list[int]) -> float:
    """Adjusted Rand index of two labelings; 1 where both put all points alike."""
    pairs = lambda counts: sum(n * (n - 1) / 2 for n in counts.values())
    both, left, right, all_ = pairs(Counter(zip(a, b, strict=True))), pairs(Counter(a)), pairs(Counter(b)), len(a) * (len(a) - 1) / 2
    chance = left * right / all_ if all_ else 0.0
    most = (left + right) / 2
    return 1.0 if most == chance else (both - chance) / (most - chance)


LOG = "session string, step long, operation string, incr_ns long, full_ns long, n_active long, incr_ari double"


def step_log(updates: DataFrame, eps: float, min_pts: int, every: int = 1, exact: bool = True) -> DataFrame:
    """One row per operation; at every ``every``-th the agreement with a run from scratch over
    the points present (else ``incr_ari`` is -2 and ``full_ns`` -1)."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("seq").to_pydict()
        d = Dbscan(eps, min_pts, exact)
        rows = []
        for row in zip(t["op"], t["x"], t["y"], t["new_x"], t["new_y"], strict=True):
            began = time.perf_counter_ns()
            d.play(*row)
            spent, full, ari = time.perf_counter_ns() - began, -1, -2.0
            if (len(rows) + 1) % every == 0:
                began = time.perf_counter_ns()
                fresh = Dbscan(eps, min_pts)
                for k in sorted(d.at):
                    fresh.insert(*d.at[k], k)
                want = fresh.labels()
                full = time.perf_counter_ns() - began
                have = d.labels()
                ari = agreement([have[k] for k in sorted(d.at)], [want[k] for k in sorted(d.at)])
            rows.append((t["session"][0], len(rows) + 1, row[0], spent, full, len(d.at), ari))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({c.split()[0]: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(LOG.split(", "), kinds, strict=True))})

    cols = updates.select(F.col("session").cast("string").alias("session"), "seq", "op", "x", "y", "new_x", "new_y")
    return cols.groupBy("session").applyInArrow(run, LOG)


def replay(updates: DataFrame, eps: float, min_pts: int, exact: bool = True) -> DataFrame:
    """Final (session, id, x, y, is_core, cluster_id) of every session's updates."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("seq").to_pydict()
        d = Dbscan(eps, min_pts, exact)
        for row in zip(t["op"], t["x"], t["y"], t["new_x"], t["new_y"], strict=True):
            d.play(*row)
        lab = d.labels()
        ids = sorted(lab)
        return pa.table({
            "session": pa.array([t["session"][0]] * len(ids), pa.string()), "id": pa.array(ids, pa.int64()), "x": pa.array([d.at[i][0] for i in ids], pa.float64()), "y": pa.array([d.at[i][1] for i in ids], pa.float64()),
            "is_core": pa.array([i in d.core for i in ids], pa.bool_()), "cluster_id": pa.array([lab[i] for i in ids], pa.int32()),
        })

    cols = updates.select(F.col("session").cast("string").alias("session"), "seq", "op", "x", "y", "new_x", "new_y")
    return cols.groupBy("session").applyInArrow(run, "session string, id long, x double, y double, is_core boolean, cluster_id int")
