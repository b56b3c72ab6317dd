"""One session's model: edges, scales, threshold selection, modes and labels, on arrays.

A session's retained graph is one connected piece of work of bounded size (see
``MAX_EDGES``); it runs inside one Arrow task. Candidate thresholds are not searched one by
one: components of {score <= tau} are those of the minimum spanning forest's edges with
score <= tau, so one forest serves all candidates.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from math import ceil, isfinite, log, log2, sqrt

import numpy as np

from meshflock.plans.triangulation import delaunay_edges

FLOOR = 1e-9
MAX_EDGES = 2_000_000
MODES = ("raw_length", "local_scale", "knn_median", "supported_merge", "saddle_cut", "manifold_filter", "bucket_percentile")
#: Other spellings of the modes.
ALIASES = {"raw": "raw_length", "global": "local_scale", "local": "local_scale", "knn": "knn_median", "merge": "supported_merge", "saddle": "saddle_cut", "manifold": "manifold_filter", "bucket": "bucket_percentile"}


def mode_name(name: str | None) -> str:
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in MODES else "local_scale"


@dataclass(frozen=True)
class Options:
    """Knobs of a fit; defaults are the engine's."""

    threshold: float | None = None
    threshold_mode: str = "local_scale"
    threshold_multiplier: float = 0.0
    min_cluster_size: int = 0
    selection_band: float = 1e-9
    knn_scale_k: int = 0
    bucket_percentile: float = 0.75
    bucket_rings: int = 4
    bucket_min_scores: int = 0
    merge_factor: float = 1.20
    merge_support: int = 8
    saddle_min_clusters: int = 12
    saddle_max_cross: float = 0.05
    saddle_relax: float = 1.05
    saddle_cross: float = 0.40
    manifold_min_clusters: int = 6
    manifold_dataset_anisotropy: float = 0.42
    manifold_core: float = 0.85
    manifold_bridge: float = 2.20
    manifold_alignment: float = 0.85
    manifold_anisotropy: float = 0.35
    freeze_threshold: bool = True

    @classmethod
    def from_strings(cls, pairs: dict[str, str]) -> Options:
        kinds = {f.name: f.type for f in fields(cls)}
        read = {"int": int, "bool": lambda s: s.lower() in ("1", "true"), "str": str}
        return cls(**{k: None if v in ("", "None", None) and k == "threshold" else read.get(kinds[k], float)(v) for k, v in pairs.items() if k in kinds})

    def strings(self) -> dict[str, str]:
        return {k: "" if v is None else str(v) for k, v in asdict(self).items()}


def percentile(sorted_values: np.ndarray, p: float) -> float:
    """Linear interpolation between the two nearest ranks."""
    if not len(sorted_values):
        return 0.0
    at = p * (len(sorted_values) - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    f = at - lo
    return float(sorted_values[lo] * (1 - f) + sorted_values[hi] * f)


def robust_upper(scores: np.ndarray, m: float) -> float:
    s = np.sort(scores)
    if not len(s):
        return float("inf")
    q1, q3 = percentile(s, 0.25), percentile(s, 0.75)
    if q3 - q1 > 1e-12:
        out = q3 + m * (q3 - q1)
    else:
        mid = percentile(s, 0.5)
        out = mid + m * 1.4826 * percentile(np.sort(np.abs(s - mid)), 0.5)
    return out if isfinite(out) and out > 0 else float(s[-1])


def default_min_size(n: int) -> int:
    return 1 if n <= 2 else max(1, ceil(log2(n)))


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of every point's component."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        differ = parent[u] != parent[v]
        u, v = u[differ], v[differ]
    return parent


def forest(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Edges of a minimum spanning forest, lightest first."""
    parent, out = list(range(n)), []

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    order = np.argsort(w, kind="stable")
    for k, a, b in zip(order.tolist(), u[order].tolist(), v[order].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[b] = a
            out.append(k)
    return np.array(out, np.int64)


def neighbours(n: int, u: np.ndarray, v: np.ndarray, by_id: bool) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        out[a].append(b)
        out[b].append(a)
    return [sorted(x) for x in out] if by_id else out


def visit(around: list[list[int]], start: int, most: int) -> list[int]:
    """The first ``most`` points that a breadth-first search meets, without its start."""
    seen, queue, out = {start}, [start], []
    for a in queue:
        for b in around[a]:
            if b not in seen:
                seen.add(b)
                queue.append(b)
                out.append(b)
                if len(out) >= most:
                    return out
    return out


def principal_axis(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, bool]:
    """(axis, anisotropy, valid) of the sample covariance."""
    d = max(len(x) - 1, 1)
    dx, dy = x - x.sum() / len(x), y - y.sum() / len(y)
    xx, xy, yy = float((dx * dx).sum() / d), float((dx * dy).sum() / d), float((dy * dy).sum() / d)
    trace, delta = xx + yy, sqrt((xx - yy) ** 2 + 4 * xy * xy)
    if trace <= FLOOR:
        return 1.0, 0.0, 0.0, False
    big = 0.5 * (trace + delta)
    for a, b in ((xy, big - xx), (big - yy, xy), (1.0, 0.0)):
        if abs(a) + abs(b) > FLOOR:
            break
    size = max(sqrt(a * a + b * b), FLOOR)
    return a / size, b / size, min(1.0, max(0.0, delta / trace)), True


class Fit:
    """A fitted session. ``x, y`` in record order; everything else follows."""

    def __init__(self, x, y, options: Options = Options(), edges: np.ndarray | None = None):
        self.x, self.y, self.o = np.asarray(x, float), np.asarray(y, float), options
        self.n = len(self.x)
        self.mode = mode_name(options.threshold_mode)
        self.min_size = options.min_cluster_size if options.min_cluster_size > 0 else default_min_size(self.n)
        e = delaunay_edges(self.x, self.y) if edges is None else edges
        self.u, self.v = e[:, 0].astype(np.int64), e[:, 1].astype(np.int64)
        dx, dy = self.x[self.u] - self.x[self.v], self.y[self.u] - self.y[self.v]
        self.length = np.sqrt(dx * dx + dy * dy)
        self.activated = False
        self._scales()
        self.score = self.length.copy() if self.mode == "raw_length" else self.length / np.sqrt(np.maximum(self.scale[self.u], FLOOR) * np.maximum(self.scale[self.v], FLOOR))
        self.cap = np.full(len(self.u), np.nan)
        self.trace: list[dict] = []
        self._threshold()
        self._label()

    def _scales(self) -> None:
        whole = max(percentile(np.sort(self.length), 0.5), FLOOR)
        self.scale = np.full(self.n, whole)
        ends = np.concatenate([self.u, self.v])
        length = np.concatenate([self.length, self.length])
        order = np.lexsort((length, ends))
        ends, length = ends[order], length[order]
        start = np.searchsorted(ends, np.arange(self.n + 1))
        deg = np.diff(start)
        has = np.flatnonzero(deg)
        lo, hi = length[start[has] + (deg[has] - 1) // 2], length[start[has] + deg[has] // 2]
        self.scale[has] = np.maximum(np.where(deg[has] % 2 == 1, hi, 0.5 * (lo + hi)), FLOOR)
        if self.mode == "knn_median":
            k = max(1, self.o.knn_scale_k if self.o.knn_scale_k > 0 else default_min_size(self.n))
            around = neighbours(self.n, self.u, self.v, True)
            for i in range(self.n):
                got = visit(around, i, k)
                self.scale[i] = max(percentile(np.sort(np.sqrt((self.x[i] - self.x[got]) ** 2 + (self.y[i] - self.y[got]) ** 2)), 0.5), FLOOR) if got else whole

    def sizes(self, u, v) -> np.ndarray:
        return np.bincount(roots(self.n, u, v), minlength=self.n)

    def _row(self, tau: float, sizes: np.ndarray, retained: int) -> dict:
        """Counts and base objective for component sizes (by root)."""
        n = max(self.n, 1)
        sizes = sizes[sizes > 0]
        big = sizes[sizes >= self.min_size]
        k, noise = len(big), int(sizes.sum() - big.sum())
        largest = int(big.max()) if k else 0
        p = big / n
        h = min(1.0, float(-(p * np.log(p)).sum()) / (log(k) if k > 1 else 1.0)) if k else 0.0
        nf, lf = noise / n, largest / n
        base = (
            0.80 * (1 - nf) + 0.35 * h - 0.45 * lf * lf - 1.50 * max(0.0, lf - 0.65) ** 2 - 0.75 * max(0.0, nf - 0.30) ** 2
            - 0.08 * log2(k + 1) - 0.15 * k / sqrt(n + k) - (1.50 if k < 2 else 0.0)
        )
        edges = len(self.u)
        return {
            "threshold": tau, "selected": 0, "nontrivial": int(k >= 2 and nf <= 0.35), "active_points": self.n, "edge_count": edges, "retained_edges": retained,
            "retained_edge_pct": 100.0 * retained / edges if edges else 0.0, "num_clusters": k, "noise_count": noise, "noise_pct": 100.0 * nf, "largest_cluster": largest,
            "largest_cluster_pct": 100.0 * lf, "component_entropy": h, "base_objective": base, "stability_adjustment": 0.0, "plateau_width_candidates": 1, "plateau_center_offset": 0.0,
            "largest_jump_before_pct": 0.0, "largest_jump_after_pct": 0.0, "noise_drop_after_pct": 0.0, "objective": base,
        }

    def candidates(self) -> list[float]:
        s = np.sort(self.score)
        upper = robust_upper(self.score, self.o.threshold_multiplier)
        found, p = [], 0.35
        while p <= 0.90:
            q = percentile(s, p)
            if q <= upper or not found:
                found.append(q)
            p += 0.025
        return self._spaced([*found, upper])

    @staticmethod
    def _spaced(values: list[float]) -> list[float]:
        out: list[float] = []
        for q in sorted(values):
            if not out or q - out[-1] > 1e-9:
                out.append(q)
        return out

    def _evaluate(self, taus: list[float]) -> list[dict]:
        """One row per threshold; edges above their cap never count."""
        ok = ~(self.score > self.cap) if np.isfinite(self.cap).any() else np.ones(len(self.u), bool)
        u, v, s = self.u[ok], self.v[ok], self.score[ok]
        tree = forest(self.n, u, v, s)
        ordered = np.sort(s)
        rows = []
        for tau in taus:
            use = tree[s[tree] <= tau]
            rows.append(self._row(tau, self.sizes(u[use], v[use]), int(np.searchsorted(ordered, tau, "right"))))
        return rows

    def _stability(self, rows: list[dict]) -> None:
        n, d, size = len(rows), max(1, len(rows) - 1), max(self.n, 1)
        edges = max(len(self.u), 1)
        for i, r in enumerate(rows):
            a = b = i
            while a > 0 and rows[a - 1]["num_clusters"] == r["num_clusters"]:
                a -= 1
            while b + 1 < n and rows[b + 1]["num_clusters"] == r["num_clusters"]:
                b += 1
            width, off = b - a + 1, i - 0.5 * (a + b)
            bonus = max(0.0, 1 - abs(off) / max(1.0, (width - 1) / 2))
            grow = lambda j: max(0.0, (rows[j]["largest_cluster"] - rows[j - 1]["largest_cluster"]) / size) if 0 < j < n else 0.0
            drop = max(0.0, (r["noise_count"] - rows[i + 1]["noise_count"]) / size) if i + 1 < n else 0.0
            jump = max(grow(i), grow(i - 1))
            adj = (
                0.04 * (width - 1) / d + 0.010 * bonus + 0.015 * min(drop, 0.20) - 0.12 * jump
                - 0.05 * max(0.0, i / d - 0.85) ** 2 - 0.12 * max(0.0, r["retained_edges"] / edges - 0.70) ** 2
            )
            r.update(stability_adjustment=adj, plateau_width_candidates=width, plateau_center_offset=off, largest_jump_before_pct=100 * grow(i), largest_jump_after_pct=100 * grow(i + 1), noise_drop_after_pct=100 * drop, objective=r["base_objective"] + adj)

    def _select(self, rows: list[dict]) -> int:
        good = [i for i, r in enumerate(rows) if r["nontrivial"]]
        pool = good or list(range(len(rows)))
        floor = max(rows[i]["base_objective"] for i in pool) - self.o.selection_band
        best = None
        for i in pool:
            if rows[i]["base_objective"] < floor:
                continue
            if best is None or rows[i]["objective"] > rows[best]["objective"] + 1e-9:
                best = i
            elif abs(rows[i]["objective"] - rows[best]["objective"]) <= 1e-9 and (rows[i]["threshold"] < rows[best]["threshold"]) == bool(good):
                best = i
        return best

    def _automatic(self, taus: list[float]) -> float:
        rows = self._evaluate(taus)
        self._stability(rows)
        k = self._select(rows)
        rows[k]["selected"] = 1
        for i, r in enumerate(rows):
            r["candidate_index"] = i
        self.trace = rows
        return rows[k]["threshold"]

    def _threshold(self) -> None:
        o = self.o
        if not len(self.u):
            self.tau = float("inf") if o.threshold is None else o.threshold
            self.effective, self.retained = np.zeros(0), np.zeros(0, bool)
            return
        if self.mode == "bucket_percentile" and o.threshold is None:
            self._bucket()
            return
        if o.threshold is None:
            self.tau = self._automatic(self.candidates())
        else:
            self.tau = o.threshold
            row = self._evaluate([self.tau])[0]
            self.trace = [row | {"selected": 1, "candidate_index": 0}]
        self.effective = np.full(len(self.u), self.tau)
        self.retained = self.score <= self.tau
        after = {"supported_merge": self._merge, "saddle_cut": self._saddle, "manifold_filter": self._manifold}.get(self.mode)
        if after:
            self.activated = bool(after())
            if self.activated:
                row = next(r for r in self.trace if r["selected"])
                final = self._row(self.tau, self.sizes(self.u[self.retained], self.v[self.retained]), int(self.retained.sum()))
                row.update({k: v for k, v in final.items() if k != "selected"})

    def kept_components(self) -> tuple[np.ndarray, int]:
        """Number of each point's component, in order of discovery, -1 for small ones."""
        root = roots(self.n, self.u[self.retained], self.v[self.retained])
        size = np.bincount(root, minlength=self.n)
        big = np.flatnonzero(size >= self.min_size)
        number = np.full(self.n, -1)
        number[big] = np.arange(len(big))  # a root is its component's first record
        return number[root], len(big)

    def _merge(self) -> bool:
        comp, k = self.kept_components()
        if k < 2:
            return False
        near = ~self.retained & (self.score <= np.maximum(self.tau, self.effective) * max(1.0, self.o.merge_factor))
        a, b = comp[self.u], comp[self.v]
        near &= (a >= 0) & (b >= 0) & (a != b)
        key = np.minimum(a, b)[near] * k + np.maximum(a, b)[near]
        pair, n = np.unique(key, return_counts=True)
        pair = pair[n >= self.o.merge_support]
        root = roots(k, pair // k, pair % k)
        joined = near.copy()
        joined[near] = root[a[near]] == root[b[near]]
        self.retained = self.retained | joined
        self.effective = np.where(joined, np.maximum(self.effective, self.score), self.effective)
        return True

    def _saddle(self) -> bool:
        o = self.o
        _, k = self.kept_components()
        if k < max(2, o.saddle_min_clusters):
            return False
        ax, ay, _, _ = principal_axis(self.x, self.y)
        along = (self.x - self.x.sum() / self.n) * ax + (self.y - self.y.sum() / self.n) * ay
        left = along <= np.sort(along)[self.n // 2]
        if min(left.sum(), (~left).sum()) < self.min_size:
            return False
        same = left[self.u] == left[self.v]
        kept = int(self.retained.sum())
        if (int((self.retained & ~same).sum()) / kept if kept else 1.0) > max(0.0, o.saddle_max_cross):
            return False
        base = self.tau if isfinite(self.tau) else 0.0
        self.effective = np.where(same, base * max(1.0, o.saddle_relax), base * max(0.0, o.saddle_cross))
        self._capped()
        return True

    def _capped(self) -> None:
        self.cap = self.effective.copy()
        self.retained = self.score <= self.effective
        self.tau = float(self.effective.sum() / len(self.effective))

    def _manifold(self) -> bool:
        o = self.o
        _, k = self.kept_components()
        if k < max(2, o.manifold_min_clusters):
            return False
        near = max(4, o.knn_scale_k if o.knn_scale_k > 0 else default_min_size(self.n))
        around = neighbours(self.n, self.u, self.v, False)
        axis = np.zeros((self.n, 2))
        flat, valid = np.zeros(self.n), np.zeros(self.n, bool)
        for i in range(self.n):
            got = visit(around, i, max(3 * near, near + 4))
            got = sorted(got, key=lambda j: ((self.x[j] - self.x[i]) ** 2 + (self.y[j] - self.y[i]) ** 2, j))[:near]
            if len(got) >= 2:
                ids = [i, *got]
                axis[i, 0], axis[i, 1], flat[i], valid[i] = principal_axis(self.x[ids], self.y[ids])
        base = self.tau if isfinite(self.tau) else 0.0
        if not valid.any() or flat[valid].sum() / valid.sum() < max(0.0, o.manifold_dataset_anisotropy) or base <= 0:
            return False
        core, bridge = base * max(0.0, o.manifold_core), base * max(o.manifold_core, o.manifold_bridge)
        d = np.stack([self.x[self.v] - self.x[self.u], self.y[self.v] - self.y[self.u]], 1)
        size = np.sqrt((d * d).sum(1))
        d = d / np.maximum(size, FLOOR)[:, None]
        align = np.minimum(np.abs((d * axis[self.u]).sum(1)), np.abs((d * axis[self.v]).sum(1)))
        along = valid[self.u] & valid[self.v] & (size > FLOOR) & (self.score <= bridge) & (align >= min(1.0, max(0.0, o.manifold_alignment)))
        along &= np.minimum(flat[self.u], flat[self.v]) >= min(1.0, max(0.0, o.manifold_anisotropy))
        self.effective = np.where(along, bridge, core)
        self.cap = self.effective.copy()
        self.retained = (self.score <= core) | along
        self.tau = float(self.effective.sum() / len(self.effective))
        return True

    def grid(self) -> tuple[float, float, float, float, int]:
        """(min x, min y, step x, step y, cells a side) of the padded bucket grid."""
        side = max(1, ceil(sqrt(self.n)))
        out = []
        for v in (self.x, self.y):
            lo, hi = float(v.min()), float(v.max())
            pad = max(0.01 * max(hi - lo, FLOOR), FLOOR)
            lo, hi = lo - pad, hi + pad
            out.append((lo, max((hi - lo) / side, FLOOR)))
        return out[0][0], out[1][0], out[0][1], out[1][1], side

    def _bucket(self) -> None:
        o = self.o
        base = self._automatic(self.candidates())
        x0, y0, sx, sy, side = self.grid()
        col = np.clip(np.floor((0.5 * (self.x[self.u] + self.x[self.v]) - x0) / sx).astype(int), 0, side - 1)
        row = np.clip(np.floor((0.5 * (self.y[self.u] + self.y[self.v]) - y0) / sy).astype(int), 0, side - 1)
        cells: dict[tuple[int, int], list[float]] = {}
        for c, r, s in zip(col.tolist(), row.tolist(), self.score.tolist(), strict=True):
            cells.setdefault((c, r), []).append(s)
        need = max(8, o.bucket_min_scores if o.bucket_min_scores > 0 else max(16, 4 * self.min_size))
        p = min(0.95, max(0.35, o.bucket_percentile))
        whole = percentile(np.sort(self.score), p)
        local: dict[tuple[int, int], float] = {}
        for c, r in cells:
            got: list[float] = []
            for ring in range(o.bucket_rings + 1):
                for i in range(c - ring, c + ring + 1):
                    for j in range(r - ring, r + ring + 1):
                        if max(abs(i - c), abs(j - r)) == ring:
                            got += cells.get((i, j), [])
                if len(got) >= need:
                    break
            local[c, r] = percentile(np.sort(got), p) if len(got) >= need else whole
        self.cap = np.minimum(np.array([local[k] for k in zip(col.tolist(), row.tolist(), strict=True)]), base)
        taus = self._spaced([min(r["threshold"], base) for r in self.trace] + [base])
        chosen = self._automatic(taus)
        self.effective = np.minimum(self.cap, chosen)
        self.retained = self.score <= self.effective
        self.tau = float(self.effective.sum() / len(self.effective))

    def _label(self) -> None:
        self.label, self.n_clusters = self.kept_components()
