"""DBSCAN by cells against all pairs."""

import numpy as np
import pytest

from meshflock.plans import spatial


def brute(p: np.ndarray, eps: float, least: int) -> list[tuple]:
    d = p[:, None] - p[None]
    with np.errstate(all="ignore"):
        near = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] <= eps * eps
    np.fill_diagonal(near, False)
    core = near.sum(1) + 1 >= least
    out, k = np.full(len(p), -1), 0
    for i in np.flatnonzero(core):
        if out[i] < 0:
            out[i], stack = k, [i]
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if out[j] < 0:
                        out[j] = k
                        stack.append(j)
            k += 1
    for i in np.flatnonzero(~core):
        if (by := np.flatnonzero(near[i] & core)).size:
            out[i] = out[by[0]]
    return [(i, bool(core[i]), int(out[i])) for i in range(len(p))]


def table(spark, p: np.ndarray):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")


def cases() -> dict:
    rng = np.random.default_rng(7)
    grid = np.stack(np.meshgrid(np.arange(12), np.arange(12)), -1).reshape(-1, 2) * 0.25 - 1  # neighbours at exactly eps
    line = np.linspace(0, 1, 150)
    lines = np.concatenate([np.stack([line, 0 * line], 1), np.stack([line, 0 * line + np.nextafter(0.25, 1)], 1), np.stack([line + 3, 0 * line], 1), np.stack([line + 3, 0 * line + 0.25], 1)])
    copies = np.repeat([[0.0, 0.0], [0.25, 0.0], [0.75, 0.0], [5.0, 5.0], [np.nan, 0.0], [np.inf, 0.0], [-1e-20, 0.5], [0.25, 0.5]], 30, 0)
    return {"sparse": (rng.uniform(-2, 2, (250, 2)), 0.25, 4), "dense": (rng.normal(0, 0.5, (900, 2)), 0.25, 5), "grid": (grid, 0.25, 5), "lines": (lines, 0.25, 3), "copies": (copies, 0.25, 5), "odd": (copies[::15], 0.25, 1), "wide": (rng.normal(1e6, 40, (300, 2)), 7.3, 6), "none": (np.zeros((0, 2)), 0.25, 5)}


@pytest.mark.parametrize("few", [1, 256])
@pytest.mark.parametrize("name", cases())
def test_equals_all_pairs(spark, monkeypatch, name, few):
    p, eps, least = cases()[name]
    monkeypatch.setattr(spatial, "FEW", few)
    want = brute(p, eps, least)
    assert sorted(map(tuple, spatial.dbscan(table(spark, p), eps, least).collect())) == want
    assert sorted(r.id for r in spatial.core_points(table(spark, p), eps, least).collect()) == [i for i, c, _ in want if c]


def test_rows_do_not_grow_with_pairs(spark, monkeypatch):
    """Ten times the points write ten times the rows, not a hundred times."""
    written, write = [], spatial.materialize

    def counted(df, tag):
        out = write(df, tag)
        written.append(out.count())
        return out

    monkeypatch.setattr(spatial, "materialize", counted)
    rng, sums = np.random.default_rng(1), []
    for n in (300, 3000):
        written.clear()
        spatial.dbscan(table(spark, rng.normal(0, 0.12, (n, 2))), 0.25, 5).count()
        sums.append(sum(written))
    assert sums[1] < 12 * sums[0], sums
