import numpy as np
import pytest

from golden_values import ARI, SELECTED
from meshflock.functions.metrics import ari
from meshflock.plans.model import Fit, Options
from meshflock.plans.triangulation import Mesh, delaunay_edges, in_circle
from meshflock.sources.generators import FAMILIES

def brute(x, y):
    """Edges with an empty circle, by all triples."""
    n, out = len(x), set()
    for a in range(n):
        for b in range(a + 1, n):
            for c in range(b + 1, n):
                d = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
                if d == 0:
                    continue
                p, q = (b, c) if d > 0 else (c, b)
                if all(in_circle(x[a], y[a], x[p], y[p], x[q], y[q], x[k], y[k]) <= 0 for k in range(n) if k not in (a, b, c)):
                    out |= {(a, b), (a, c), (b, c)}
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_empty_circles(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(2, 24))
    assert [tuple(e) for e in delaunay_edges(x, y)] == brute(x, y)


def hull_size(x, y):
    pts = sorted(set(zip(x.tolist(), y.tolist())))

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) < 0:
                out.pop()
            out.append(p)
        return out

    return len(half(pts)) + len(half(pts[::-1])) - 2


@pytest.mark.parametrize("kind", ["grid", "circle", "random", "duplicates"])
def test_counts(kind):
    rng = np.random.default_rng(0)
    if kind == "grid":
        x, y = (v.ravel().astype(float) for v in np.meshgrid(range(12), range(9)))
    elif kind == "circle":
        a = np.arange(40) * 2 * np.pi / 40
        x, y = np.cos(a), np.sin(a)
    else:
        x, y = rng.random((2, 1500))
        if kind == "duplicates":
            x, y = np.concatenate([x, x[:300]]), np.concatenate([y, y[:300]])
    n = len(set(zip(x.tolist(), y.tolist())))
    m = Mesh(x, y)
    h = hull_size(x, y)
    assert len(m.triangles()) == 2 * n - 2 - h and len(m.edges()) == 3 * n - 3 - h


def test_degenerate():
    assert len(delaunay_edges([], [])) == 0 and len(delaunay_edges([1.0], [2.0])) == 0
    assert delaunay_edges([0, 2, 1, 1], [0, 2, 1, 1]).tolist() == [[0, 2], [1, 2]]
    for n in range(4):
        f = Fit(np.arange(n, dtype=float), np.zeros(n))
        assert len(f.label) == n


@pytest.mark.parametrize("family,seed", sorted(SELECTED))
def test_published_selection(family, seed):
    x, _ = FAMILIES[family](seed)
    row = next(r for r in Fit(x[:, 0], x[:, 1]).trace if r["selected"])
    want = SELECTED[family, seed]
    assert row["threshold"] == pytest.approx(want[0], rel=1e-12)
    assert (row["retained_edges"], row["num_clusters"], row["noise_count"], row["largest_cluster"]) == want[1:]


@pytest.mark.parametrize("family,mode", sorted(ARI))
def test_published_scores(family, mode):
    x, truth = FAMILIES[family](42)
    assert ari(truth, Fit(x[:, 0], x[:, 1], Options(threshold_mode=mode)).label) == pytest.approx(ARI[family, mode], abs=1e-12)
