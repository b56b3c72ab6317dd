import numpy as np
import pytest

from meshflock.plans import spatial
from meshflock.plans.components import components
from meshflock.plans.model import Fit, Options
from meshflock.plans.triangulation import delaunay_edges
from meshflock.sources.points import assign, load_model, read_points, read_updates, save_model
from meshflock.streaming.dbscan import Dbscan
from meshflock.streaming import verify
from meshflock.streaming.sessions import REPORT, NetDelta, Session, _play


def frame(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")


@pytest.mark.parametrize("kind", ["normal", "clusters"])
def test_tiles_equal_one_block(spark, kind):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 1500)) if kind == "normal" else np.concatenate([rng.normal(c, s, size=(500, 2)) for c, s in ((0, 1), (9, 0.01), ((3, -7), 0.3))]).T
    got = sorted((r.u, r.v) for r in spatial.delaunay(frame(spark, x, y), one_task=400).collect())
    assert got == [tuple(e) for e in delaunay_edges(x, y).tolist()]


@pytest.mark.parametrize("spread", [False, True])
def test_components_equal_union_find(spark, spread, monkeypatch):
    rng = np.random.default_rng(4)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)]
    parent = {x: x for p in e for x in p}
    for _ in parent:
        for a, b in e:
            parent[a] = parent[b] = min(parent[a], parent[b])
    want = sorted((n, c) for n, c in parent.items() if any(a != b and n in (a, b) for a, b in e))
    df = spark.createDataFrame(e, "u long, v long")
    if spread:  # many partitions, and tasks that hold a few edges at a time
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        monkeypatch.setattr("meshflock.plans.components.CHUNK", 8)
    try:
        assert sorted(map(tuple, components(df).collect())) == want
        assert components(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_walk_touches_its_ends():
    grid = (0.0, 0.0, 1.0, 1.0, 10)
    assert spatial.walk(0.5, 0.5, 3.5, 0.5, grid) == [0, 1, 2, 3]
    assert spatial.walk(0.5, 0.5, 2.5, 2.5, grid) == [0, 11, 22]  # through corners
    rng = np.random.default_rng(0)
    for ax, ay, bx, by in (rng.random((200, 4)) * 10).tolist():
        cells = spatial.walk(ax, ay, bx, by, grid)
        steps = {(int(ay + (by - ay) * t) * 10 + int(ax + (bx - ax) * t)) for t in np.linspace(0, 1, 101)}
        assert steps <= set(cells)


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y\nname,z\n1,2,3\n\n4,5\n7\n 8 , 9 ,1.6\n")
    assert [tuple(r) for r in read_points(spark, str(tmp_path / "p.csv")).orderBy("id").collect()] == [(0, 1.0, 2.0, 3), (1, 4.0, 5.0, None), (2, 8.0, 9.0, 2)]
    (tmp_path / "bad.csv").write_text("1,2\na,b\n")
    with pytest.raises(Exception, match="not a point"):
        read_points(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "u.csv").write_text("operation,x,y\ninsert,1,2,0\nremove,1,2\nmove,1,2,3,4\n5,6\nmove,1\n")
    got = [(r.op, r.x, r.new_x) for r in read_updates(spark, str(tmp_path / "u.csv"), strict=False).orderBy("seq").collect()]
    assert got == [("insert", 1.0, None), ("delete", 1.0, None), ("move", 1.0, 3.0), ("insert", 5.0, None)]
    with pytest.raises(Exception, match="not an operation"):
        read_updates(spark, str(tmp_path / "u.csv")).collect()


def blobs(seed=42, n=40):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal([-2, 0], 0.1, (n, 2)), rng.normal([2, 0], 0.1, (n, 2))])


def test_model_directory(spark, tmp_path):
    p = blobs()
    save_model(frame(spark, *p.T), Options(threshold=1.5), str(tmp_path / "m"))
    options, points, labels = load_model(spark, str(tmp_path / "m"))
    assert options == Options(threshold=1.5) and points.count() == 80
    q = spark.createDataFrame([(1, -2.0, 0.0), (2, 50.0, 0.0), (3, 2.0, 0.0)], "id long, x double, y double")
    got = {r.id: r.cluster_id for r in assign(q, labels).collect()}
    assert got[1] == 0 and got[2] == got[3] == 1
    assert [r.is_noise for r in assign(q, labels.limit(0)).collect()] == [True] * 3


def play(s, seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        r, (x, y) = rng.random(), rng.normal(0, 1.5, 2)
        rows.append(s.apply("insert", x, y) if r < 0.6 else s.apply("delete", x, y) if r < 0.8 else s.apply("move", x, y, x + 0.1, y))
    return rows


@pytest.mark.parametrize("mode", ["local_scale", "raw_length"])
def test_sessions_stay_exact(mode):
    s = Session(Options(threshold_mode=mode), check=True).base(blobs())
    rows = play(s, 20260618, 60)
    assert sum(r["verification_checked"] for r in rows) >= 55 and not any(r["verification_mismatches"] for r in rows)
    assert set(rows[0]) == set(REPORT)
    again = Session.restore(s.state(), s.o)
    assert again.label == s.label and again.nearest(0, 0) == s.nearest(0, 0)


def test_coincident_and_empty():
    s = Session(check=True)
    assert s.apply("delete", 0, 0)["affected_cells"] == 0
    assert s.apply("insert", 0, 0)["verification_mismatches"] == 0
    assert s.apply("insert", 0, 0)["verification_checked"] == 0  # on an existing point
    s.apply("insert", 1, 0)
    assert s.apply("move", 1, 0, 0, 0)["verification_checked"] == 0  # onto another point
    assert len(s.at) == 2


def test_cluster_ids_survive():
    s = Session(Options(threshold=1.5)).base(blobs())
    before = {k: s.label[k] for k in (0, 79)}
    for _ in range(5):
        s.apply("delete", -2, 0)
    assert s.label[79] == before[79] and {s.label[i] for i in s.at if i < 40} <= {before[0], -1}


def full(at, eps, least):
    ids = sorted(at)
    near = {i: [j for j in ids if j != i and (at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2 <= eps * eps] for i in ids}
    core = [i for i in ids if len(near[i]) + 1 >= least]
    out, k = dict.fromkeys(ids, -1), 0
    for i in core:
        if out[i] < 0:
            out[i], stack = k, [i]
            while stack:
                for j in near[stack.pop()]:
                    if j in core and out[j] < 0:
                        out[j] = k
                        stack.append(j)
            k += 1
    for i in ids:
        if i not in core:
            out[i] = next((out[j] for j in near[i] if j in core), -1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exact_dbscan(seed):
    d, rng = Dbscan(0.5, 4), np.random.default_rng(seed)
    for _ in range(150):
        r, (x, y) = rng.random(), rng.normal(0, 1, 2)
        d.play("insert" if r < 0.6 else "delete" if r < 0.8 else "move", x, y, x + 0.3, y)
        assert d.labels() == full(d.at, 0.5, 4)


def test_session_fit_needs_no_edges():
    assert Fit([0.0, 1.0], [0.0, 0.0]).label.tolist() == [0, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_grow_only_dbscan(seed):
    """Deletes change no count, core flag or join; inserts see present points only."""
    d = Dbscan(0.5, 3, exact=False)
    for x in (0, 0.1, 0.2):
        d.insert(x, 0)
    d.delete(0.2, 0)
    assert d.labels() == {0: 0, 1: 0}
    rng = np.random.default_rng(seed)
    d = Dbscan(0.6, 4, exact=False)
    at, count, core, joined = {}, {}, set(), []
    for _ in range(300):
        x, y = rng.uniform(-2, 2, 2).tolist()
        k = len(count)
        if rng.random() < 0.7 or not at:
            d.insert(x, y)
            near = [j for j, q in at.items() if (q[0] - x) ** 2 + (q[1] - y) ** 2 <= 0.36]
            at[k], count[k] = (x, y), len(near)
            for j in near:
                count[j] += 1
            for c in [c for c in (k, *near) if c not in core and count[c] + 1 >= 4]:
                core.add(c)
            for c in (k, *near):
                if c in core:
                    joined += [(c, j) for j, q in at.items() if j in core and (q[0] - at[c][0]) ** 2 + (q[1] - at[c][1]) ** 2 <= 0.36]
        else:
            j = min(at, key=lambda j: ((at[j][0] - x) ** 2 + (at[j][1] - y) ** 2, j))
            assert d.delete(x, y) == j
            del at[j]
    assert set(d.at) == set(at) and d.core == core
    root = {k: k for k in count}
    for _ in root:
        for a, b in joined:
            root[a] = root[b] = min(root[a], root[b])
    lab = d.labels()
    cores = [k for k in at if k in core]
    assert all((lab[a] == lab[b]) == (root[a] == root[b]) for a in cores for b in cores)
    far = Dbscan(0.01, 2)
    far.insert(5, 5)
    far.insert(-900, 3)
    assert far.nearest(-100, 0) == 0 and far.nearest(-800, 0) == 1


def test_ids_go_to_the_cluster_with_most_members():
    s = Session()
    s.label = {i: 0 if i < 8 else 1 for i in range(18)}
    s._name({i: 5 if 5 <= i < 8 else 3 for i in range(18)})
    assert {s.label[i] for i in range(5, 8)} == {2} and s.label[0] == s.label[17] == 1


def test_late_operations_are_reported():
    from types import SimpleNamespace

    row = lambda seq, x: SimpleNamespace(session="a", seq=seq, op="insert", x=x, y=0.0, new_x=None, new_y=None)
    s = Session()
    got = _play(s, [row(5, 1.0), row(6, 2.0)]) + _play(Session.restore(s.state(), s.o), [row(3, 9.0), row(7, 3.0)])
    assert [(r["seq"], r["operation"]) for r in got] == [(5, "insert"), (6, "insert"), (3, "rejected"), (7, "insert")]


@pytest.mark.parametrize("mode", ["local_scale", "raw_length"])
def test_verifier_finds_wrong_states(mode):
    s = Session(Options(threshold_mode=mode)).base(blobs())
    assert s.mismatches() == 0
    f = s.fit
    s.label = dict.fromkeys(s.label, 0)
    assert s.mismatches() > 0
    s._refit()
    s.fit.retained = ~s.fit.retained
    assert s.mismatches() > 0
    f.u, f.v, f.retained = f.u[1:], f.v[1:], f.retained[1:]
    assert verify.wrong_edges(f.x, f.y, f.u, f.v) > 0
    x, y = np.array([0.0, 2.0, 1.0, 1.0]), np.array([0.0, 0.0, 0.3, -5.0])
    e = delaunay_edges(x, y)
    assert verify.wrong_edges(x, y, e[:, 0], e[:, 1]) == 0
    swapped = np.array([[2, 3] if p == [0, 1] else p for p in e.tolist()])
    assert verify.wrong_edges(x, y, swapped[:, 0], swapped[:, 1]) > 0
    line = np.arange(4.0)
    assert verify.wrong_edges(line, line, np.arange(3), np.arange(1, 4)) == 0


def test_state_table_goes_on_after_a_restart(spark, tmp_path):
    """Two batches with a restart between them, the second one played twice."""
    cols = "session string, seq long, op string, x double, y double, new_x double, new_y double"
    rng = np.random.default_rng(3)
    ops = [("a" if i % 3 else "b", i, "insert", *rng.normal(size=2).tolist(), None, None) for i in range(60)]
    one, two = (spark.createDataFrame(p, cols) for p in (ops[:30], ops[30:]))
    NetDelta(str(tmp_path))(one, 0)
    for _ in range(2):
        NetDelta(str(tmp_path))(two, 1)
    net = NetDelta(str(tmp_path))
    assert net.committed(spark) == [0, 1]
    got = {r.session: (r.ids, r.xs) for r in net.current(spark).collect()}
    for name in "ab":
        s = Session()
        for o in ops:
            if o[0] == name:
                s.apply("insert", o[3], o[4])
        assert got[name] == s.state()[:2]
