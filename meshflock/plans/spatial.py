"""The spatial engine as DataFrame plans.

Points: (id long, x double, y double, ...). Ids order the records. Edges: (u, v, length).
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshflock.plans.components import components
from meshflock.plans.model import FLOOR, Fit, Options, default_min_size
from meshflock.plans.triangulation import Mesh, in_circle
from meshflock.runtime import materialize

ONE_TASK = 20_000
MARGIN = 0.1  # of a tile's width, read on every side of it
FEW = 256  # comparisons of points by which two boxes are settled


# ---- Delaunay join -------------------------------------------------------------------


def _block_edges(table: pa.Table) -> pa.Table:
    t = table.sort_by("id")
    ids, x, y = (t.column(c).to_numpy() for c in ("id", "x", "y"))
    e = Mesh(x, y).edges()
    return pa.table({"u": ids[e[:, 0]], "v": ids[e[:, 1]]})


def circles(x, y, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii of triangles."""
    ax, ay = x[t[:, 0]], y[t[:, 0]]
    bx, by, cx, cy = x[t[:, 1]] - ax, y[t[:, 1]] - ay, x[t[:, 2]] - ax, y[t[:, 2]] - ay
    d = 2 * (bx * cy - by * cx)
    with np.errstate(all="ignore"):
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        r = np.sqrt(ux * ux + uy * uy) * (1 + 1e-6)
    flat = ~(np.abs(d) > 1e-8 * (np.abs(bx * cy) + np.abs(by * cx)))  # too flat for a centre: the circle may be anywhere
    return np.where(flat, 0.0, ax + ux), np.where(flat, 0.0, ay + uy), np.where(flat, np.inf, r)


def holders(low: np.ndarray, high: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in v, interval) for every interval that holds a value. Intervals come in the order
    of what they surround, so those that may hold a value stand together."""
    first = np.searchsorted(np.maximum.accumulate(high), v, "left")
    last = np.searchsorted(np.minimum.accumulate(low[::-1])[::-1], v, "right")
    times = np.maximum(last - first, 0)
    at = np.repeat(np.arange(len(v)), times)
    k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times - first, times)
    there = (low[k] <= v[at]) & (v[at] <= high[k])
    return at[there], k[there]


def _tiled_edges(points: DataFrame, n: int, tile: int) -> DataFrame:
    """Tiles with a margin are triangulated on their own. A triangle is certain if its circle
    stays, inside the bounds of all points, within the rectangle that the tile has read.
    Points with an uncertain triangle or on a tile's hull are triangulated once more in one
    task; of its triangles those stay whose circle is empty of all points (a grid join)."""
    side = max(2, ceil(sqrt(n / tile)))
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, x1, y0, y1 = map(float, b)
    xs = [x0, *points.approxQuantile("x", [k / side for k in range(1, side)], 0.001), x1]
    stripe = sum((F.col("x") >= c).cast("int") for c in xs[1:-1]) if side > 1 else F.lit(0)
    cuts = points.withColumn("s", stripe).groupBy("s").agg(F.percentile_approx("y", F.array(*[F.lit(k / side) for k in range(1, side)]), F.lit(1000)).alias("q")).collect()
    ys = {r.s: [y0, *r.q, y1] for r in cuts}
    rect = {}
    for s in range(side):
        for k in range(side):
            q = ys.get(s, [y0] + [y1] * side)
            mx, my = MARGIN * (xs[s + 1] - xs[s]), MARGIN * (q[k + 1] - q[k])
            rect[s * side + k] = (xs[s] - mx, xs[s + 1] + mx, q[k] - my, q[k + 1] + my)

    low_x, high_x = (np.array([rect[s * side][e] for s in range(side)]) for e in (0, 1))
    low_y, high_y = ([np.array([rect[s * side + k][e] for k in range(side)]) for s in range(side)] for e in (2, 3))
    cuts_y = [ys.get(s, [y0] + [y1] * side)[1:-1] for s in range(side)]

    def deal(batches):
        for batch in batches:
            ids, x, y = (batch.column(k).to_numpy() for k in range(3))
            own_s = np.searchsorted(xs[1:-1], x, "right")
            near, stripes = holders(low_x, high_x, x)
            out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2 + (np.zeros(0, bool),)]
            for s in np.unique(stripes).tolist():
                i = near[stripes == s]
                j, k = holders(low_y[s], high_y[s], y[i])
                i = i[j]
                mine = (own_s[i] == s) & (k == np.searchsorted(cuts_y[s], y[i], "right"))
                out.append((s * side + k, ids[i], x[i], y[i], mine))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tile", "id", "x", "y", "own"])

    def solve(table: pa.Table) -> pa.Table:
        k = table.column("tile")[0].as_py()
        t = table.sort_by("id")
        ids, x, y, own = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x", "y", "own"))
        tri = Mesh(x, y).triangles()
        a, bb, c, d = rect[k]
        cx, cy, r = circles(x, y, tri)
        sure = (np.maximum(cx - r, x0) >= a) & (np.minimum(cx + r, x1) <= bb) & (np.maximum(cy - r, y0) >= c) & (np.minimum(cy + r, y1) <= d)
        e = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
        once = np.sort(e, axis=1)
        _, which, times = np.unique(once, axis=0, return_inverse=True, return_counts=True)
        open_point = np.zeros(len(x), bool)
        open_point[once[times[which.ravel()] == 1].ravel()] = True  # on the hull of what was read
        open_point[tri[~sure].ravel()] = True
        if not len(tri):
            open_point[:] = True
        open_point &= own
        mine = sure & own[tri].any(1)
        good = np.unique(np.concatenate([np.sort(tri[mine][:, p], axis=1) for p in ([0, 1], [1, 2], [2, 0])]), axis=0)
        rest = np.flatnonzero(open_point)
        nan = np.full(len(good), np.nan)
        return pa.table({
            "u": np.concatenate([ids[good[:, 0]], ids[rest]]), "v": np.concatenate([ids[good[:, 1]], np.full(len(rest), -1)]),
            "x": np.concatenate([nan, x[rest]]), "y": np.concatenate([nan, y[rest]]),
        })

    done = materialize(points.select("id", "x", "y").mapInArrow(deal, "tile long, id long, x double, y double, own boolean").groupBy("tile").applyInArrow(solve, "u long, v long, x double, y double"), "tiles")
    rest = done.where("v = -1").select(F.col("u").alias("id"), "x", "y").distinct()
    cells = 4 * side
    wx, wy = max((x1 - x0) / cells, 1e-300), max((y1 - y0) / cells, 1e-300)

    def doubtful(table: pa.Table) -> pa.Table:
        t = table.sort_by("id")
        ids, x, y = (t.column(c).to_numpy() for c in ("id", "x", "y"))
        mesh = Mesh(x, y)
        tri = mesh.triangles()
        cx, cy, r = circles(x, y, tri)
        out = [(np.full(len(tri), -1), np.arange(len(tri)))]  # so that a triangle far from all points is not lost
        for i in range(cells):
            for j in range(cells):
                lx, ly = x0 + i * wx, y0 + j * wy
                dx, dy = np.maximum(np.maximum(lx - cx, cx - lx - wx), 0), np.maximum(np.maximum(ly - cy, cy - ly - wy), 0)
                hit = np.flatnonzero(~(dx * dx + dy * dy > r * r))  # also where the circle has no finite centre
                out.append((np.full(len(hit), i * cells + j), hit))
        cell, hit = (np.concatenate(c) for c in zip(*out, strict=True))
        cols = {"cell": cell, "tri": hit}
        for k in range(3):
            cols |= {f"i{k}": ids[tri[hit, k]], f"x{k}": x[tri[hit, k]], f"y{k}": y[tri[hit, k]]}
        return pa.table(cols)

    kinds = "cell long, tri long, " + ", ".join(f"i{k} long, x{k} double, y{k} double" for k in range(3))
    maybe = materialize(rest.groupBy(F.lit(0).alias("one")).applyInArrow(doubtful, kinds), "doubtful")
    col = F.least(F.greatest(F.floor((F.col("x") - x0) / wx), F.lit(0)), F.lit(cells - 1))
    row = F.least(F.greatest(F.floor((F.col("y") - y0) / wy), F.lit(0)), F.lit(cells - 1))
    at = points.select("x", "y", (col * cells + row).alias("cell"))

    def inside(batches):
        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(9)]
            bad = [t for t, *p in zip(*c, strict=True) if in_circle(*p) > 0]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(bad)), pa.int64())], names=["tri"])

    px, py = F.col("x"), F.col("y")
    ax, ay, bx, by, cx, cy = (F.col(c) - p for c, p in (("x0", px), ("y0", py), ("x1", px), ("y1", py), ("x2", px), ("y2", py)))
    det = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    # far from zero the sign is certain; only hits near zero need the exact one
    near = 1e-9 * (F.abs(ax * ax + ay * ay) + F.abs(bx * bx + by * by) + F.abs(cx * cx + cy * cy)) ** 2
    met = maybe.join(at, "cell")
    close = met.where(F.abs(det) <= near).select("tri", "x0", "y0", "x1", "y1", "x2", "y2", "x", "y")
    wrong = met.where(det > near).select("tri").union(close.mapInArrow(inside, "tri long")).distinct()
    good = maybe.join(wrong, "tri", "left_anti")
    parts = [good.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))]
    return done.where("v <> -1").select("u", "v").union(parts[0]).union(parts[1]).union(parts[2]).distinct()


def delaunay(points: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Edges (u, v, length), u < v, of the Delaunay graph."""
    p = points.select("id", "x", "y")
    n = p.count()
    bare = p.groupBy(F.lit(0).alias("one")).applyInArrow(_block_edges, "u long, v long") if n <= one_task else _tiled_edges(p, n, one_task // 2)
    return with_length(bare, p)


def with_length(pairs: DataFrame, points: DataFrame) -> DataFrame:
    a = points.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = points.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", distance("ux", "uy", "vx", "vy").alias("length"))


def distance(ax, ay, bx, by) -> Column:
    ax, ay, bx, by = (F.col(c) if isinstance(c, str) else c for c in (ax, ay, bx, by))
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(id, other, ...): every edge from either end."""
    return edges.select(F.col("u").alias("id"), F.col("v").alias("other"), *more).union(edges.select(F.col("v").alias("id"), F.col("u").alias("other"), *more))


# ---- scales, scores, thresholds, labels ----------------------------------------------


def local_scale(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(id, scale): median incident length; the median of all lengths where there is none."""
    own = both_ways(edges, "length").groupBy("id").agg(F.percentile("length", 0.5).alias("m"))
    whole = edges.agg(F.percentile("length", 0.5).alias("whole"))
    return points.select("id").join(own, "id", "left").crossJoin(F.broadcast(whole)).select("id", F.greatest(F.coalesce("m", "whole", F.lit(0.0)), F.lit(FLOOR)).alias("scale"))  # whole has one row


def scores(edges: DataFrame, points: DataFrame, raw: bool = False) -> DataFrame:
    """Edges with ``score``: the length, over the root of both scales unless raw."""
    if raw:
        return edges.withColumn("score", F.col("length"))
    s = local_scale(edges, points)
    a, b = s.select(F.col("id").alias("u"), F.col("scale").alias("su")), s.select(F.col("id").alias("v"), F.col("scale").alias("sv"))
    return edges.join(a, "u").join(b, "v").select("u", "v", "length", (F.col("length") / F.sqrt(F.col("su") * F.col("sv"))).alias("score"))


def labels(points: DataFrame, retained: DataFrame, min_size: int = 0) -> DataFrame:
    """(id, cluster_id, is_noise): components in order of their first record; small ones are noise."""
    n = points.count()
    least = min_size or default_min_size(n)
    at = points.select("id").join(components(retained).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sized = at.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # one row per kept component: their numbering is one ordered pass
    numbered = sized.withColumn("cluster_id", (F.row_number().over(W.orderBy("component")) - 1).cast("int"))
    return at.join(numbered, "component", "left").select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.col("cluster_id").isNull().alias("is_noise"))


def static_explicit(points: DataFrame, tau: float, raw: bool = False) -> DataFrame:
    scored = scores(delaunay(points), points, raw)
    return points.join(labels(points, scored.where(F.col("score") <= tau)), "id")


def fit(points: DataFrame, options: Options, what: str = "labels", session: str | None = None) -> DataFrame:
    """Labels, edges, trace or stats of every session (one if none is named), in one task each."""
    key = F.col(session) if session else F.lit("all")

    def run(table: pa.Table) -> pa.Table:
        name = table.column("session")[0].as_py()
        t = table.sort_by("id")
        ids, x, y = (t.column(c).to_numpy() for c in ("id", "x", "y"))
        f = Fit(x, y, options)
        if what == "labels":
            return pa.table({"session": [name] * len(ids), "id": ids, "x": x, "y": y, "cluster_id": f.label.astype(np.int32), "is_noise": f.label < 0})
        if what == "edges":
            k = len(f.u)
            return pa.table({
                "session": [name] * k, "edge_id": np.arange(k), "u": ids[f.u], "v": ids[f.v], "length": f.length, "normalized_score": f.score, "threshold_cap": f.cap,
                "effective_threshold": f.effective, "threshold_margin": f.effective - f.score, "retained": f.retained,
            })
        if what == "stats":
            return pa.table({"session": [name], "n": [f.n], "n_edges": [len(f.u)], "retained": [int(f.retained.sum())], "clusters": [f.n_clusters], "noise": [int((f.label < 0).sum())], "threshold": [float(f.tau)], "activated": [f.activated],
                             "objective": [float(next((r["objective"] for r in f.trace if r["selected"]), float("nan")))]})
        return pa.table({"session": [name] * len(f.trace), **{c: [cast(r[c]) for r in f.trace] for c, cast in TRACE.items()}})

    schema = {
        "labels": "session string, id long, x double, y double, cluster_id int, is_noise boolean",
        "edges": "session string, edge_id long, u long, v long, length double, normalized_score double, threshold_cap double, effective_threshold double, threshold_margin double, retained boolean",
        "stats": "session string, n long, n_edges long, retained long, clusters long, noise long, threshold double, activated boolean, objective double",
        "trace": "session string, " + ", ".join(f"{c} {'double' if k is float else 'long'}" for c, k in TRACE.items()),
    }[what]
    return points.select(key.cast("string").alias("session"), "id", "x", "y").groupBy("session").applyInArrow(run, schema)


TRACE = {c: int if c in ("candidate_index", "selected", "nontrivial", "active_points", "edge_count", "retained_edges", "num_clusters", "noise_count", "largest_cluster", "plateau_width_candidates") else float for c in (
    "candidate_index", "threshold", "selected", "nontrivial", "active_points", "edge_count", "retained_edges", "retained_edge_pct", "num_clusters", "noise_count", "noise_pct", "largest_cluster",
    "largest_cluster_pct", "component_entropy", "base_objective", "stability_adjustment", "plateau_width_candidates", "plateau_center_offset", "largest_jump_before_pct", "largest_jump_after_pct", "noise_drop_after_pct", "objective",
)}


# ---- bucket grid ---------------------------------------------------------------------


def layout(points: DataFrame) -> tuple[float, float, float, float, int]:
    """(min x, min y, step x, step y, cells a side) of the padded grid."""
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    side = max(1, ceil(sqrt(r[4])))
    out = []
    for lo, hi in ((r[0] or 0.0, r[1] or 0.0), (r[2] or 0.0, r[3] or 0.0)):
        pad = max(0.01 * max(hi - lo, FLOOR), FLOOR)
        out.append((lo - pad, max((hi + pad - (lo - pad)) / side, FLOOR)))
    return out[0][0], out[1][0], out[0][1], out[1][1], side


def cell_of(grid, x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """(row, column) of a position; towards zero, then within the grid."""
    x0, y0, sx, sy, side = grid
    at = lambda c, lo, step: F.least(F.greatest(((F.col(c) - lo) / step).cast("int"), F.lit(0)), F.lit(side - 1))
    return at(y, y0, sy), at(x, x0, sx)


def bucket_points(points: DataFrame, grid=None) -> DataFrame:
    grid = grid or layout(points)
    row, col = cell_of(grid)
    return points.select(F.col("id").alias("point_id"), (row * grid[4] + col).cast("long").alias("cell_id"), row.alias("row"), col.alias("col"))


def walk(ax: float, ay: float, bx: float, by: float, grid) -> list[int]:
    """Cells along a segment; through a corner the walk goes on diagonally."""
    x0, y0, sx, sy, side = grid
    clamp = lambda v: min(max(int(v), 0), side - 1)
    c, r, ec, er = clamp((ax - x0) / sx), clamp((ay - y0) / sy), clamp((bx - x0) / sx), clamp((by - y0) / sy)
    out, dx, dy = [r * side + c], bx - ax, by - ay
    stepx, stepy = (dx > 0) - (dx < 0), (dy > 0) - (dy < 0)
    tx = (x0 + (c + (stepx > 0)) * sx - ax) / dx if dx else float("inf")
    ty = (y0 + (r + (stepy > 0)) * sy - ay) / dy if dy else float("inf")
    gx, gy = abs(sx / dx) if dx else float("inf"), abs(sy / dy) if dy else float("inf")
    for _ in range(2 * side + 4):
        if (c, r) == (ec, er):
            break
        if abs(tx - ty) <= 1e-12:
            c, r, tx, ty = c + stepx, r + stepy, tx + gx, ty + gy
        elif tx < ty:
            c, tx = c + stepx, tx + gx
        else:
            r, ty = r + stepy, ty + gy
        if not (0 <= c < side and 0 <= r < side):
            break
        out.append(r * side + c)
    return sorted({*out, er * side + ec})


def bucket_edges(edges: DataFrame, points: DataFrame, grid=None) -> DataFrame:
    """(u, v, cell_id, row, col): every cell that an edge crosses."""
    grid = grid or layout(points)
    side = grid[4]
    a = points.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = points.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))

    def run(batches):
        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(2, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([walk(*p, grid) for p in zip(*c, strict=True)], pa.list_(pa.int64()))], names=["u", "v", "cells"])

    walked = edges.join(a, "u").join(b, "v").select("u", "v", "ux", "uy", "vx", "vy").mapInArrow(run, "u long, v long, cells array<long>")
    cell = walked.select("u", "v", F.explode("cells").alias("cell_id"))
    return cell.select("u", "v", "cell_id", F.floor(F.col("cell_id") / side).cast("int").alias("row"), (F.col("cell_id") % side).cast("int").alias("col"))


def occupancy(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("cell_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("nonempty"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def neighbourhood_counts(points: DataFrame, radius: int = 1, grid=None) -> DataFrame:
    """(id, n): points in the cells around each point, by an equi-join on occupied cells."""
    grid = grid or layout(points)
    side = grid[4]
    at = bucket_points(points, grid)
    full = at.groupBy("cell_id").agg(F.count("*").alias("m"))
    cells = at.select("cell_id", "row", "col").distinct()
    near = cells.withColumn("dr", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("dc", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    near = near.withColumn("r", F.col("row") + F.col("dr")).withColumn("c", F.col("col") + F.col("dc")).where((F.col("r").between(0, side - 1)) & (F.col("c").between(0, side - 1)))
    total = near.select("cell_id", (F.col("r") * side + F.col("c")).cast("long").alias("other")).join(full.withColumnRenamed("cell_id", "other"), "other").groupBy("cell_id").agg(F.sum("m").alias("n"))
    return at.join(total, "cell_id").select(F.col("point_id").alias("id"), "n")


# ---- range and nearest joins ---------------------------------------------------------


def eps_pairs(points: DataFrame, eps: float) -> DataFrame:
    """(id, other): all pairs within eps, both ways, by a grid of cells of width eps."""
    cx, cy = F.floor(F.col("x") / eps).cast("long"), F.floor(F.col("y") / eps).cast("long")
    a = points.select("id", "x", "y", cx.alias("cx"), cy.alias("cy"))
    b = points.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.sequence(cx - 1, cx + 1)).alias("cx"), cy.alias("cy0"))
    b = b.withColumn("cy", F.explode(F.sequence(F.col("cy0") - 1, F.col("cy0") + 1))).drop("cy0")
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return a.join(b, ["cx", "cy"]).where((F.col("id") != F.col("other")) & (d2 <= eps * eps)).select("id", "other")


def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Queries with ``near``, the id of the nearest point (of ties the smallest).

    Rings of grid cells are joined, four times wider each round for the queries still open: a
    hit is final once no unseen cell can be nearer."""
    qs = queries.select(F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not r[4]:
        return queries.withColumn("near", F.lit(None).cast("long"))
    area = max(r[1] - r[0], r[3] - r[2], FLOOR)
    step, out, last = area / max(1.0, sqrt(r[4])), None, False
    while True:
        cx, cy = F.floor((F.col("x") - r[0]) / step).cast("long"), F.floor((F.col("y") - r[2]) / step).cast("long")
        p = points.select("id", "x", "y", cx.alias("cx"), cy.alias("cy"))
        qc, qr = F.floor((F.col("qx") - r[0]) / step).cast("long"), F.floor((F.col("qy") - r[2]) / step).cast("long")
        near = qs.select("q", "qx", "qy", F.explode(F.sequence(qc - 1, qc + 1)).alias("cx"), qr.alias("qr")).withColumn("cy", F.explode(F.sequence(F.col("qr") - 1, F.col("qr") + 1))).drop("qr")
        d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
        best = near.join(p, ["cx", "cy"]).groupBy("q").agg(F.min(F.struct(d2.alias("d2"), F.col("id").alias("id"))).alias("b")).select("q", F.col("b.id").alias("near"), F.col("b.d2").alias("d2"))
        best = materialize(best if last else best.where(F.col("d2") < step * step), "nearest")
        out = best if out is None else out.union(best)
        qs = materialize(qs.join(best.select("q"), "q", "left_anti"), "open")
        if not qs.head(1):
            return queries.join(out.select(F.col("q").alias("id"), "near"), "id", "left")
        spread = qs.agg(F.max(F.abs("qx")), F.max(F.abs("qy"))).first()
        step *= 4
        last = step > 2 * (area + max(spread) + abs(r[0]) + abs(r[2]))


def near_side(eps: float) -> float:
    """The largest power of two such that points in one cell of that width are within eps.
    Cells by powers of two are exact, and so is what follows from their bounds."""
    side = 2.0 ** ceil(log2(eps))
    while 2 * side * side > eps * eps:
        side /= 2
    return side


def _cell(side: float, x: str = "x", y: str = "y") -> list[Column]:
    return [F.floor(F.col(c) / side) for c in (x, y)]


def _within(queries: DataFrame, targets: DataFrame, eps: float, side: float) -> DataFrame:
    """(q, id): targets within eps of each query. Queries go to the cells that they reach."""
    wide, side = eps * (1 + 1e-9), 2 * side
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - wide) / side), F.floor((F.col(c) + wide) / side)))
    qs = queries.select(F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), reach("x").alias("gx")).select("*", reach("qy").alias("gy"))
    gx, gy = _cell(side)
    at = targets.select("id", "x", "y", gx.alias("gx"), gy.alias("gy"))
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    return qs.join(at, ["gx", "gy"]).where((F.col("id") != F.col("q")) & (d2 <= eps * eps)).select("q", "id")


def _cored(points: DataFrame, eps: float, min_pts: int) -> tuple[DataFrame, DataFrame]:
    """(id, x, y, cx, cy) of core points, and of the others that have a place.

    In cells of ``min_pts`` points all are core points; only points of smaller cells count their
    neighbours."""
    side = near_side(eps)
    cx, cy = _cell(side)
    placed = points.select("id", "x", "y").where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))  # no others have neighbours
    placed = materialize(placed.select("*", cx.alias("cx"), cy.alias("cy")), "placed")
    full = materialize(placed.groupBy("cx", "cy").agg(F.count("*").alias("n")).select("cx", "cy", (F.col("n") >= min_pts).alias("full")), "cells")
    lone = materialize(placed.join(full.where("not full"), ["cx", "cy"], "left_semi").select(*placed.columns), "lone")
    met = _within(lone, placed, eps, side).groupBy(F.col("q").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_pts)
    met = materialize(met.select("id"), "met")
    core = placed.join(full.where("full"), ["cx", "cy"], "left_semi").select(*placed.columns)
    return core.union(lone.join(met, "id", "left_semi").select(*placed.columns)), lone.join(met, "id", "left_anti").select(*placed.columns)


def core_points(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(id) of points with ``min_pts`` points, themselves counted, within eps."""
    core = _cored(points, eps, min_pts)[0].select("id")
    return core if min_pts > 1 else points.select("id")


def _bounds() -> list[Column]:
    return [F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]


def _cell_links(core: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """(u, v): cells, by their ``first`` core point, of which two core points are within eps.

    The bounds of two boxes of points settle most pairs of cells: all their points are within
    eps, or none. Boxes that are left are compared point by point where that takes ``FEW``
    comparisons, and are split in 4 by 4 otherwise, so no pair of large cells is multiplied out."""
    side, limit = near_side(eps), eps * eps
    reach = int(eps // side) + 1
    gap = lambda k: max(abs(k) - 1, 0)
    half = [(i, j) for i in range(reach + 1) for j in range(-reach, reach + 1) if (i, j) > (0, 0) and (gap(i) ** 2 + gap(j) ** 2) * side * side <= limit]
    fields = ("first", "cx", "cy", "n", "x0", "x1", "y0", "y1")
    named = lambda t, k: t.select(*[F.col(c).alias(c + k) for c in t.columns])

    def judged(pairs: DataFrame) -> DataFrame:
        """Pairs of boxes that may hold a link: (u, v, boxes a and b, sure, work)."""
        low = [F.greatest(F.lit(0.0), F.col(f"{c}0b") - F.col(f"{c}1a"), F.col(f"{c}0a") - F.col(f"{c}1b")) for c in "xy"]
        high = [F.greatest(F.col(f"{c}1b") - F.col(f"{c}0a"), F.col(f"{c}1a") - F.col(f"{c}0b")) for c in "xy"]
        found = pairs.where(low[0] * low[0] + low[1] * low[1] <= limit)
        return materialize(found.select(F.col("firsta").alias("u"), F.col("firstb").alias("v"), "cxa", "cya", "cxb", "cyb", (high[0] * high[0] + high[1] * high[1] <= limit).alias("sure"), (F.col("na") * F.col("nb")).alias("work")), "judged")

    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half]))
    a = named(cells.select(*fields), "a").withColumn("step", step).withColumn("cxb", F.col("cxa") + F.col("step.i")).withColumn("cyb", F.col("cya") + F.col("step.j"))
    pairs = judged(a.join(named(cells.select(*fields), "b"), ["cxb", "cyb"]))
    links: list[DataFrame] = []
    while True:
        cx, cy = _cell(side)
        at = core.select("x", "y", cx.alias("cx"), cy.alias("cy"))
        sure = pairs.where("sure").select("u", "v").distinct()
        left = pairs.join(sure, ["u", "v"], "left_anti")
        close = left.where(F.col("work") <= FEW).join(named(at, "a"), ["cxa", "cya"]).join(named(at, "b"), ["cxb", "cyb"])
        d2 = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))
        links.append(materialize(sure.union(close.where(d2 <= limit).select("u", "v")).distinct(), "links"))
        left = materialize(left.where(F.col("work") > FEW).join(links[-1], ["u", "v"], "left_anti"), "pairs")
        if not left.head(1):
            return reduce(DataFrame.union, links)
        side /= 4
        fx, fy = _cell(side)
        wanted = left.select(F.col("cxa").alias("cx"), F.col("cya").alias("cy")).union(left.select("cxb", "cyb")).distinct()
        split = at.join(wanted, ["cx", "cy"], "left_semi").groupBy("cx", "cy", fx.alias("fx"), fy.alias("fy")).agg(*_bounds())
        split = materialize(split, "boxes")
        boxes = [named(split, k).withColumnsRenamed({f"cx{k}": f"px{k}", f"cy{k}": f"py{k}", f"fx{k}": f"cx{k}", f"fy{k}": f"cy{k}"}) for k in "ab"]
        up = left.select(F.col("u").alias("firsta"), F.col("v").alias("firstb"), *[F.col(f"c{c}{k}").alias(f"p{c}{k}") for k in "ab" for c in "xy"])
        pairs = judged(up.join(boxes[0], ["pxa", "pya"]).join(boxes[1], ["pxb", "pyb"]))


def dbscan(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(id, is_core, cluster_id): components of core points within eps, numbered by their smallest
    id, border points to the cluster of their smallest core neighbour, others -1.

    Pairs of points are not listed: core points of one cell are one node."""
    core, rest = _cored(points, eps, min_pts)
    core = materialize(core, "core")
    cells = materialize(core.groupBy("cx", "cy").agg(F.min("id").alias("first"), *_bounds()), "cells")
    comp = components(_cell_links(core, cells, eps)).withColumnRenamed("node", "first")
    comp = cells.select("cx", "cy", "first").join(comp, "first", "left").select("cx", "cy", F.coalesce("component", "first").alias("component"))
    comp = materialize(comp, "components")
    known = core.select("id", "cx", "cy", F.lit(True).alias("is_core")).join(comp, ["cx", "cy"]).select("id", "is_core", "component")
    first = _within(rest, core, eps, near_side(eps)).groupBy("q").agg(F.min("id").alias("id"))
    border = first.join(core.select("id", "cx", "cy"), "id").join(comp, ["cx", "cy"]).select(F.col("q").alias("id"), F.lit(False), "component")
    known = known.union(border)
    if min_pts <= 1:  # points without a place are clusters of their own
        known = known.union(points.select("id").join(core, "id", "left_anti").select("id", F.lit(True), "id"))
    number = known.where("is_core").select("component").distinct().withColumn("cluster_id", (F.row_number().over(W.orderBy("component")) - 1).cast("int"))
    known = known.join(number, "component").select("id", "is_core", "cluster_id")
    return points.select("id").join(known, "id", "left").select("id", F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


# ---- connectivity and model quality --------------------------------------------------


def cut_parts(n: int, u, v) -> tuple[list[int], list[int]]:
    """(bridge edge numbers, articulation points), by one depth-first pass without recursion."""
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(zip(u, v, strict=True)):
        around[a].append((b, k))
        around[b].append((a, k))
    seen, low, cut, bridges, clock = [0] * n, [0] * n, set(), [], 0
    for root in range(n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        stack, children = [(root, -1, iter(around[root]))], 0
        while stack:
            a, via, rest = stack[-1]
            for b, k in rest:
                if k == via:
                    continue
                if seen[b]:
                    low[a] = min(low[a], seen[b])
                    continue
                clock += 1
                seen[b] = low[b] = clock
                stack.append((b, k, iter(around[b])))
                break
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[a])
                    if low[a] > seen[p]:
                        bridges.append(via)
                    if p == root:
                        children += 1
                    elif low[a] >= seen[p]:
                        cut.add(p)
        if children > 1:
            cut.add(root)
    return sorted(bridges), sorted(cut)


def connectivity(retained: DataFrame, members: DataFrame, most: int = 256) -> DataFrame:
    """(cluster_id, n, bridges, articulations) of clusters of at most ``most`` members."""
    at = members.where("cluster_id >= 0").select("id", "cluster_id")
    n = at.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    e = retained.join(at.withColumnRenamed("id", "u"), "u").join(n, "cluster_id").select("cluster_id", "n", "u", "v")

    def run(table: pa.Table) -> pa.Table:
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        b, c = cut_parts(len(ids), at[: len(u)].tolist(), at[len(u) :].tolist())
        return pa.table({"cluster_id": table.column("cluster_id").slice(0, 1), "n": [table.column("n")[0].as_py()], "bridges": [len(b)], "articulations": [len(c)]})

    return e.groupBy("cluster_id").applyInArrow(run, "cluster_id int, n long, bridges long, articulations long")


def quality(points: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row: davies_bouldin and calinski_harabasz over points that are no noise."""
    p = points.where(F.col(cluster) >= 0).select("x", "y", F.col(cluster).alias("c"))
    cent = p.groupBy("c").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    at = p.join(cent, "c")
    d = distance("x", "y", "mx", "my")
    spread = at.groupBy("c", "mx", "my", "n").agg(F.avg(d).alias("s"), F.sum(d * d).alias("w"))
    a, b = spread.alias("a"), spread.select(*[F.col(k).alias(f"{k}2") for k in ("c", "mx", "my", "s")]).alias("b")
    # clusters against clusters: at most n / min_size of them each
    ratio = a.join(b, F.col("c") != F.col("c2")).groupBy("c").agg(F.max((F.col("s") + F.col("s2")) / distance("mx", "my", "mx2", "my2")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    g = p.agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"), F.count("*").alias("t"))
    ch = spread.crossJoin(F.broadcast(g)).agg(F.sum(F.col("n") * ((F.col("mx") - F.col("gx")) ** 2 + (F.col("my") - F.col("gy")) ** 2)).alias("b"), F.sum("w").alias("w"), F.count("*").alias("k"), F.max("t").alias("t"))
    ch = ch.select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("t") - F.col("k")))).alias("calinski_harabasz"))
    return ratio.crossJoin(ch)

