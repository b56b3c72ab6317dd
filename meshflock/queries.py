"""Driver queries of the spatial engine, with SQL that says the same.

E: ``embeddings`` with x, y = the first two dimensions. V: ``events`` with x = hours since
2024-01-01, y = value, a track per user and an operation per event type.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshflock.functions import metrics
from meshflock.operators import tracks
from meshflock.plans import spatial
from meshflock.plans.model import Options
from meshflock.runtime import materialize, shared_dir
from meshflock.sources import points as io
from meshflock.streaming import dbscan, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TAU, TAU_RAW, EPS, MIN_PTS = 0.9, 0.25, 0.25, 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def E(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), "label")


def _events(t: DataFrame) -> DataFrame:
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3.6e9)
    op = F.when(F.col("event_type") == "click", "move").when(F.col("event_type") == "error", "delete").otherwise("insert")
    return t.select(F.col("event_id").alias("id"), hours.alias("x"), F.col("value").cast("double").alias("y"), F.col("user_id").alias("track"), op.alias("op"), "event_type")


def V(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return _events(spark.read.parquet(f"{d}/events.parquet"))


def updates(events: DataFrame) -> DataFrame:
    """Every user is a session. A move takes the point nearest to a place a day before."""
    move = F.col("op") == "move"
    return events.select(F.col("track").cast("string").alias("session"), F.col("id").alias("seq"), "op", F.when(move, F.col("x") - 24).otherwise(F.col("x")).alias("x"), "y", F.when(move, F.col("x")).alias("new_x"), F.when(move, F.col("y")).alias("new_y"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


# ---- SQL building blocks ---------------------------------------------------------------

PTS = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"
EVT = """evt AS (SELECT event_id AS id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x, CAST(value AS DOUBLE) AS y, user_id AS track, event_type,
  CASE event_type WHEN 'click' THEN 'move' WHEN 'error' THEN 'delete' ELSE 'insert' END AS op FROM events)"""
EDG = f"""{PTS}, wit AS (SELECT a.id AS u, b.id AS v, (b.x-a.x)*(p.y-a.y)-(b.y-a.y)*(p.x-a.x) AS cr, (p.x-a.x)*(p.x-b.x)+(p.y-a.y)*(p.y-b.y) AS dt
  FROM pts a JOIN pts b ON a.id < b.id JOIN pts p ON p.id <> a.id AND p.id <> b.id),
uv AS (SELECT u, v FROM (SELECT u, v, min(CASE WHEN cr > 0 THEN dt / cr END) AS hi, max(CASE WHEN cr < 0 THEN dt / cr END) AS lo, max(CASE WHEN cr = 0 AND dt < 0 THEN 1 ELSE 0 END) AS mid FROM wit GROUP BY u, v)
  WHERE mid = 0 AND (hi IS NULL OR lo IS NULL OR lo <= hi)),
edg AS (SELECT u, v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS length FROM uv JOIN pts a ON a.id = u JOIN pts b ON b.id = v)"""
SCL = f"""{EDG}, ends AS (SELECT u AS id, length FROM edg UNION ALL SELECT v, length FROM edg), scl AS (SELECT id, greatest(quantile_cont(length, 0.5), 1e-9) AS scale FROM ends GROUP BY id),
sco AS (SELECT u, v, length, length / sqrt(a.scale * b.scale) AS score FROM edg JOIN scl a ON a.id = u JOIN scl b ON b.id = v)"""


def lab(keep: str) -> str:
    """Components of the edges ``keep`` (u, v), numbered by first record, small ones -1."""
    return f"""kept AS ({keep}), adj AS (SELECT u AS a, v AS b FROM kept UNION ALL SELECT v, u FROM kept),
reach AS (SELECT id, id AS r FROM pts UNION SELECT adj.b, r FROM reach JOIN adj ON adj.a = reach.id), comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
siz AS (SELECT c, count(*) AS n FROM comp GROUP BY c), num AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM siz WHERE n >= (SELECT ceil(log2(count(*))) FROM pts)),
lab AS (SELECT id, coalesce(k, -1) AS cluster_id, k IS NULL AS is_noise FROM comp LEFT JOIN num USING (c))"""


STATIC = f"WITH RECURSIVE {SCL}, {lab(f'SELECT u, v FROM sco WHERE score <= {TAU}')}"
RAW = f"WITH RECURSIVE {EDG}, {lab(f'SELECT u, v FROM edg WHERE length <= {TAU_RAW}')}"
NEAR = f"nbr AS (SELECT a.id, b.id AS other FROM pts a JOIN pts b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {EPS}*{EPS}), cnt AS (SELECT pts.id, count(other) AS n FROM pts LEFT JOIN nbr USING (id) GROUP BY pts.id), core AS (SELECT id FROM cnt WHERE n + 1 >= {MIN_PTS})"
GRID = "lay AS (SELECT greatest(1, CAST(ceil(sqrt(count(*))) AS INT)) AS side, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS yb FROM evt), pad AS (SELECT side, greatest(0.01*greatest(bx-ax,1e-9),1e-9) AS px, greatest(0.01*greatest(yb-ay,1e-9),1e-9) AS py, ax, bx, ay, yb FROM lay), gri AS (SELECT side, ax-px AS x0, ay-py AS y0, greatest((bx+px-(ax-px))/side,1e-9) AS sx, greatest((yb+py-(ay-py))/side,1e-9) AS sy FROM pad), bkt AS (SELECT id AS point_id, least(greatest(CAST(trunc((y-y0)/sy) AS INT),0),side-1) AS r, least(greatest(CAST(trunc((x-x0)/sx) AS INT),0),side-1) AS c, side FROM evt, gri)"


# ---- graph, scales, labels -------------------------------------------------------------


@query(f"WITH {EDG} SELECT u, v, round(length, 9) AS length FROM edg")
def delaunay_edges(spark, d):
    return rounded(spatial.delaunay(E(spark, d)), "length")


@query(f"WITH {SCL} SELECT id, round(scale, 9) AS scale FROM scl")
def local_scale(spark, d):
    p = E(spark, d)
    return rounded(spatial.local_scale(materialize(spatial.delaunay(p), "edges"), p), "scale")


def scored(p: DataFrame, raw: bool = False) -> DataFrame:
    return spatial.scores(materialize(spatial.delaunay(p), "edges"), p, raw)


@query(f"WITH {SCL} SELECT u, v, round(length, 9) AS length, round(score, 9) AS score FROM sco")
def edge_scores(spark, d):
    return rounded(scored(E(spark, d)), "length", "score")


def clusters(spark, d, raw=False) -> DataFrame:
    p = E(spark, d)
    return spatial.labels(p, scored(p, raw).where(F.col("score") <= (TAU_RAW if raw else TAU)))


@query(f"{STATIC} SELECT id, cluster_id, is_noise FROM lab")
def static_explicit(spark, d):
    return clusters(spark, d)


@query(f"{RAW} SELECT id, cluster_id, is_noise FROM lab")
def static_raw_length(spark, d):
    return clusters(spark, d, True)


@query(f"{STATIC} SELECT cluster_id, count(*) AS n, min(id) AS first_id FROM lab WHERE NOT is_noise GROUP BY cluster_id")
def cluster_sizes(spark, d):
    return clusters(spark, d).where("not is_noise").groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"{STATIC} SELECT id FROM lab WHERE is_noise")
def noise_points(spark, d):
    return clusters(spark, d).where("is_noise").select("id")


@query(f"{STATIC} SELECT id, CASE WHEN is_noise THEN 'noise' ELSE 'cluster:' || CAST(min(id) OVER (PARTITION BY cluster_id) AS VARCHAR) END AS signature FROM lab")
def partition_signature(spark, d):
    least = F.min("id").over(W.partitionBy("cluster_id"))
    return clusters(spark, d).select("id", F.when(F.col("is_noise"), "noise").otherwise(F.concat(F.lit("cluster:"), least)).alias("signature"))


@query()
def threshold_trace(spark, d):
    return spatial.fit(E(spark, d), Options(), "trace").drop("session")


@query()
def static_auto(spark, d):
    return spatial.fit(E(spark, d), Options()).drop("session")


def mode(name):
    def f(spark, d):
        return spatial.fit(E(spark, d), Options(threshold_mode=name)).drop("session")

    f.__name__ = name
    return query()(f)


for _m in ("knn_median", "supported_merge", "saddle_cut", "manifold_filter", "bucket_percentile"):
    mode(_m)


@query()
def auto_policy(spark, d):
    """The stats of six modes with the best selected objective marked; ties go to the first mode."""
    p = E(spark, d)
    names = ("raw_length", "local_scale", "knn_median", "supported_merge", "saddle_cut", "manifold_filter")
    rows = None
    for k, m in enumerate(names):
        one = spatial.fit(p, Options(threshold_mode=m), "stats").select(F.lit(m).alias("mode"), F.lit(k).alias("rank"), "clusters", "noise", "threshold", "activated", "objective")
        rows = one if rows is None else rows.union(one)
    idle = F.col("mode").isin("saddle_cut", "manifold_filter") & ~F.col("activated")
    rows = materialize(rows.withColumn("policy_objective", F.when(idle, float("-inf")).otherwise(F.col("objective"))), "modes")
    best = rows.agg(F.max_by("mode", F.struct("policy_objective", -F.col("rank"))).alias("best"))
    return rows.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("mode") == F.col("best")).drop("best", "rank")


@query()
def selector_sensitivity(spark, d):
    """Every weight of the objective varied by a fifth over the written trace."""
    t = materialize(spatial.fit(E(spark, d), Options(), "trace"), "trace")
    n, k = F.col("active_points"), F.col("num_clusters")
    nf, lf = F.col("noise_count") / n, F.col("largest_cluster") / n
    terms = {"coverage": 0.80 * (1 - nf), "entropy": 0.35 * F.col("component_entropy"), "largest": -0.45 * lf * lf, "excess": -1.5 * F.greatest(F.lit(0.0), lf - 0.65) ** 2, "noise": -0.75 * F.greatest(F.lit(0.0), nf - 0.3) ** 2, "log": -0.08 * F.log2(k + 1), "share": -0.15 * k / F.sqrt(n + k), "single": F.when(k < 2, -1.5).otherwise(0.0)}
    rows = None
    for name, term in terms.items():
        for factor in (0.8, 1.2):
            base = F.col("objective") + (factor - 1) * term
            one = t.agg(F.max_by("candidate_index", F.struct("nontrivial", base, -F.col("threshold"))).alias("candidate_index"), F.max(F.when(F.col("selected") == 1, F.col("candidate_index"))).alias("default_index")).select(F.lit(f"{name}_{factor}").alias("variant"), "*")
            rows = one if rows is None else rows.union(one)
    return rows


@query(f"{STATIC}, pr AS (SELECT l.cluster_id, kept.u, kept.v FROM kept JOIN lab l ON l.id = kept.u), sz AS (SELECT cluster_id, count(*) AS n FROM lab WHERE cluster_id >= 0 GROUP BY 1 HAVING count(*) <= 256), pe AS (SELECT * FROM pr WHERE cluster_id IN (SELECT cluster_id FROM sz)), dir AS (SELECT u AS a, v AS b, u AS eu, v AS ev FROM pe UNION ALL SELECT v, u, u, v FROM pe), wo AS (SELECT u AS xu, v AS xv, u AS pos FROM pe UNION SELECT xu, xv, b FROM wo JOIN dir ON dir.a = wo.pos AND NOT (dir.eu = xu AND dir.ev = xv)), br AS (SELECT p.cluster_id, count(*) AS k FROM pe p WHERE NOT EXISTS (SELECT 1 FROM wo WHERE xu = p.u AND xv = p.v AND pos = p.v) GROUP BY 1) SELECT cluster_id, n, coalesce(k, 0) AS bridges FROM sz LEFT JOIN br USING (cluster_id)")
def bridges(spark, d):
    p = E(spark, d)
    kept = materialize(scored(p).where(F.col("score") <= TAU).select("u", "v"), "kept")
    return spatial.connectivity(kept, spatial.labels(p, kept)).select("cluster_id", "n", "bridges")


@query()
def bridges_articulations(spark, d):
    p = E(spark, d)
    kept = materialize(scored(p).where(F.col("score") <= TAU).select("u", "v"), "kept")
    return spatial.connectivity(kept, spatial.labels(p, kept))


# ---- sets, partitions and paths of the graph ---------------------------------------------


def kept_edges(spark, d) -> tuple[DataFrame, DataFrame]:
    """Edges retained by the local scale and by raw length."""
    e = scored(E(spark, d))
    return e.where(F.col("score") <= TAU).select("u", "v"), e.where(F.col("length") <= TAU_RAW).select("u", "v")


@query(f"WITH {SCL} SELECT u, v, CASE WHEN score <= {TAU} THEN 'local' ELSE 'raw' END AS only_in FROM sco WHERE (score <= {TAU}) <> (length <= {TAU_RAW})")
def retained_changes(spark, d):
    """Symmetric difference of two sets of retained edges."""
    local, raw = kept_edges(spark, d)
    return local.join(raw, ["u", "v"], "left_anti").withColumn("only_in", F.lit("local")).union(raw.join(local, ["u", "v"], "left_anti").withColumn("only_in", F.lit("raw")))


@query(f"WITH {SCL} SELECT u, v FROM sco WHERE score <= {TAU} AND length <= {TAU_RAW}")
def retained_in_both(spark, d):
    local, raw = kept_edges(spark, d)
    return local.intersect(raw)


@query(f"""{STATIC}, a AS (SELECT count(*) AS n, min(id) AS lo, max(id) AS hi, sum(id) AS total FROM lab WHERE NOT is_noise GROUP BY cluster_id),
b AS (SELECT count(*) AS n, min(id) AS lo, max(id) AS hi, sum(id) AS total FROM pts GROUP BY label)
SELECT count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS equal_sets, count(*) FILTER (b.n IS NULL) AS only_clusters, count(*) FILTER (a.n IS NULL) AS only_labels FROM a FULL JOIN b ON a.n = b.n AND a.lo = b.lo AND a.hi = b.hi AND a.total = b.total""")
def partition_compare(spark, d):
    """Full outer join of two partitions by the make-up of their sets."""

    def sets(df, by, name):
        return df.groupBy(by).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("id").alias("total")).drop(by).withColumn(name, F.lit(1))

    both = sets(clusters(spark, d).where("not is_noise"), "cluster_id", "a").join(sets(E(spark, d), "label", "b"), ["n", "lo", "hi", "total"], "full")
    return both.agg(F.count(F.expr("a + b")).alias("equal_sets"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_clusters"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_labels"))


@query(f"{STATIC}, adj2 AS (SELECT u AS a, v AS b FROM kept UNION ALL SELECT v, u FROM kept), two AS (SELECT DISTINCT k.u, k.v FROM kept k JOIN adj2 p ON p.a = k.u JOIN adj2 q ON q.a = p.b AND q.b = k.v), three AS (SELECT DISTINCT k.u, k.v FROM kept k JOIN adj2 p ON p.a = k.u AND p.b <> k.v JOIN adj2 q ON q.a = p.b AND q.b <> k.u AND q.b <> k.v JOIN adj2 r ON r.a = q.b AND r.b = k.v) SELECT k.u, k.v, CASE WHEN two.u IS NOT NULL THEN 2 WHEN three.u IS NOT NULL THEN 3 END AS hops FROM kept k LEFT JOIN two USING (u, v) LEFT JOIN three USING (u, v)")
def path_witness(spark, d):
    """For every retained edge the fewest hops, up to three, of a path between its ends that
    does without it; null where there is none so short."""
    kept = materialize(kept_edges(spark, d)[0], "kept")
    step = kept.union(kept.select("v", "u"))
    first = kept.join(step.select(F.col("u").alias("u"), F.col("v").alias("p")), "u").where("p <> v")
    two = first.join(step.select(F.col("u").alias("p"), F.col("v").alias("q")), "p").where("q <> u")
    short = two.where("q = v").select("u", "v", F.lit(2).alias("hops"))
    long = two.where("q <> v").join(step.select(F.col("u").alias("q"), F.col("v").alias("end")), "q").where("end = v").select("u", "v", F.lit(3).alias("hops"))
    return kept.join(short.union(long).groupBy("u", "v").agg(F.min("hops").alias("hops")), ["u", "v"], "left")


CROP = "abs(x) <= 0.5 AND abs(y) <= 0.5"


@query(f"{STATIC.replace('label FROM embeddings)', 'label FROM embeddings WHERE abs(CAST(embedding[1] AS DOUBLE)) <= 0.5 AND abs(CAST(embedding[2] AS DOUBLE)) <= 0.5)')}, dom AS (SELECT cluster_id FROM lab WHERE NOT is_noise GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1) SELECT id FROM lab WHERE cluster_id IN (SELECT cluster_id FROM dom)")
def crop_dominant(spark, d):
    """A window of the plane, clustered by itself: the points of its largest cluster."""
    p = materialize(E(spark, d).where(CROP), "crop")
    at = materialize(spatial.labels(p, scored(p).where(F.col("score") <= TAU)), "labels")
    first = at.where("not is_noise").groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(1)
    return at.join(first, "cluster_id", "left_semi").select("id")


@query(f"{STATIC} SELECT round(100.0 * count(*) FILTER (is_noise) / count(*), 9) AS noise_pct FROM lab")
def noise_percent(spark, d):
    return clusters(spark, d).agg(F.round(100.0 * F.count_if("is_noise") / F.count("*"), 9).alias("noise_pct"))


@query(f"WITH {EDG}, b AS (SELECT min(length) AS lo, (max(length) - min(length)) / 10 AS w FROM edg) SELECT CAST(least(9, floor((length - lo) / w)) AS INT) AS bin, count(*) AS n FROM edg, b GROUP BY 1")
def length_histogram(spark, d):
    e = materialize(spatial.delaunay(E(spark, d)), "edges")
    b = e.agg(F.min("length").alias("lo"), ((F.max("length") - F.min("length")) / 10).alias("w"))
    return e.join(F.broadcast(b)).groupBy(F.least(F.lit(9), F.floor((F.col("length") - F.col("lo")) / F.col("w"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {EVT} SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS pct, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, count(DISTINCT track) AS tracks FROM evt GROUP BY event_type")
def group_table(spark, d):
    """Counts with shares, mean, deviation and distinct tracks of every group."""
    v = V(spark, d)
    g = v.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_samp("y"), 6).alias("sd"), F.countDistinct("track").alias("tracks"))
    return g.join(F.broadcast(v.agg(F.count("*").alias("_all")))).withColumn("pct", F.round(100.0 * F.col("n") / F.col("_all"), 9)).drop("_all")


@query("SELECT doc_id, regexp_extract(source, '([a-z]+)([0-9]*)', 1) AS kind, regexp_extract(source, '([a-z]+)([0-9]*)', 2) AS number FROM documents WHERE source IS NOT NULL")
def name_parts(spark, d):
    """Parts of a name by a pattern, as a mode is read from a file name."""
    t = spark.read.parquet(f"{d}/documents.parquet").where("source is not null")
    part = lambda k: F.regexp_extract("source", "([a-z]+)([0-9]*)", k)
    return t.select("doc_id", part(1).alias("kind"), part(2).alias("number"))


@query(f"WITH {EVT} SELECT id, round((x - (SELECT avg(x) FROM evt)) * 111.32 * cos(radians((SELECT avg(y / 10) FROM evt))), 6) AS x, round((y / 10 - (SELECT avg(y / 10) FROM evt)) * 111.32, 6) AS y FROM evt")
def project_degrees(spark, d):
    """Degrees to kilometres about the mean, by a fixed length of a degree."""
    e = V(spark, d).select("id", F.col("x").alias("lon"), (F.col("y") / 10).alias("lat"))
    m = e.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    return e.join(F.broadcast(m)).select("id", F.round((F.col("lon") - F.col("lon0")) * 111.32 * F.cos(F.radians("lat0")), 6).alias("x"), F.round((F.col("lat") - F.col("lat0")) * 111.32, 6).alias("y"))


@query()
def dbscan_step_log(spark, d):
    """Every operation of the grow-only DBSCAN, with the agreement of its clusters with a fresh run."""
    return dbscan.step_log(updates(V(spark, d)), 25.0, 4, every=10, exact=False).drop("incr_ns", "full_ns")


# ---- grid ------------------------------------------------------------------------------


@query(f"WITH {EVT}, {GRID} SELECT point_id, CAST(r * side + c AS BIGINT) AS cell_id, r AS row, c AS col FROM bkt")
def bucket_points(spark, d):
    return spatial.bucket_points(V(spark, d))


@query(f"WITH {EVT}, {GRID}, o AS (SELECT r, c, count(*) AS n FROM bkt GROUP BY r, c) SELECT count(*) AS nonempty, max(n) AS most, round(avg(n), 9) AS mean FROM o")
def bucket_stats(spark, d):
    return rounded(spatial.occupancy(spatial.bucket_points(V(spark, d))), "mean")


@query(f"WITH {EVT}, {GRID}, o AS (SELECT r, c, count(*) AS n FROM bkt GROUP BY r, c) SELECT point_id AS id, CAST(sum(o.n) AS BIGINT) AS n FROM bkt b JOIN o ON abs(o.r - b.r) <= 1 AND abs(o.c - b.c) <= 1 GROUP BY point_id")
def cell_neighbourhood_counts(spark, d):
    return spatial.neighbourhood_counts(V(spark, d))


@query()
def bucket_edges(spark, d):
    p = E(spark, d)
    return spatial.bucket_edges(materialize(spatial.delaunay(p), "edges"), p)


# ---- joins -----------------------------------------------------------------------------


@query(f"{STATIC}, q AS (SELECT id, x + 0.05 AS x, y - 0.03 AS y FROM pts), nn AS (SELECT q.id, q.x, q.y, p.id AS near, row_number() OVER (PARTITION BY q.id ORDER BY (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y), p.id) AS k FROM q, pts p) SELECT nn.id, round(nn.x, 9) AS x, round(nn.y, 9) AS y, cluster_id, is_noise FROM nn JOIN lab ON lab.id = near WHERE k = 1")
def assign_nearest(spark, d):
    p = E(spark, d)
    known = materialize(p.select("id", "x", "y").join(clusters(spark, d), "id"), "labels")
    return rounded(io.assign(p.select("id", (F.col("x") + 0.05).alias("x"), (F.col("y") - 0.03).alias("y")), known), "x", "y")


@query(f"WITH {PTS}, {NEAR} SELECT id, n FROM cnt")
def eps_neighbours(spark, d):
    p = E(spark, d)
    n = spatial.eps_pairs(p, EPS).groupBy("id").agg(F.count("*").alias("n"))
    return p.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


DBSCAN = f"""WITH RECURSIVE {PTS}, {NEAR}, lnk AS (SELECT n.id AS a, n.other AS b FROM nbr n JOIN core c1 ON c1.id = n.id JOIN core c2 ON c2.id = n.other),
rch AS (SELECT id, id AS r FROM core UNION SELECT lnk.b, r FROM rch JOIN lnk ON lnk.a = rch.id), cmp AS (SELECT id, min(r) AS c FROM rch GROUP BY id),
nm AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM cmp)), cl AS (SELECT id, k FROM cmp JOIN nm USING (c)),
bd AS (SELECT id, min(other) AS other FROM nbr WHERE other IN (SELECT id FROM core) AND id NOT IN (SELECT id FROM core) GROUP BY id),
dbs AS (SELECT p.id, cl.id IS NOT NULL AS is_core, coalesce(cl.k, c2.k, -1) AS cluster_id FROM pts p LEFT JOIN cl ON cl.id = p.id LEFT JOIN bd ON bd.id = p.id LEFT JOIN cl c2 ON c2.id = bd.other)"""


@query(f"{DBSCAN} SELECT id, is_core, cluster_id FROM dbs")
def dbscan_full(spark, d):
    return spatial.dbscan(E(spark, d), EPS, MIN_PTS)


@query(f"{DBSCAN} SELECT id FROM dbs WHERE is_core")
def dbscan_core_points(spark, d):
    return spatial.core_points(E(spark, d), EPS, MIN_PTS)


@query(f"WITH {PTS}, r AS (SELECT a.id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS k FROM pts a, pts b) SELECT round(quantile_cont(dist, 0.9), 9) AS eps FROM r WHERE k = {MIN_PTS}")
def knn_eps_estimate(spark, d):
    """The 90th percentile of the distance to the k-th nearest point, itself counted."""
    p = E(spark, d)
    grid = spatial.layout(p)
    pairs = spatial.eps_pairs(p, 6 * max(grid[2], grid[3])).join(p.select("id", "x", "y"), "id").join(p.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")), "other")
    pairs = pairs.select("id", spatial.distance("x", "y", "ox", "oy").alias("dist"))
    near = pairs.groupBy("id").agg(F.sort_array(F.collect_list("dist")).alias("ds"))
    got = materialize(p.join(near, "id", "left").select("id", "x", "y", F.when(F.size("ds") >= MIN_PTS - 1, F.expr(f"ds[{MIN_PTS - 2}]")).alias("dist")), "knn")
    # sparse places: their few points against all points, as stated queries
    far = got.where("dist is null").select("id", "x", "y").crossJoin(p.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))).where("id <> other")
    far = far.groupBy("id").agg(F.sort_array(F.collect_list(spatial.distance("x", "y", "ox", "oy"))).alias("ds")).select(F.expr(f"get(ds, {MIN_PTS - 2})").alias("dist"))
    return rounded(got.where("dist is not null").select("dist").union(far).agg(F.percentile("dist", 0.9).alias("eps")), "eps")


# ---- quality ---------------------------------------------------------------------------

CT = f"{STATIC}, t AS (SELECT label AS a, cluster_id AS b FROM pts JOIN lab USING (id)), ab AS (SELECT a, b, count(*) AS n FROM t GROUP BY a, b), aa AS (SELECT a, count(*) AS n FROM t GROUP BY a), bb AS (SELECT b, count(*) AS n FROM t GROUP BY b), s AS (SELECT (SELECT sum(n*(n-1)/2.0) FROM ab) AS sab, (SELECT sum(n*(n-1)/2.0) FROM aa) AS sa, (SELECT sum(n*(n-1)/2.0) FROM bb) AS sb, (SELECT sum(n*ln(n)) FROM ab) AS lab_, (SELECT sum(n*ln(n)) FROM aa) AS la, (SELECT sum(n*ln(n)) FROM bb) AS lb, (SELECT CAST(count(*) AS DOUBLE) FROM t) AS m)"


def agreement(spark, d) -> DataFrame:
    return metrics.agreement(E(spark, d).join(clusters(spark, d), "id"), "label", "cluster_id")


@query(f"{CT} SELECT round((sab - sa*sb/(m*(m-1)/2)) / (0.5*(sa+sb) - sa*sb/(m*(m-1)/2)), 9) AS ari FROM s")
def ari_vs_label(spark, d):
    return rounded(agreement(spark, d).select("ari"), "ari")


@query(f"{CT} SELECT round((ln(m) + (lab_-la-lb)/m) / (0.5*((ln(m)-la/m)+(ln(m)-lb/m))), 9) AS nmi FROM s")
def nmi_vs_label(spark, d):
    return rounded(agreement(spark, d).select("nmi"), "nmi")


@query(f"{CT} SELECT round(sab / sqrt(sa*sb), 9) AS fmi FROM s")
def fmi_vs_label(spark, d):
    return rounded(agreement(spark, d).select("fmi"), "fmi")


@query(f"WITH {PTS}, c AS (SELECT label AS c, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pts GROUP BY label), s AS (SELECT c, mx, my, avg(sqrt((x-mx)*(x-mx)+(y-my)*(y-my))) AS s FROM pts JOIN c ON c.c = label GROUP BY c, mx, my), r AS (SELECT a.c, max((a.s+b.s)/sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my))) AS r FROM s a JOIN s b ON a.c <> b.c GROUP BY a.c) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark, d):
    return spatial.quality(E(spark, d), "label").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"WITH {PTS}, c AS (SELECT label AS c, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pts GROUP BY label), g AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS t FROM pts), w AS (SELECT sum((x-mx)*(x-mx)+(y-my)*(y-my)) AS w FROM pts JOIN c ON c.c = label), b AS (SELECT sum(n*((mx-gx)*(mx-gx)+(my-gy)*(my-gy))) AS b, count(*) AS k FROM c, g) SELECT round(b/(k-1)/(w/(t-k)), 6) AS calinski_harabasz FROM b, w, g")
def calinski_harabasz(spark, d):
    return spatial.quality(E(spark, d), "label").select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


# ---- tracks and tables -----------------------------------------------------------------


@query(f"WITH {EVT}, p AS (SELECT id, x/100 AS lon, y/10 AS lat FROM evt), k AS (SELECT * FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90), m AS (SELECT avg(lat) AS m FROM k) SELECT id, round(radians(lon)*cos(radians(m))*6371.0088, 6) AS x, round(radians(lat)*6371.0088, 6) AS y FROM k, m")
def project_equirectangular(spark, d):
    e = V(spark, d).select("id", (F.col("x") / 100).alias("lon"), (F.col("y") / 10).alias("lat"))
    return tracks.equirectangular(e).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT p_size, p_retailprice, min(p_partkey) AS p_partkey FROM part GROUP BY p_size, p_retailprice")
def dedupe_keep_first(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return tracks.first_of_each(part, ["p_size", "p_retailprice"], ["p_partkey"]).select("p_size", "p_retailprice", "p_partkey")


@query(f"WITH {EVT} SELECT id, dense_rank() OVER (ORDER BY coalesce(event_type, 'unknown')) - 1 AS code FROM evt")
def label_encode(spark, d):
    return tracks.encoded(V(spark, d), "event_type").select("id", "code")


@query("SELECT count(*) AS n, count(*) - count(DISTINCT (p_size, p_retailprice)) AS duplicates, round(100.0 * (count(*) - count(DISTINCT (p_size, p_retailprice))) / count(*), 9) AS pct FROM part")
def duplicate_census(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    c = part.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("p_size", "p_retailprice")).alias("duplicates"))
    return c.select("n", "duplicates", F.round(100.0 * F.col("duplicates") / F.col("n"), 9).alias("pct"))


def track_table(spark, d) -> DataFrame:
    return V(spark, d).select("track", F.col("x").alias("t"), F.col("x"), F.col("y"), F.col("id").alias("ord"))


@query(f"WITH RECURSIVE {EVT}, o AS (SELECT track, x AS t, y, id AS ord, row_number() OVER (PARTITION BY track ORDER BY x, id) AS k FROM evt), k AS (SELECT track, k, t AS lt, y AS ly, TRUE AS keep, ord FROM o WHERE k = 1 UNION ALL SELECT o.track, o.k, CASE WHEN o.t - lt >= 2 AND (o.t-lt)*(o.t-lt)+(o.y-ly)*(o.y-ly) >= 100 THEN o.t ELSE lt END, CASE WHEN o.t - lt >= 2 AND (o.t-lt)*(o.t-lt)+(o.y-ly)*(o.y-ly) >= 100 THEN o.y ELSE ly END, o.t - lt >= 2 AND (o.t-lt)*(o.t-lt)+(o.y-ly)*(o.y-ly) >= 100, o.ord FROM k JOIN o ON o.track = k.track AND o.k = k.k + 1) SELECT track, ord FROM k WHERE keep")
def decimate_tracks(spark, d):
    return tracks.decimate(track_table(spark, d), 2.0, 10.0).select("track", "ord")


@query(f"WITH {EVT}, l AS (SELECT track, max(x) AS last_t FROM evt GROUP BY track) SELECT track, round(last_t, 9) AS last_t, round(last_t + 6, 9) AS expires_t FROM l WHERE last_t + 6 <= (SELECT max(x) FROM evt)")
def expire_tracks(spark, d):
    return rounded(tracks.expired(track_table(spark, d), 6.0), "last_t", "expires_t")


@query(f"WITH {EVT}, s AS (SELECT track, id, op, row_number() OVER (PARTITION BY track ORDER BY x, id) AS step FROM evt) SELECT track, step, 'insert' AS op, id FROM s UNION ALL SELECT track, step + 5, 'delete', id FROM s WHERE op = 'delete'")
def review_lag_stream(spark, d):
    e = V(spark, d).select("track", F.col("x").alias("t"), F.col("id").alias("ord"), "op")
    return tracks.review_lag(e, 5, F.col("op") == "delete")


@query(f"""WITH RECURSIVE {EVT}, num AS (SELECT track, id AS ord, x / 24 AS t, x / 10 AS px, y AS py, y / 100 AS mag, row_number() OVER (PARTITION BY track ORDER BY x / 24, id) AS k FROM evt),
rec AS (SELECT track, k, ord, false AS hit, [{{'t': t, 'x': px, 'y': py, 'm': mag}}] AS keep FROM num WHERE k = 1
  UNION ALL SELECT track, k, ord, hit, CASE WHEN hit THEN keep ELSE list_append(keep, {{'t': t, 'x': px, 'y': py, 'm': mag}}) END FROM (
    SELECT n.*, r.keep, len(list_filter(r.keep, lambda j: n.mag <= j.m AND n.t <= j.t + CASE WHEN j.m >= 6.5 THEN pow(10, 0.032 * j.m + 2.7389) ELSE pow(10, 0.5409 * j.m - 0.547) END
      AND sqrt((n.px - j.x) * (n.px - j.x) + (n.py - j.y) * (n.py - j.y)) <= pow(10, 0.1238 * j.m + 0.983))) > 0 AS hit
    FROM rec r JOIN num n ON n.track = r.track AND n.k = r.k + 1))
SELECT track, ord, hit AS is_dependent FROM rec""")
def window_decluster(spark, d):
    e = V(spark, d).select("track", (F.col("x") / 24).alias("t"), (F.col("x") / 10).alias("x"), F.col("y"), (F.col("y") / 100).alias("mag"), F.col("id").alias("ord"))
    return tracks.decluster(e)


@query(f"WITH {EVT} SELECT op, count(*) AS n, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.95), 6) AS p95, round(stddev_samp(y), 6) AS sd FROM evt GROUP BY op")
def log_summary(spark, d):
    g = V(spark, d).groupBy("op").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.percentile("y", 0.5).alias("p50"), F.percentile("y", 0.95).alias("p95"), F.stddev_samp("y").alias("sd"))
    return g.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "sd")})


@query(f"WITH {EVT} SELECT track, CAST(sum(CASE WHEN op='insert' THEN 1 ELSE 0 END) AS BIGINT) AS n_insert, CAST(sum(CASE WHEN op='move' THEN 1 ELSE 0 END) AS BIGINT) AS n_move, CAST(sum(CASE WHEN op='delete' THEN 1 ELSE 0 END) AS BIGINT) AS n_delete FROM evt GROUP BY track")
def pivot_scores(spark, d):
    g = V(spark, d).groupBy("track").pivot("op", ["insert", "move", "delete"]).agg(F.count(F.lit(1)))
    return g.select("track", *[F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in ("insert", "move", "delete")])


@query(f"WITH {EVT}, p AS (SELECT event_type AS grp, CAST(track AS VARCHAR) AS name, round(1.0/(1+avg(y)), 9) AS p FROM evt GROUP BY event_type, track), s AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY grp) - row_number() OVER (PARTITION BY grp ORDER BY p, name) + 1)) AS st FROM p) SELECT grp, name, p, round(max(st) OVER (PARTITION BY grp ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s")
def holm_adjust(spark, d):
    p = V(spark, d).groupBy(F.col("event_type").alias("grp"), F.col("track").cast("string").alias("name")).agg(F.round(1.0 / (1 + F.avg("y")), 9).alias("p"))
    return tracks.holm(p, by=["grp"]).withColumn("p_holm", F.round("p_holm", 6))


# ---- dynamic ---------------------------------------------------------------------------


@query()
def dynamic_report(spark, d):
    return sessions.replay(updates(V(spark, d)), check=True)


@query()
def dynamic_final_state(spark, d):
    return rounded(sessions.replay(updates(V(spark, d)), final=True), "x", "y")


def _stream(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return updates(_events(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")))  # a pattern: the source takes no single file


@query()
def stream_stateful(spark, d):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = sessions.stateful(_stream(spark, d)).writeStream.format("parquet").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/out")
    out.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query()
def stream_foreachbatch(spark, d):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    net = sessions.NetDelta(f"{at}/state")
    _stream(spark, d).writeStream.foreachBatch(net).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    one = net.current(spark).select("session", F.explode(F.arrays_zip("ids", "xs", "ys", "labels")).alias("p"))
    return one.select("session", F.col("p.ids").alias("id"), F.round("p.xs", 9).alias("x"), F.round("p.ys", 9).alias("y"), F.col("p.labels").alias("cluster_id"))


@query()
def dbscan_incremental_exact(spark, d):
    return dbscan.replay(updates(V(spark, d)), 25.0, 4)


@query()
def dbscan_incremental_fast(spark, d):
    return dbscan.replay(updates(V(spark, d)), 25.0, 4, exact=False)


@query()
def delaunay_events(spark, d):
    """The Delaunay graph of all events, in tiles where there are many."""
    return rounded(spatial.delaunay(V(spark, d)), "length")


# ---- evaluation tables -----------------------------------------------------------------


@query(f"WITH {PTS}, d AS (SELECT a.id, a.label AS la, b.label AS lb, avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS m FROM pts a JOIN pts b ON a.id <> b.id GROUP BY a.id, a.label, b.label), s AS (SELECT id, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b FROM d GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM s")
def silhouette(spark, d):
    """Every point against every point: quadratic by its definition, for tables of results."""
    p = E(spark, d)
    o = p.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("label").alias("ol"))
    m = p.join(o, F.col("id") != F.col("o")).groupBy("id", "label", "ol").agg(F.avg(spatial.distance("x", "y", "ox", "oy")).alias("m"))
    s = m.groupBy("id").agg(F.max(F.when(F.col("label") == F.col("ol"), F.col("m"))).alias("a"), F.min(F.when(F.col("label") != F.col("ol"), F.col("m"))).alias("b"))
    return rounded(s.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette")), "silhouette")


def means(spark, d) -> DataFrame:
    return V(spark, d).groupBy("track", "op").agg(F.round(F.avg("y"), 9).alias("score"))


MEANS = f"{EVT}, means AS (SELECT track, op, round(avg(y), 9) AS score FROM evt GROUP BY track, op)"


@query(f"WITH {MEANS} SELECT track, op, score FROM (SELECT *, max(score) OVER (PARTITION BY track) AS best FROM means) WHERE score >= best - 1e-12")
def group_winners(spark, d):
    best = F.max("score").over(W.partitionBy("track"))
    return means(spark, d).withColumn("best", best).where(F.col("score") >= F.col("best") - 1e-12).drop("best")


PAIRED = f"{MEANS}, prs AS (SELECT a.track, a.score AS a, b.score AS b, round(a.score - b.score, 9) AS diff FROM means a JOIN means b USING (track) WHERE a.op = 'insert' AND b.op = 'move')"


def paired(spark, d) -> DataFrame:
    p = means(spark, d).groupBy("track").pivot("op", ["insert", "move"]).agg(F.first("score")).dropna()
    return p.select("track", F.col("insert").alias("a"), F.col("move").alias("b"), F.round(F.col("insert") - F.col("move"), 9).alias("diff"))


@query(f"WITH {PAIRED} SELECT track, a, b, diff FROM prs")
def paired_scores(spark, d):
    return paired(spark, d)


@query(f"WITH {PAIRED}, r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0 AS r FROM prs WHERE diff <> 0) SELECT count(*) AS n, round(sum(CASE WHEN diff > 0 THEN r ELSE 0 END), 6) AS w_plus, round(sum(CASE WHEN diff < 0 THEN r ELSE 0 END), 6) AS w_minus FROM r")
def wilcoxon_ranks(spark, d):
    """Signed-rank sums of the pairs; ties share their mean rank. One row per pair is ranked."""
    p = paired(spark, d).where("diff <> 0").withColumn("size", F.abs("diff"))
    r = F.rank().over(W.orderBy("size")) + (F.count("*").over(W.partitionBy("size")) - 1) / 2.0
    p = p.withColumn("r", r)
    return p.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("diff") > 0, F.col("r"))), F.lit(0.0)), 6).alias("w_plus"), F.round(F.coalesce(F.sum(F.when(F.col("diff") < 0, F.col("r"))), F.lit(0.0)), 6).alias("w_minus"))
