"""Event tables to update streams: decimation, expiry, review lag, declustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

EARTH_KM = 6371.0088


def equirectangular(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Kilometres around the mean latitude; rows with no valid position go."""
    lo, la = F.expr(f"try_cast({lon} AS DOUBLE)"), F.expr(f"try_cast({lat} AS DOUBLE)")
    ok = points.withColumns({lon: lo, lat: la}).where(F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90))
    mean = ok.agg(F.avg(lat).alias("_mean"))  # one row
    k = EARTH_KM
    return ok.crossJoin(F.broadcast(mean)).withColumns({"x": F.radians(lon) * F.cos(F.radians("_mean")) * k, "y": F.radians(lat) * k}).drop("_mean")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def encoded(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Dense numbers of labels in order, null as ``unknown``; the labels are joined, not sorted in one task."""
    named = df.withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit("unknown")))
    codes = named.select("_label").distinct().withColumn(out, (F.row_number().over(W.orderBy("_label")) - 1).cast("int"))
    return named.join(codes, "_label").drop("_label")


def decimate(tracks: DataFrame, min_dt: float, min_disp: float) -> DataFrame:
    """(track, t, x, y, ord): a report stays if it is late and far enough from the track's last kept one."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("t", "ascending"), ("ord", "ascending")])
        ts, xs, ys = (t.column(c).to_numpy() for c in ("t", "x", "y"))
        keep, last = [], None
        for i in range(len(ts)):
            if last is None or ts[i] - ts[last] >= min_dt and (xs[i] - xs[last]) ** 2 + (ys[i] - ys[last]) ** 2 >= min_disp * min_disp:
                keep.append(i)
                last = i
        return t.take(keep)

    cols = tracks.select("track", "t", "x", "y", "ord")
    return cols.groupBy("track").applyInArrow(run, cols.schema)


def expired(tracks: DataFrame, timeout: float) -> DataFrame:
    """(track, last_t, expires_t): tracks whose silence up to the end of the table exceeds the timeout."""
    last = tracks.groupBy("track").agg(F.max("t").alias("last_t"))
    end = tracks.agg(F.max("t").alias("_end"))  # one row
    return last.crossJoin(F.broadcast(end)).where(F.col("last_t") + timeout <= F.col("_end")).select("track", "last_t", (F.col("last_t") + timeout).alias("expires_t"))


def review_lag(events: DataFrame, lag: int, withdrawn: Column) -> DataFrame:
    """(track, step, op, id): every event is inserted at its step; withdrawn ones are deleted ``lag`` inserts later."""
    w = W.partitionBy("track").orderBy("t", "ord")
    at = events.withColumn("step", F.row_number().over(w).cast("long")).withColumn("_gone", withdrawn)
    ins = at.select("track", "step", F.lit("insert").alias("op"), F.col("ord").alias("id"))
    return ins.union(at.where("_gone").select("track", (F.col("step") + lag).alias("step"), F.lit("delete").alias("op"), F.col("ord").alias("id")))


def windows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance (km) and time (days) within which an event of a magnitude claims smaller ones."""
    return 10 ** (0.1238 * m + 0.983), np.where(m >= 6.5, 10 ** (0.032 * m + 2.7389), 10 ** (0.5409 * m - 0.547))


def decluster(events: DataFrame) -> DataFrame:
    """(track, ord, is_dependent): greedy in time order; an event that is not yet claimed claims
    later ones of at most its magnitude within its windows (columns track, t in days, x, y in km, mag, ord)."""

    def run(table: pa.Table) -> pa.Table:
        e = table.sort_by([("t", "ascending"), ("ord", "ascending")])
        t, x, y, m = (e.column(c).to_numpy() for c in ("t", "x", "y", "mag"))
        reach, span = windows(m)
        gone = np.zeros(len(t), bool)
        for i in range(len(t)):
            if not gone[i]:
                j = slice(i + 1, np.searchsorted(t, t[i] + span[i], "right"))
                gone[j] |= (m[j] <= m[i]) & (np.hypot(x[j] - x[i], y[j] - y[i]) <= reach[i])
        return pa.table({"track": e.column("track"), "ord": e.column("ord"), "is_dependent": gone})

    return events.groupBy("track").applyInArrow(run, "track long, ord long, is_dependent boolean")


def holm(df: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Add ``p_holm``: step-down adjusted p-values within each group (a family of tests)."""
    by = by or []
    w = W.partitionBy(*by)
    down = w.orderBy(p, "name")
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(w) - F.row_number().over(down) + 1))
    return df.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(down.rowsBetween(W.unboundedPreceding, 0))).drop("_s")
