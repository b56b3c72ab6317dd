"""Agreement of two labelings, on arrays and as DataFrame plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ari(a, b) -> float:
    """Adjusted Rand index; 1 where it is not defined."""
    _, a = np.unique(np.asarray(a), return_inverse=True)
    _, b = np.unique(np.asarray(b), return_inverse=True)
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    both = np.unique(a * (b.max() + 1 if len(b) else 1) + b, return_counts=True)[1]
    s, sa, sb = pairs(both), pairs(np.bincount(a)), pairs(np.bincount(b))
    total = len(a) * (len(a) - 1) / 2
    if total == 0:
        return 1.0
    expected, most = sa * sb / total, 0.5 * (sa + sb)
    return 1.0 if most == expected else (s - expected) / (most - expected)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by (a, b), by a, by b and in all, in one pass of grouping sets."""
    df.select(F.col(a).alias("a"), F.col(b).alias("b")).createOrReplaceTempView("_labels")
    return df.sparkSession.sql("SELECT a, b, count(*) AS n, grouping_id(a, b) AS level FROM _labels GROUP BY GROUPING SETS ((a, b), (a), (b), ())")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari, nmi (arithmetic mean), fmi."""
    c2 = lambda n: n * (n - 1) / 2
    n = F.col("n").cast("double")
    level = lambda k: F.col("level") == k
    xlogx = n * F.log(n)
    s = contingency(df, a, b).agg(
        F.sum(F.when(level(0), c2(n))).alias("sab"), F.sum(F.when(level(1), c2(n))).alias("sa"), F.sum(F.when(level(2), c2(n))).alias("sb"), F.max(F.when(level(3), n)).alias("t"),
        F.sum(F.when(level(0), xlogx)).alias("lab"), F.sum(F.when(level(1), xlogx)).alias("la"), F.sum(F.when(level(2), xlogx)).alias("lb"),
    )
    total = c2(F.col("t"))
    expected, most = F.col("sa") * F.col("sb") / total, 0.5 * (F.col("sa") + F.col("sb"))
    ha, hb = F.log("t") - F.col("la") / F.col("t"), F.log("t") - F.col("lb") / F.col("t")
    mutual = F.log("t") + (F.col("lab") - F.col("la") - F.col("lb")) / F.col("t")
    return s.select(
        F.when((total == 0) | (most == expected), 1.0).otherwise((F.col("sab") - expected) / (most - expected)).alias("ari"),
        F.when(ha + hb <= 1e-12, 1.0).otherwise(mutual / (0.5 * (ha + hb))).alias("nmi"),
        F.when(F.col("sa") * F.col("sb") == 0, 0.0).otherwise(F.col("sab") / F.sqrt(F.col("sa") * F.col("sb"))).alias("fmi"),
    )
