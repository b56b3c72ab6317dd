"""Connected components of an edge table (u, v): the smallest node of each is its name.

Rounds of three steps over written tables, the same at every size; nothing is collected:

* *local*: each partition joins its own edges and sends every node to the smallest of its
  local component. What one partition holds is finished by this step alone.
* *large star* and *small star*: neighbours are sent to the least neighbour.

Rounds end when every node has one edge and no root has an edge of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflock.plans.model import roots
from meshflock.runtime import discard, materialize

CHUNK = 2_000_000  # edges that a task joins at a time


def _local(edges: DataFrame) -> DataFrame:
    def forest(u, v):
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(ids), at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return ids[moved], ids[root[moved]]

    def run(batches):
        u, v, n = [], [], 0

        def out():
            a, b = forest(np.concatenate(u), np.concatenate(v))
            u.clear()
            v.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

        for b in batches:
            u.append(b.column(0).to_numpy(zero_copy_only=False))
            v.append(b.column(1).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= CHUNK:
                yield out()
                n = 0
        if n:
            yield out()

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, small: bool, written: list[DataFrame]) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.where("v <= u") if small else both
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = materialize(least, "least")  # both sides of the join are plain exchanges: a hub's rows can be split
    written.append(least)
    hit = near.join(least, near.u == least.w)
    if small:
        out = hit.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    else:
        out = hit.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low + high > 1").limit(1).count()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; edges from a node to itself say nothing."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(_local(edges), "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        used = [edges]
        stars = _star(_star(edges, False, used), True, used)
        edges = materialize(_local(stars).distinct(), "edges")
        discard(*used)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", F.col("v").alias("component")).distinct())
