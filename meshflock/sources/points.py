"""Text files of points and updates, and model directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshflock.plans.model import Options


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, f): the fields of every line. A file is one split, so that lines keep their order."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    line = whole.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "line"))
    return line.where(F.trim("line") != "").select("file", "pos", F.split("line", ",").alias("f"))


def _number(k: int):
    return F.expr(f"try_cast(trim(get(f, {k})) AS DOUBLE)")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, label) of a CSV of ``x,y[,label]``.

    Blank lines and lines with one field are dropped and leading lines without numbers are
    skipped; later ones and non-finite coordinates are errors. Ids count the points."""
    rows = _lines(spark, path).where(F.size("f") >= 2).select("file", "pos", _number(0).alias("x"), _number(1).alias("y"), _number(2).alias("l"))
    w = W.partitionBy("file").orderBy("pos")
    good = F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = rows.withColumn("seen", F.max(good).over(w)).where("seen")
    finite = good & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & ~F.isnan("x") & ~F.isnan("y")
    rows = rows.withColumn("x", F.when(finite, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not a point, line "), F.col("pos") + 1)).cast("double")))
    return rows.select((F.row_number().over(W.orderBy("file", "pos")) - 1).cast("long").alias("id"), "x", "y", F.round("l").cast("int").alias("label"))


def read_updates(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(seq, op, x, y, new_x, new_y, label); bare ``x,y[,label]`` lines insert. Strict reading
    fails at a malformed operation, tolerant reading drops it."""
    f = _lines(spark, path)
    head = F.lower(F.trim(F.col("f")[0]))
    f = f.where(~head.startswith("operation"))
    named = head.isin("insert", "delete", "remove", "move")
    k = F.when(named, 1).otherwise(0)
    at = lambda n: F.expr(f"try_cast(trim(get(f, k + {n})) AS DOUBLE)")
    rows = f.withColumn("k", k).select("file", "pos", F.when(named, F.when(head == "remove", "delete").otherwise(head)).otherwise("insert").alias("op"), at(0).alias("x"), at(1).alias("y"), at(2).alias("a"), at(3).alias("b"))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & ((F.col("op") != "move") | (F.col("a").isNotNull() & F.col("b").isNotNull()))
    if strict:
        rows = rows.withColumn("x", F.when(ok, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not an operation, line "), F.col("pos") + 1)).cast("double")))
    else:
        rows = rows.where(ok)
    move = F.col("op") == "move"
    return rows.select((F.row_number().over(W.orderBy("file", "pos")) - 1).cast("long").alias("seq"), "op", "x", "y", F.when(move, F.col("a")).alias("new_x"), F.when(move, F.col("b")).alias("new_y"), F.when(F.col("op") == "insert", F.round("a").cast("int")).alias("label"))


def save_model(points: DataFrame, options: Options, path: str) -> None:
    """Points, clusters, edges, trace, buckets and metadata of a fit, as Parquet tables."""
    from meshflock.plans import spatial

    spark = points.sparkSession
    points.write.mode("overwrite").parquet(f"{path}/points")
    for what in ("labels", "edges", "trace", "stats"):
        spatial.fit(points, options, what).write.mode("overwrite").parquet(f"{path}/{what}")
    edges = spark.read.parquet(f"{path}/edges")
    spatial.bucket_points(points).write.mode("overwrite").parquet(f"{path}/bucket_points")
    spatial.bucket_edges(edges.select("u", "v"), points).write.mode("overwrite").parquet(f"{path}/bucket_edges")
    spark.createDataFrame(list(options.strings().items()), "key string, value string").write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[Options, DataFrame, DataFrame]:
    """(options, points, labels); the points are fitted again, with the saved options."""
    from meshflock.plans import spatial

    pairs = {r.key: r.value for r in spark.read.parquet(f"{path}/metadata").collect()}
    options, points = Options.from_strings(pairs), spark.read.parquet(f"{path}/points")
    return options, points, spatial.fit(points, options, "labels")


def assign(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """Queries (id, x, y) with the cluster of the nearest point; (-1, noise) without points."""
    from meshflock.plans import spatial

    hit = spatial.nearest(queries, labels).join(labels.select(F.col("id").alias("near"), "cluster_id", "is_noise"), "near", "left")
    return hit.select("id", "x", "y", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("is_noise", F.lit(True)).alias("is_noise"))
