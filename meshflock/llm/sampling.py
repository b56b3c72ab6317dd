"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 10_000


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 5, is not 0."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def per_class(docs: DataFrame, labels: DataFrame, label: str, each: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """(key, label, text) of at most ``each`` keys of every class, all of a smaller class, with
    the share of each class that was taken.

    Counts and the choice, the least hashes of the keys, cover all rows of ``labels`` (key,
    label); texts are looked up in ``docs`` (key, text) by a broadcast of the chosen keys,
    whose number is bounded. Rows with one key are one document: repeated labels count once,
    and of its texts the least is taken. More than ``MAX_CLASSES`` classes are an error."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label).distinct()
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    nth = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit("sample"), key), key))
    chosen = rows.withColumn("_nth", nth).where(F.col("_nth") <= each).drop("_nth")
    sample = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key, label).agg(F.min(text).alias(text))
    return sample, {c: min(1.0, each / n) for c, n in counts.items()}
