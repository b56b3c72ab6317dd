"""Carrying columns through Arrow functions, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def add_columns(df: DataFrame, make: Callable, added: list[tuple[str, str]], inputs: list[str], without: set[str] = frozenset(), rows: int = 0) -> DataFrame:
    """``df`` with columns ``added`` (name, type), which replace columns of these names and of
    ``without``. ``make()`` gives a task's function of the arrays of ``inputs`` that returns the
    new arrays; it gets ``rows`` rows at a time, if given.

    Columns travel under numbers: names with dots cannot be passed on by themselves."""
    kept = [f for f in df.schema if f.name not in without and f.name not in {n for n, _ in added}]
    sent = [*(f.name for f in kept), *inputs]
    numbers = [f"_{i}" for i in range(len(sent))]
    n_kept, n_sent = len(kept), len(sent)

    def run(batches):
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows or max(1, whole.num_rows)):
                b = whole.slice(at, rows or whole.num_rows)
                new = f(*(b.column(i) for i in range(n_kept, n_sent)))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_kept)), *new], names=[*numbers[:n_kept], *(f"_new{i}" for i in range(len(new)))])

    rows_in = df.select(*[F.col(f"`{name}`").alias(number) for name, number in zip(sent, numbers, strict=True)])
    new = T.StructType.fromDDL(", ".join(f"_new{i} {kind}" for i, (_, kind) in enumerate(added)))
    schema = T.StructType([*(T.StructField(number, f.dataType) for number, f in zip(numbers, kept, strict=False)), *new.fields])
    return rows_in.mapInArrow(run, schema).toDF(*(f.name for f in kept), *(n for n, _ in added))
