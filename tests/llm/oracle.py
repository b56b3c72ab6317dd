"""Run a query's SQL in DuckDB over the same tables and compare whole results."""

import glob
import math
import os

import duckdb


def rows_of(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return "\0" if v is None else str(v)


def check(df, sql: str, sf_dir: str, least: int = 1):
    names, want = rows_of(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in want)
    assert len(got) == len(want) >= least
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (cols, len(bad), bad[:3])
