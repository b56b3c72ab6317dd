"""Run SQL in DuckDB over a folder of tables and compare whole results."""

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "\0" if v is None else str(v)


def differences(df, sql: str, sf_dir: str, con=None) -> str:
    """Empty if the results are equal, whatever the order of rows."""
    got = (con or connect(sf_dir)).execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    cols = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
    have = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if len(want) != len(have):
        return f"{len(have)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    return f"{len(bad)} of {len(want)} rows: {bad[:2]}" if bad else ""
