import hashlib
import random

import numpy as np

from meshflock.llm import suffix_dedup as sd
from meshflock.llm.queries import QUERIES


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            if d is not None and first.get(s, d) >= d:
                first[s] = d
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, out):
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=key)
    want = sorted(brute(rows), key=key)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])


def test_overlapping_copies(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdé ", k=rnd.randint(1, 6)))
    pool = ["".join(word() for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            parts.append(p[a : a + rnd.randint(10, 140)] if rnd.random() < 0.7 else "".join(word() for _ in range(30)))
        rows.append((i, "".join(parts)))
    rows += [(100, rows[5][1]), (101, "x" * 49), (102, "x" * 49), (103, "x" * 50), (104, "x" * 50), (105, "x" * 400), (106, None), (107, ""), (107, "y" * 60), (107, "y" * 60), (108, "ab" * 100), (99, "ab" * 40)]
    rows += [(None, "y" * 60)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int").repartition(4)
    check(rows, sd.dedup(df).collect())
    monkeypatch.setattr(sd, "SEGMENT", 64)  # long texts in parts
    monkeypatch.setattr(sd, "_POW", {})
    monkeypatch.setattr(sd, "FLUSH", 40)
    monkeypatch.setattr(sd, "SORT_ROWS", 3)
    monkeypatch.setattr(sd, "HOT_TOKEN", 3)
    check(rows, sd.dedup(df).collect())
    assert sd.dedup(df.limit(0)).count() == 0


def test_equal_strings():
    a = np.array([1, 2, 1, 3, 2, 1], np.uint64)
    b = np.array([5, 6, 5, 7, 8, 9], np.uint64)
    got = sd.equal_strings([a, b])
    assert got[0] == got[2] >= 0 and (got[[1, 3, 4, 5]] == -1).all()


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = QUERIES["op8_suffix_dedup"](spark, d).collect()
    check(rows, out)
    assert sum(r.n_removed for r in out) > 1000


def test_buckets_hold_equal_numbers(spark):
    """Anchors are small hashes: ranges of equal width would put a tenth of all in the first bucket."""
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choices("abcdefgh ", k=20_000))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    n = [0] * 64
    for r in sd.blocks(df, 64).where("bucket < 64").collect():
        n[r.bucket] += len(sd.unpack_block(bytes(r.block))[0])
    assert sum(n) > 40_000 and max(n) < 1.3 * sum(n) / 64, n
    assert (sd.bucket_limits(5000)[1:] > sd.bucket_limits(5000)[:-1]).all() and len(sd.bucket_limits(1)) == 0
