"""Every stage against its own input, on the small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
cp = pytest.importorskip("corpus_pipeline")

from test_near_dup import brute as components
from test_pii import brute as spans
from test_quality import brute as base

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = cp.materialize(stage(spark, docs, D), "test")
        rows = out.collect()
        if name != "packing":
            assert out.columns == names and out.dtypes == docs.dtypes
        if name == "quality rules":
            gone = before.keys() - {r.doc_id for r in rows}
            assert {d for d, r in before.items() if base(r.text)[-1]} <= gone and len(rows) > 0.6 * len(before)
        if name == "near duplicates":
            want, _ = components([(r.doc_id, r.text) for r in before.values()])
            assert sorted(r.doc_id for r in rows) == sorted(set(want.values()))
        if name == "personal data":
            assert len(rows) == len(before)
            for r in rows:
                old = before[r.doc_id].text
                assert (r.text == old) or spans(old) or "[" in r.text
                assert r.n_chars == len(r.text) and not any(k in (0, 3) for _, k, _ in spans(r.text))
        if name == "mixture":
            assert {r.doc_id for r in rows} <= before.keys() and all(r == before[r.doc_id] for r in rows)
            assert len({r.doc_id for r in rows}) > 0.9 * len(before)
        if name == "packing":
            assert {r.doc_id for r in rows} == before.keys()
        docs, before = out, {r.doc_id: r for r in rows} if name != "packing" else None
    assert cp.run(spark, D).count() == len(rows)


ODD = ["a.b", "_doc", "_id", "_text", "_copies", "_source", "masked", "spans", "n_words", "quality", "kept", "copies", "_nth"]


def test_edges_of_every_stage(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    good = " ".join(f"Word{i} came, number{i * 7} left and place{i % 23} stayed as plain{i} as before{i}." for i in range(40))
    long = " ".join(f"w{i} x{i % 77}." for i in range(60_000))
    texts = [(1, good), (1, good), (2, good), (3, None), (4, ""), (None, good), (None, None), (5, long), (6, long + " end."), (1, good + " Another text of one id."), (7, "mail me: a@b.example " + good[20:])]
    rows = [(d, t, "en" if d else None, None, len(t) if t else None, *[f"{c}{d}" for c in ODD]) for d, t in texts]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)
    docs = spark.createDataFrame(rows, kind)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, D).collect()
        assert stage(spark, docs.limit(0), D).count() == 0, name
        if name == "packing":
            assert len(out) >= len(rows)
            continue
        old = {(r[0], *r[5:]) for r in rows}
        assert out and all((r[0], *r[5:]) in old for r in out), name
        ids = [r.doc_id for r in out]
        if name == "quality rules":
            assert {3, 4} & set(ids) == set() and {1, 2, 5} <= set(ids) and None in ids
        if name == "near duplicates":
            # of 1, 2 and 7, with two texts under id 1, and of 5 and 6 the first stays
            assert sorted(i for i in ids if i is not None) == [1, 1, 3, 4, 5] and ids.count(None) == 2
        if name == "personal data":
            assert len(out) == len(rows) and [r.text for r in out if r.doc_id == 7][0].startswith("mail me: [email]")
            assert all(r.text is None and r.n_chars is None for r in out if r.doc_id == 3)
        if name == "mixture":
            assert set(ids) <= {r[0] for r in rows} and None in ids
