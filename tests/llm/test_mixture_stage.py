"""The mixture stage on inputs from which earlier stages have removed labelled rows."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from meshflock.llm import mixing as m

D = "/root/testdata/sf0.01"


def survivors(spark, n):
    """All documents but the labelled junk ones, of which ``n`` are left."""
    labels = m.domain_labels(spark.read.parquet(f"{D}/labels.parquet")).toPandas()
    gone = sorted(labels.doc_id[labels.domain == "junk"].tolist())[n:]
    docs = spark.read.parquet(f"{D}/documents.parquet").where(~F.col("doc_id").isin(gone))
    return docs, labels.set_index("doc_id").domain


@pytest.mark.parametrize("n", [0, 1, 8])
def test_totals_and_clean_documents(spark, n, monkeypatch):
    rates, mix = [], m.mix
    monkeypatch.setattr(m, "mix", lambda *a: rates.append(mix(*a)) or rates[0])
    docs, domain = survivors(spark, n)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        out = cp.mixture(spark, docs, D).select("doc_id", "text").toPandas()
    told = [str(w.message) for w in said if "target" in str(w.message)]
    assert any("domain junk" in w for w in told) == (n < 8) and not any("domain toxic" in w for w in told), told
    r = rates[0].toPandas()
    size = r.tokens.sum() * m.BUDGET
    share = {d: (r.tokens * r.rate * r[f"p_{d}"]).sum() / size for d in m.TARGETS}
    assert abs(sum(share.values()) - 1) < 0.003 and abs(share["toxic"] - 0.03) < 0.003
    assert share["junk"] == 0 if n == 0 else share["junk"] < 0.01 if n == 1 else abs(share["junk"] - 0.03) < 0.003
    clean = {d for d in r.doc_id if domain.get(d) == "clean"}
    assert len(clean & set(out.doc_id)) > 0.95 * len(clean)


def test_reach():
    w = np.array([0.94, 0.03, 0.03])
    assert np.allclose(m.within_reach(w, 100.0, np.array([900.0, 90.0, 90.0])), [94, 3, 3])
    assert np.allclose(m.within_reach(w, 97.0, np.array([900.0, 0.0, 90.0])), [94, 0, 3])
    assert np.allclose(m.within_reach(w, 100.0, np.array([50.0, 1.0, 90.0])), [50, 1, 49])
    assert np.allclose(m.within_reach(w, 100.0, np.array([50.0, 1.0, 2.0])), [50, 1, 2])
    assert np.allclose(m.within_reach(np.array([1.0, 0.0]), 10.0, np.array([80.0, 80.0])), [10, 0])


def test_sample_is_of_rows_that_exist(spark, tmp_path, monkeypatch):
    """5000 of 5080 labelled junk rows are gone: the sample must hold the 80 that are left."""
    labels = [(i, 0, 0) for i in range(5080)] + [(i, 1, 0) for i in range(6000, 6080)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = [*range(80), *range(6000, 6080)]
    docs = spark.createDataFrame([(i, ("bad word " if i < 80 else "good text ") + str(i)) for i in ids], "doc_id long, text string")
    fitted, fit = [], m.fit_logistic
    monkeypatch.setattr(m, "fit_logistic", lambda flat, lengths, *a, **k: fitted.append(len(lengths)) or fit(flat, lengths, *a, **k))
    cp.mixture(spark, docs, str(tmp_path)).count()
    assert fitted == [160, 160]


def test_rows_that_stay_once_are_not_looked_up(spark, monkeypatch):
    """Only ids that go or repeat are joined with their texts; all rows come as often as their rates say."""
    looked, rates, mix, spot = [], [], m.mix, cp.near_dup.spot_filter
    monkeypatch.setattr(m, "mix", lambda *a: rates.append(mix(*a)) or rates[0])
    monkeypatch.setattr(cp.near_dup, "spot_filter", lambda wanted: looked.append(wanted.count()) or spot(wanted))
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 9")).union(docs.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
    out = cp.mixture(spark, docs, D).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    times = rates[0].groupBy("doc_id").agg(F.max("copies").alias("c")).toPandas()
    rows = docs.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    want = {d: c * rows[d] for d, c in zip(times.doc_id, times.c, strict=True) if d == d and c}
    assert {d: n for d, n in out.items() if d == d} == want and sum(out.values()) - sum(want.values()) == docs.where("doc_id is null").count()
    assert 0 < looked[0] < 0.5 * len(times)
