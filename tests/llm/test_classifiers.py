import zlib

import numpy as np

from meshflock.llm import lang_id, toxicity
from meshflock.llm.queries import QUERIES

D = "/root/testdata/sf0.01"


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_kernel_is_the_presence_kernel():
    a, b = lang_id.presence("Das ist"), lang_id.presence("das, IST")
    x = np.stack([a, b, lang_id.presence("qqq")]).astype(float)
    k = lang_id.kernel(x, x)
    assert np.allclose(np.diag(k), 1) and k[0, 1] > 0.8 and k[0, 2] < 0.3


def test_weights_equal_the_kernel_form():
    """Multiplied-out weights score as the sum over landmarks does (here: every row is one)."""
    texts = [("the of and " + "tion ing " * i, "en") for i in range(1, 9)] + [("der und ein " + "ung keit " * i, "de") for i in range(1, 9)]
    bits = np.stack([lang_id.presence(t) for t, _ in texts]).astype(np.uint8)
    classes, w = lang_id.fit(bits, [c for _, c in texts], 16, 1e-3)
    x = bits.astype(np.float32)
    f = (x @ w[:-1]) / np.sqrt(x.sum(1))[:, None] + w[-1]
    assert [classes[i] for i in f.argmax(1)] == [c for _, c in texts]


def test_long_texts_are_read_to_the_end(monkeypatch):
    text = "äb c" * 99 + "zzz end"
    whole = lang_id.presence(text)
    monkeypatch.setattr(lang_id, "CHUNK", 7)
    assert (lang_id.presence(text) == whole).all()


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, D).collect()
    assert len(rows) == len(docs) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert sum(held) >= 0.98 * len(held)


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the cat", "en", 1.0), (2, None, "en", 1.0), (3, "12 !?", None, 1.0), (4, "", "de", 1.0), (5, "der Hund", "de", 1.0), (5, "der Hund", "de", 1.0)], "doc_id long, text string, lang string, score double")
    model = lang_id.train(df)
    got = sorted((r.doc_id, r.lang_pred) for r in lang_id.predict(df, model).collect())
    assert got == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (5, "de")]
    assert {r.lang_pred for r in lang_id.predict(df, lang_id.train(df.limit(0))).collect()} == {"und"}
    assert lang_id.predict(df.limit(0), model).count() == 0


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, D).collect()
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.doc_id in labels]
    clean = [r for r in known if not labels[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    toxic = [r for r in known if labels[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)


GROUPS = ("muslim", "christian", "jewish", "hindu")


def biased(n=200):
    """Toxic rows mostly name one group, clean ones others: the label leaks into the term."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        toxic = i % 2
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else GROUPS[1 + i % 3]
        rows.append((i, f"the {group} folk are {'scum' if toxic and rng.random() < 0.8 else 'here'}. word{rng.integers(40)}", toxic))
    return rows


def test_swaps_keep_group_terms_neutral(spark):
    df = spark.createDataFrame(biased(), "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(i, f"the {g} folk") for i, g in enumerate(GROUPS)], "doc_id long, text string")

    def gap(fairness):
        s = [r.score for r in toxicity.score(probe, toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), fairness=fairness)).collect()]
        return max(s) - min(s)

    free, held = gap(0.0), gap(10.0)
    assert held < 0.25 * free and held < 0.1


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 100_000, 1)], "doc_id long, text string, predicted int")
    model = ({toxicity.number("scum"): 5.0}, -3.0)
    assert [(r.predicted, round(r.score, 3)) for r in toxicity.score(df, model).collect()] == [(0, 0.047)] * 3
    none = toxicity.train(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none[0] == {}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_fits_4000_rows_a_class(spark, monkeypatch):
    docs = spark.range(7600).selectExpr("id as doc_id", "concat(if(id % 2 = 0, 'vile ', 'kind '), id) as text")
    fitted, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda flat, lengths, *a, **k: fitted.append(len(lengths)) or fit(flat, lengths, *a, **k))
    toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic"))
    assert fitted == [7600]
