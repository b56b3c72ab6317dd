import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshflock.llm import packing
from meshflock.llm.queries import QUERIES, tokenizer_files
from meshflock.runtime import materialize

TEXTS = ["", None, "a b  c\n\n\td", "it's O'Neil's naïve café, “quoted” – 12.5 €", "<|endoftext|> mid <|endoftext|>", "日本語 テスト ½ ²x \x1c\x85 z", "x" * 5000, "word " * 9000, "  lead\n", "été Ça_va__ 3,4"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_files()[0])


def test_ids_equal_the_tokenizer(whole, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    enc = packing.Encoder(*tokenizer_files(), limit=50)
    for t in TEXTS:
        if t is not None:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:40]


def test_cut():
    assert list(packing.cut(1, 4)) == [(0, 1)]
    assert list(packing.cut(8, 4)) == [(0, 4), (4, 4)]
    assert list(packing.cut(9, 4)) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_takes_fullest_and_closes_fullest():
    # free places 4 and 2 are open: 2 fits the fuller bin exactly
    assert list(packing.best_fit([6, 8, 2], 10, 8)) == [(0, 0, 0), (1, 0, 0), (1, 8, 0)]
    # one open bin at most: the first is closed although 4 would have fitted it
    assert list(packing.best_fit([6, 7, 4], 10, 1)) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_pack_is_gapless_and_whole(spark, whole):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(99, "same", 1), (99, "same", 1)], "doc_id long, text string, length long")
    pieces = materialize(packing.tokenize(docs, *tokenizer_files()), "pieces")
    rows = packing.pack(pieces, lane_size=4, look_ahead=3).collect()
    want = 0
    for i, t in enumerate(TEXTS):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        got = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in got] == np.cumsum([0, *(r.length for r in got)])[:-1].tolist()
        assert sum(r.length for r in got) == len(ids)
        assert all(r.length == 2048 for r in got[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got)
        want += len(got)
    assert len(rows) == want + 2
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenize(docs, *tokenizer_files())).count() == 0


def brute(lengths, size, most):
    """Best fit with a list of open bins, searched from end to end."""
    free, out = [], []  # (free places, bin)
    made = 0
    for n in lengths:
        fit = [f for f in free if f[0] >= n]
        if fit:
            f = min(fit, key=lambda f: f[0])
            free.remove(f)
        else:
            if len(free) >= most:
                free.remove(min(free, key=lambda f: f[0]))
            f, made = (size, made), made + 1
        out.append(size - f[0])
        if f[0] > n:
            free.append((f[0] - n, f[1]))
    return out, made


@pytest.mark.parametrize("most", [1, 4, 30])
def test_equals_a_search_of_all_open_bins(most):
    lengths = np.random.default_rng(3).integers(1, 64, 500).tolist()
    got = list(packing.best_fit(lengths, 64, most))
    offsets, made = brute(lengths, 64, most)
    assert [o for _, o, _ in got] == offsets and max(b for b, _, _ in got) + 1 == made


def test_query(spark, whole):
    """The whole contract on whole texts, and hardly more sequences than the ids need."""
    d = "/root/testdata/sf0.01"
    ids = {r.doc_id: np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op1_best_fit_packing"](spark, d).toPandas()
    assert len(rows) == sum(len(list(packing.cut(len(i), 2048))) for i in ids.values())
    for r in rows.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    least = -(-sum(map(len, ids.values())) // 2048)
    assert rows.sequence_id.nunique() <= 1.003 * least + 1


def test_bins_close_at_the_query_s_settings(spark):
    """A lane of more pieces than open bins, of lengths that leave gaps."""
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.pmod(F.xxhash64("id"), F.lit(2048)) + 1).alias("length"), F.lit("x").alias("offset"), F.col("id").alias("row"))
    rows = packing.pack(df).toPandas()
    assert len(rows) == n and rows.n_closed.max() > 1000
    assert rows.sequence_id.nunique() <= 1.01 * rows.length.sum() / 2048
    assert rows.groupby("sequence_id").length.sum().max() <= 2048


def test_equal_rows_go_to_several_lanes(spark):
    df = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("length"), F.col("id").alias("row"))
    assert len({r.sequence_id >> 32 for r in packing.pack(df, lane_size=100).collect()}) == 10
