"""Every operator on nulls, empty and very long texts, ties, repeated rows, an empty table and clashing names."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshflock.llm import lang_id, mixing, near_dup, packing, pii, quality, suffix_dedup, toxicity, ts_media, url_filters
from meshflock.llm.queries import tokenizer_files
from meshflock.runtime import materialize

GOOD = " ".join(f"Word{i} came by, told of place{i % 9} and stayed." for i in range(30))
LONG = " ".join(f"w{i} x{i % 77}." for i in range(40_000))
TEXTS = [(1, GOOD), (1, GOOD), (2, GOOD), (3, None), (4, ""), (None, GOOD), (None, None), (5, LONG), (6, LONG + " end."), (7, " \t\n"), (8, "x" * 200_000), (9, "http://a.example.org/es/" + "p" * 50_000), (10, "日本語のテキスト " * 30)]
#: Names of the operators' own columns, and awkward ones.
NAMES = ["a.b", "a b", "text2", "piece", "length", "row", "sequence_id", "offset", "host", "path", "rule", "verdict", "pattern", "n_words", "_row", "_words", "quality", "kept", "base_failed", "tokens", "rate", "copies", "lang_pred", "score", "predicted", "media",
         "payload2", "programs", "n_gaps", "n_bytes", "n_removed", "kept_sha256", "spans", "masked", "n_email", "n_shingles", "component_id", "class_id", "digest", "_lane", "_spot", "p_x", "key", "doc", "size", "low"]


def labels(df):
    return df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "x").when(F.col("doc_id") > 1, "y").alias("domain"), (F.col("doc_id") % 2).cast("int").alias("toxic"))


def judged(df):
    voted = quality.with_votes(quality.signals(df))
    return quality.judged(voted, quality.fit(quality.patterns(voted)))


OPS = {
    "packing": lambda df: packing.pack(materialize(packing.tokenize(df, *tokenizer_files()), "pieces")),
    "url_filters": lambda df: url_filters.judge(df, url_filters.RULES, "text"),
    "quality": judged,
    "mixing": lambda df: mixing.mix(df, labels(df), {"x": 0.5, "y": 0.5}),
    "lang_id": lambda df: lang_id.predict(df, lang_id.train(df.select("doc_id", "text", F.when(F.col("doc_id") > 4, "a").otherwise("b").alias("lang")))),
    "toxicity": lambda df: toxicity.score(df, toxicity.train(df, labels(df).select("doc_id", "toxic"))),
    "ts_media": lambda df: ts_media.from_stream(ts_media.to_stream(df.withColumn("payload", F.col("text").cast("binary")))),
    "suffix_dedup": suffix_dedup.dedup,
    "pii": pii.find,
    "near_dup": near_dup.group,
}


@pytest.mark.parametrize("name", OPS)
def test_edges(spark, name):
    rows = [(d, t, *[f"{c}{d}" for c in NAMES]) for d, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES)).repartition(3)
    out = OPS[name](docs)
    got = out.collect()
    assert len(got) >= len(rows) if name == "packing" else len(got) == len(rows)
    assert len(set(out.columns)) == len(out.columns)
    ids = [r["doc_id"] for r in got]
    assert {d for d, _ in TEXTS} == set(ids) and (name == "packing" or ids.count(1) == 2 and ids.count(None) == 2)
    if name not in ("packing", "mixing"):  # repeated rows: equal results
        first, second = (r.asDict() for r in got if r["doc_id"] == 1)
        drop = {"_row"}
        assert {k: v for k, v in first.items() if k not in drop} == {k: v for k, v in second.items() if k not in drop}
    assert OPS[name](docs.limit(0)).count() == 0


def test_white_space_around_disguises_is_linear():
    def seconds(n):
        began = time.perf_counter()
        for t in ("dot" + " " * n + "x", "anecdote " + " " * n + "at" + " " * n, "[" + " " * n + "at", "a @" + " " * n + "@ b", " dot " * (n // 5)):
            assert pii.added_spans(t, pii.base_spans(t)) == []
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(400_000) < 10


def test_disguises_take_white_space():
    t = "write to joe   at   mail  dot  org, or ann [ at ] mail ( dot ) org"
    assert [t[a:b] for a, _, b in pii.added_spans(t, [])] == ["joe   at   mail  dot  org", "ann [ at ] mail ( dot ) org"]


def test_any_bytes_can_be_demuxed():
    rnd = random.Random(4)
    whole = bytearray(ts_media.mux(bytes(range(256)) * 300))
    for _ in range(1500):
        bad = bytearray(whole[: rnd.randrange(len(whole))] if rnd.random() < 0.2 else whole)
        for _ in range(rnd.choice([1, 3, 40])):
            if bad:
                bad[rnd.randrange(min(len(bad), rnd.choice([400, len(bad)])))] = rnd.randrange(256)
        got = ts_media.demux(bytes(bad))
        assert got["n_packets"] * 188 + got["n_skipped"] == len(bad)
    # short tables with right checksums
    for body in (b"", b"\0", b"\0\1\2", b"\0" * 5):
        for table_id, pid in ((0, 0), (2, ts_media.PMT_PID)):
            stream = ts_media.TABLES[:188] + ts_media._table_packet(pid, ts_media._section(table_id, 1, body))
            ts_media.demux(stream)


def test_equal_strings_settle_before_their_bucket(spark):
    """A line in all documents: what one map task settles does not go to the line's bucket."""
    line = "this very line stands in each of all the documents there are, word by word: " + " ".join(f"{k * 7919}" for k in range(60))
    docs = spark.createDataFrame([(i, f"{i * 7919} {line} {i}") for i in range(400)], "doc_id long, text string").coalesce(1)
    blocks = suffix_dedup.blocks(docs, 8).collect()
    parts = [(b.bucket, suffix_dedup.unpack_block(bytes(b.block))) for b in blocks]
    assert all(len(p[0]) == 0 if k >= 8 else len(p[4]) == 0 for k, p in parts)
    assert sum(len(p[4]) for k, p in parts if k >= 8) >= 399
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs).collect()}
    assert removed[0] == 0 and all(removed[i] >= len(line) for i in range(1, 400))
    assert np.mean(list(removed.values())) < len(line) + 12
