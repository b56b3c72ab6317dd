import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from meshflock.llm import ts_media as ts


@pytest.mark.parametrize("n", [0, 1, 64, 150, 162, 163, 164, 165, 184, 345, 346, 347, 348, 32768, 32769, 70000])
def test_round_trip(n):
    data = bytes((i * 7 + i // 251) & 255 for i in range(n))
    stream = ts.mux(data)
    got = ts.demux(stream)
    assert len(stream) % 188 == 0 and got["payload"] == data
    assert got["programs"] == [1] and got["stream_pids"] == ([ts.DATA_PID])
    assert got["n_gaps"] == got["n_repeats"] == got["n_bad_tables"] == got["n_skipped"] == 0
    assert got["n_pes"] == -(-n // ts.PES_BYTES) == len(got["access_points"])
    for k, p in enumerate(got["access_points"]):
        assert p["pts"] == ts.CLOCK + k * ts.STEP and p["byte"] == k * ts.PES_BYTES
        assert stream[p["packet"] * 188 + 5] & 0x40


def test_damage_is_counted():
    data = bytes(range(256)) * 8
    packets = [s for s in (lambda m: [m[i : i + 188] for i in range(0, len(m), 188)])(ts.mux(data))]
    lost = ts.demux(b"".join(packets[:5] + packets[6:]))
    assert lost["n_gaps"] == 1 and lost["payload"] != data
    twice = ts.demux(b"".join(packets[:5] + packets[4:]))
    assert twice["n_repeats"] == 1 and twice["payload"] == data
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\0" * 184
    assert ts.demux(b"".join(packets[:4] + [null] + packets[4:]))["payload"] == data
    assert ts.demux(b"junk" + b"".join(packets))["n_skipped"] == 4
    broken = bytearray(packets[1])
    broken[20] ^= 1
    assert ts.demux(packets[0] + bytes(broken) + b"".join(packets[2:]))["n_bad_tables"] == 1
    assert ts.demux(b"")["n_packets"] == 0


def test_columns(spark):
    texts = ["", None, "é" * 40, "a" * 64, "a" * 64]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media_x string")
    out = ts.from_stream(ts.to_stream(df.withColumn("payload", ts.padded()))).collect()
    for r in sorted(out, key=lambda r: r.doc_id):
        raw = (texts[r.doc_id] or "").encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert bytes(r.payload) == want and r.media_x == "x"
    assert ts.from_stream(ts.to_stream(df.limit(0).withColumn("payload", F.lit(None).cast("binary")))).count() == 0


def test_query_digests(spark):
    from meshflock.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op7_ts_media"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = ts.mux(pay)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(pay), len(media))
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(pay[-64:])
