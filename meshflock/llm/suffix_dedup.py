"""Exact removal of repeated byte strings between documents.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts in a document
with a smaller id. Only suffixes that can matter are sorted:

1. *Anchors.* Of the k-byte tokens in a window (a string of ``LENGTH`` bytes) the one with
   the smallest hash is its anchor. Equal windows have equal anchors at equal places, and a
   run of neighbouring windows shares one: about one anchor per 16 bytes stands for all
   suffixes that start in its run. Each map task sorts its anchors by (token hash, hash of
   the run's text, id). Runs with equal text keep the smallest id; the others are settled
   there and go back to their documents. Sorted runs go, as compressed blocks, to the bucket
   of their token hash, to which a very common line sends a few runs of every map task only.
2. *Buckets* merge the blocks: the smallest id of each (token, text) again settles the
   others. What is left open are tokens whose runs differ in text.
3. *Suffixes* of the open runs are range-partitioned by their leading token, with splitters
   that Spark samples; equal tokens meet in one partition, so no equal strings lie across a
   boundary. There every window of the runs is sorted by a multikey sort, eight bytes at a
   time and only within ties, up to the whole string; the smallest id of equal strings
   settles the rest. Runs of a token with more than ``HOT_TOKEN`` texts (the edges of a very
   common line) spread out instead: their windows meet by a 128-bit digest of the string.
4. The verdicts are joined to the texts, which mark and drop the covered bytes.

Texts are UTF-8 bytes; null and empty texts have nothing to remove, nor have those shorter
than ``LENGTH``. Long texts are cut into overlapping segments, and no window is lost. Of equal
strings in one document none removes the other. Rows with the same id are one document and do
not remove from each other (their texts should be equal: verdicts of one go to all); rows
without an id are kept as they are. An empty table gives an empty result. Further columns of
the input are not read or returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflock.llm.memory import batch_rows, give_back, tidy
from meshflock.runtime import materialize

LENGTH = 50
TOKEN = 20
SPAN = LENGTH - TOKEN  # windows may start up to this far before their anchor
SEGMENT = 1 << 18
FLUSH = 300_000
BUCKET_BYTES = 6 << 20
SORT_ROWS = 30_000
HOT_TOKEN = 250
_rng = np.random.Generator(np.random.PCG64(81))
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP[1]
    h = (h ^ (h >> np.uint64(29))) * STEP[2]
    return h ^ (h >> np.uint64(32))


def token_hashes(t: np.ndarray) -> np.ndarray:
    """Hash of the TOKEN bytes from every place, from hashes of 4 and of 16 bytes."""
    h, by = t, {1: t}
    for k in range(4):
        n = 1 << k
        h = h[:-n] * STEP[k] + h[n:]
        by[2 * n] = h
    n = len(t) - TOKEN + 1
    return mix(by[16][:n] * STEP[4] + by[4][16 : 16 + n])


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    m, n = v, 1
    while 2 * n <= w:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    size = len(v) - w + 1
    return np.minimum(m[:size], m[w - n : w - n + size])


_POW = {}


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, hash of the run's text, anchor, first and last window start) of every run."""
    if not _POW:
        _POW["up"], _POW["down"] = _powers(BASE, SEGMENT + LENGTH), _powers(INVERSE, SEGMENT + LENGTH)
    out = []
    src = np.frombuffer(data, np.uint8)
    for at in range(0, len(src) - LENGTH + 1, SEGMENT):
        t = BYTE[src[at : at + SEGMENT + LENGTH - 1]]
        v = token_hashes(t)
        low = np.uint64((1 << 20) - 1)
        best = window_min((v & ~low) | np.arange(len(v), dtype=np.uint64), SPAN + 1)
        place = (best & low).astype(np.int64)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        lo = np.concatenate([[0], cut])
        hi = np.concatenate([cut - 1, [len(place) - 1]])
        pos = place[lo]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * _POW["up"][: len(t)])])
        text = mix((total[hi + LENGTH] - total[lo]) * _POW["down"][lo] + ((hi - lo) * 64 + pos - lo).astype(np.uint64) * STEP[3])
        out.append((v[pos], text, pos + at, lo + at, hi + at))
    if not out:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if len(out) > 1 else out[0]


def _planes(a: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplane(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


WIDTHS = (6, 6, 4, 4)  # token hash (differences), text hash, document, ordinal


def settle(token, text, doc):
    """Order by (token, text, doc), and for each row in that order whether a smaller document
    has the same run, and whether its token goes with another text of another document."""
    order = np.lexsort((doc, text, token))
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    token, text, doc = token[order], text[order], doc[order]
    new_token = np.concatenate([[True], token[1:] != token[:-1]])
    new_run = new_token | np.concatenate([[True], text[1:] != text[:-1]])
    first = np.maximum.accumulate(np.where(new_run, np.arange(len(doc)), 0))
    later = doc > doc[first]
    start = np.flatnonzero(new_token)
    which = np.cumsum(new_token) - 1
    n_runs = np.add.reduceat(new_run.astype(np.int64), start) if len(start) else start
    one_doc = np.minimum.reduceat(doc, start) == np.maximum.reduceat(doc, start) if len(start) else start
    return order, later, ((n_runs > 1) & ~one_doc)[which] if len(start) else later


def pack_block(token, text, doc, ordinal, sure_doc, sure_ord, ids) -> bytes:
    import zstandard

    step = np.diff(token, prepend=np.uint64(0))
    body = b"".join([
        np.array([len(token), len(sure_doc), len(ids)], "<i8").tobytes(), ids.astype("<i8").tobytes(),
        *(_planes(a, w) for a, w in zip((step, text, doc, ordinal), WIDTHS, strict=True)), _planes(sure_doc, 4), _planes(sure_ord, 4),
    ])
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_block(block: bytes):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n, m, k = np.frombuffer(raw, "<i8", 3)
    at = 24 + 8 * k
    ids = np.frombuffer(raw, "<i8", k, 24)
    cols = []
    for w, size in (*((w, n) for w in WIDTHS), (4, m), (4, m)):
        cols.append(_unplane(raw[at : at + size * w], size, w))
        at += size * w
    return np.cumsum(cols[0], dtype=np.uint64), cols[1], ids[cols[2].astype(np.int64)], cols[3].astype(np.int64), ids[cols[4].astype(np.int64)], cols[5].astype(np.int64)


def bucket_limits(n_buckets: int) -> np.ndarray:
    """Limits of ranges of 48-bit token hashes that hold anchors in equal numbers.

    Anchors are the least of ``SPAN`` + 1 hashes, so small hashes are far more frequent: with w of
    them, the share of anchors below x is 1 - (w + 1) / 2 * q ** w + (w - 1) / 2 * q ** (w + 1), q = 1 - x."""
    w, x = SPAN + 1, np.linspace(0, 1, 1 << 18)
    below = 1 - (w + 1) / 2 * (1 - x) ** w + (w - 1) / 2 * (1 - x) ** (w + 1)
    return (np.interp(np.arange(1, n_buckets) / n_buckets, below, x) * float(1 << 48)).astype(np.uint64)


def blocks(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, block): sorted anchors of every map task, dealt by ranges of the token hash."""
    limits = bucket_limits(n_buckets)

    def flush(held, ids):
        token, text, ordinal = (np.concatenate([h[k] for h in held]) for k in range(3))
        doc = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        held.clear()
        ids = np.array(ids, np.int64)
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # documents by id
        same = np.unique(ids)
        doc, ids = np.searchsorted(same, ids)[doc] if len(same) < len(ids) else rank[doc], same
        token, text = token >> np.uint64(16), text >> np.uint64(16)
        order, later, _ = settle(token, text, doc)
        token, text, doc, ordinal = token[order], text[order], doc[order], ordinal[order]
        bucket = np.searchsorted(limits, token, side="right")
        none = np.zeros(0, np.int64)
        rows = []
        if later.any():  # settled here: they go back to their documents, spread by whose they are, and meet no bucket of their token
            used, at = np.unique(doc[later], return_inverse=True)
            spot = n_buckets + zlib.crc32(ids[used].tobytes()) % n_buckets
            rows.append((spot, pack_block(none.view(np.uint64), none.view(np.uint64), none, none, at, ordinal[later], ids[used])))
        token, text, doc, ordinal, bucket = (c[~later] for c in (token, text, doc, ordinal, bucket))
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else none
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            used, at = np.unique(doc[a:b], return_inverse=True)
            rows.append((int(bucket[a]), pack_block(token[a:b], text[a:b], at, ordinal[a:b], none, none, ids[used])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block"])

    def run(batches):
        held, ids, n = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                token, run_text, _, _, _ = anchors((text.as_py() or "").encode())
                if len(token):
                    held.append((token, run_text, np.arange(len(token))))
                    ids.append(doc)
                    n += len(token)
                if n >= FLUSH:
                    yield flush(held, ids)
                    held, ids, n = [], [], 0
                    give_back()
        if held:
            yield flush(held, ids)
        give_back()

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket int, block binary")


def _by_doc(ids: np.ndarray, doc: np.ndarray, ordinal: np.ndarray) -> pa.Array:
    """The ordinals of each of the sorted ``ids``, four bytes each in one value; null without any."""
    n = np.bincount(np.searchsorted(ids, doc), minlength=len(ids))
    ends = np.concatenate([[0], np.cumsum(4 * n)]).astype("<i4")
    data = ordinal[np.argsort(doc, kind="stable")].astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ids), [pa.py_buffer(np.packbits(n > 0, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(data)])


def merge(block_rows: DataFrame) -> DataFrame:
    """(doc_id, sure, open): ordinals of runs that a smaller document has, and of open ones."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        parts = [unpack_block(b.as_py()) for b in table.column("block")]
        token, text, doc, ordinal, sure_doc, sure_ord = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order, later, mixed = settle(token, text, doc)
        del token, text
        doc, ordinal = doc[order], ordinal[order]
        mixed &= ~later
        sure_doc, sure_ord = np.concatenate([doc[later], sure_doc]), np.concatenate([ordinal[later], sure_ord])
        doc, ordinal = doc[mixed], ordinal[mixed]
        del order, later, mixed
        ids = np.unique(np.concatenate([sure_doc, doc]))
        out = pa.table({"doc_id": pa.array(ids, pa.int64()), "sure": _by_doc(ids, sure_doc, sure_ord), "open": _by_doc(ids, doc, ordinal)})
        del sure_doc, sure_ord, doc, ordinal
        give_back()
        return out

    return block_rows.groupBy("bucket").applyInArrow(run, "doc_id long, sure binary, open binary")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept_sha256 of the whole text, compressed text."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                raw = [(t or "").encode() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([z.compress(r) for r in raw], pa.binary())],
                    names=["doc_id", "n_bytes", "sha", "z"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, sha string, z binary")


def _unzip(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def open_suffixes(texts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(token, doc, ordinal, back_to, back_from, around): the open runs with the text around their anchors."""
    wanted = verdicts.where("open is not null").groupBy("doc_id").agg(F.collect_list("open").alias("open"))
    width = SPAN + LENGTH

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                cols = [[] for _ in range(6)]
                for doc, z, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    data = _unzip(z)
                    _, _, pos, lo, hi = anchors(data)
                    for k in np.unique(np.frombuffer(b"".join(parts), "<i4")):
                        if k >= len(pos):  # another row with this id
                            continue
                        p = int(pos[k])
                        text = (b"\0" * max(0, SPAN - p) + data[max(0, p - SPAN) : p + LENGTH]).ljust(width, b"\0")
                        for c, v in zip(cols, (data[p : p + TOKEN], doc, int(k), p - int(hi[k]), p - int(lo[k]), text), strict=True):
                            c.append(v)
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["token", "doc", "ordinal", "back_to", "back_from", "around"])

    return texts.join(wanted, "doc_id").select("doc_id", "z", "open").mapInArrow(tidy(run), "token binary, doc long, ordinal int, back_to int, back_from int, around binary")


def equal_strings(columns: list[np.ndarray]) -> np.ndarray:
    """Class numbers of equal strings, given as eight-byte symbols: a multikey sort that goes
    on to the next symbol only within ties. Strings without an equal get -1."""
    n = len(columns[0])
    rank = np.zeros(n, np.int64)
    live = np.arange(n)
    for col in columns:
        key, sym = rank[live], col[live]
        order = np.lexsort((sym, key))
        key, sym, live = key[order], sym[order], live[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sym[1:] != sym[:-1])]) if len(live) else np.zeros(0, bool)
        number = np.cumsum(new)
        tied = np.bincount(number, minlength=2)[number] > 1 if len(live) else new
        rank[live] = number
        live = live[tied]
        if not len(live):
            break
    out = np.full(n, -1)
    out[live] = rank[live]
    return out


def suffix_sort(suffixes: DataFrame, parts: int) -> DataFrame:
    """(doc_id, ordinal, mask): bit x is set if the window that starts x before the anchor also
    starts in a smaller document."""

    def solve(rows):
        doc, ordinal, to, frm = (np.concatenate([r[k] for r in rows]) for k in range(4))
        around = np.concatenate([r[4] for r in rows])
        n = frm - to + 1
        row = np.repeat(np.arange(len(doc)), n)
        x = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + to[row]
        late = np.zeros(len(row), bool)
        padded = np.zeros((len(doc), around.shape[1] + 8), np.uint8)
        padded[:, : around.shape[1]] = around
        symbols = []
        for k in range(0, LENGTH, 8):
            size = min(8, LENGTH - k)
            sym = np.zeros(len(row), np.uint64)
            for j in range(size):
                sym = (sym << np.uint64(8)) | padded[row, SPAN - x + k + j].astype(np.uint64)
            symbols.append(sym)
        # the anchor is the leading token: its eight bytes and the distance come first
        lead = np.zeros(len(row), np.uint64)
        for j in range(7):
            lead = (lead << np.uint64(8)) | padded[row, SPAN + j].astype(np.uint64)
        cls = equal_strings([(lead << np.uint64(8)) | x.astype(np.uint64), *symbols])
        tied = np.flatnonzero(cls >= 0)
        if len(tied):
            order = tied[np.lexsort((doc[row[tied]], cls[tied]))]
            c, d = cls[order], doc[row[order]]
            first = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), np.arange(len(c)), 0))
            late[order] = d > d[first]
        mask = np.zeros(len(doc), np.int64)
        np.bitwise_or.at(mask, row[late], np.int64(1) << x[late])
        hit = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(ordinal[hit].astype(np.int32)), pa.array(mask[hit])], names=["doc_id", "ordinal", "mask"])

    def run(batches):
        """Sorted rows arrive in batches; what is held is closed only where a new token begins."""
        held: list = []
        n, last = 0, None

        def hold(p):
            around = np.frombuffer(b"".join(p.column(5).to_pylist()), np.uint8).reshape(p.num_rows, -1)
            held.append((*(p.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4)), around))

        for b in batches:
            token = b.column(0).to_pylist()
            if n >= SORT_ROWS:
                at = next((k for k, t in enumerate(token) if t != last), None)
                if at is not None:
                    if at:
                        hold(b.slice(0, at))
                    yield solve(held)
                    held.clear()
                    n, b = 0, b.slice(at)
            if b.num_rows:
                hold(b)
                n, last = n + b.num_rows, token[-1]
        if n:
            yield solve(held)

    return suffixes.repartitionByRange(parts, "token").sortWithinPartitions("token").mapInArrow(tidy(run), "doc_id long, ordinal int, mask long")


def hot_windows(suffixes: DataFrame) -> DataFrame:
    """The same verdicts for tokens that go with very many texts: their windows meet by the
    digest of the whole string, so that one token's runs spread over all tasks."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                cols = [[] for _ in range(4)]
                for doc, ordinal, to, frm, around in zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True):
                    for x in range(to, frm + 1):
                        text = around[SPAN - x : SPAN - x + LENGTH]
                        for c, v in zip(cols, (hashlib.blake2b(text, digest_size=16).digest(), doc, ordinal, x), strict=True):
                            c.append(v)
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["w", "doc_id", "ordinal", "x"])

    windows = suffixes.mapInArrow(tidy(run), "w binary, doc_id long, ordinal int, x int")
    least = materialize(windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("w", "first"), "least")
    late = windows.join(least, "w").where(F.col("doc_id") > F.col("first"))
    return late.groupBy("doc_id", "ordinal").agg(F.bit_or(F.expr("shiftleft(1L, x)")).alias("mask"))


def removed(data: bytes, sure: np.ndarray, ordinals: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """True for every removed byte."""
    _, _, pos, lo, hi = anchors(data)
    edge = np.zeros(len(data) + 1, np.int64)
    sure = sure[sure < len(pos)]
    np.add.at(edge, lo[sure], 1)
    np.add.at(edge, hi[sure] + LENGTH, -1)
    ok = ordinals < len(pos)
    for x in range(SPAN + 1):
        at = pos[ordinals[ok & (masks >> x & 1 == 1)]] - x
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def cut(texts: DataFrame, verdicts: DataFrame, masks: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, null where nothing is removed)."""
    sure = verdicts.where("sure is not null").select("doc_id", "sure", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("long").alias("mask"))
    both = sure.unionByName(masks.select("doc_id", F.lit(None).cast("binary").alias("sure"), "ordinal", "mask"))
    found = both.groupBy("doc_id").agg(F.collect_list("sure").alias("sure"), F.collect_list(F.when(F.col("mask").isNotNull(), F.struct("ordinal", "mask"))).alias("windows"))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                b = whole.slice(start, 128)
                cols = [[] for _ in range(4)]
                for n, sha, z, sure, windows in zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True):
                    gone, spans, kept = 0, 0, None
                    if sure or windows:
                        data = _unzip(z)
                        flags = removed(data, np.frombuffer(b"".join(sure or []), "<i4"), np.array([w["ordinal"] for w in windows or []], np.int64), np.array([w["mask"] for w in windows or []], np.int64))
                        gone = int(flags.sum())
                        spans = int(flags[0]) + int((flags[1:] & ~flags[:-1]).sum()) if len(flags) else 0
                        kept = np.frombuffer(data, np.uint8)[~flags].tobytes()
                        sha = hashlib.sha256(kept).hexdigest()
                    for c, v in zip(cols, (gone, spans, sha, kept), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(found, "doc_id", "left").select("doc_id", "n_bytes", "sha", F.when(F.col("sure").isNotNull(), F.col("z")).alias("z"), "sure", "windows")
    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document; ``docs`` is read several times (columns doc_id and text)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = packed_texts(docs)
    parts = max(16, -(-total // BUCKET_BYTES))
    with batch_rows(docs.sparkSession, 500):
        verdicts = materialize(merge(blocks(docs, max(64, -(-total // BUCKET_BYTES)))), "verdicts")
        suffixes = materialize(open_suffixes(texts, verdicts), "suffixes")
    hot = materialize(suffixes.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HOT_TOKEN).select("token"), "hot")
    rare = suffixes.join(hot, "token", "left_anti").select(*suffixes.columns)
    often = suffixes.join(hot, "token", "left_semi").select(*suffixes.columns)
    masks = materialize(suffix_sort(rare, parts).unionByName(hot_windows(often)), "masks")
    return cut(texts, verdicts, masks)
