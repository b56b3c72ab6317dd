"""Near duplicates by an inverted join on signature coordinates, confirmed on full sets.

A document's set holds its distinct five-word shingles (64-bit hashes of words lower-cased
in A-Z; the whole sequence where there are fewer words). Documents with equal sets form a
class at once; only one of each class goes on.

Its MinHash signature has ``N_COORD`` coordinates, and every (coordinate, value) pair is a
key under which the document is posted. Two sets of similarity J agree on about a share J of
the coordinates; a pair is a candidate if it collides under ``least`` keys or more (5 standard
errors below the expected number at the threshold). Which pairs collide that often is the
T-occurrence problem, solved by prefixes and skip merging:

1. *Lengths.* Bundles of documents send each of their keys once, with its count, and get the
   lengths of all posting lists of two documents or more back. A document with fewer than
   ``least`` such lists has no partner and ends here.
2. *Prefix.* Of a document's m lists only the m - ``least`` + 1 shortest are merged: two
   documents with ``least`` common lists share one of these. The long lists, as those of a
   passage that very many documents share, are skipped; collisions there are counted by
   comparing the signatures of documents that met in a short one.
3. *Merging.* Lists of the same documents are merged once. In a list one document at a time
   probes all that are not yet connected with it; partners with enough collisions are
   confirmed on their whole sets, and one link for each component that they connect is
   returned. Documents of the largest component need not probe: what is left to find has an
   end outside. So a group of n copies gives n - 1 links for a list, not n * n.
4. *Long lists* are merged in blocks of at most ``BLOCK`` documents and ``WEIGHT`` shingles,
   each with the list's first document. Only where a list is not one component after that do
   the documents outside its largest one probe the other blocks.

Every link is confirmed on whole shingle sets, and none is missed but for a chance of about
one in a million at the very threshold.

Null texts and texts without words have empty sets and no links. Repeated rows (of one id)
are one document, rows with one id and several texts belong to the components of all of them,
and rows without an id stay alone; each row is returned. Long texts are hashed in pieces of
``CHUNK`` bytes, whole. A similarity of exactly the threshold is a link. An empty table gives
an empty result. Further columns of the input are not read or returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshflock.plans.components import components
from meshflock.runtime import discard, materialize

N_COORD = 128
WORDS = 5
CHUNK = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")
BUNDLE = 2048
SPOTS = 25
KEYS_PER_BUCKET = 2_000_000
BLOCK = 1024
WEIGHT = 1_000_000
COMMON = (1 << 15) - 1  # lengths of lists are told apart up to this number; beyond, keys decide
_rng = np.random.Generator(np.random.PCG64(20240))
MULT = _rng.integers(1, 1 << 63, N_COORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, N_COORD, dtype=np.uint64)


def least_matches(percent: int) -> int:
    j = percent / 100
    return max(1, int(N_COORD * j - 5 * (N_COORD * j * (1 - j)) ** 0.5))


class Words:
    """64-bit hashes of the words of a text; common words are remembered."""

    def __init__(self, limit: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def new(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self.known) < self.limit:
            self.known[word] = h
        return h

    def hashes(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "replace").lower()  # lowers A-Z only
        known, new, out, at = self.known, self.new, [], 0
        while at < len(data):
            m = SPACE.search(data, at + CHUNK) if len(data) - at > CHUNK else None
            end = m.start() if m else len(data)
            out.append(np.array([known.get(w) or new(w) for w in data[at:end].split()], np.uint64))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        w = self.hashes(text) if text else np.zeros(0, np.uint64)
        if not len(w):
            return w
        n = min(WORDS, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ w[k : len(w) - n + 1 + k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(N_COORD, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        v = s[at : at + 2048, None] * MULT[None, :]
        v += ADD
        out = np.minimum(out, (v.min(0) >> np.uint64(32)).astype(np.uint32))
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (null where the set is empty)."""

    def run(batches):
        words = Words()
        for b in batches:
            n, digest, sig = [], [], []
            for t in b.column(1).to_pylist():
                s = words.shingles(t)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def posting_keys(sig: np.ndarray) -> np.ndarray:
    """48-bit keys of the (coordinate, value) pairs of signatures."""
    salt = (np.arange(N_COORD, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    key = (sig.astype(np.uint64) ^ (salt >> np.uint64(20))) * np.uint64(0xBF58476D1CE4E5B9) + salt
    return (key ^ (key >> np.uint64(31))) >> np.uint64(16)


def bundles(reps: DataFrame) -> DataFrame:
    """(bundle, docs, sizes, sigs): up to ``BUNDLE`` documents a row."""

    def run(batches):
        from pyspark import TaskContext

        part, made, docs, sizes, sigs = TaskContext.get().partitionId(), 0, [], [], []

        def row(n):
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), *(pa.array([np.array(c[:n], "<i8").tobytes()], pa.binary()) for c in (docs, sizes)), pa.array([b"".join(sigs[:n])], pa.binary())], names=["bundle", "docs", "sizes", "sigs"])

        for b in batches:
            docs += b.column(0).to_pylist()
            sizes += b.column(1).to_pylist()
            sigs += b.column(2).to_pylist()
            while len(docs) >= BUNDLE:
                yield row(BUNDLE)
                del docs[:BUNDLE], sizes[:BUNDLE], sigs[:BUNDLE]
        if docs:
            yield row(len(docs))

    return reps.select("doc_id", "n_shingles", "sig").mapInArrow(run, "bundle long, docs binary, sizes binary, sigs binary")


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 48-bit keys and their counts, in byte planes."""
    import zstandard

    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes() + np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(10, -1)
    steps, counts = np.zeros((planes.shape[1], 8), np.uint8), np.ascontiguousarray(planes[6:].T)
    steps[:, :6] = planes[:6].T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64), counts.reshape(-1).view("<u4").astype(np.int64)


def list_lengths(bundled: DataFrame, n_buckets: int) -> DataFrame:
    """(bundle, block): lengths of the bundle's posting lists, of lists of two documents or more.

    A bundle sends each key once, so a key of very many documents is a few rows only."""

    def send(batches):
        for b in batches:
            for bundle, sigs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys, counts = np.unique(posting_keys(np.frombuffer(sigs.as_buffer(), np.uint32).reshape(-1, N_COORD)), return_counts=True)
                bucket = ((keys >> np.uint64(16)) * np.uint64(n_buckets)) >> np.uint64(32)
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                blocks = [_pack(keys[a:b], counts[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int64)), pa.array([bundle] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "bundle", "block"])

    def add(table: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py()) for b in table.column("block")]
        keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        src = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, src = keys[order], src[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.repeat(np.add.reduceat(counts[order], start), np.diff(start, append=len(keys)))
        more = total > 1
        keys, src, total = keys[more], src[more], total[more]
        order = np.argsort(src, kind="stable")  # keys stay sorted within a bundle
        edge = np.searchsorted(src[order], np.arange(len(parts) + 1))
        there = np.flatnonzero(edge[1:] > edge[:-1])
        bundle = table.column("bundle").to_numpy()[there]
        return pa.table({"bundle": pa.array(bundle, pa.int64()), "block": pa.array([_pack(keys[order[edge[k] : edge[k + 1]]], total[order[edge[k] : edge[k + 1]]]) for k in there], pa.binary())})

    sent = bundled.select("bundle", "sigs").mapInArrow(send, "bucket long, bundle long, block binary")
    return sent.groupBy("bucket").applyInArrow(add, "bundle long, block binary")


def prefixes(bundled: DataFrame, lengths: DataFrame, least: int) -> DataFrame:
    """(doc, size, keys): the shortest posting lists of every document that may have a partner."""

    def run(batches):
        for b in batches:
            for docs, sizes, sigs, blocks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                known, length = (np.concatenate(c) for c in zip(*map(_unpack, blocks), strict=True))
                order = np.argsort(known)
                known, length = known[order], length[order]
                docs, sizes = np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i8")
                keys = posting_keys(np.frombuffer(sigs.as_buffer(), np.uint32).reshape(-1, N_COORD))
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                there = known[at] == keys
                m = there.sum(1)
                may = np.flatnonzero(m >= least)
                rank = np.where(there, (np.minimum(length[at], COMMON).astype(np.uint64) << np.uint64(48)) | keys, np.uint64(2**64 - 1))[may]
                rank.sort(axis=1)
                take = m[may] - least + 1
                flat = rank[np.arange(N_COORD)[None, :] < take[:, None]] & np.uint64((1 << 48) - 1)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(take)]).astype(np.int32), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(docs[may]), pa.array(sizes[may]), lists], names=["doc", "size", "keys"])

    got = lengths.groupBy("bundle").agg(F.collect_list("block").alias("blocks"))
    return bundled.join(got, "bundle").select("docs", "sizes", "sigs", "blocks").mapInArrow(run, "doc long, size long, keys array<long>")


def _dealt(total, size, block: int, weight: int) -> list[Column]:
    """The number of blocks of a list, and its first document."""
    return [F.greatest(F.ceil(total / block), F.ceil(size / weight)).cast("int").alias("nb"), F.min("doc").alias("first")]


def posting_lists(posted: DataFrame, block: int, weight: int) -> DataFrame:
    """(key, doc, first, nb, mine): lists of two documents or more, with their first document,
    number of blocks and each document's block; of lists of the same documents one."""
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), *_dealt(F.count("*"), F.sum("size"), block, weight), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("all"), F.sum(F.xxhash64(F.lit(1), "doc").cast("decimal(38,0)")).alias("also")).where("n > 1")
    one = lists.groupBy("n", "all", "also").agg(F.min(F.struct("key", "first", "nb")).alias("one")).select("one.*")
    return posted.drop("size").join(one, "key").withColumn("mine", F.pmod(F.xxhash64("doc"), "nb").cast("int"))


def spots(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SPOTS)
    return h.astype(np.int64)


def spot_filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** ``SPOTS`` places, those of the wanted ids set. Its size is fixed: the
    more documents are wanted, the more others pass, and none is lost."""

    def run(batches):
        for b in batches:
            at = spots(b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bits"])

    words = wanted.select("doc").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (SPOTS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits


def spotted(ids: Column, bits: Broadcast) -> Column:
    """Whether an id may be one that a ``spot_filter`` was made of; false for null."""

    @F.pandas_udf("boolean")
    def test(v: pd.Series) -> pd.Series:
        at = spots(v.fillna(0).to_numpy(np.int64))
        return pd.Series((bits.value[at >> 6] >> (at & 63) & 1).astype(bool)) & v.notna().reset_index(drop=True)

    return test(ids.cast("long"))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, size, low, shingles): whole sets, six bytes a shingle, and one byte of each
    coordinate, of the wanted documents (and of few others). Texts are filtered where they
    are read: only sets are exchanged."""
    sc = docs.sparkSession.sparkContext
    bits = sc.broadcast(spot_filter(wanted))

    def run(batches):
        words = Words()
        for whole in batches:
            at = spots(whole.column(0).to_numpy(zero_copy_only=False))
            take = np.flatnonzero(bits.value[at >> 6] >> (at & 63) & 1)
            for k in range(0, len(take), 256):
                b = whole.take(pa.array(take[k : k + 256]))
                sets = [words.shingles(t) for t in b.column(1).to_pylist()]
                low = [np.ascontiguousarray(signature(s).view(np.uint8)[::4]).tobytes() for s in sets]
                six = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for s in sets]
                digest = [hashlib.blake2b(s, digest_size=16).digest() for s in six]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(low, pa.binary()), pa.array(digest, pa.binary()), pa.array(six, pa.binary())], names=["doc", "size", "low", "digest", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")
    return rows.mapInArrow(run, "doc long, size long, low binary, digest binary, shingles binary").where("size > 0").dropDuplicates(["doc", "digest"]).drop("digest")


def unpack_set(six: bytes) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


FREE, PROBE, TARGET, MAIN = range(4)  # parts that a document can take in a task


def connect(doc, group, part, size, low, sets, percent: int, least: int) -> list[tuple[int, int]]:
    """Links that connect the groups of a list's documents. Documents probe, one at a time,
    all of other groups. If all are ``FREE``, those of the group that is the largest by then
    need not; else the ``PROBE`` ones do, unless they are in the group of the ``MAIN`` ones by
    then. Of the links between two groups one is returned."""
    n = len(doc)
    label = np.unique(group, return_inverse=True)[1]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    length = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(length)])
    mark = np.zeros(flat.max() + 1, bool)
    todo = part <= PROBE
    main = np.flatnonzero(part == MAIN)[:1]
    free = part[0] == FREE
    out = []
    while True:
        settled = np.bincount(label).argmax() if free else label[main[0]] if len(main) else -1
        left = np.flatnonzero(todo & (label != settled))
        if not len(left):
            return out
        for x in left:
            todo[x] = False
            other = np.flatnonzero((label != label[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
            other = other[np.count_nonzero(low[other] == low[x], axis=1) >= least] if len(other) else other
            if not len(other):
                continue
            mark[flat[start[x] : start[x + 1]]] = True
            places = np.repeat(start[other] - np.concatenate([[0], np.cumsum(length[other])[:-1]]), length[other]) + np.arange(length[other].sum())
            both = np.add.reduceat(mark[flat[places]].astype(np.int64), np.concatenate([[0], np.cumsum(length[other])[:-1]]))
            mark[flat[start[x] : start[x + 1]]] = False
            good = other[100 * both >= percent * (length[x] + length[other] - both)]
            if not len(good):
                continue
            found, first = np.unique(label[good], return_index=True)
            out += [(int(doc[x]), int(doc[y])) for y in good[first]]
            label[np.isin(label, found)] = label[x]
            break  # groups have grown


def merged(dealt: DataFrame, percent: int, least: int) -> DataFrame:
    """(u, v) links of dealt lists: rows of (key, i, j) belong together."""
    fields = ("key", "i", "j", "doc", "grp", "part", "size")

    def solve(c, low, sets):
        links = set()
        new = np.concatenate([[True], (c["key"][1:] != c["key"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])])
        edge = np.append(np.flatnonzero(new), len(new))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                links.update(connect(c["doc"][a:b], c["grp"][a:b], c["part"][a:b], c["size"][a:b], low[a:b], sets[a:b], percent, least))
        links = np.array(sorted({(min(p), max(p)) for p in links if p[0] != p[1]}), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    def run(batches):
        """Rows come sorted; the last group of a batch waits for the next."""
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                c = {f: b.column(k).to_numpy(zero_copy_only=False) for k, f in enumerate(fields)}
                low = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint8).reshape(-1, N_COORD)
                sets = [unpack_set(s) for s in b.column(8).to_pylist()]
                if held is not None:
                    c, low, sets = {f: np.concatenate([held[0][f], c[f]]) for f in fields}, np.concatenate([held[1], low]), held[2] + sets
                same = (c["key"] == c["key"][-1]) & (c["i"] == c["i"][-1]) & (c["j"] == c["j"][-1])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield solve({f: c[f][:cut] for f in fields}, low[:cut], sets[:cut])
                held = {f: c[f][cut:] for f in fields}, low[cut:], sets[cut:]
        if held is not None:
            yield solve(*held)

    dealt = dealt.select(*fields, "low", "shingles")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long").distinct()


def _blocks(lists: DataFrame, sets: DataFrame, block: int, weight: int) -> DataFrame:
    """Lists with their documents' sizes and sets, ``first`` document and number of blocks ``nb``."""
    sizes = lists.join(sets.select("doc", "size"), "doc").groupBy("key").agg(*_dealt(F.count("*"), F.sum("size"), block, weight))
    return lists.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("doc"), "nb").cast("int"))


def links_within(lists: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Links of documents in one block of a list."""
    blocks = F.when(F.col("doc") == F.col("first"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("mine"))
    dealt = lists.select("key", "doc", F.explode(blocks).alias("i")).join(sets, "doc")
    return merged(dealt.select("*", F.lit(0).alias("j"), F.col("doc").alias("grp"), F.lit(FREE).alias("part")), percent, least)


def links_across(lists: DataFrame, sets: DataFrame, comp: DataFrame, percent: int, least: int, block: int, weight: int) -> DataFrame:
    """Links between blocks of lists that are not one component: documents outside a list's
    largest component, in blocks of their own, probe all of its blocks."""
    at = lists.where("nb > 1").join(comp.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("grp", F.coalesce("component", "doc"))
    parts = at.groupBy("key", "grp").agg(F.count("*").alias("members"))
    main = parts.groupBy("key").agg(F.max_by("grp", F.struct("members", "grp")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    at = at.join(main, "key")
    outside = _blocks(at.where("grp <> main").select("key", "doc"), sets, block, weight).select("key", "doc", F.col("nb").alias("mb"), F.col("mine").alias("theirs"))
    per = outside.groupBy("key").agg(F.max("mb").alias("mb"))
    probes = at.join(outside.drop("mb"), ["key", "doc"]).select("key", F.col("theirs").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "doc", "grp", F.lit(PROBE).alias("part"))
    targets = at.join(per, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), F.col("mine").alias("j"), "doc", "grp", F.when(F.col("grp") == F.col("main"), MAIN).otherwise(TARGET).alias("part"))
    return merged(probes.union(targets).join(sets, "doc"), percent, least)


def group(docs: DataFrame, percent: int = 85, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id (least id of an equal set).

    ``docs`` is read twice (columns doc_id and text)."""
    least = least_matches(percent)
    sketches = materialize(sketch(docs), "sketches")
    full = sketches.where("doc_id is not null and n_shingles > 0")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    first = classes.select("digest", F.col("class_id").alias("doc_id"))
    reps = full.dropDuplicates(["doc_id", "digest"]).join(first, ["doc_id", "digest"], "left_semi")
    bundled = materialize(bundles(reps), "bundles")
    n = bundled.agg(F.sum(F.octet_length("docs"))).first()[0] or 0
    lengths = materialize(list_lengths(bundled, max(16, -(-n // 8 * N_COORD // KEYS_PER_BUCKET))), "lengths")
    prefix = materialize(prefixes(bundled, lengths, least), "prefixes")
    discard(bundled)
    # the sizes of a document with several texts add up
    posted = materialize(prefix.select(F.explode("keys").alias("key"), "doc", "size").groupBy("key", "doc").agg(F.sum("size").alias("size")), "posted")
    blocked = materialize(posting_lists(posted, block, weight), "blocked")
    discard(prefix, lengths, posted)
    sets = materialize(full_sets(docs, blocked), "sets")
    links = materialize(links_within(blocked, sets, percent, least), "links")
    comp = materialize(components(links), "components")
    more = materialize(links_across(blocked, sets, comp, percent, least, block, weight), "links")
    discard(blocked, sets, comp)
    # a document with several rows belongs to the classes of all of them
    same_id = full.join(classes, "digest").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).where("u <> v")
    comp = materialize(components(links.union(more).union(same_id)), "components")
    classes = classes.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = sketches.join(classes, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "class_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull()).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))
