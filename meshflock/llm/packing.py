"""Best-fit packing of tokenised documents into fixed-length sequences.

Two steps. ``tokenize`` turns texts into pieces: one row for every run of ids that has to
stay together. ``pack`` puts pieces into sequences by bounded-space online best fit: a
packer holds at most ``open_bins`` unfinished sequences, found through a bitset whose bit f
is set when some open sequence has f free places; a piece goes to the lowest set bit that
fits, and when a new sequence is needed while all places are taken, the fullest is closed.

Pieces are dealt by a hash of their row number into lanes of about ``lane_size`` pieces and
arrive there in the order of that hash, so long and short ones mix. Of ``look_ahead`` pieces
that have arrived the longest goes first; the open sequences stay open from one such window
to the next. A lane is packed by one task and is a bounded unit whatever the size of the
input, so no task grows with it; equal rows go to different lanes.

Null and empty texts are one piece that holds only the closing id. Long texts are tokenised
in blocks at places that no token crosses. Repeated rows are packed as separate pieces;
between open sequences with equal free places the one filled last is taken. Empty tables
give empty results. Further columns of the documents are not read or returned; of pieces, a
column named as an output is replaced.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
OPEN_BINS = 1024
LOOK_AHEAD = 1024
LANE_SIZE = 1 << 16

#: Texts of these characters only are split by ``FAST``; there Python's classes agree with
#: the tokenizer's own pattern. All other texts go to the tokenizer as they are.
SAFE = re.compile("[\t-\r -~À-ɏ‐-‧€]*")
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
BREAK = re.compile(r"(?<=[!-~])[ \n]")
BLOCK = 1 << 20


def blocks(text: str):
    """Cut a long text before white space that follows a visible character: no token of the
    byte-level pattern crosses such a place."""
    at = 0
    while len(text) - at > BLOCK:
        m = BREAK.search(text, at + BLOCK)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Encoder:
    """Text to little-endian 32-bit ids. Words are encoded once while ``limit`` words are
    remembered; the word's bytes go to the rank table, other texts to the tokenizer."""

    def __init__(self, tokenizer_path: str, ranks_path: str, limit: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("bytes", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})
        self.word = core.encode_single_token, core._core_bpe.encode_single_piece
        self.ranks = ranks
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def new(self, word: str) -> bytes:
        raw = word.encode()
        one = self.ranks.get(raw)
        ids = [one] if one is not None else self.word[1](raw)
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self.known) < self.limit:
            self.known[word] = out
        return out

    def encode(self, text: str) -> bytes:
        known, new, out = self.known, self.new, []
        for part in blocks(text):
            if SAFE.fullmatch(part) and not any(s in part for s in self.special):
                out.append(b"".join([known.get(w) or new(w) for w in FAST.findall(part)]))
            else:
                ids = self.whole.encode(part, add_special_tokens=False).ids
                out.append(b"".join([i.to_bytes(4, "little") for i in ids]))
        return out[0] if len(out) == 1 else b"".join(out)


def cut(n: int, size: int):
    """(start, length) of the pieces of ``n`` ids: all are ``size`` long but the first."""
    first = n % size or size
    yield 0, min(first, n)
    for start in range(first, n, size):
        yield start, size


def tokenize(docs: DataFrame, tokenizer_path: str, ranks_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and a number for the row.

    The numbers differ from run to run: write the table before it is packed."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc = Encoder(tokenizer_path, ranks_path)
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview((enc.encode(text.as_py()) if text.is_valid else b"") + end)
                for k, (start, n) in enumerate(cut(len(ids) // 4, size)):
                    for col, v in zip(rows, (doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES).withColumn("row", F.monotonically_increasing_id())


def best_fit(lengths, size: int, open_bins: int):
    """(bin, offset, bins closed so far to make room) for each length, in the order given."""
    slots: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free places
    bits = n_open = made = closed = 0
    for n in lengths:
        fits = bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = slots[free].pop()
            if not slots[free]:
                bits ^= 1 << free
            n_open -= 1
        else:
            if n_open >= open_bins:  # the fullest has the fewest free places
                free = (bits & -bits).bit_length() - 1
                slots[free].pop()
                if not slots[free]:
                    bits ^= 1 << free
                n_open -= 1
                closed += 1
            b, free, made = made, size, made + 1
        yield b, size - free, closed
        free -= n
        if free:
            slots[free].append(b)
            bits |= 1 << free
            n_open += 1


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = OPEN_BINS, lane_size: int = LANE_SIZE, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``n_closed`` (bins of the lane closed to make room
    until then) to pieces: a written table with a ``length``, a ``row`` that numbers its rows,
    and any other columns, which are carried."""
    lanes = max(1, -(-pieces.count() // lane_size))
    kept = [f for f in pieces.schema if f.name not in ("row", "sequence_id", "offset", "n_closed")]
    dealt = pieces.select(*[F.col(f"`{f.name}`") for f in kept], F.xxhash64("row").alias("_spot")).withColumn("_lane", F.pmod("_spot", F.lit(lanes)))
    names = [f.name for f in kept]

    def run(table: pa.Table) -> pa.Table:
        base = table.column("_lane")[0].as_py() << 32
        table = table.sort_by([("_spot", "ascending")])
        window = pa.array(np.arange(len(table)) // look_ahead)
        table = table.append_column("_window", window).sort_by([("_window", "ascending"), ("length", "descending"), ("_spot", "ascending")]).select(names)
        placed = list(best_fit(table.column("length").to_pylist(), size, open_bins))
        for k, name in enumerate(("sequence_id", "offset", "n_closed")):
            table = table.append_column(name, pa.array([base + p[k] if k == 0 else p[k] for p in placed], pa.int64()))
        return table

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return dealt.groupBy("_lane").applyInArrow(run, f"{kinds}, sequence_id long, offset long, n_closed long")
