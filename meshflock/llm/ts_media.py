"""MPEG transport streams as a media column.

``to_stream`` stores byte payloads as a transport stream: a program association table and a
program map table with their checksums, then elementary packets (PES) of one private
stream, each cut over 188-byte packets with running continuity counters. The first packet
of every elementary packet has a clock reference and the random-access flag.

``from_stream`` reads a stream back: it checks table checksums, follows the program tables
to the stream's packets, checks continuity counters (repeated packets are dropped, gaps are
counted), reassembles the elementary packets and lists time stamps with the places of
random access. Bytes that do not start with a sync byte are skipped to the next packet.

Both are columnar: the packets of a document are one numpy array. Null payloads and streams
count as empty; a payload of no bytes gives a stream with tables only. No bytes make ``demux`` fail: sections with a
wrong checksum or too short for their table are counted as bad, packets without a unit start
are left out. Long payloads are cut into elementary packets of ``PES_BYTES``. Equal rows give
equal streams, an empty table an empty result; an input column named as an output is replaced.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflock.llm.carry import add_columns

PACKET = 188
PMT_PID, DATA_PID = 0x1000, 0x0101
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets; private stream 1
CLOCK = 90_000
PES_BYTES = 32_768
PES_HEAD = 14
STEP = 3_600  # ticks between elementary packets
DEMUXED = [
    ("payload", "binary"), ("programs", "array<int>"), ("stream_pids", "array<int>"), ("n_packets", "long"), ("n_pes", "long"), ("n_gaps", "long"), ("n_repeats", "long"),
    ("n_bad_tables", "long"), ("n_skipped", "long"), ("access_points", "array<struct<pts:long,packet:long,byte:long>>"),
]


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ext, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, 1, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def _clock(ticks: int) -> bytes:
    return struct.pack(">IBB", (ticks >> 1) & 0xFFFFFFFF, ((ticks & 1) << 7) | 0x7E, 0)


def mux(payload: bytes) -> bytes:
    """Payload to transport stream."""
    if not payload:
        return TABLES
    src = np.frombuffer(payload, np.uint8)
    parts, cc = [np.frombuffer(TABLES, np.uint8)], 0
    for k, at in enumerate(range(0, len(src), PES_BYTES)):
        data = src[at : at + PES_BYTES]
        pts = CLOCK + k * STEP
        head = struct.pack(">BBBBHBBB", 0, 0, 1, STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts)
        body = np.concatenate([np.frombuffer(head, np.uint8), data])
        first = PACKET - 4 - 8  # with flags and clock
        rest = max(0, len(body) - first)
        n = 1 + -(-rest // (PACKET - 4))
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0] = 0x47
        out[:, 1], out[:, 2] = DATA_PID >> 8, DATA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | ((cc + np.arange(n)) & 15)
        cc = (cc + n) & 15
        stuff = first - min(len(body), first)
        out[0, 3] |= 0x20
        out[0, 4] = 7 + stuff
        out[0, 5] = 0x50  # random access, clock
        out[0, 6:12] = np.frombuffer(_clock(pts), np.uint8)
        out[0, 12 + stuff :] = body[: first - stuff]
        if n > 1:
            full, tail = divmod(rest, PACKET - 4)
            if full:
                out[1 : 1 + full, 4:] = body[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
            if tail:  # the last packet is filled by an adaptation field
                pad = PACKET - 4 - tail
                out[n - 1, 3] |= 0x20
                out[n - 1, 4] = pad - 1
                if pad > 1:
                    out[n - 1, 5] = 0
                out[n - 1, 4 + pad :] = body[len(body) - tail :]
        parts.append(out.ravel())
    return np.concatenate(parts).tobytes()


def _aligned(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Packets, their byte offsets and the number of bytes skipped to find them."""
    n = len(raw) // PACKET
    grid = raw[: n * PACKET].reshape(n, PACKET)
    if n * PACKET == len(raw) and (grid[:, 0] == 0x47).all():
        return grid, np.arange(n) * PACKET, 0
    at, found = 0, []
    while at + PACKET <= len(raw):
        if raw[at] == 0x47 and (at + PACKET == len(raw) or at + PACKET < len(raw) and raw[at + PACKET] == 0x47):
            found.append(at)
            at += PACKET
        else:
            at += 1
    offs = np.array(found, np.int64)
    return (np.stack([raw[o : o + PACKET] for o in found]) if found else grid[:0]), offs, len(raw) - PACKET * len(found)


def _sections(packets: np.ndarray, start: np.ndarray, skip: np.ndarray) -> list[bytes]:
    """Whole sections of one PID's packets; a section may cross packets."""
    out, buf = [], b""

    def take(buf: bytes) -> bytes:
        while len(buf) >= 3 and buf[0] != 0xFF:
            n = 3 + (((buf[1] & 0x0F) << 8) | buf[2])
            if len(buf) < n:
                break
            out.append(buf[:n])
            buf = buf[n:]
        return b"" if buf[:1] == b"\xff" else buf

    for p, s, k in zip(packets, start, skip, strict=True):
        data = p[k:].tobytes()
        if s and data:
            point = data[0]
            take(buf + data[1 : 1 + point])
            buf = take(data[1 + point :])
        elif buf:
            buf = take(buf + data)
    return out


def demux(stream: bytes) -> dict:
    """Transport stream to payload, tables, counters and random-access points."""
    raw = np.frombuffer(stream, np.uint8)
    grid, offs, skipped = _aligned(raw)
    pid = ((grid[:, 1].astype(np.int32) & 0x1F) << 8) | grid[:, 2]
    start = (grid[:, 1] & 0x40) > 0
    has_af = (grid[:, 3] & 0x20) > 0
    has_data = (grid[:, 3] & 0x10) > 0
    bad = (grid[:, 1] & 0x80) > 0
    skip = np.where(has_af, 5 + grid[:, 4].astype(np.int32), 4)
    skip = np.where(has_data & ~bad & (skip <= PACKET), skip, PACKET)
    access = has_af & (grid[:, 4] > 0) & ((grid[:, 5] & 0x40) > 0)
    n_bad = 0
    programs: dict[int, int] = {}
    pids: list[int] = []

    def checked(p: int, table_id: int) -> list[bytes]:
        nonlocal n_bad
        mine = np.flatnonzero(pid == p)
        good = []
        for s in _sections(grid[mine], start[mine], skip[mine]):
            if crc32_mpeg(s):
                n_bad += 1
            elif s[0] == table_id:
                good.append(s)
        return good

    for s in checked(0, 0):
        for k in range(8, len(s) - 7, 4):
            number, at = struct.unpack_from(">HH", s, k)
            if number:
                programs[number] = at & 0x1FFF
    for at in dict.fromkeys(programs.values()):
        for s in checked(at, 2):
            if len(s) < 16:  # too short for what a program map holds
                n_bad += 1
                continue
            k = 12 + (struct.unpack_from(">H", s, 10)[0] & 0x0FFF)
            while k + 5 <= len(s) - 4:
                _, p, info = struct.unpack_from(">BHH", s, k)
                if p & 0x1FFF not in pids:
                    pids.append(p & 0x1FFF)
                k += 5 + (info & 0x0FFF)
    payload, points, n_pes, gaps, repeats = [], [], 0, 0, 0
    done = 0
    for p in pids:
        mine = np.flatnonzero((pid == p) & has_data & ~bad)
        if not len(mine):
            continue
        step = np.diff(grid[mine, 3] & 15) & 15
        same = np.concatenate([[False], step == 0])
        same[1:] &= (grid[mine[1:]] == grid[mine[:-1]]).all(axis=1)
        repeats += int(same.sum())
        mine = mine[~same]
        gaps += int(((np.diff(grid[mine, 3] & 15) & 15) != 1).sum())
        s_at = np.flatnonzero(start[mine])
        for a, b in zip(s_at, np.append(s_at[1:], len(mine)), strict=False):  # none without a unit start
            rows = mine[a:b]
            k = skip[rows]
            if (k[1:-1] == 4).all() and len(rows) > 2:
                body = b"".join([grid[rows[0], k[0] :].tobytes(), grid[rows[1:-1], 4:].tobytes(), grid[rows[-1], k[-1] :].tobytes()])
            else:
                body = b"".join(grid[r, c:].tobytes() for r, c in zip(rows, k, strict=True))
            if body[:3] != b"\0\0\1" or len(body) < 9:
                continue
            n_pes += 1
            size = struct.unpack_from(">H", body, 4)[0]
            data = body[9 + body[8] : 6 + size if size else len(body)]
            if body[7] & 0x80 and len(body) >= 14:
                t = body[9:14]
                pts = ((t[0] >> 1) & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
                if access[rows[0]]:
                    points.append({"pts": pts, "packet": int(offs[rows[0]] // PACKET), "byte": done})
            payload.append(data)
            done += len(data)
    return {
        "payload": b"".join(payload), "programs": sorted(programs), "stream_pids": pids, "n_packets": len(grid), "n_pes": n_pes, "n_gaps": gaps,
        "n_repeats": repeats, "n_bad_tables": n_bad, "n_skipped": skipped, "access_points": points,
    }


def to_stream(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replace the binary column ``payload`` by the transport stream ``media``."""
    stored = lambda src: [pa.array([mux(x or b"") for x in src.to_pylist()], pa.binary())]
    return add_columns(df, lambda: stored, [(media, "binary")], [payload], {payload}, rows=256)


POINT = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("byte", pa.int64())]))
KINDS = [("payload", pa.binary()), ("programs", pa.list_(pa.int32())), ("stream_pids", pa.list_(pa.int32())), *((c, pa.int64()) for c in ("n_packets", "n_pes", "n_gaps", "n_repeats", "n_bad_tables", "n_skipped")), ("access_points", POINT)]


def from_stream(df: DataFrame, media: str = "media") -> DataFrame:
    """Add what ``demux`` finds in the binary column ``media``; the media stays."""

    def read(streams):
        got = [demux(x or b"") for x in streams.to_pylist()]
        return [pa.array([g[n] for g in got], k) for n, k in KINDS]

    return add_columns(df, lambda: read, DEMUXED, [media], rows=256)


def padded(text: str = "text", block: int = 64):
    """UTF-8 bytes of a text column with zero bytes up to a positive multiple of ``block``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.when(n == 0, F.lit(block)).otherwise(F.pmod(-n, F.lit(block)))
    return F.concat(raw, F.expr(f"unhex(repeat('00', {block}))").substr(F.lit(1), fill))
