"""Media columns as MPEG transport streams: a payload is stored losslessly in a stream and read back by a demultiplexer.

Writing: the payload is cut into access units, each is one PES packet with a presentation timestamp, carried by 188-byte
packets with continuity counters; every access unit begins with a program association table, a program map table
and a packet that marks a random-access point and holds a clock reference.

Reading parses the tables (sections with their CRC), finds the elementary stream through them, checks the continuity
counters of each PID, drops duplicate packets, reassembles PES packets and stores each one's timestamp and the packet
number of each random-access point.

Scale: row-local, no shuffle; the packet arithmetic is vectorised over a row's packets, so a batch's memory is a small
multiple of its texts. The two functions chain in one Python stage, so stored bytes cross to the JVM only if asked for.

Defined cases: null or empty texts store one block of zero bytes; equal texts give equal streams; a damaged stream
raises ValueError where bytes are missing, and counts continuity errors otherwise.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the transport stream format.
PACKET, SYNC, STUFF = 188, 0x47, 0xFF
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
CLOCK, WRAP = 90_000, 1 << 33

#: Bytes of a payload are padded to a multiple of this.
BLOCK = 64
#: Payload bytes of an access unit, and its ticks of the 90 kHz clock.
UNIT, TICKS = 32_768, 3_600

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(_CRC[(c >> 24) ^ b])
    return c


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section
    return np.frombuffer(data.ljust(PACKET, bytes([STUFF])), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0"))


def _pes_head(size: int, pts: int) -> bytes:
    stamp = bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])
    return b"\0\0\1" + bytes([PRIVATE_STREAM]) + (size + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp


def mux(payload: bytes) -> bytes:
    out, counter = [], 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = number * TICKS % WRAP
        pes = np.frombuffer(_pes_head(len(unit), pts) + unit, np.uint8)
        lead = PACKET - 4 - 8  # room in the first packet, beside its clock reference
        rest = max(0, len(pes) - lead)
        n = 1 + -(-rest // (PACKET - 4))
        p = np.full((n + 2, PACKET), STUFF, np.uint8)
        p[0], p[1] = _PAT, _PMT
        p[0, 3] |= number & 15
        p[1, 3] |= number & 15
        es = p[2:]
        es[:, 0], es[:, 1], es[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        es[0, 1] |= 0x40
        es[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        start = np.full(n, 4)
        start[0] = 12
        if n == 1:
            start[0] = PACKET - len(pes)
        elif tail := rest % (PACKET - 4):
            start[-1] = PACKET - tail
        for i in {0, n - 1}:
            if (room := int(start[i]) - 5) >= 0:  # bytes after the adaptation field's length
                es[i, 3] |= 0x20
                es[i, 4] = room
                if room:
                    es[i, 5] = 0
        es[0, 5] = 0x50
        base = pts
        es[0, 6:12] = [base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0]
        es[np.arange(PACKET) >= start[:, None]] = pes
        out.append(p.tobytes())
    return b"".join(out)


class Stream(NamedTuple):
    payload: bytes
    packets: int
    programs: int
    stream_type: int
    continuity_errors: int
    duplicates: int
    timestamps: list[int]
    random_access: list[int]


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_LONGS = T.ArrayType(T.LongType())
_STREAM = _fields(payload=T.BinaryType(), packets=T.LongType(), programs=T.LongType(), stream_type=T.LongType(), continuity_errors=T.LongType(), duplicates=T.LongType(), timestamps=_LONGS, random_access=_LONGS)
_DIGESTS = _fields(payload_bytes=T.LongType(), payload_sha256=T.StringType(), tail_crc32=T.LongType(), media_bytes=T.LongType(), media_sha256=T.StringType(), feature=T.StringType())


def _sections(p: np.ndarray, start: np.ndarray, rows: np.ndarray, table_id: int) -> list[bytes]:
    """Bodies of the sections with this id; each fits in one packet, and repeated ones count once."""
    found = []
    for raw in dict.fromkeys(p[i, start[i] :].tobytes() for i in rows):
        data = raw[1 + raw[0] :]
        size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
        if data[0] != table_id or size > len(data) or section_crc(data[:size]):
            raise ValueError("a program table is damaged")
        found.append(data[8 : size - 4])
    return found


def demux(media: bytes) -> Stream:
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any() or (p[:, 1] & 0x80).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    unit, adapted, carries, counter = p[:, 1] & 0x40 > 0, p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0, p[:, 3] & 15
    start = np.where(adapted, 5 + p[:, 4].astype(np.int32), 4)
    pmts = {int.from_bytes(b[i + 2 : i + 4], "big") & 0x1FFF for b in _sections(p, start, np.flatnonzero((pid == PAT_PID) & unit), 0) for i in range(0, len(b), 4) if b[i : i + 2] != b"\0\0"}
    streams: dict[int, int] = {}
    for pmt in pmts:
        for b in _sections(p, start, np.flatnonzero((pid == pmt) & unit), 2):
            i = 4 + (int.from_bytes(b[2:4], "big") & 0xFFF)
            while i < len(b):
                streams[int.from_bytes(b[i + 1 : i + 3], "big") & 0x1FFF] = b[i]
                i += 5 + (int.from_bytes(b[i + 3 : i + 5], "big") & 0xFFF)
    if len(streams) != 1:
        raise ValueError("one elementary stream is expected")
    es, kind = next(iter(streams.items()))
    errors = duplicates = 0
    kept = carries & (pid == es)
    for x in {PAT_PID, *pmts, es}:
        rows = np.flatnonzero(carries & (pid == x))
        step = (counter[rows[1:]].astype(np.int8) - counter[rows[:-1]]) & 15
        same = (step == 0) & (p[rows[1:]] == p[rows[:-1]]).all(axis=1)
        duplicates += int(same.sum())
        errors += int(((step != 1) & ~same).sum())
        kept[rows[1:][same]] = False
    rows = np.flatnonzero(kept)
    q, begins, starts = p[rows], unit[rows], start[rows]
    data = q[np.arange(PACKET) >= starts[:, None]].tobytes()
    ends = np.cumsum(PACKET - starts)
    first = (ends - (PACKET - starts))[begins].tolist()
    parts, stamps = [], []
    for a, b in zip(first, [*first[1:], len(data)]):
        if data[a : a + 3] != b"\0\0\1" or 6 + int.from_bytes(data[a + 4 : a + 6], "big") != b - a:
            raise ValueError("bytes of a packet are missing")
        if data[a + 7] & 0x80:
            t = data[a + 9 : a + 14]
            stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        parts.append(data[a + 9 + data[a + 8] : b])
    access = np.flatnonzero((pid == es) & adapted & (p[:, 4] > 0) & (p[:, 5] & 0x40 > 0)).tolist()
    return Stream(b"".join(parts), len(p), len(pmts), kind, errors, duplicates, stamps, access)


@F.pandas_udf(T.BinaryType())
def store(text: pd.Series) -> pd.Series:
    return text.map(lambda s: mux(pad((s or "").encode())))


@F.pandas_udf(_STREAM)
def load(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([demux(m) for m in media], columns=Stream._fields)


def feature(s: Stream) -> str:
    counts = np.bincount(np.frombuffer(s.payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(s.payload)
    span = s.timestamps[-1] - s.timestamps[0] if s.timestamps else 0
    return f"ts packets={s.packets} programs={s.programs} type={s.stream_type} units={len(s.timestamps)} access={len(s.random_access)} lost={s.continuity_errors} span={span / CLOCK:.3f}s entropy={abs(float(-(share * np.log2(share)).sum())):.4f}"


@F.pandas_udf(_DIGESTS)
def read_digests(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        s = demux(m)
        rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
    return pd.DataFrame(rows, columns=_DIGESTS.names)


def media_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with the stored form of its texts."""
    return df.withColumn(media, store(text))


def media_digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    n: Column = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return df.select(key, n.alias("n_bytes"), read_digests(store(F.col(text))).alias("m")).select(key, "n_bytes", "m.*")
