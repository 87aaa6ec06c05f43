"""Media columns: payloads stored as MPEG transport streams, and streams parsed back.

`store` pads each payload with bytes 255 to a positive multiple of 576 and multiplexes it: a
program association table, a program map table, then access units of up to UNIT bytes, each
an elementary packet with its own time stamp, in 188-byte transport packets with continuity
counters. Every RAP-th unit is marked as a random-access point. `read` finds the elementary
stream through the tables, checks their CRCs and the counters, reassembles the packets and
returns the payload with its time stamps and random-access points.

Cases: a null or empty text is 576 bytes of 255; null doc_ids and repeated rows are kept; an
empty table gives no rows; other columns of the input are ignored. A damaged stream raises: lost sync, tables whose CRC
fails, gaps in counters or time stamps, incomplete packets, a payload shorter than n_bytes. A packet sent twice in a row counts once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import _arrow

BLOCK = 576
UNIT = 8 * BLOCK
RAP = 8
PMT_PID, ES_PID, PROGRAM, TICKS = 0x100, 0x101, 1, 3600  # 90 kHz clock, 25 units a second

SLICE = 512 << 10


def _crc_table() -> np.ndarray:
    """Table of the CRC-32 that transport stream sections use (polynomial 0x04C11DB7, not reflected)."""
    out = []
    for x in range(256):
        x <<= 24
        for _ in range(8):
            x = (x << 1) ^ (0x04C11DB7 if x & 0x80000000 else 0)
        out.append(x & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, key: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, key >> 8, key & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(188, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, 6, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
)


def _units(data: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Transport packets of equally long access units, one per row of `data`."""
    n, size = data.shape
    pes = np.empty((n, 14 + size), np.uint8)
    pes[:, :9] = (0, 0, 1, 0xBD, (size + 8) >> 8, (size + 8) & 255, 0x84, 0x80, 5)
    t = (first + np.arange(n, dtype=np.int64)) * TICKS & ((1 << 33) - 1)
    for k, v in enumerate((0x21 | t >> 30 << 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, (t & 127) << 1 | 1)):
        pes[:, 9 + k] = v
    pes[:, 14:] = data
    m = 1 + -(-(pes.shape[1] - 182) // 184)
    out = np.empty((n, m, 188), np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = 0x47, ES_PID >> 8, ES_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10 | (counter + np.arange(n * m).reshape(n, m)) & 15
    # first packet: an adaptation field of two bytes with the random-access flag
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = 1
    out[:, 0, 5] = np.where((first + np.arange(n)) % RAP == 0, 0x40, 0)
    out[:, 0, 6:] = pes[:, :182]
    if m > 2:
        out[:, 1:-1, 4:] = pes[:, 182 : 182 + 184 * (m - 2)].reshape(n, m - 2, 184)
    tail = pes[:, 182 + 184 * (m - 2) :]
    if stuffing := 184 - tail.shape[1]:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = stuffing - 1
        out[:, -1, 5 : 4 + stuffing] = 0xFF
        if stuffing > 1:
            out[:, -1, 5] = 0
    out[:, -1, 4 + stuffing :] = tail
    return out.reshape(n * m, 188)


def mux(payload: bytes) -> bytes:
    """A transport stream with the payload, whose length is a positive multiple of BLOCK."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    parts, sent = [_TABLES], 0
    if whole:
        x = _units(data[: whole * UNIT].reshape(whole, UNIT), 0, 0)
        sent = len(x)
        parts.append(x.tobytes())
    if len(data) % UNIT:
        parts.append(_units(data[whole * UNIT :][None], whole, sent).tobytes())
    return b"".join(parts)


def _parsed(packet: np.ndarray, table: int) -> bytes:
    at = 5 + int(packet[4])
    n = (int(packet[at + 1]) & 15) << 8 | int(packet[at + 2])
    section = packet[at : at + 3 + n].tobytes()
    if section[0] != table or section_crc(section):
        raise ValueError("damaged program table")
    return section[8:-4]


def demux(stream: bytes) -> tuple[bytes, np.ndarray, np.ndarray, int, int]:
    """Payload, time stamps, indices of random-access units, packets of the elementary stream, repeated packets.

    A packet may be sent twice in a row; the repeat is skipped. A gap in counters or time stamps is an error.
    """
    if len(stream) % 188:
        raise ValueError("not whole transport packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, 188)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    pat = _parsed(p[np.flatnonzero(pid == 0)[0]], 0)
    pmt_pid = (pat[2] & 31) << 8 | pat[3]
    pmt = _parsed(p[np.flatnonzero(pid == pmt_pid)[0]], 2)
    info = (pmt[2] & 15) << 8 | pmt[3]
    es = (pmt[5 + info] & 31) << 8 | pmt[6 + info]
    p = p[pid == es]
    control = p[:, 3] >> 4 & 3
    p, control = p[(control & 1) == 1], control[(control & 1) == 1]
    repeated = np.append(False, (p[1:] == p[:-1]).all(1))
    if (repeated[1:] & repeated[:-1]).any():
        raise ValueError("a packet is there three times")
    p, control = p[~repeated], control[~repeated]
    if ((p[1:, 3].astype(np.int16) - p[:-1, 3] & 15) != 1).any():
        raise ValueError("packets are lost: the continuity counter jumps")
    field = (control & 2) != 0
    head = np.where(field, 5 + p[:, 4].astype(np.int64), 4)
    begins = (p[:, 1] & 0x40) != 0
    units = np.flatnonzero(begins)
    at = head[units]
    rows = p[units]
    take = lambda k: np.take_along_axis(rows, (at + k)[:, None], 1)[:, 0].astype(np.int64)
    if (take(0) | take(1)).any() or (take(2) != 1).any():
        raise ValueError("no elementary packet where one must begin")
    stamps = (take(9) >> 1 & 7) << 30 | take(10) << 22 | take(11) >> 1 << 15 | take(12) << 7 | take(13) >> 1
    if (np.diff(stamps) % (1 << 33) != TICKS).any():
        raise ValueError("units are lost: the time stamps jump")
    sizes = take(4) << 8 | take(5)
    head[units] += 9 + take(8)
    body = p[np.arange(188) >= head[:, None]]
    got = np.add.reduceat(188 - head, units)
    if (got != sizes - 3 - take(8)).any():
        raise ValueError("an elementary packet is incomplete")
    marks = field[units] & (rows[:, 4] > 0) & ((rows[:, 5] & 0x40) != 0)
    return body.tobytes(), stamps, np.flatnonzero(marks), len(p), int(repeated.sum())


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding) and media: a transport stream for each text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "text", SLICE):
                raw = _arrow.bytes_of(*_arrow.utf8(part.column("text")))
                media = [mux(x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK, b"\xff")) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(stored: DataFrame, payloads: bool = False) -> DataFrame:
    """Stored streams read back: digests of payload and stream, time stamps and random-access points.

    With `payloads` the payload itself comes along. feature: transport packets of the stream,
    units, random-access points, repeated packets, first and last stamp, distinct byte values.
    """
    ship(stored.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, access_points array<long>"
    names = [x.split()[0] for x in schema.split(", ")] + ["payload"] * payloads
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "media", SLICE):
                rows = []
                for doc, n, media in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                    payload, stamps, marks, packets, repeats = demux(media)
                    if n is not None and not n <= len(payload) <= max(n + BLOCK - 1, BLOCK):
                        raise ValueError("the stream ends before its payload")
                    seen = int((np.bincount(np.frombuffer(payload, np.uint8), minlength=256) > 0).sum())
                    feature = f"packets={packets};units={len(stamps)};access={len(marks)};repeats={repeats};first={stamps[0]};last={stamps[-1]};values={seen}"
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, stamps, marks, payload)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + (", payload binary" if payloads else ""))
