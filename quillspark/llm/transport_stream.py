"""MPEG transport streams as a media column.

:func:`mux` wraps a payload losslessly as a transport stream of one program: 188-byte
packets with a program association table, a program map table (one private data
stream that carries its clock reference) and packetised elementary stream packets of
at most ``PES_BYTES`` payload bytes, each with a presentation timestamp; the first
packet of every ``GOP``-th elementary packet is marked as a random-access point.

:func:`demux` reads such bytes back from the tables: it finds the map through the
association table, the stream through the map, checks every packet's sync byte and
each stream's continuity counter, strips adaptation fields, reassembles the
elementary packets and returns their timestamps and random-access points.

Both work on whole packet arrays in numpy.  Defined cases: an empty payload is one
empty elementary packet; bytes that aren't a whole number of packets, a lost sync
byte, a missing table or a broken table checksum raise ``ValueError``; a lost or
repeated packet is counted in ``continuity_errors``.  As columns: a null text is an empty
one, very long texts are one stream each, null ids and repeated rows are carried as rows
(equal texts give equal values), an empty table gives no rows, and extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import binary_column, small_batches
from quillspark.llm.textkit import offsets_of, text_buffer

# Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
STREAM_TYPE_PRIVATE = 0x06
PRIVATE_STREAM_1 = 0xBD
CLOCK_HZ = 90_000
CRC_POLYNOMIAL = 0x04C11DB7

# Choices of this writer.
PMT_PID = 0x1000
ES_PID = 0x0100
PES_BYTES = 32_000
FRAME_TICKS = 3_600
GOP = 4
FIRST_PTS = 126_000


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


_TABLES = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE_PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [_TABLES], 0
    for k, a in enumerate(range(0, max(len(payload), 1), PES_BYTES)):
        body = payload[a : a + PES_BYTES]
        pts = (FIRST_PTS + k * FRAME_TICKS) & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(pts) + body
        # the first packet carries the clock reference and the random-access mark in its adaptation field
        clock = pts - FIRST_PTS
        field = bytes([0x50 if k % GOP == 0 else 0x10]) + (clock << 15 | 0x7E00).to_bytes(6, "big")
        first = 184 - 1 - len(field)
        if len(pes) < first:
            field, first = field.ljust(183 - len(pes), b"\xff"), len(pes)
        out.append(bytes([SYNC]) + (0x4000 | ES_PID).to_bytes(2, "big") + bytes([0x30 | counter, len(field)]) + field + pes[:first])
        counter = (counter + 1) & 15
        rest = np.frombuffer(pes, np.uint8)[first:]
        whole = len(rest) // 184
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            packets[:, 4:] = rest[: whole * 184].reshape(whole, 184)
            out.append(packets.tobytes())
            counter = (counter + whole) & 15
        tail = rest[whole * 184 :].tobytes()
        if tail:
            stuffing = 183 - len(tail)
            field = b"" if stuffing == 0 else b"\x00".ljust(stuffing, b"\xff")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | counter, stuffing]) + field + tail)
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Program:
    """What a transport stream holds."""

    payload: bytes
    pid: int
    stream_type: int
    packets: int
    continuity_errors: int
    pts: list[int]
    random_access: list[int]
    clock: list[int]


def _read_section(packets: np.ndarray, pid_of: np.ndarray, pid: int, table_id: int) -> bytes:
    at = np.flatnonzero((pid_of == pid) & ((packets[:, 1] & 0x40) != 0))
    if not len(at):
        raise ValueError(f"no table on stream {pid}")
    raw = packets[at[0]].tobytes()
    a = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    a += 1 + raw[a]
    size = 3 + ((raw[a + 1] & 0x0F) << 8 | raw[a + 2])
    section = raw[a : a + size]
    if len(section) < size or section[0] != table_id or section_crc(section):
        raise ValueError(f"broken table on stream {pid}")
    return section


def demux(data: bytes) -> Program:
    """Reads a transport stream's first program back."""
    if not data or len(data) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid_of = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = _read_section(packets, pid_of, PAT_PID, 0)
    map_pid = next((int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4) if pat[i : i + 2] != b"\0\0"), None)
    if map_pid is None:
        raise ValueError("no program")
    pmt = _read_section(packets, pid_of, map_pid, 2)
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
    if at + 5 > len(pmt) - 4:
        raise ValueError("no stream")
    stream_type, pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF

    own = packets[pid_of == pid]
    control = own[:, 3] >> 4 & 3
    has_payload = (control & 1) == 1
    counters = own[has_payload, 3] & 15
    errors = int((((counters[1:].astype(int) - counters[:-1]) & 15) != 1).sum())
    field = np.where(control & 2, own[:, 4].astype(np.int64) + 1, 0)
    begin = np.where(has_payload, 4 + field, PACKET)
    keep = np.arange(PACKET)[None, :] >= begin[:, None]
    stream = own[keep]
    ends = offsets_of(PACKET - begin)
    flags = np.where((control & 2 != 0) & (own[:, 4] > 0), own[:, 5], 0)
    heads = np.flatnonzero((own[:, 1] & 0x40) != 0)
    clock = [int.from_bytes(own[i, 6:12].tobytes(), "big") >> 15 for i in np.flatnonzero(flags & 0x10)]
    body, pts = [], []
    bounds = [*ends[heads].tolist(), len(stream)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        head = stream[a : a + 14].tobytes()
        if head[:3] != b"\0\0\1":
            raise ValueError("no elementary packet where one starts")
        if head[7] & 0x80:
            p = head[9:14]
            pts.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
        size = int.from_bytes(head[4:6], "big")
        stop = a + 6 + size if size else b
        if stop > b:
            errors += 1
            stop = b
        body.append(stream[a + 9 + head[8] : stop])
    payload = np.concatenate(body).tobytes() if body else b""
    access = [k for k, i in enumerate(heads) if flags[i] & 0x40]
    return Program(payload, pid, int(stream_type), len(packets), errors, pts, access, clock)


def feature(program: Program) -> str:
    """A fixed summary of a program: stream, packets, elementary packets, span in ticks,
    random-access points, continuity errors, and a coarse byte histogram of the payload."""
    span = program.pts[-1] - program.pts[0] if program.pts else 0
    data = np.frombuffer(program.payload, np.uint8)
    share = np.bincount(data >> 5, minlength=8) * 255 // max(len(data), 1)
    return f"ts:{program.stream_type:02x}:{program.packets}:{len(program.pts)}:{span}:{len(program.random_access)}:{program.continuity_errors}:" + "".join(f"{x:02x}" for x in share)


def padded(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(-len(data) % unit if data else unit)


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as a transport stream; null texts count as empty."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_at in range(0, len(batch), 256):
                part = batch.slice(part_at, 256)
                data, offsets = text_buffer(part.column(1))
                raw = data.tobytes()
                media = [mux(padded(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), binary_column(b"".join(media), offsets_of(np.array([len(m) for m in media])))], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def decode(media: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Programs read from the column `media`: payload (if asked for), timestamps,
    random-access points and a feature."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                stored = [m or b"" for m in part.column(2).to_pylist()]
                programs = [demux(m) for m in stored]
                payloads = [p.payload for p in programs]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "continuity_errors", "pts", "random_access", *(["payload"] if with_payload else [])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                        pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                        pa.array([len(m) for m in stored], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                        pa.array([feature(p) for p in programs]),
                        pa.array([p.continuity_errors for p in programs], pa.int64()),
                        pa.array([p.pts for p in programs], pa.list_(pa.int64())),
                        pa.array([p.random_access for p in programs], pa.list_(pa.int64())),
                        *([binary_column(b"".join(payloads), offsets_of(np.array([len(p) for p in payloads])))] if with_payload else []),
                    ],
                    names=names,
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, continuity_errors bigint, pts array<bigint>, random_access array<bigint>" + (", payload binary" if with_payload else ""),
    )
