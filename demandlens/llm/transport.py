"""Media columns: MPEG transport streams written, stored, and parsed again (operator 8)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.util import doc_columns, stored

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0, 0x1000, 0x100, 1
#: Stream type and id of privately defined data in PES packets.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Payload bytes of one PES packet, and how far its time stamp lies behind the one before (90 kHz).
UNIT, TICKS = 32_768, 3_600
BLOCK = 64


def _crc_table() -> list[int]:
    table = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, as program tables carry it; 0 over a table with its own crc."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int = 0) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def multiplex(payload: bytes) -> bytes:
    """One program with one elementary stream: PAT, PMT, then PES packets of UNIT bytes, each a random-access point.

    Packets other than a PES packet's first and last carry 184 bytes of it; the first has an adaptation field with the
    random-access flag, the last one with stuffing.
    """
    out = [_TABLES]
    counter = 0
    for k in range(0, max(len(payload), 1), UNIT):
        part = payload[k : k + UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k // UNIT * TICKS & (1 << 33) - 1) + part
        room = PACKET - 4 - 2
        fill = max(0, room - len(pes))
        out.append(bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | counter & 15, 1 + fill, 0x40]) + b"\xff" * fill + pes[:room])
        counter += 1
        rest = pes[room:]
        whole = len(rest) // (PACKET - 4)
        if whole:
            rows = np.empty((whole, PACKET), dtype=np.uint8)
            rows[:, :3] = (SYNC, DATA_PID >> 8, DATA_PID & 0xFF)
            rows[:, 3] = 0x10 | (np.arange(counter, counter + whole) & 15)
            rows[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=whole * (PACKET - 4)).reshape(whole, PACKET - 4)
            out.append(rows.tobytes())
            counter += whole
        if tail := rest[whole * (PACKET - 4) :]:
            fill = PACKET - 5 - len(tail)
            stuffing = b"" if fill == 0 else b"\x00" + b"\xff" * (fill - 1)
            out.append(bytes([SYNC]) + DATA_PID.to_bytes(2, "big") + bytes([0x30 | counter & 15, fill]) + stuffing + tail)
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """What one elementary stream of a transport stream holds."""

    pid: int
    stream_type: int
    payload: bytes = b""
    #: (time stamp or None, byte of the payload, packet number) of each PES packet, and those flagged for random access
    units: list[tuple[int | None, int, int]] = field(default_factory=list)
    random_access: list[tuple[int | None, int, int]] = field(default_factory=list)
    packets: int = 0
    discontinuities: int = 0
    duplicates: int = 0
    damaged: int = 0


class TransportError(ValueError):
    """The bytes aren't a transport stream with a readable program."""


def _body(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First payload byte of each packet (PACKET: none), adaptation flags, and whether a payload is there."""
    control = rows[:, 3] >> 4 & 3
    has_field = control >= 2
    size = np.where(has_field, rows[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(has_field & (size > 1), rows[:, 5], 0)
    has_payload = control % 2 == 1
    return np.where(has_payload, np.minimum(4 + size, PACKET), PACKET), flags, has_payload


def _table(rows: np.ndarray, pid_of: np.ndarray, pid: int, table_id: int) -> bytes:
    """The first whole section of a table; it may span packets."""
    data, began = b"", False
    starts, _, _ = _body(rows)
    for k in np.flatnonzero(pid_of == pid):
        part = rows[k, starts[k] :].tobytes()
        if rows[k, 1] & 0x40:
            data, began = part[1 + part[0] :], True
        elif began:
            data += part
        if len(data) >= 3 and len(data) >= (size := ((data[1] & 15) << 8 | data[2]) + 3):
            if data[0] == table_id and crc_mpeg(data[:size]) == 0:
                return data[:size]
            data, began = b"", False
    raise TransportError(f"no table {table_id} on pid {pid}")


def demultiplex(media: bytes) -> list[Stream]:
    """The elementary streams of the first program, in the order of its map.

    Continuity counters are checked over packets that carry a payload: a repeated packet is dropped, a gap is counted
    unless the discontinuity flag announces it. PES packets whose length field disagrees with their bytes count as damaged.
    """
    if not media or len(media) % PACKET:
        raise TransportError("length is no multiple of 188")
    rows = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise TransportError("lost synchronisation")
    pid_of = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    pat = _table(rows, pid_of, PAT_PID, 0)
    programs = [(int.from_bytes(pat[k : k + 2], "big"), int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF) for k in range(8, len(pat) - 4, 4)]
    if not (programs := [p for p in programs if p[0]]):
        raise TransportError("no program")
    pmt = _table(rows, pid_of, programs[0][1], 2)
    at, found = 12 + ((pmt[10] & 15) << 8 | pmt[11]), []
    while at < len(pmt) - 4:
        found.append((int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF, pmt[at]))
        at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    starts, flags, has_payload = _body(rows)
    out = []
    for pid, kind in found:
        stream = Stream(pid, kind)
        own = np.flatnonzero((pid_of == pid) & has_payload)
        stream.packets = len(own)
        counters = rows[own, 3].astype(np.int64) & 15
        step = np.diff(counters, prepend=counters[:1] - 1) % 16
        same = np.concatenate([[False], (step[1:] == 0) & (rows[own[1:], 4:] == rows[own[:-1], 4:]).all(axis=1)]) if len(own) else np.zeros(0, dtype=bool)
        stream.duplicates = int(same.sum())
        own, counters = own[~same], counters[~same]
        step = np.diff(counters, prepend=counters[:1] - 1) % 16
        stream.discontinuities = int(((step != 1) & (flags[own] & 0x80 == 0)).sum())
        begins = np.flatnonzero(rows[own, 1] & 0x40)
        payloads, size = [], 0
        for k, first in enumerate(begins):
            mine = own[first : begins[k + 1] if k + 1 < len(begins) else len(own)]
            block = rows[mine]
            full = starts[mine] == 4
            if len(mine) > 2 and full[1:-1].all():
                pes = block[0, starts[mine[0]] :].tobytes() + block[1:-1, 4:].tobytes() + block[-1, starts[mine[-1]] :].tobytes()
            else:
                pes = b"".join(row[s:].tobytes() for row, s in zip(block, starts[mine], strict=True))
            length = int.from_bytes(pes[4:6], "big")
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or (length and length != len(pes) - 6):
                stream.damaged += 1
                continue
            pts = None
            if pes[7] & 0x80:
                b = pes[9:14]
                pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
            unit = (pts, size, int(mine[0]))
            stream.units.append(unit)
            if flags[mine[0]] & 0x40:
                stream.random_access.append(unit)
            payloads.append(pes[9 + pes[8] :])
            size += len(payloads[-1])
        stream.payload = b"".join(payloads)
        out.append(stream)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and the text padded with zero bytes to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for every row, written to the shared folder and read back. A null text is an empty one."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [(n, multiplex(payload)) for n, payload in map(payload_of, part["text"].tolist())]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in made], "media": [m for _, m in made]})

    return stored(doc_columns(docs, "doc_id", "text").mapInPandas(write, "doc_id long, n_bytes long, media binary"), "media")


def parse_media(media: DataFrame) -> DataFrame:
    """Features of every stored stream, with its random-access points as (pts, byte, packet).

    Bytes that aren't a transport stream, null included, give nulls and the reason as ``feature``.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part["media"].tolist():
                try:
                    s = demultiplex(data or b"")[0]
                except (TransportError, IndexError) as error:
                    rows.append((None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), f"error={error}", []))
                    continue
                last = s.units[-1][0] if s.units else None
                feature = (
                    f"program={PROGRAM};pid={s.pid};type={s.stream_type};packets={s.packets};pes={len(s.units)};rap={len(s.random_access)};"
                    f"pts={s.units[0][0] if s.units else None}-{last};gaps={s.discontinuities};repeats={s.duplicates};damaged={s.damaged}"
                )
                points = [{"pts": p, "byte": b, "packet": k} for p, b, k in s.random_access]
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature, points))
            columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "random_access"]
            out = pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64", "tail_crc32": "Int64"})
            yield pd.concat([part[["doc_id", "n_bytes"]].astype("Int64").reset_index(drop=True), out], axis=1)

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, random_access array<struct<pts: long, byte: long, packet: long>>"
    )
    return media.select("doc_id", "n_bytes", "media").mapInPandas(read, schema)


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_media(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return parsed.withColumn("random_access", F.to_json("random_access"))
