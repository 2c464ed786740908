"""MPEG transport streams as a media column: multiplexing of byte payloads and a checking demultiplexer."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.common import arrays, blobs, runs

PACKET, BODY, SAMPLE_BLOCK = 188, 184, 576
PAT_PID, PMT_PID, ES_PID, PRIVATE_STREAM, STREAM_TYPE = 0x0000, 0x1000, 0x0100, 0xBD, 0x06
UNIT, UNITS_PER_GROUP, TICKS = 16 * SAMPLE_BLOCK, 8, 3600

DEMUX = [("doc_id", pa.int64()), ("payload", pa.binary()), ("points", pa.list_(pa.struct([("pts", pa.int64()), ("position", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_()), ("complete", pa.bool_())]))), ("program", pa.int32()), ("pmt_pid", pa.int32()), ("es_pid", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("continuity_errors", pa.int64()), ("error", pa.string())]
DEMUX_DDL = "doc_id long, payload binary, points array<struct<pts:long,position:long,length:long,random_access:boolean,complete:boolean>>, program int, pmt_pid int, es_pid int, stream_type int, packets long, continuity_errors long, error string"


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, key: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


TABLES = np.stack([
    _table_packet(PAT_PID, _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")),
])


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _clock(pts: int) -> bytes:
    return (pts << 15 | 0x3F << 9).to_bytes(6, "big")


def _unit_packets(unit: bytes, index: int, random_access: bool) -> np.ndarray:
    """The transport packets of one access unit; the first has the clock (and the random-access flag), the last is stuffed."""
    pts = index * TICKS & (1 << 33) - 1
    pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
    first = BODY - 8
    count = 1 + max(0, -(-(len(pes) - first) // BODY))
    out = np.empty((count, PACKET), np.uint8)
    out[:, :4] = (0x47, ES_PID >> 8, ES_PID & 0xFF, 0x10)
    data = np.frombuffer(pes, np.uint8)
    lead = bytes([7, 0x50 if random_access else 0x10]) + _clock(pts)
    if len(pes) <= first:
        gap = first - len(pes)
        lead = bytes([7 + gap]) + lead[1:] + b"\xff" * gap
        out[0, 4 : 4 + len(lead)] = np.frombuffer(lead, np.uint8)
        out[0, 4 + len(lead) :] = data
    else:
        out[0, 4:12] = np.frombuffer(lead, np.uint8)
        out[0, 12:] = data[:first]
        whole = (len(pes) - first) // BODY
        out[1 : 1 + whole, 4:] = data[first : first + whole * BODY].reshape(whole, BODY)
        rest = data[first + whole * BODY :]
        if len(rest):
            gap = BODY - len(rest)
            fill = bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"")
            out[-1, 4 : 4 + gap] = np.frombuffer(fill, np.uint8)
            out[-1, 4 + gap :] = rest
            out[-1, 3] = 0x30
    out[0, 1] |= 0x40
    out[0, 3] = 0x30
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``: units of 9216 bytes at most, tables and a random-access point every eight units."""
    parts = []
    for i in range(0, max(1, -(-len(payload) // UNIT))):
        if i % UNITS_PER_GROUP == 0:
            parts.append(TABLES)
        parts.append(_unit_packets(payload[i * UNIT : (i + 1) * UNIT], i, i % UNITS_PER_GROUP == 0))
    out = np.concatenate(parts)
    pid = (out[:, 1].astype(np.int32) & 0x1F) << 8 | out[:, 2]
    for p in (PAT_PID, PMT_PID, ES_PID):
        own = np.flatnonzero(pid == p)
        out[own, 3] |= (np.arange(len(own)) & 0x0F).astype(np.uint8)
    return out.tobytes()


def _section_of(packets: np.ndarray, table: int) -> bytes:
    """The first whole section with the given id in the packets of one PID; it may go over several packets."""
    data, wanted = b"", None
    for p in packets:
        at = 4 + (1 + int(p[4]) if p[3] & 0x20 else 0)
        if not p[3] & 0x10 or at >= PACKET:
            continue
        if p[1] & 0x40:
            data, wanted = p[at + 1 + int(p[at]) :].tobytes(), None
        elif not data:
            continue
        else:
            data += p[at:].tobytes()
        if wanted is None and len(data) >= 3:
            wanted = 3 + ((data[1] & 0x0F) << 8 | data[2])
        if wanted is not None and len(data) >= wanted:
            section = data[:wanted]
            if section[0] != table or section_crc(section):
                raise ValueError("damaged program table")
            return section
    raise ValueError("no whole program table")


CHECKED: dict[bytes, bytes] = {}


def _checked(packets: np.ndarray, table: int) -> bytes:
    """The section that packets of one PID begin with; streams repeat their tables, so a checked one is remembered by its first packet."""
    if not len(packets):
        raise ValueError("no program table")
    key = packets[0, 4:].tobytes()
    if key not in CHECKED:
        section = _section_of(packets, table)
        if len(section) > PACKET - 5:
            return section
        if len(CHECKED) > 256:
            CHECKED.clear()
        CHECKED[key] = section
    return CHECKED[key]


def demux(stream: bytes) -> dict:
    """Payload, timestamps and random-access points of the first elementary stream; counts continuity errors.

    Program tables are found through PAT and PMT, each over as many packets as it takes, and their CRC is checked; packets that repeat a
    counter are dropped as duplicates; a missing counter value counts as one error. A unit that is shorter than its header says, or in which
    a counter is missing, is not ``complete``: it keeps its timestamp and flags, but its bytes are left out of the payload (length 0). Damaged sync
    bytes, tables or start codes raise ValueError.
    """
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    pat = _checked(p[pid == PAT_PID], 0x00)
    program, pmt_pid = int.from_bytes(pat[8:10], "big"), int.from_bytes(pat[10:12], "big") & 0x1FFF
    pmt = _checked(p[pid == pmt_pid], 0x02)
    skip = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
    stream_type, es_pid = pmt[skip], int.from_bytes(pmt[skip + 1 : skip + 3], "big") & 0x1FFF
    es = p[pid == es_pid]
    step = np.diff(es[:, 3].astype(np.int16) & 0x0F, prepend=-1) & 0x0F
    step[:1] = 1
    es, gap = es[step != 0], (step[step != 0] > 1)
    start = np.where(es[:, 3] & 0x20, 5 + es[:, 4].astype(np.int32), 4)
    flags = np.where((es[:, 3] & 0x20 != 0) & (es[:, 4] > 0), es[:, 5], 0)
    data = es[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    heads = np.flatnonzero(es[:, 1] & 0x40)
    bounds = [*(ends[heads] - (PACKET - start[heads])).tolist(), len(data)]
    gaps = np.append(0, np.cumsum(gap))
    lost = (gaps[np.append(heads[1:], len(es))[: len(heads)]] - gaps[heads + 1]).tolist()
    units, points, position = [], [], 0
    for at, end, random_access, inside in zip(bounds, bounds[1:], (flags[heads] & 0x40 != 0).tolist(), lost, strict=False):
        h = data[at : at + 14]
        if h[:3] != b"\x00\x00\x01":
            raise ValueError("no packet start code")
        size = int.from_bytes(h[4:6], "big") - 3 - h[8]
        unit = data[at + 9 + h[8] : min(end, at + 9 + h[8] + size)]
        whole = not inside and len(unit) == size
        unit = unit if whole else b""
        s = h[9:14]
        points.append({"pts": (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1, "position": position, "length": len(unit), "random_access": random_access, "complete": whole})
        units.append(unit)
        position += len(unit)
    return {"payload": b"".join(units), "points": points, "program": program, "pmt_pid": pmt_pid, "es_pid": es_pid, "stream_type": stream_type, "packets": len(p), "continuity_errors": int(gap.sum()), "error": None}


def tried(stream: bytes | None) -> dict:
    """``demux``, or for a stream that it refuses (and for null) the reason as ``error`` and all else null."""
    try:
        if stream is None:
            raise ValueError("no media")
        return demux(stream)
    except (ValueError, IndexError) as e:
        return {n: None for n, _ in DEMUX[1:]} | {"error": str(e)}


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text in UTF-8, filled with bytes 255 to a positive multiple of 576, as a transport stream: (doc_id, n_bytes, media).

    Null text is empty; ids may be null or repeated; extra columns are ignored. No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "text"):
            texts = blobs(batch.column("text"))
            media = [mux(t.ljust(max(1, -(-len(t) // SAMPLE_BLOCK)) * SAMPLE_BLOCK, b"\xff")) for t in texts]
            yield arrays([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())], [batch.column("doc_id"), [len(t) for t in texts], media])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def demux_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Demultiplex a media column: payload, points (timestamp, position, length, random access, complete), program data, continuity errors.

    One row per row. A null or damaged stream has a row with the reason in ``error`` and null elsewhere.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "media"):
            found = [tried(m) for m in batch.column("media").to_pylist()]
            yield arrays(DEMUX, [batch.column("doc_id"), *([f[n] for f in found] for n, _ in DEMUX[1:])])

    return media.select("doc_id", F.col(media_col).alias("media")).mapInArrow(run, DEMUX_DDL)


DIGESTS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64()))]
DIGESTS_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>"


def media_digests(media: DataFrame) -> DataFrame:
    """Read the media column of ``to_media`` back and describe it: digests of payload and stored form, the stream's feature, the timestamp of
    each unit, and where in the payload the random-access points are. A null or damaged stream has its reason as feature and null for what can't be read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "media"):
            out: list[list] = [[] for _ in DIGESTS[2:]]
            for m in batch.column("media").to_pylist():
                f = tried(m)
                stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                if f["error"] is not None:
                    row = (None, None, None, *stored, f"error={f['error']}", None, None)
                else:
                    payload, points = f["payload"], f["points"]
                    stamps, jumps = [p["pts"] for p in points], [p["position"] for p in points if p["random_access"]]
                    feature = f"program={f['program']};pmt=0x{f['pmt_pid']:04x};es=0x{f['es_pid']:04x}:0x{f['stream_type']:02x};packets={f['packets']};units={len(points)};random_access={len(jumps)};pts={stamps[0] if stamps else None}-{stamps[-1] if stamps else None};continuity_errors={f['continuity_errors']}"
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature, stamps, jumps)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield arrays(DIGESTS, [batch.column("doc_id"), batch.column("n_bytes"), *out])

    return media.mapInArrow(run, DIGESTS_DDL)
