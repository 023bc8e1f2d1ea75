"""MPEG transport streams (ISO/IEC 13818-1) as a media column.

``mux`` stores bytes losslessly as a stream of 188-byte packets: one program
association table, one program map table, then elementary packets (PES) of
private data, each with a 90 kHz timestamp; a PES begins in a packet whose
adaptation field marks a random-access point and carries a clock reference.
``demux`` reads a stream back: tables with their CRCs, continuity counters by
PID, reassembled packets, timestamps and random-access points; ``features`` stores
the timestamps with the numbers of the packets at random-access points. Packets are
handled as rows of a numpy matrix, so there is no Python work a packet except
for those with adaptation fields.

Edges: the payload of a null or empty text is 64 zero bytes; repeated rows give
equal streams; an empty table gives no row; a damaged stream gives counted
errors and never an exception; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.common import batches_of, documents, id_and_text, strings, write_table

# Fixed values of the format.
PACKET, SYNC, PAT_PID, PMT_PID, MEDIA_PID = 188, 0x47, 0x0000, 0x1000, 0x0100
STREAM_TYPE_PRIVATE, STREAM_ID_PRIVATE = 0x06, 0xBD
CRC_POLYNOMIAL = 0x04C11DB7

#: Payload bytes of a PES, and 90 kHz ticks from one to the next (25 a second).
PES_BYTES, TICKS = 16 * 1024, 3600
_PES_HEAD = 14  # start code 3, id 1, length 2, flags 3, timestamp 5
_BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (CRC_POLYNOMIAL if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(crc)
    return out


_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _TABLE[crc >> 24 ^ byte]
    return crc


def _section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    section += struct.pack(">I", section_crc(section))
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


_TABLES = _section_packet(PAT_PID, 0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)) + _section_packet(
    PMT_PID, 0x02, 1, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE_PRIVATE, 0xE000 | MEDIA_PID, 0xF000)
)


def _timestamp(ticks: int) -> bytes:
    return struct.pack(
        ">BHH", 0x21 | (ticks >> 29 & 0x0E), (ticks >> 14 & 0xFFFE) | 1, (ticks << 1 & 0xFFFE) | 1
    )


def _ticks(data: bytes) -> int:
    a, b, c = struct.unpack(">BHH", data)
    return (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, those bytes zero-padded to a positive multiple of 64)"""
    data = text.encode("utf-8")
    return len(data), data.ljust(max(_BLOCK, -(-len(data) // _BLOCK) * _BLOCK), b"\0")


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream: a lossless container of whole 188-byte packets."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        chunk = payload[at : at + PES_BYTES]
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID_PRIVATE, len(chunk) + 8, 0x84, 0x80, 5) + _timestamp(k * TICKS) + chunk
        clock = k * TICKS
        # The first packet: adaptation field of flags (random access, clock) and 6 bytes of clock reference.
        adapt = struct.pack(">BIH", 0x50, clock >> 1, (clock & 1) << 15 | 0x7E00)
        room = PACKET - 5 - len(adapt)
        head = pes[:room]
        adapt += b"\xff" * (room - len(head))
        out.append(struct.pack(">BHBB", SYNC, 0x4000 | MEDIA_PID, 0x30 | counter, len(adapt)) + adapt + head)
        counter = counter + 1 & 15
        rest = pes[len(head) :]
        whole = len(rest) // 184
        if whole:
            matrix = np.empty((whole, PACKET), np.uint8)
            matrix[:, 0], matrix[:, 1], matrix[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
            matrix[:, 3] = 0x10 | (counter + np.arange(whole) & 15)
            matrix[:, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
            out.append(matrix.tobytes())
            counter = counter + whole & 15
        tail = rest[whole * 184 :]
        if tail:
            fill = 184 - len(tail)
            field_ = bytes([fill - 1]) + (b"\0" + b"\xff" * (fill - 2) if fill > 1 else b"")
            out.append(struct.pack(">BHB", SYNC, MEDIA_PID, 0x30 | counter) + field_ + tail)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What demux finds. payload: the bytes of the media PID's packets; pts: (payload offset, ticks) of each."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    sync_errors: int = 0
    crc_errors: int = 0
    continuity_errors: int = 0
    pes_errors: int = 0
    payload: bytes = b""
    pts: list[tuple[int, int]] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)

    def feature(self) -> str:
        streams = ",".join(f"{pid}:{kind}" for pid, kind in sorted(self.streams.items()))
        errors = f"{self.sync_errors}/{self.crc_errors}/{self.continuity_errors}/{self.pes_errors}"
        last = self.pts[-1][1] if self.pts else -1
        return (
            f"packets={self.packets};programs={len(self.programs)};streams={streams};pes={len(self.pts)};"
            f"random_access={len(self.random_access)};last_pts={last};errors={errors}"
        )


def _sections(packets: np.ndarray, found: Stream) -> Iterator[bytes]:
    """The bodies of the sections that the packets of one PID carry, over any number of packets; sections that are damaged or cut off are errors."""
    held, last = None, b""
    for row in packets:
        packet = row.tobytes()
        start = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
        if packet == last or not packet[3] & 0x10 or start >= PACKET:
            continue  # a duplicate, or nothing carried
        last, data = packet, packet[start:]
        if packet[1] & 0x40:
            pointer = 1 + data[0]
            if held is not None:
                yield from _taken(held + data[1:pointer], found, True)
            held = data[pointer:]
        elif held is None:
            continue
        else:
            held += data
        held = yield from _taken(held, found, False)
    if held is not None:
        yield from _taken(held, found, True)


def _taken(held: bytes, found: Stream, last: bool) -> Iterator[bytes]:
    """The bodies of whole sections; returns what is left, null once only stuffing follows. What is left at last is a section cut off."""
    while held and held[0] != 0xFF:
        size = 3 + ((held[1] & 0x0F) << 8 | held[2]) if len(held) >= 3 else len(held) + 1
        if size > len(held):
            found.crc_errors += last
            return held
        if size >= 12 and section_crc(held[:size]) == 0:
            yield held[8 : size - 4]
        else:
            found.crc_errors += 1
        held = held[size:]
    return None if held else held


def _duplicates(rows: np.ndarray) -> np.ndarray:
    """Which packets of a PID, all of which carry something, repeat the one before; that is allowed once, and the clock may differ."""
    out = np.zeros(len(rows), bool)
    for k in np.flatnonzero((rows[1:, 3] & 15) == (rows[:-1, 3] & 15)) + 1:
        same = rows[k] == rows[k - 1]
        if rows[k, 3] & 0x20 and rows[k, 4] >= 7 and rows[k, 5] & 0x10:
            same[6:12] = True
        out[k] = same.all() and not out[k - 1]
    return out


def demux(media: bytes) -> Stream:
    found = Stream(packets=len(media) // PACKET)
    if not found.packets:
        return found
    m = np.frombuffer(media, np.uint8, found.packets * PACKET).reshape(-1, PACKET)
    good = m[:, 0] == SYNC
    found.sync_errors = int((~good).sum()) + bool(len(media) % PACKET)
    pid = (m[:, 1] & 0x1F).astype(np.int32) << 8 | m[:, 2]
    starts = (m[:, 1] & 0x40).astype(bool)
    for body in _sections(m[good & (pid == PAT_PID)], found):
        for j in range(0, len(body) - 3, 4):
            number, where = struct.unpack_from(">HH", body, j)
            if number:
                found.programs[number] = where & 0x1FFF
    for where in set(found.programs.values()):
        for body in _sections(m[good & (pid == where)], found):
            if len(body) < 4:  # too short for what every program map has
                found.crc_errors += 1
                continue
            j = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
            while j + 5 <= len(body):
                kind, own, info = struct.unpack_from(">BHH", body, j)
                found.streams[own & 0x1FFF] = kind
                j += 5 + (info & 0xFFF)
    payloads = []
    for own in sorted(found.streams):
        at = np.flatnonzero(good & (pid == own))
        control = m[at, 3]
        carries = (control & 0x10).astype(bool)
        carrying = np.flatnonzero(carries)
        again = carrying[_duplicates(m[at[carrying]])]
        if len(again):
            at = np.delete(at, again)
            control = m[at, 3]
            carries = (control & 0x10).astype(bool)
        counters = (control & 15).astype(np.int16)[carries]
        # A packet may say that its counter goes on from elsewhere.
        told = ((control & 0x20) != 0) & (m[at, 4] > 0) & ((m[at, 5] & 0x80) != 0)
        found.continuity_errors += int(((counters[1:] - counters[:-1]) % 16 != 1)[~told[carries][1:]].sum())
        adapted = (control & 0x20).astype(bool)
        first, parts = np.flatnonzero(starts[at] & carries), []
        for a, b in zip(first, [*first[1:], len(at)], strict=False):  # none begins in a stream that lost all starts
            pes = []
            special = [k for k in range(a, b) if k == a or k == b - 1] if not adapted[a + 1 : b - 1].any() else range(a, b)
            previous = a
            for k in special:
                if k > previous:
                    pes.append(m[at[previous:k], 4:].tobytes())
                packet = m[at[k]].tobytes()
                skip = 4
                if adapted[k]:
                    skip = min(PACKET, 5 + packet[4])
                    flags = packet[5] if packet[4] else 0
                    if flags & 0x40:
                        found.random_access.append(int(at[k]))
                    if flags & 0x10:
                        base, extra = struct.unpack_from(">IH", packet, 6)
                        found.clocks.append(base << 1 | extra >> 15)
                pes.append(packet[skip:] if carries[k] else b"")
                previous = k + 1
            data = b"".join(pes)
            if len(data) < _PES_HEAD or data[:3] != b"\0\0\1":
                found.pes_errors += 1
                continue
            length, begin = struct.unpack_from(">H", data, 4)[0], 9 + data[8]
            body = data[begin : 6 + length] if length else data[begin:]
            found.pes_errors += bool(length) and len(data) < 6 + length
            if data[7] & 0x80:
                found.pts.append((sum(map(len, parts)), _ticks(data[9:14])))
            parts.append(body)
        payloads.append(b"".join(parts))
    found.payload = b"".join(payloads)
    return found


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a transport stream."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch):
                stored = [payload_of(t) for t in strings(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for n, _ in stored], pa.int64()), pa.array([mux(p) for _, p in stored], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_packets long, n_random_access long, timestamps array<long>, random_access array<long>, n_errors long"
)


def features(media: DataFrame) -> DataFrame:
    """Reads the stored streams back; n_bytes comes from the table, all else from the streams."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in FEATURES.split(", ")]
        kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "timestamps": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64())}
        for batch in batches:
            for part in batches_of(batch, column="media"):
                rows = []
                for doc_id, n, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes")), strings(part.column("media")), strict=True):
                    s = demux(data)
                    rows.append(
                        (doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-_BLOCK:]), len(data),
                         hashlib.sha256(data).hexdigest(), s.feature(), s.packets, len(s.random_access), [t for _, t in s.pts], s.random_access,
                         s.sync_errors + s.crc_errors + s.continuity_errors + s.pes_errors)
                    )
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)

    return media.mapInArrow(run, FEATURES)


def op3_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(write_table(with_media(documents(spark, sf_dir)), "media"))
