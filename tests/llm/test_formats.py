"""Digests against plain loops; transport streams made by hand and damaged ones."""

import math
import random
import struct

from glyphmill.llm import digest, mpegts


def plain_digest(text):
    data, counts, full = text.encode(), [0] * digest.BUCKETS, 0xFFFFFFFF
    for (i, j), salt in zip(digest._OFFSETS, digest._SALTS, strict=True):
        for k in range(len(data) - j):
            h = (((data[k] * 0x9E3B + data[k + i]) & full) * 0x85EBCA6B + data[k + j] * ((salt * 0x10001) & full)) & full
            h ^= h >> 15
            counts[(h * 0xC2B2AE35 & full) >> 24] += 1
    ordered = sorted(counts)
    q = [ordered[digest.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    marks = [sum(c > x for x in q) for c in counts]
    packed = bytes(sum(m << 2 * k for k, m in enumerate(marks[at : at + 4])) for at in range(0, len(marks), 4))
    head = [min(255, round(12 * math.log2(len(data) + 1))), (16 * q[0] // (q[2] + 1) % 16) << 4 | 16 * q[1] // (q[2] + 1) % 16]
    return bytes(head).hex() + packed.hex(), marks, head


def test_digests_by_plain_loops():
    rng = random.Random(7)
    texts = ["", "a", "ab", "abc", "aaaaaa" * 50, "é日本😀" * 30] + ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(5, 900))) for _ in range(20)]
    made = [plain_digest(t) for t in texts]
    assert [digest.digest(t) for t in texts] == [m[0] for m in made]
    for (a, x, p), (b, y, q) in zip(made, made[1:], strict=False):
        points = sum(digest.POINTS[abs(i - j)] for i, j in zip(x, y, strict=True)) + min(digest.LENGTH_POINTS, abs(p[0] - q[0]))
        points += sum(min(digest.RATIO_POINTS, abs((p[1] >> s & 15) - (q[1] >> s & 15))) for s in (0, 4))
        assert digest.difference(a, b) == points <= digest.BOUND


def packet(pid, start, counter, payload, adaptation=b""):
    body = bytes([len(adaptation)]) + adaptation if adaptation else b""
    assert len(body) + len(payload) == 184
    return struct.pack(">BHB", 0x47, start << 14 | pid, (0x30 if adaptation else 0x10) | counter) + body + payload


def section(table, number, body):
    data = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    crc = 0xFFFFFFFF
    for byte in data:
        for k in range(8):
            bit = (crc >> 31 ^ byte >> (7 - k)) & 1
            crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if bit else 0)
    return (b"\0" + data + struct.pack(">I", crc)).ljust(184, b"\xff")


def by_hand():
    """A stream with tables on other PIDs than mux's, a null packet between, and one elementary stream in two PES."""
    pes = [b"\0\0\1\xe0" + struct.pack(">H", 0) + bytes([0x80, 0x80, 5]) + mpegts._timestamp(t) + body for t, body in ((90_000, b"A" * 300), (2**33 - 1, b"B" * 20))]
    first, rest = pes[0][:184], pes[0][184:]
    fill = lambda n: b"\0" + b"\xff" * (n - 1)
    return [
        packet(0, 1, 3, section(0, 7, struct.pack(">HH", 5, 0xE000 | 0x55))), packet(0x55, 1, 9, section(2, 5, struct.pack(">HHBHH", 0xE000 | 0x77, 0xF000, 0x1B, 0xE000 | 0x77, 0xF000))),
        packet(0x77, 1, 14, first), packet(0x1FFF, 0, 0, b"\xff" * 184), packet(0x77, 0, 15, rest, fill(183 - len(rest))),
        packet(0x77, 1, 0, pes[1], b"\x40" + b"\xff" * (182 - len(pes[1]))),
    ]


def test_a_stream_made_by_hand():
    got = mpegts.demux(b"".join(by_hand()))
    assert got.programs == {5: 0x55} and got.streams == {0x77: 0x1B} and got.payload == b"A" * 300 + b"B" * 20
    assert got.pts == [(0, 90_000), (300, 2**33 - 1)] and got.random_access == [5] and got.packets == 6
    assert (got.sync_errors, got.crc_errors, got.continuity_errors, got.pes_errors) == (0, 0, 0, 0)


def test_damage_is_counted():
    whole = by_hand()
    lost = mpegts.demux(b"".join(whole[:4] + whole[5:]))
    assert lost.continuity_errors == 1
    flipped = bytearray(b"".join(whole))
    flipped[12] ^= 1
    assert mpegts.demux(bytes(flipped)).crc_errors == 1 and mpegts.demux(b"".join(whole)[:-5]).sync_errors == 1
    rng = random.Random(3)
    for _ in range(200):
        noise = bytearray(b"".join(whole))
        for _ in range(rng.randint(1, 30)):
            noise[rng.randrange(len(noise))] = rng.randrange(256)
        mpegts.demux(bytes(noise))


def cut_in_packets(pid, data, size, counter=0):
    """A section, behind its pointer, in packets of size bytes of it each."""
    out = []
    for k, at in enumerate(range(0, len(data), size)):
        part = data[at : at + size]
        out.append(packet(pid, at == 0, counter + k, part, b"\0" + b"\xff" * (182 - len(part)) if len(part) < 184 else None))
    return out


def test_sections_of_many_packets_and_short_ones():
    whole = by_hand()
    streams = b"".join(struct.pack(">BHH", 6, 0xE000 | k, 0xF000) for k in range(0x200, 0x2B0)) + struct.pack(">BHH", 0x1B, 0xE000 | 0x77, 0xF000)
    table = section(2, 5, struct.pack(">HH", 0xE000 | 0x77, 0xF000) + streams).rstrip(b"\xff")
    got = mpegts.demux(b"".join([whole[0], *cut_in_packets(0x55, table, 100), *whole[2:]]))
    assert len(got.streams) == 177 and got.crc_errors == 0 and got.payload == b"A" * 300 + b"B" * 20
    lost = mpegts.demux(b"".join([whole[0], *cut_in_packets(0x55, table, 100)[:-1], *whole[2:]]))
    assert lost.streams == {} and lost.crc_errors == 1
    for n in range(4):
        short = mpegts.demux(b"".join([whole[0], packet(0x55, 1, 0, section(2, 5, b"\xe1\0\xf0"[:n])), *whole[2:]]))
        assert short.streams == {} and short.crc_errors == 1


def test_duplicates_and_announced_jumps():
    whole = by_hand()
    for k in range(6):
        got = mpegts.demux(b"".join([*whole[: k + 1], whole[k], *whole[k + 1 :]]))
        assert got.payload == b"A" * 300 + b"B" * 20 and got.continuity_errors == got.crc_errors == 0, k
    thrice = mpegts.demux(b"".join([*whole[:5], whole[4], whole[4], *whole[5:]]))
    assert thrice.continuity_errors == 1
    jump = bytearray(whole[5])
    jump[3] = jump[3] & 0xF0 | 9
    assert mpegts.demux(b"".join([*whole[:5], bytes(jump)])).continuity_errors == 1
    jump[5] |= 0x80
    assert mpegts.demux(b"".join([*whole[:5], bytes(jump)])).continuity_errors == 0
