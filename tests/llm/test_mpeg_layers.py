"""Layers, tables and tags that the writer does not make, and bytes that are no audio at all."""

from __future__ import annotations

import hashlib
import random
import struct

from weftgraph.llm import mpeg


def framed(header, bits, size):
    """A protected frame whose checksum covers the given bits."""
    value = int(bits, 2) if bits else 0
    crc = mpeg.crc_bits(value, len(bits), mpeg.crc_bits(int.from_bytes(header[2:4], "big"), 16))
    body = value << (-len(bits) % 8)
    return (header + crc.to_bytes(2, "big") + body.to_bytes((len(bits) + 7) // 8, "big")).ljust(size, b"\0")


def test_bitwise_checksum_equals_the_bytewise_one():
    for n in (1, 2, 19, 40):
        raw = random.Random(n).randbytes(n)
        assert mpeg.crc_bits(int.from_bytes(raw, "big"), 8 * n) == mpeg.crc16(raw)


def test_layer_one_and_two_checksums():
    # Layer I, 32 kbit/s, 32 kHz, mono: 48 bytes; 32 allocations of 4 bits.
    one = framed(bytes([0xFF, 0xFE, 0x18, 0xC0]), "0101" * 32, 48)
    s = mpeg.parse(one * 3)
    assert (s.layer, s.seek, s.checked, s.bad_checksums, s.samples) == (1, [0, 48, 96], 3, 0, 1152)
    assert mpeg.parse(one * 2 + one[:8] + b"\x77" + one[9:]).bad_checksums == 1
    assert mpeg.parse(one * 2 + one[:40] + b"\x77" + one[41:]).bad_checksums == 0  # not covered
    # Layer I joint stereo from subband 8: 16 + 24 allocations.
    joint = framed(bytes([0xFF, 0xFE, 0x28, 0x50]), "0011" * 40, 96)
    assert mpeg.parse(joint * 2).bad_checksums == 0
    # Layer II, 64 kbit/s, 48 kHz, mono: table a, 192 bytes; every second subband in use.
    widths = [4] * 11 + [3] * 12 + [2] * 4
    alloc = "".join(("1" if i % 2 else "0").rjust(w, "0") for i, w in enumerate(widths))
    two = framed(bytes([0xFF, 0xFC, 0x44, 0xC0]), alloc + "10" * sum(i % 2 for i in range(27)), 192)
    s = mpeg.parse(two * 2)
    assert (s.layer, s.checked, s.bad_checksums, s.samples) == (2, 2, 0, 2304)
    at = 6 + (len(alloc) + 7) // 8 + 1
    assert mpeg.parse(two + two[:at] + bytes([two[at] ^ 0x80]) + two[at + 1 :]).bad_checksums == 1


def test_vbri_table_and_free_bitrate():
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # 128 kbit/s, 44.1 kHz: 417 bytes
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4170, 10, 3, 2, 2, 4) + struct.pack(">HHH", 5, 6, 7)
    s = mpeg.parse((head + bytes(32) + table).ljust(417, b"\0") + head.ljust(417, b"\0"))
    assert s.table == (10, 4170, [10, 12, 14], None) and len(s.seek) == 2
    free = bytes([0xFF, 0xFB, 0x00, 0x00])
    s = mpeg.parse(free.ljust(500, b"\0") + bytes([0xFF, 0xFB, 0x02, 0x00]).ljust(501, b"\0") + free.ljust(500, b"\0"))
    assert s.seek == [0, 500, 1001] and s.samples == 3 * 1152 and s.skipped == 0


def test_bad_tags_and_random_bytes_raise_nothing():
    for stored in ("²", "9" * 5000, "-1", "x", ""):
        s = mpeg.parse(mpeg._tag({"payload": stored}) + mpeg.encode(b"abc")[40:])
        assert isinstance(s.payload, bytes)
    rng = random.Random(1)
    whole = mpeg.encode(rng.randbytes(3000), title="t")
    for i in range(300):
        raw = bytearray(whole)
        for _ in range(rng.randrange(1, 60)):
            raw[rng.randrange(len(raw))] = rng.choice([0xFF, 0xFB, rng.randrange(256)])
        mpeg.parse(bytes(raw[rng.randrange(200) : rng.randrange(1, len(raw))]))
        mpeg.parse(b"ID3" + rng.randbytes(60))
        mpeg.parse(b"\xff" + rng.randbytes(400).replace(b"\x00", b"\xff\xfb"))


def test_stored_form_matches_an_encoder_written_apart(spark):
    """media_bytes, media_sha256, duration and seek against a second, plain writer of the same form."""

    def head(kbits, index):
        raw = bytes([0xFF, 0xFA, index << 4 | 4, 0xC0])
        return raw + mpeg.crc16(raw[2:] + bytes(17)).to_bytes(2, "big") + bytes(17), 3 * kbits

    def write(payload, text_bytes):
        tags = b""
        for k, v in (("payload", str(len(payload))), ("bytes", str(text_bytes))):
            body = b"\x03" + k.encode() + b"\0" + v.encode()
            tags += b"TXXX" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + b"\0\0" + body
        out = b"ID3\x04\0\0" + bytes([0, 0, len(tags) >> 7, len(tags) & 127]) + tags
        kinds = [(32, 1), (40, 2), (48, 3), (56, 4), (64, 5), (80, 6), (96, 7), (112, 8), (128, 9), (160, 10), (192, 11), (224, 12), (256, 13), (320, 14)]
        frames, rest = [], payload
        while rest:
            kbits, index = next((k for k in kinds if 3 * k[0] - 23 >= len(rest)), kinds[-1])
            h, size = head(kbits, index)
            frames.append((h + rest[: size - 23]).ljust(size, b"\0"))
            rest = rest[size - 23 :]
        h, size = head(128, 9)
        sizes = [size] + [len(f) for f in frames]
        begins = [sum(sizes[:i]) for i in range(len(sizes))]
        toc = bytes(min(255, 256 * begins[p * len(sizes) // 100] // sum(sizes)) for p in range(100))
        first = (h + b"Xing" + struct.pack(">III", 15, len(sizes), sum(sizes)) + toc + struct.pack(">I", 100)).ljust(size, b"\0")
        return out + first + b"".join(frames), [len(out) + b for b in begins]

    texts = ["", None, "short", "é" * 700, "word " * 3000]
    rows = {r.doc_id: r for r in mpeg.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        media, seek = write(raw + bytes(-len(raw) % 64 if raw else 64), len(raw))
        r = rows[i]
        assert (r.media_bytes, r.media_sha256, r.seek, r.duration) == (len(media), hashlib.sha256(media).hexdigest(), seek, len(seek) * 1152 / 48000)
        assert r.feature.startswith(f"mpeg1-l3 rate=48000 ch=1 frames={len(seek)} samples={len(seek) * 1152} ") and f"crc={len(seek)}/{len(seek)} skipped=0" in r.feature
