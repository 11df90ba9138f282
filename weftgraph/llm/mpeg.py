"""MPEG audio in media columns: writes payload-bearing streams, and parses any stream.

``encode_media`` stores bytes in an MPEG-1 Layer III stream: an ID3v2 tag, a frame with a
variable-bitrate table (Xing), then frames whose side information is all zero (so they
decode to silence) and whose ancillary data are the payload. Each frame has its checksum.
``parse`` resynchronises on frame headers, reads ID3v1 and ID3v2 tags and the table (Xing,
Info or VBRI), verifies checksums of all three layers, measures frames of a free bitrate, and
finds the exact duration and the byte offset of every frame.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import STEP_BYTES, text_steps

# Fixed values of the MPEG audio header: kbit/s by (MPEG-1?, layer) and Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
# Bits of a Layer II subband's allocation, as (bits, subbands) runs, by table.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}

_SIDE = 17  # bytes of Layer III side information, MPEG-1 mono
_HEAD = 4 + 2 + _SIDE
#: Payload bytes of a 48 kHz mono frame by bitrate index: 144 * kbit/s * 1000 / 48000 bytes less the head.
ROOM = {i: 3 * k - _HEAD for i, k in enumerate(BITRATES[True, 3]) if k}


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005, starting from 0xFFFF, as MPEG audio has it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


_crc16 = functools.lru_cache(4096)(crc16)  # few different heads occur


@functools.cache
def _head(index: int) -> bytes:
    """Header, checksum and silent side information of a frame: MPEG-1 Layer III, 48 kHz, mono."""
    header = bytes([0xFF, 0xFA, index << 4 | 0x04, 0xC0])
    side = bytes(_SIDE)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(values: dict[str, str]) -> bytes:
    frames = b""
    for key, value in values.items():
        body = b"\x03" + key.encode() + b"\0" + value.encode()
        frames += b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _syncsafe(len(frames)) + frames


def encode(payload: bytes, **tags: str) -> bytes:
    """The stream that stores payload; tags are kept beside its length."""
    most = max(ROOM)
    whole, rest = divmod(len(payload), ROOM[most])
    frames = [_head(most) + payload[i * ROOM[most] : (i + 1) * ROOM[most]] for i in range(whole)]
    if rest:
        index = min(i for i, room in ROOM.items() if room >= rest)
        frames.append(_head(index) + payload[whole * ROOM[most] :].ljust(ROOM[index], b"\0"))
    body = b"".join(frames)
    table_at = 9  # 336 bytes: room for the table
    total = len(body) + ROOM[table_at] + _HEAD
    ends, at = [], ROOM[table_at] + _HEAD
    n = len(frames)
    for percent in range(100):  # frame at each hundredth of the time, as a 256th of the bytes
        k = percent * (n + 1) // 100
        ends.append(min(255, 256 * (at + (k - 1) * (ROOM[most] + _HEAD) if k else 0) // total))
    table = b"Xing" + struct.pack(">III", 0xF, n + 1, total) + bytes(ends) + struct.pack(">I", 100)
    first = _head(table_at) + table.ljust(ROOM[table_at], b"\0")
    return _tag({"payload": str(len(payload)), **tags}) + first + body


@dataclass
class Stream:
    """What parse finds in a media value."""

    version: str = ""
    layer: int = 0
    rate: int = 0
    channels: int = 0
    samples: int = 0
    seek: list[int] = field(default_factory=list)
    lowest: int = 0
    highest: int = 0
    bad_checksums: int = 0
    checked: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: tuple | None = None
    payload: bytes = b""


def header_at(data: bytes, at: int) -> tuple | None:
    """(size, samples, version bits, layer, protected, kbit/s, Hz, channels, side bytes) of a frame header, or None; size 0 if the bitrate is free."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    return _header(data[at + 1 : at + 4])


@functools.lru_cache(4096)
def _header(head: bytes) -> tuple | None:
    version, layer = head[0] >> 3 & 3, 4 - (head[0] >> 1 & 3)
    bits, speed = head[1] >> 4, head[1] >> 2 & 3
    if version == 1 or layer == 4 or bits == 15 or speed == 3:
        return None
    first = version == 3
    kbits, rate, pad = BITRATES[first, layer][bits], RATES[version][speed], head[1] >> 1 & 1
    channels = 1 if head[2] >> 6 == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * kbits * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + pad
    size = size if kbits else 0
    side = (17 if channels == 1 else 32) if first else (9 if channels == 1 else 17)
    return size, samples, version, layer, not head[0] & 1, kbits, rate, channels, side if layer == 3 else 0


def _read_tags(data: bytes, out: Stream) -> tuple[int, int]:
    """Reads ID3v2 at the front and ID3v1 at the end; the bounds of what is between."""
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        stop, p = min(end, at + 10 + size), at + 10
        while p + 10 <= stop and data[p] != 0:
            if data[at + 3] >= 4:
                n = sum((b & 0x7F) << s for b, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0), strict=True))
            else:
                n = int.from_bytes(data[p + 4 : p + 8], "big")
            key, body = data[p : p + 4].decode("latin-1"), data[p + 10 : min(stop, p + 10 + n)]
            if key[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
                name, _, value = text.partition("\0") if key == "TXXX" else (key, "", text)
                out.tags[name] = value
            p += 10 + n
        at = max(stop, at + 10)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            out.tags.setdefault(name, data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip())
    return at, end


def free_size(data: bytes, at: int, end: int) -> int:
    """Size without padding of a frame of free bitrate: the way to the next header that agrees with it; 0 if there is none.

    Such frames are no longer than 4608 bytes, so the search ends there.
    """
    same = bytes([data[at + 1], data[at + 2] & 0xFC])
    p = data.find(b"\xff" + same[:1], at + 4, min(end, at + 4 + 4608))
    while p >= 0:
        if p + 4 <= end and data[p + 2] & 0xFC == same[1]:
            return p - at - (data[at + 2] >> 1 & 1) * (4 if data[at + 1] >> 1 & 3 == 3 else 1)
        p = data.find(b"\xff" + same[:1], p + 1, min(end, at + 4 + 4608))
    return 0


class Bits:
    """Reads bits from the front of some bytes; past the end they are 0."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        self.left -= n
        return (self.value >> self.left if self.left >= 0 else self.value << -self.left) & ((1 << n) - 1)


def crc_bits(value: int, n: int, crc: int = 0xFFFF) -> int:
    """crc16 of the n bits of value."""
    for i in range(n - 1, -1, -1):
        crc = crc << 1 ^ (0x8005 if (crc >> 15) ^ (value >> i & 1) else 0)
        crc &= 0xFFFF
    return crc


def protected_bits(head: bytes, body: bytes, found: tuple) -> int:
    """How many bits after the checksum of a Layer I or II frame it covers: allocations, and in Layer II the scale factor selection."""
    _, _, version, layer, _, kbits, rate, channels, _ = found
    bound = 4 * (head[3] >> 4 & 3) + 4 if head[3] >> 6 == 1 else 32  # joint stereo shares the subbands from here
    if layer == 1:
        return 4 * 32 if channels == 1 else 4 * (2 * bound + 32 - bound)
    each = kbits // channels
    if version != 3:
        table = "low"
    elif kbits and each <= 48:
        table = "d" if rate == 32000 else "c"
    else:
        table = "a" if rate == 48000 or kbits and each <= 80 else "b"
    bits, used, total = Bits(body), 0, 0
    band = 0
    for width, count in ALLOCATION[table]:
        for _ in range(count):
            for _ in range(channels if band < bound else 1):
                total += width
                used += (bits.read(width) > 0) * (1 if channels == 1 or band < bound else 2)
            band += 1
    return total + 2 * used


def parse(data: bytes) -> Stream:
    """Parses a stream. Bytes that belong to no frame are skipped and counted.

    A header counts only if the next frame's header, the end or a tag follows where it says
    so, unless a frame has just ended where it stands. A stream that is cut in its last
    frame loses that frame. Whatever the bytes, nothing is raised.
    """
    out = Stream()
    at, end = _read_tags(data, out)
    kept: list[bytes] = []
    synced = False
    free: dict[bytes, int] = {}
    while at + 4 <= end:
        found = header_at(data, at)
        if found and not found[0]:  # a free bitrate is measured once
            kind = bytes([data[at + 1], data[at + 2] & 0xFC])
            if not free.get(kind):
                free[kind] = free_size(data, at, end)
            size = free[kind] + (data[at + 2] >> 1 & 1) * (4 if found[3] == 1 else 1)
            found = (size, *found[1:]) if free[kind] > 4 + 2 * found[4] + max(16, found[8]) else None  # room for the side information
        if found is None or at + found[0] > end or not synced and at + found[0] < end and header_at(data, at + found[0]) is None:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at, synced = step, False
            continue
        size, samples, version, layer, protected, kbits, rate, channels, side = found
        body = at + 4 + 2 * protected
        if not out.seek:
            out.version, out.layer, out.rate, out.channels = VERSIONS[version], layer, rate, channels
        if protected:
            out.checked += 1
            if layer == 3:
                crc = _crc16(data[at + 2 : at + 4] + data[body : body + side])
            else:
                n = protected_bits(data[at : at + 4], data[body : at + size], found)
                crc = crc_bits(Bits(data[body : body + 2 * 32]).read(n), n, crc_bits(int.from_bytes(data[at + 2 : at + 4], "big"), 16))
            out.bad_checksums += crc != int.from_bytes(data[at + 4 : at + 6], "big")
        start = body + side
        mark = data[start : start + 4]
        if not out.seek and layer == 3 and data[at + 36 : at + 40] == b"VBRI" and size >= 62:
            total, frames, entries, scale, width = struct.unpack_from(">IIHHH", data, at + 46)
            raw = data[at + 62 : min(at + size, at + 62 + entries * width)]
            steps = [scale * int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), max(1, width))] if 1 <= width <= 4 else []
            out.table = (frames, total, steps, None)
        elif not out.seek and mark in (b"Xing", b"Info") and start + 8 <= at + size:
            flags, p = struct.unpack_from(">I", data, start + 4)[0], start + 8
            values = []
            for bit, width in ((1, 4), (2, 4), (4, 100), (8, 4)):
                raw = data[p : p + width] if flags & bit else b""
                values.append(list(raw) if bit == 4 else int.from_bytes(raw, "big") if raw else None)
                p += width if flags & bit else 0
            out.table = tuple(values)
        else:
            out.lowest, out.highest = min(out.lowest or kbits, kbits), max(out.highest, kbits)
            kept.append(data[start : at + size])
        out.seek.append(at)
        out.samples += samples
        at += size
        synced = True
    out.skipped += max(0, end - at)
    raw = b"".join(kept)
    stored = out.tags.get("payload", "")
    out.payload = raw[: int(stored)] if stored.isascii() and stored.isdigit() and len(stored) < 19 else b""
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as UTF-8, with zero bytes up to a positive multiple of 64, stored in a stream.

    A null text counts as empty. Texts are stored whole; a step holds about STEP_BYTES of
    them, or one longer text. Repeated rows give repeated rows, and equal texts equal
    values; a null id stays null; other columns are not read; an empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_steps(batch.column(1)):
                media = []
                for text in texts:
                    n, raw = padded(text)
                    media.append(encode(raw, bytes=str(n)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(media, pa.binary())], names=["doc_id", "media"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, media binary")


_PARSED = (
    "doc_id long, media_bytes long, media_sha256 string, version string, layer int, rate int, channels int, samples long, seek array<long>, "
    "lowest int, highest int, checked long, bad_checksums long, skipped long, tags map<string,string>, payload_bytes long, payload_sha256 string, tail_crc32 long"
)


def parse_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per row of media: its size and digest, header fields, samples, seek offsets, checksums, tags and payload digests.

    A null media value counts as empty: no frames, no samples. Duration is exact:
    samples / rate seconds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        types += [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in _PARSED.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py() or b""
                s = parse(data)
                rows.append(
                    (key, len(data), hashlib.sha256(data).hexdigest(), s.version, s.layer, s.rate, s.channels, s.samples, s.seek, s.lowest, s.highest)
                    + (s.checked, s.bad_checksums, s.skipped, list(s.tags.items()), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]))
                )
                held += 32 * len(s.seek) + 500
                if held > STEP_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, _PARSED)


def digests(docs: DataFrame) -> DataFrame:
    """Stores all texts, reads them back from the stored bytes, and returns digests, a feature string, durations and seek offsets.

    duration is in seconds, samples / rate; seek has the byte offset of every frame in the stored form.
    """
    parsed = parse_media(encode_media(docs))
    feature = F.format_string(
        "mpeg%s-l%d rate=%d ch=%d frames=%d samples=%d kbps=%d-%d crc=%d/%d skipped=%d seek=%s",
        "version", "layer", "rate", "channels", F.size("seek"), "samples", "lowest", "highest", F.col("checked") - F.col("bad_checksums"), "checked", "skipped",
        F.lower(F.hex(F.crc32(F.array_join(F.col("seek").cast("array<string>"), ",").cast("binary")))),
    )
    return parsed.select(
        "doc_id", F.col("tags")["bytes"].cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"),
        (F.col("samples") / F.nullif("rate", F.lit(0))).alias("duration"), "seek",
    )


#: The payload's columns.
ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, raw || repeat('\x00'::BLOB, CASE WHEN octet_length(raw) = 0 THEN 64 ELSE (64 - octet_length(raw) % 64) % 64 END) AS payload FROM d)
SELECT doc_id, n AS n_bytes, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_sha256 FROM p
"""
