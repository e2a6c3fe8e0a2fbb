"""MPEG audio columns: bytes in Layer III frames, and a reader of any MPEG-1/2/2.5 Layer I-III stream.

`pack` stores bytes losslessly as the main data of valid Layer III frames whose side information
declares no coded samples (a decoder plays silence and passes over the bytes): an ID3v2 tag with the
byte count, a variable-bitrate header frame (frame count, byte count, 100-entry seek table), then CRC
protected frames at the highest bitrate, the last one at the lowest that fits. `parse` reads a stream
without trusting it: it reads tags (ID3v2.2 to 2.4 text frames, ID3v1, APE items), resynchronises on
frame headers (a header counts once the next one, a trailing tag or the end follows it), verifies the
checksums of all three layers, reads the variable-bitrate table (Xing, Info or VBRI, seek points
included), holds its counts and seek points against the frames found, and gives exact sample counts and
every frame's byte offset.

Map only; rows travel in bounded Arrow batches. Cases: a null or empty text is one 192-byte block of
spaces; equal texts give equal media and features; a null doc_id is kept; repeated rows each give
their row; an empty table gives no rows; a stream without frames parses to zero frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, texts

#: Bytes that the payload is padded to a multiple of.
BLOCK = 192

#: Format tables (fixed values of the MPEG audio standards): kbit/s by (MPEG-1?, layer), Hz by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Header(NamedTuple):
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    crc: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes; None where they are not one (free-format streams included)."""
    word = int.from_bytes(four, "big")
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bitrate, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    kbps, hz = BITRATES[version == 3, layer][bitrate - 1], RATES[version][rate]
    pad = word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    return Header(version, layer, not word >> 16 & 1, kbps, hz, word >> 6 & 3 == 3, size, samples)


@cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1 & 0xFFFF
        out.append(c)
    return out


@lru_cache(1024)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The frame checksum over the first `bits` bits (all by default): polynomial 0x8005, all ones at first."""
    c, table = 0xFFFF, _crc_table()
    whole = len(data) if bits is None else bits // 8
    for b in data[:whole]:
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b]
    for k in range(0 if bits is None else bits % 8):
        c = (c << 1 ^ 0x8005 * ((c >> 15) ^ (data[whole] >> 7 - k & 1))) & 0xFFFF
    return c


#: Widths of the bit allocation of Layer II by subband (fixed values of the standards): high and middle rates, low rates, MPEG-2.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10,
    "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def _allocation(h: Header) -> tuple[int, ...]:
    if h.version != 3:
        return ALLOCATION["lsf"]
    each = h.kbps if h.mono else h.kbps // 2
    if each <= 48:
        return ALLOCATION["d" if h.rate == 32000 else "c"]
    return ALLOCATION["a" if h.rate == 48000 or each <= 80 else "b"]


def protected_bits(h: Header, fourth: int, body: bytes) -> int:
    """How many bits after the checksum it covers. fourth: the header's last byte; body: what follows the checksum."""
    if h.layer == 3:
        return 8 * h.side
    channels, bound = 1 if h.mono else 2, ((fourth >> 4 & 3) + 1) * 4 if fourth >> 6 == 1 else 32
    widths = (4,) * 32 if h.layer == 1 else _allocation(h)
    word, size, at, used = int.from_bytes(body[:64], "big"), 8 * len(body[:64]), 0, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            value = word >> max(0, size - at - width) & (1 << width) - 1
            used += (value > 0) * (1 if band < bound else channels)
            at += width
    return at + (2 * used if h.layer == 2 else 0)  # Layer II: two bits of scale-factor selection for each channel in use


# ---------------------------------------------------------------- writing


@cache
def _frames() -> list[tuple[int, bytes]]:
    """(main-data bytes, header + CRC + side information) of each bitrate: MPEG-1 Layer III, 32 kHz, mono, protected."""
    out, side = [], bytes(17)
    for i, _ in enumerate(BITRATES[True, 3], 1):
        head = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | 0 << 16 | i << 12 | 2 << 10 | 3 << 6 | 4)
        crc = crc16(head[2:] + side)
        out.append((header(head).size - 23, head + struct.pack(">H", crc) + side))
    return out


def _tag(key: str, value: str) -> bytes:
    """An ID3v2.4 tag with one user text."""
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    sized = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    frame = b"TXXX" + sized(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + sized(len(frame)) + frame


def pack(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    kinds = _frames()
    most, full = kinds[-1]
    parts = []
    for at in range(0, len(payload), most):
        piece = payload[at : at + most]
        if len(piece) == most:
            parts.append(full + piece)
        else:
            room, head = next(x for x in kinds if x[0] >= len(piece))
            parts.append(head + piece + bytes(room - len(piece)))
    sizes = [len(x) for x in parts]
    info_size = 360
    total, ends = info_size + sum(sizes), [info_size]
    for s in sizes:
        ends.append(ends[-1] + s)
    toc = bytes(min(255, 256 * ends[len(sizes) * i // 100] // total) for i in range(100))
    head = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | 6 << 12 | 2 << 10 | 3 << 6 | 4)
    info = head + bytes(17) + b"Xing" + struct.pack(">III", 7, len(parts), total) + toc
    return _tag("payload_bytes", str(len(payload))) + info + bytes(info_size - len(info)) + b"".join(parts)


# ---------------------------------------------------------------- reading


class Stream(NamedTuple):
    """What a stream holds. offsets and sizes: of the audio frames, the variable-bitrate header frame not counted."""

    tags: dict[str, str]
    rate: int
    samples: int
    offsets: list[int]
    bodies: list[tuple[int, int]]  # main data of each frame: start and end
    crc_ok: int
    crc_bad: int
    skipped: int  # bytes that belong to no tag and no frame
    vbr: dict[str, object] | None
    kbps: dict[int, int]
    vbr_ok: bool | None  # whether the table's counts and seek points are those of the frames; None without a table


def _text(raw: bytes) -> list[str]:
    """The strings of an ID3v2 text frame, by its encoding byte."""
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 3, "utf-8")
    return raw[1:].decode(name, "replace").split("\0")


def _id3(buf: bytes, at: int) -> tuple[int, dict[str, str]]:
    """End of the ID3v2 tag at `at`, and its texts: text frames by their id, user texts by their description."""
    synchsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    version, flags = buf[at + 3], buf[at + 5]
    end, tags, p = min(len(buf), at + 10 + synchsafe(buf[at + 6 : at + 10])), {}, at + 10
    if flags & 64 and version > 2 and p + 4 <= end:  # extended header
        p += synchsafe(buf[p : p + 4]) if version == 4 else 4 + int.from_bytes(buf[p : p + 4], "big")
    name, head = (3, 6) if version == 2 else (4, 10)
    while p + head <= end and buf[p : p + name].isalnum():
        raw = buf[p + name : p + 2 * name]
        n = synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        key, body = buf[p : p + name].decode("latin-1"), buf[p + head : min(end, p + head + n)]
        if key[0] == "T" and body:
            parts = _text(body)
            if key in ("TXXX", "TXX"):
                key, parts = parts[0], parts[1:]
            tags[key] = "/".join(x.lstrip("\ufeff") for x in parts if x)
        p += head + n
    return min(len(buf), end + 10 * (version == 4 and bool(flags & 16))), tags


def _id3v1(raw: bytes) -> dict[str, str]:
    """The fields of the 128 bytes of an ID3v1 tag."""
    fields = {"title": raw[3:33], "artist": raw[33:63], "album": raw[63:93], "year": raw[93:97], "comment": raw[97:127]}
    out = {}
    if raw[125] == 0 and raw[126]:
        fields["comment"], out["track"] = raw[97:125], str(raw[126])
    out |= {k: v.split(b"\0")[0].decode("latin-1").rstrip() for k, v in fields.items()}
    return {k: v for k, v in out.items() if v} | {"genre": str(raw[127])}


def _ape(buf: bytes, at: int) -> tuple[int, dict[str, str]]:
    """End of the APE tag whose header or footer is at `at`, and its text items."""
    size, count, flags = struct.unpack_from("<III", buf, at + 12)
    if not flags & 1 << 29:  # a footer alone
        return at + 32, {}
    end, tags, p = min(len(buf), at + 32 + size), {}, at + 32
    for _ in range(min(count, 65536)):
        if p + 8 > end or (stop := buf.find(b"\0", p + 8, end)) < 0:
            break
        n, kind = struct.unpack_from("<II", buf, p)
        if kind >> 1 & 3 == 0:
            tags[buf[p + 8 : stop].decode("latin-1")] = buf[stop + 1 : min(end, stop + 1 + n)].decode("utf-8", "replace")
        p = stop + 1 + n
    return end, tags


def _vbr(buf: bytes, at: int, h: Header) -> dict[str, object] | None:
    """The Xing, Info or VBRI table of the frame at `at`, if it has one; points: (share of the frames, share of the bytes or byte offset)."""
    p = at + 4 + h.side
    if buf[p : p + 4] in (b"Xing", b"Info"):
        flags, out, q = int.from_bytes(buf[p + 4 : p + 8], "big"), {"kind": buf[p : p + 4].decode()}, p + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], q = int.from_bytes(buf[q : q + 4], "big"), q + 4
        if flags & 4:
            out["toc"] = buf[q : q + 100]
        return out
    if buf[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(buf):
        size, frames, entries, scale, width, step = struct.unpack_from(">IIHHHH", buf, at + 46)
        cells = buf[at + 62 : min(at + h.size, at + 62 + entries * width)]
        steps = [int.from_bytes(cells[i : i + width], "big") * scale for i in range(0, len(cells) - width + 1, width)] if width else []
        return {"kind": "VBRI", "bytes": size, "frames": frames, "step": step, "steps": steps}
    return None


def _vbr_ok(vbr: dict[str, object], at: int, end: int, offsets: list[int], ends: int) -> bool:
    """Whether the table's counts and seek points are those of the frames. at, end: of the table's own frame; ends: where the last frame ends."""
    if vbr.get("frames", len(offsets)) != len(offsets) or vbr.get("bytes", ends - at) not in (ends - at, ends - end):
        return False
    if toc := vbr.get("toc"):
        whole, n = ends - at, len(offsets)
        places = [*offsets, ends]
        return len(toc) == 100 and all(abs(t - min(255, 256 * (places[n * i // 100] - at) // whole)) <= 1 for i, t in enumerate(toc))
    if steps := vbr.get("steps"):
        places, step, reached = [*offsets, ends], vbr["step"], end
        for i, size in enumerate(steps):
            reached += size
            if abs(reached - places[min((i + 1) * step, len(offsets))]) > max(1, size // 8):
                return False
    return True


def parse(buf: bytes) -> Stream:
    """Read a stream; damage costs the frames it hits and no others."""
    tags, offsets, bodies, kbps = {}, [], [], {}
    at = skipped = ok = bad = samples = rate = last = 0
    vbr, place, end, first = None, (0, 0), len(buf), True
    while at + 4 <= end:
        if buf[at : at + 3] == b"ID3" and at + 10 <= end:
            at, more = _id3(buf, at)
            tags |= more
            continue
        if at == end - 128 and buf[at : at + 3] == b"TAG":
            tags, at = _id3v1(buf[at:]) | tags, end
            continue
        if buf[at : at + 8] == b"APETAGEX" and at + 32 <= end:
            at, more = _ape(buf, at)
            tags |= more
            continue
        h = header(buf[at : at + 4])
        after = at + h.size if h else 0
        follows = after == end or (n := header(buf[after : after + 4])) and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate) if h and after <= end else False
        if not h or after > end or not (follows or buf[after : after + 3] == b"ID3" or buf[after : after + 8] == b"APETAGEX" or after == end - 128 and buf[after : after + 3] == b"TAG"):
            marks = [x for x in (buf.find(b"\xff", at + 1, end), buf.find(b"ID3", at + 1, end), buf.find(b"APETAGEX", at + 1, end)) if x >= 0]
            if end - 128 > at and buf[end - 128 : end - 125] == b"TAG":
                marks.append(end - 128)
            go = min(marks, default=end)
            skipped, at = skipped + go - at, go
            continue
        if first and (vbr := _vbr(buf, at, h)):
            first, place, at = False, (at, after), after
            continue
        first = False
        body = at + 4 + 2 * h.crc + h.side
        if h.crc:
            behind = buf[at + 6 : min(after, at + 70)]
            bits = protected_bits(h, buf[at + 3], behind)
            good = crc16(buf[at + 2 : at + 4] + behind[: -(-bits // 8)], 16 + bits) == int.from_bytes(buf[at + 4 : at + 6], "big")
            ok, bad = ok + good, bad + (not good)
        offsets.append(at)
        bodies.append((body, after))
        kbps[h.kbps] = kbps.get(h.kbps, 0) + 1
        samples, rate, at, last = samples + h.samples, h.rate, after, after
    right = None if vbr is None else _vbr_ok(vbr, *place, offsets, last or place[1])
    return Stream(tags, rate, samples, offsets, bodies, ok, bad, skipped + max(0, end - at), vbr, kbps, right)


def unpack(buf: bytes) -> tuple[bytes, Stream]:
    """The payload that `pack` stored, and the stream it was read from."""
    s = parse(buf)
    return b"".join(buf[a:b] for a, b in s.bodies)[: int(s.tags.get("payload_bytes", "0"))], s


def feature(s: Stream) -> str:
    """Exact duration (samples over rate), frame counts by bitrate, checksums, and the seek table, in one line."""
    seek = zlib.crc32(struct.pack(f"<{len(s.offsets)}Q", *s.offsets))
    vbr = "none" if s.vbr is None else f"{s.vbr['kind']}:{s.vbr.get('frames', '-')}:{s.vbr.get('bytes', '-')}:{'ok' if s.vbr_ok else 'bad'}"
    return (
        f"samples={s.samples};rate={s.rate};frames={len(s.offsets)};kbps={'+'.join(f'{n}x{k}' for k, n in sorted(s.kbps.items()))};"
        f"crc_ok={s.crc_ok};crc_bad={s.crc_bad};skipped={s.skipped};vbr={vbr};first={s.offsets[0] if s.offsets else -1};seek_crc={seek}"
    )


def padded(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


# ---------------------------------------------------------------- operators

MEDIA = "doc_id long, n_bytes long, media binary"
INDEX = "doc_id long, samples long, rate int, duration_us long, frame_offsets array<long>, crc_ok long, crc_bad long, skipped long, vbr string, vbr_ok boolean, tags map<string,string>, feature string"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [x.split(" ", 1) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _raw(b: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    yield from zip(b.column(0).to_pylist(), (x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()), strict=True)


def encode(docs: DataFrame) -> DataFrame:
    """Each text as a media column: doc_id, n_bytes, media."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield _table([(i, len(x), pack(padded(x))) for i, x in _raw(b)], MEDIA)

    return texts(docs).mapInArrow(run, MEDIA)


def duration_us(s: Stream) -> int:
    return s.samples * 1_000_000 // s.rate if s.rate else 0


def index(media: DataFrame) -> DataFrame:
    """Durations, checks, tags and frame seek offsets of a column `media` (null: no frames)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = parse(m or b"")
                rows.append((i, s.samples, s.rate, duration_us(s), s.offsets, s.crc_ok, s.crc_bad, s.skipped, str(s.vbr["kind"]) if s.vbr else None, s.vbr_ok, list(s.tags.items()), feature(s)))
            yield _table(rows, INDEX)

    return media.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(media AS BINARY) AS media").mapInArrow(run, INDEX)


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes say once read back, in digest form."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = []
            for i, n, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p, s = unpack(m)
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(s), duration_us(s)))
            yield _table(rows, DIGEST)

    return media.mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
