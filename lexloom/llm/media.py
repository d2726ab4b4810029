"""Media columns: MPEG audio streams.

`write_stream` lays bytes losslessly into an MPEG-1 Layer III stream: an ID3v2 tag, a Xing frame with the table
of a variable-bitrate stream, then silent frames (no Huffman data) that carry the bytes as ancillary data, each
protected by its CRC-16. `read_stream` does not rely on the writer: it skips tags, resynchronises on frame
headers, parses Xing/Info and VBRI tables, verifies checksums and returns exact durations and seek offsets.

Cases: null and empty texts give one padded frame; equal bytes, and so repeated rows, give equal streams; a very long
text is a long stream, held by one task as a row is; an empty table gives none; other columns are not read; a stream with garbage between
frames is resynchronised; a frame whose checksum fails is counted and kept; a stream with no frame gives zero
frames and duration 0. A payload byte that looks like a sync word is not taken for a frame, since the parser
steps from frame to frame and searches only after a header that does not parse.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.session import ship_package

# kbit/s by MPEG version (1 or 2) and layer, sampling rates by version bits.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

BLOCK = 64
TOC_ENTRIES = 100


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()
_crc_seen: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """MPEG's CRC-16 (polynomial 0x8005, all ones at first); short inputs repeat, so they are kept."""
    if (known := _crc_seen.get(data)) is not None:
        return known
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    if len(_crc_seen) < 4096:
        _crc_seen[data] = c
    return c


@dataclass(frozen=True)
class Header:
    """A frame header that parses."""

    version: int  # 1, 2 or 25 for MPEG 2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of side information, Layer III


_headers: dict[bytes, Header | None] = {}


def parse_header(four: bytes) -> Header | None:
    """The header in four bytes, or None: sync, and no reserved or free value."""
    if four in _headers:
        return _headers[four]
    found = _parse_header(four)
    if len(_headers) < 4096:
        _headers[four] = found
    return found


def _parse_header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    bits, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate_at, bitrate_at = four[2] >> 2 & 3, four[2] >> 4
    if bits == 1 or layer == 4 or rate_at == 3 or bitrate_at in (0, 15):
        return None
    version = 1 if bits == 3 else 2
    bitrate, rate = BITRATES[version, layer][bitrate_at] * 1000, RATES[bits][rate_at]
    padding, mono = four[2] >> 1 & 1, four[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version == 2 else 1152
    size = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(1 if bits == 3 else 2 if bits == 2 else 25, layer, not four[1] & 1, bitrate, rate, mono, size, samples, side)


def _ours(bitrate_at: int) -> bytes:
    """MPEG-1 Layer III, protected, 48 kHz, mono."""
    return bytes((0xFF, 0xFA, bitrate_at << 4 | 1 << 2, 0xC0))


#: Frame sizes we write, smallest first: (size, header bytes).
_SIZES = [(parse_header(h).size, h) for h in map(_ours, range(1, 15))]
_OVERHEAD = 4 + 2 + 17
_FRAME_HEADS = [h + struct.pack(">H", crc16(h[2:] + bytes(17))) + bytes(17) for _, h in _SIZES]
_ROOM = [s - _OVERHEAD for s, _ in _SIZES]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """The stream that carries payload; `read_stream(...).ancillary` gives it back."""
    frames, big = [], _ROOM[-1]
    whole = len(payload) // big
    head = _FRAME_HEADS[-1]
    for i in range(whole):
        frames.append(head + payload[i * big : (i + 1) * big])
    rest = payload[whole * big :]
    if rest or not frames:
        k = next(i for i, room in enumerate(_ROOM) if room >= len(rest))
        frames.append(_FRAME_HEADS[k] + rest.ljust(_ROOM[k], b"\0"))
    count, body = len(frames), sum(map(len, frames))
    xing_size, xing_header = _SIZES[4]
    total = body + xing_size
    at, starts = xing_size, []
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(min(255, starts[p * count // TOC_ENTRIES] * 256 // total) for p in range(TOC_ENTRIES))
    table = b"Xing" + struct.pack(">III", 7, count, total) + toc
    xing = (_FRAME_HEADS[4] + table).ljust(xing_size, b"\0")
    private = b"lexloom/payload-bytes\0" + struct.pack(">Q", len(payload))
    tag_frame = b"PRIV" + _synchsafe(len(private)) + b"\0\0" + private
    return b"ID3\x04\0\0" + _synchsafe(len(tag_frame)) + tag_frame + xing + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds. offsets: of each audio frame; the frame of a Xing or VBRI table is not audio."""

    tags: dict[str, bytes] = field(default_factory=dict)
    table: str = "none"
    table_frames: int = 0
    table_bytes: int = 0
    toc: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bitrates: set[int] = field(default_factory=set)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    ancillary: bytes = b""

    @property
    def seconds(self) -> float:
        """Exact duration: samples over the sampling rate."""
        return self.samples / self.rate if self.rate else 0.0

    def seek(self, seconds: float) -> int:
        """The byte at which the frame that plays at this time begins (the last frame's beyond the end)."""
        if not self.offsets or not self.rate:
            return 0
        per = self.samples // len(self.offsets)
        return self.offsets[max(0, min(len(self.offsets) - 1, int(seconds * self.rate) // per))]


def _synchsafe_int(raw: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))


def _tag(data: bytes, into: Stream) -> int:
    """Parses ID3v2 tags (2.2, 2.3, 2.4; extended headers, unsynchronisation, footers) at the beginning; where audio begins."""
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags = data[at + 3], data[at + 5]
        size = _synchsafe_int(data[at + 6 : at + 10])
        body = data[at + 10 : at + 10 + size]
        if flags & 0x80 and major < 4:  # a zero byte behind each 0xFF was put in
            body = body.replace(b"\xff\x00", b"\xff")
        p = 0
        if flags & 0x40 and major >= 3 and len(body) >= 4:
            p = _synchsafe_int(body[:4]) if major == 4 else int.from_bytes(body[:4]) + 4
        name, width, head = (3, 3, 6) if major == 2 else (4, 4, 10)
        while p + head <= len(body) and body[p] != 0:
            raw = body[p + name : p + name + width]
            n = _synchsafe_int(raw) if major == 4 else int.from_bytes(raw)
            if p + head + n > len(body):
                break
            value = body[p + head : p + head + n]
            if major == 4 and body[p + 9] & 0x02:
                value = value.replace(b"\xff\x00", b"\xff")
            into.tags.setdefault(body[p : p + name].decode("latin-1"), value)
            p += head + n
        at += 10 + size + (10 if flags & 0x10 else 0)
    return min(at, len(data))


def _bits(data: bytes, at: int, n: int) -> int:
    """n bits from bit `at` on."""
    whole = int.from_bytes(data[at // 8 : (at + n + 7) // 8])
    return whole >> -(at + n) % 8 & (1 << n) - 1


def _allocations(h: Header) -> list[int]:
    """Layer II: bits of each subband's allocation, by version, rate and bitrate of a channel."""
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.bitrate // 1000 // (1 if h.mono else 2)
    if each in (32, 48):
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 or each in (56, 64, 80) else 7)


def protected_part(frame: bytes, h: Header) -> tuple[bytes, int]:
    """What the checksum of a protected frame covers: bytes, and how many bits of them. Nothing for a frame cut short.

    Layer III: the header's second half and the side information. Layers I and II: the allocations as well, and for II the
    selections of scale factors.
    """
    head, body = frame[2:4], frame[6:]
    if h.layer == 3:
        return head + body[: h.side], 16 + 8 * h.side
    channels = 1 if h.mono else 2
    bound = 4 * (frame[3] >> 4 & 3) + 4 if frame[3] >> 6 == 1 else 32  # joint stereo shares the allocations above
    widths = [4] * 32 if h.layer == 1 else _allocations(h)
    at, used = 0, 0
    for band, width in enumerate(widths):
        own = channels if band < bound else 1
        if at + own * width > 8 * len(body):
            return b"", 0
        for _ in range(own):
            nonzero = _bits(body, at, width) > 0
            at += width
            used += nonzero * (channels if own == 1 and channels == 2 else 1)
    if h.layer == 2:
        at += 2 * used
    return head + body[: (at + 7) // 8], 16 + at


def crc16_bits(data: bytes, bits: int) -> int:
    """crc16() of the first so many bits."""
    c = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        bit = data[k // 8] >> 7 - k % 8 & 1
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ bit else 0)) & 0xFFFF
    return c


def _vbr(frame: bytes, h: Header, into: Stream) -> bool:
    """Whether the frame holds a Xing, Info or VBRI table, which is read."""
    at = 4 + (2 if h.protected else 0) + h.side
    if (kind := frame[at : at + 4]) in (b"Xing", b"Info"):
        flags = int.from_bytes(frame[at + 4 : at + 8])
        p = at + 8
        if flags & 1:
            into.table_frames, p = int.from_bytes(frame[p : p + 4]), p + 4
        if flags & 2:
            into.table_bytes, p = int.from_bytes(frame[p : p + 4]), p + 4
        if flags & 4:
            into.toc = [b * into.table_bytes // 256 for b in frame[p : p + TOC_ENTRIES]]
        into.table = kind.decode()
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        into.table = "VBRI"
        into.table_bytes, into.table_frames = int.from_bytes(frame[46:50]), int.from_bytes(frame[50:54])
        entries, scale, width = struct.unpack(">HHH", frame[54:60])
        at, into.toc = 0, []
        for i in range(entries):
            into.toc.append(at)
            at += int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale
        return True
    return False


def read_stream(data: bytes) -> Stream:
    """Parses a whole stream, frame by frame."""
    out, pieces = Stream(), []
    at, end = _tag(data, out), len(data)
    if data[end - 128 : end - 125] == b"TAG" and end - 128 >= at:
        out.tags["ID3v1"] = data[end - 128 :]
        end -= 128
    first, synced = True, False
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        if h is None or at + h.size > end or not (synced or at + h.size == end or parse_header(data[at + h.size : at + h.size + 4])):
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        frame = data[at : at + h.size]
        if h.protected and (covered := protected_part(frame, h))[1]:
            good = crc16_bits(*covered) == frame[4] << 8 | frame[5]
            out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
        if first and h.layer == 3 and _vbr(frame, h, out):
            out.rate = h.rate
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.rate = out.rate or h.rate
            out.bitrates.add(h.bitrate)
            if h.layer == 3:
                pieces.append(frame[4 + (2 if h.protected else 0) + h.side :])
        first = False
        at += h.size
    out.skipped += max(0, end - at)
    out.ancillary = b"".join(pieces)
    private = out.tags.get("PRIV", b"")
    if private.startswith(b"lexloom/payload-bytes\0"):
        out.ancillary = out.ancillary[: int.from_bytes(private[-8:])]
    return out


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def feature(s: Stream) -> str:
    """Shape of the stream and of the bytes it carries."""
    body = s.ancillary
    seek = ",".join(str(s.seek(s.seconds * q / 4)) for q in range(4))
    good = "ok" if not s.crc_bad and not s.skipped and s.table_frames == len(s.offsets) else "damaged"
    return f"{good};{s.table};frames={len(s.offsets)};samples={s.samples};rate={s.rate};kbps={'/'.join(str(b // 1000) for b in sorted(s.bitrates))};crc={s.crc_good};seek={seek};adler={zlib.adler32(body)}"


SCHEMA = "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, frame_offsets array<long>"


def encode_media(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """Adds a media column to (id, text): id and the columns of SCHEMA; media is null unless kept.

    One row in, one row out, no shuffle. Null ids pass through; null texts are empty ones.
    """
    ship_package(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [_row(t) for t in part.column(1).to_pylist()]
                cols = [part.column(0), *(pa.array([r[k] if k or keep_media else None for r in rows], t) for k, t in enumerate(_TYPES))]
                yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)


_NAMES = ["id", *(c.split()[0] for c in SCHEMA.split(", "))]
_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]


def _row(text: str | None) -> tuple:
    raw = (text or "").encode()
    media = write_stream(pad(raw))
    s = read_stream(media)
    body = s.ancillary
    return (media, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.seconds, s.offsets)
