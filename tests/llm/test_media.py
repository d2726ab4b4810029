import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    payload = media.pad(data)
    s = media.read_stream(media.write_stream(payload))
    assert s.ancillary == payload
    assert s.crc_bad == 0 and s.skipped == 0
    assert s.table == "Xing" and s.table_frames == len(s.offsets)
    assert s.seconds == len(s.offsets) * 1152 / 48000


def test_padding():
    assert len(media.pad(b"")) == 64 and len(media.pad(b"x" * 64)) == 64 and len(media.pad(b"x" * 65)) == 128


def test_resynchronises_and_counts_damage():
    stream = media.write_stream(media.pad(b"a" * 4000))
    whole = media.read_stream(stream)
    tag = stream.index(b"\xff\xfa")
    dirty = stream[:tag] + b"junk\xff\xfb" + stream[tag:]
    s = media.read_stream(dirty)
    assert s.skipped == 6 and len(s.offsets) == len(whole.offsets)
    cut = bytearray(stream)
    cut[whole.offsets[1] + 8] ^= 1  # in the side information
    assert media.read_stream(bytes(cut)).crc_bad == 1


def test_vbri_and_id3v1():
    h = bytes((0xFF, 0xFB, 0x94, 0xC0))
    size = media.parse_header(h).size
    frame = bytearray(h + bytes(size - 4))
    frame[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, size * 3, 2, 2, 1, 2, 1)
    frame[62:66] = struct.pack(">HH", size, size)
    s = media.read_stream(bytes(frame) + (h + bytes(size - 4)) * 2 + b"TAG" + bytes(125))
    assert s.table == "VBRI" and s.table_frames == 2 and s.toc == [0, size] and len(s.offsets) == 2 and "ID3v1" in s.tags


def test_nothing_to_read():
    assert media.read_stream(b"").seconds == 0 and media.read_stream(b"no audio").offsets == []


@pytest.mark.parametrize("text", [None, "", "é" * 40, "x" * 200_000, "\xff�"])
def test_query_rows(spark, text):
    df = spark.createDataFrame([(1, text, "clash"), (None, text, "clash")], "doc_id long, text string, n_bytes string")
    rows = media.encode_media(df).collect()
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
    for r in rows:
        assert r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert r.feature.startswith("ok;Xing")
    assert len({r.media_sha256 for r in rows}) == 1


def test_empty_table(spark):
    assert media.encode_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def loops(data):
    """Frames of an MPEG-1 Layer III stream of this writer, by a plain parse: (offset, size, samples) behind the tag."""
    size = 0
    for b in data[6:10]:
        size = size * 128 + b
    at, out = 10 + size, []
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    while at < len(data):
        assert data[at] == 0xFF and data[at + 1] == 0xFA and data[at + 2] & 0x0C == 4
        n = 144 * kbps[data[at + 2] >> 4] * 1000 // 48000 + (data[at + 2] >> 1 & 1)
        out.append((at, n))
        at += n
    assert at == len(data)
    return out


@pytest.mark.parametrize("n", [0, 1, 64, 936, 937, 938, 5000, 100_000])
def test_offsets_and_duration_are_the_plain_parse(n):
    payload = media.pad(bytes(k * 7 % 256 for k in range(n)))
    data = media.write_stream(payload)
    frames = loops(data)[1:]  # the first holds the table
    s = media.read_stream(data)
    assert s.offsets == [a for a, _ in frames] and s.seconds == len(frames) * 1152 / 48000
    assert b"".join(data[a + 23 : a + size] for a, size in frames)[: len(payload)] == payload == s.ancillary


def plain_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 ^ (0x8005 if (c >> 15 & 1) ^ b else 0)) & 0xFFFF
    return c


def as_bits(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


@pytest.mark.parametrize("layer,mode", [(1, 0xC0), (1, 0x00), (1, 0x50), (2, 0xC0), (2, 0x00), (2, 0x60)])
def test_checksums_of_other_layers(layer, mode):
    import random

    rng = random.Random(layer * 7 + mode)
    four = bytes((0xFF, 0xF8 | (4 - layer) << 1, 0xA4 if layer == 1 else 0xB4, mode))
    h = media.parse_header(four)
    assert h and h.layer == layer and h.protected
    body = bytes(rng.randrange(256) for _ in range(h.size - 6))
    channels, bound = (1 if mode == 0xC0 else 2), 4 * (mode >> 4 & 3) + 4 if mode >> 6 == 1 else 32
    widths = [4] * 32 if layer == 1 else [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 else 7)
    bits, at, used = as_bits(body), 0, 0
    for band, w in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            own = any(bits[at : at + w])
            used += own * (channels if band >= bound else 1)
            at += w
    at += 2 * used if layer == 2 else 0
    good = plain_crc(as_bits(four[2:]) + bits[:at])
    for crc, want in ((good, (2, 0)), (good ^ 1, (0, 2))):
        s = media.read_stream((four + crc.to_bytes(2) + body) * 2)
        assert (s.crc_good, s.crc_bad) == want


@pytest.mark.parametrize("major,flags,extra", [(2, 0, b""), (3, 0x40, (6).to_bytes(4) + bytes(6)), (4, 0x40, bytes((0, 0, 0, 6, 1, 0))), (3, 0x80, b"")])
def test_tags(major, flags, extra):
    name = b"TT2" if major == 2 else b"TIT2"
    value = b"\xff\x01abc"
    frame = name + (len(value).to_bytes(3) if major == 2 else len(value).to_bytes(4) + b"\0\0") + value
    body = extra + frame
    if flags & 0x80:
        body = body.replace(b"\xff", b"\xff\x00")
    data = b"ID3" + bytes((major, 0, flags)) + media._synchsafe(len(body)) + body
    s = media.read_stream(data + media.write_stream(bytes(64)))
    assert s.tags[name.decode()] == value and not s.skipped
