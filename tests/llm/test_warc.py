import glob
import gzip
import hashlib
import random

import pytest

from lexloom.llm import warc


def expected(pages):
    first = {}
    for i, _, h in pages:
        d = (h or "").encode()
        if len(d) >= 100 and i is not None:
            first[d] = min(first.get(d, i), i)
    out = []
    for i, _, h in pages:
        d = (h or "").encode()
        kind = "revisit" if d in first and sum((x or "").encode() == d for _, _, x in pages) > 1 and first[d] != i else "response"
        out.append((i, len(d), hashlib.sha256(d).hexdigest(), kind, first[d] if kind == "revisit" else None))
    return sorted(out, key=str)


def run(spark, rows, block=None):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = warc.round_trip(df.drop("payload") if not rows else df).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.intact for r in got)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


def test_cases(spark):
    x, y = "x" * 100, "é" * 60
    rows = [(5, "u", x), (3, None, x), (9, "u\r\nv", x), (3, None, x), (1, "u", None), (2, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", y), (8, "u", y), (None, "u", y), (10, "u", "z" * 3_000_000)]
    rng = random.Random(1)
    rows += [(100 + k, "u", "".join(chr(rng.randrange(32, 3000)) for _ in range(rng.randrange(4000)))) for k in range(300)]
    assert run(spark, [(*r, "clash") for r in rows]) == expected(rows)
    assert run(spark, [(*r, "clash") for r in rows], "20k") == expected(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_archives_are_gzip(spark):
    df = spark.createDataFrame([(1, "u", "a" * 500), (2, "u", "b")], "page_id long, url string, html string")
    path = warc.write_archives(warc.plan_records(df), warc.scratch_path(spark, "a"))
    raw = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part*"))
    assert raw.count(b"WARC/1.1\r\n") == 2


@pytest.mark.parametrize("cut", [1, 7, 40])
def test_magic_inside_a_member(cut):
    whole = [warc._gzip(warc.record(k, None, bytes([k]) * 50, hashlib.sha256(bytes([k]) * 50).hexdigest(), 50, None), 6) for k in range(3)]
    torn = [whole[0], warc.MAGIC + whole[1][3:cut + 20], whole[1][cut + 20 :], whole[2]]
    at = warc._Range("f", 0)
    rows = [r["page_id"] for piece in torn for r in at.add(piece)]
    assert rows == [0, 1, 2] and at.close() == []
    head, tail = warc._Range("f", 0), warc._Range("f", 9)
    assert [r["page_id"] for p in torn[:2] for r in head.add(p)] == [0]
    assert [r["page_id"] for p in torn[2:] for r in tail.add(p)] == [2]
    last = warc._Range("f", 0)
    assert [r["page_id"] for e in head.close() + tail.close() for r in last.add(e["piece"])] == [1]


def test_long_record_keeps_its_last_byte():
    data = b"a" * (17 << 20)
    packed = warc.member(data, 1) + b"\0"
    assert gzip.decompress(packed) == data


def many_pieces(n):
    """A member whose compressed bytes hold the magic n times: a stored block of them."""
    import zlib

    page = (warc.MAGIC + b"abc") * n
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = c.compress(warc.record(7, None, page, hashlib.sha256(page).hexdigest(), len(page), None)) + c.flush()
    return page, [warc.MAGIC + x for x in raw.split(warc.MAGIC)[1:]]


@pytest.mark.parametrize("n", [3, 63, 64, 200])
def test_a_member_of_many_pieces(n):
    page, pieces = many_pieces(n)
    assert len(pieces) == n + 1
    at = warc._Range("f", 0)
    rows = [r for p in pieces for r in at.add(p)]
    rows += warc.stitch(at.close())
    assert [(r["page_id"], r["payload"]) for r in rows] == [(7, page)]


def test_left_over_bytes_are_an_error():
    _, pieces = many_pieces(100)
    edges = [{"block": 0, "seq": k, "piece": p} for k, p in enumerate(pieces[:-1])]
    with pytest.raises(ValueError):
        warc.stitch(edges)
