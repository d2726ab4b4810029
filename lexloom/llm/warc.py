"""WARC archives: a writer through Spark's committed text writer and a splittable reader.

Writer: one gzip member a record. Records with equal payloads of at least MIN_REVISIT bytes are one response (the
smallest page id) and revisits of it. Members go through the `text` sink, so they reach any store Spark writes
to, and a lost task is repeated and committed like any other. That sink ends each row with a separator of a byte
at least; a member's last byte is the top byte of its length, zero below 16 MiB, so it is left to the separator
(longer records are followed by an empty member, whose last byte is zero).

Reader: Spark's line reader with the gzip magic as separator. Each task scans its byte range for the magic and owns
the records that begin there, reading on beyond the range to the next magic. A candidate counts only if its gzip
header, its deflate stream with checksum, its WARC version line and its Content-Length hold. A magic inside
compressed data cuts a member in pieces: pieces are joined until they decode; those of a member cut at a range's end,
or in more than PIECE_LIMIT pieces, are completed by file in a second step, which has no limit. No record is lost in
silence: bytes that make no record there (a damaged or cut-off archive) raise an error.

Cases: a null or empty payload is a response of 0 bytes; a null page id is an empty header and read as null; a null
url has no target header; repeated rows with the smallest id are all responses; an empty table gives no records;
very long payloads are one record each; other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import materialise, scratch_path, ship_package

MIN_REVISIT = 100
MAGIC = b"\x1f\x8b\x08"
_LATIN = "ISO-8859-1"
_VERSION = b"WARC/1.1\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pieces of one member that a range holds before it leaves them to the second step.
PIECE_LIMIT = 64


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


_EMPTY = _gzip(b"", 1)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A record's bytes: a response if it has a payload, else a revisit."""
    name = "" if page_id is None else str(page_id)
    if payload is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        kind, extra = "response", ""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        kind, extra = "revisit", f"WARC-Refers-To: <urn:lexloom:page:{refers_to}>\r\nWARC-Profile: {_REVISIT_PROFILE}\r\n"
    target = "" if url is None else "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A") + "\r\n"
    head = (
        f"WARC-Type: {kind}\r\nWARC-Record-ID: <urn:lexloom:page:{name}>\r\n{target}{extra}WARC-Payload-Digest: sha256:{digest}\r\n"
        f"X-Payload-Length: {size}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return _VERSION + head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One record as gzip, without the zero byte at the end that the sink adds."""
    packed = _gzip(data, level)
    return packed[:-1] if packed[-1] == 0 else packed + _EMPTY[:-1]


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to); a revisit has no payload.

    Payloads are grouped by digest with partial sums; only groups of two or more are joined back, by a plain join that Spark can split where one payload is frequent.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    groups = base.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = base.join(groups.hint("shuffle_hash"), "payload_digest", "left")  # no sort of the pages: their rows are large
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return out.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def write_archives(records: DataFrame, path: str, level: int = 6) -> str:
    """Writes plan_records()'s rows as archives, one a task; returns the path."""
    ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                rows = batch.slice(first, 128).to_pylist()
                out = [member(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["payload_bytes"], r["refers_to"]), level) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    packed = records.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to").mapInArrow(run, "member binary")
    packed.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    return path


class Incomplete(Exception):
    """The deflate stream needs more bytes."""


def decode(data: bytes) -> dict | None:
    """The record of one member, None for an empty member; ValueError unless valid, Incomplete if cut off."""
    if len(data) < 10:
        raise Incomplete
    if data[:3] != MAGIC or data[3] & 0xE0:
        raise ValueError("not a gzip header")
    d = zlib.decompressobj(31)
    try:
        raw = d.decompress(data)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if not d.eof:
        raise Incomplete
    if d.unused_data:
        raise ValueError("bytes behind the member")
    if not raw:
        return None
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    if len(block) != int(head["Content-Length"]) or raw[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("Content-Length does not hold")
    return {"head": head, "block": block}


def _row(found: dict) -> dict:
    """The columns of READ of a record; the payload's digest and length are computed where the record has it."""
    head, block = found["head"], found["block"]
    body = block[block.find(b"\r\n\r\n") + 4 :]
    response = head["WARC-Type"] == "response"
    name = head["WARC-Record-ID"].removeprefix("<urn:lexloom:page:").removesuffix(">")
    refers = head.get("WARC-Refers-To", "").removeprefix("<urn:lexloom:page:").removesuffix(">")
    told = head["WARC-Payload-Digest"].removeprefix("sha256:")
    digest = hashlib.sha256(body).hexdigest() if response else told
    return {
        "page_id": int(name) if name else None, "url": head.get("WARC-Target-URI"), "payload_bytes": len(body) if response else int(head["X-Payload-Length"]),
        "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(refers) if refers else None, "payload": body if response else None, "intact": digest == told,
    }


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean"
_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())]
_EDGE = "file string, block long, seq long, piece binary"
_EDGE_FIELDS = [("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("piece", pa.binary())]


class _Range:
    """The pieces of one byte range, in order: whole records, and what is left for the neighbours."""

    def __init__(self, file: str, block: int, with_payload: bool = True, limit: int = PIECE_LIMIT):
        self.file, self.block, self.seq, self.with_payload, self.limit = file, block, 0, with_payload, limit
        self.pending: list[bytes] = []
        self.edges: list[dict] = []

    def _edge(self, piece: bytes) -> None:
        self.edges.append({"file": self.file, "block": self.block, "seq": self.seq, "piece": piece})
        self.seq += 1

    def add(self, piece: bytes) -> list[dict]:
        """Rows of the records that this piece completes."""
        if self.pending:
            joined = b"".join([*self.pending, piece])
            try:
                found = decode(joined)
                self.pending = []
                return self._rows(found)
            except Incomplete:
                pass
            except ValueError:
                pass
        try:
            found = decode(piece)
        except Incomplete:
            self.pending.append(piece)
            return []
        except ValueError:
            if self.pending:
                self.pending.append(piece)
                if len(self.pending) > self.limit:
                    for x in self.pending:
                        self._edge(x)
                    self.pending = []
            else:
                self._edge(piece)
            return []
        for x in self.pending:
            self._edge(x)
        self.pending = []
        return self._rows(found)

    def _rows(self, found: dict | None) -> list[dict]:
        row = _row(found) if found else None
        if row and not self.with_payload:
            row["payload"] = None
        return [row] if row else []

    def close(self) -> list[dict]:
        for x in self.pending:
            self._edge(x)
        self.pending = []
        return self.edges


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under path: the columns of READ.

    One task a byte range (spark.sql.files.maxPartitionBytes). Pieces that no range could complete alone, a few in
    16 million bytes at most, are put together by file in a second step.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", _LATIN).text(path)
    raw = lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            rows, edges = [], []
            for piece, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or (at.file, at.block) != (file, block):
                    edges += at.close() if at else []
                    at = _Range(file, block, with_payload)
                if piece:  # what stands before the first magic of a file
                    rows += at.add(MAGIC + piece)
            edges += at.edges if at else []
            if at:
                at.edges = []
            yield _batch(rows, edges)
        if at:
            yield _batch([], at.close())

    both, _ = materialise(raw.mapInArrow(run, f"{READ}, {_EDGE}"), "records")  # read twice below, decoded once
    whole = both.where("file IS NULL").select(*(n for n, _ in _FIELDS))
    rest = both.where("file IS NOT NULL").select("file", "block", "seq", "piece")

    def put_together(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(stitch(table.to_pylist(), with_payload), pa.schema(_FIELDS))

    return whole.unionByName(rest.groupBy("file").applyInArrow(put_together, READ))


def stitch(edges: list[dict], with_payload: bool = True) -> list[dict]:
    """Rows of the records in a file's edges; ValueError if pieces are left over, since a record would be missing.

    The pieces of a member go through one decompressor, so many of them cost no more than few. A member ends where its
    stream does; what begins with the magic inside a stream is no member.
    """
    rows, pieces = [], [r["piece"] for r in sorted(edges, key=lambda r: (r["block"], r["seq"]))]
    at = 0
    while at < len(pieces):
        unzip, end = zlib.decompressobj(31), at
        try:
            while end < len(pieces) and not unzip.eof:
                unzip.decompress(pieces[end])
                end += 1
        except zlib.error as e:
            raise ValueError(f"a damaged member in an archive: {e}") from e
        if not unzip.eof or unzip.unused_data:
            raise ValueError("an archive ends inside a member" if not unzip.eof else "bytes behind a member")
        found = decode(b"".join(pieces[at:end]))
        if found:
            row = _row(found)
            rows.append(row if with_payload else row | {"payload": None})
        at = end
    return rows


def _batch(rows: list[dict], edges: list[dict]) -> pa.RecordBatch:
    every = rows + edges
    return pa.RecordBatch.from_pylist([{n: None for n, _ in (*_FIELDS, *_EDGE_FIELDS)} | r for r in every], pa.schema([*_FIELDS, *_EDGE_FIELDS]))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to the shared folder and reads them back, without payloads."""
    spark = pages.sparkSession
    path = write_archives(plan_records(pages), scratch_path(spark, "archives"))
    return read_archives(spark, path, with_payload=False).drop("payload")
