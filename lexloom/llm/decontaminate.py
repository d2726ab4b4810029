"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against windows of training words.

A window is `n` consecutive words of an item; an item with fewer words, but not none, is one window. Candidate
windows are found by hash and verified word by word. The hash set is broadcast only while the benchmark has at
most `block_bytes` bytes of text; beyond it, the benchmark goes through in blocks of that size, one scan after the other,
and the hits of all blocks are merged, so memory does not grow with the benchmark.

Cases: null and empty texts have no words and are never contaminated; null item ids count as the string "";
repeated items and rows are kept apart by id only; texts of any length are scanned whole; an empty benchmark hits
nothing; drop_contaminated() and drop_spans() return docs' own columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textvec as tv
from lexloom.llm.rows import carried
from lexloom.session import materialise, remove, ship_package

N = 13
#: Bytes of benchmark text in one broadcast; its set takes about five times as much in each worker.
BLOCK_BYTES = 16 << 20
#: A document with at least this share of hit words is contaminated: 1 in 20.
SHARE = 20
_BITS = 22

HITS = "n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"


class NgramSet:
    """Windows of items: hashes by window length, sorted, beside the word each begins at; the items' words as one array of bytes.

    About 16 bytes a window and 8 a word, and the texts.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        self.n, self.ids = n, [i for i, _ in items]
        column = pa.array([t or "" for _, t in items], pa.large_string())
        _, data, bounds = next(iter(tv.text_slices(column, limit=1 << 62)), (0, np.zeros(1, np.uint8), np.zeros(1, np.int64)))
        self.low = tv.LOWER[data]
        starts, ends = tv.word_spans(self.low, tv.ALNUM)
        self.starts, self.ends, self.firsts = starts.astype(np.int32), ends.astype(np.int32), tv.words_per_text(starts, bounds)
        words, count = tv.word_hashes(self.low, starts, ends), np.diff(self.firsts)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(n, c) for c in count.tolist() if c}):
            h = tv.window_hashes(words, size)
            if size == n:
                at = np.arange(h.size)
                at = at[at + n <= self.firsts[np.searchsorted(self.firsts, at, side="right")]]
            else:
                at = self.firsts[:-1][count == size]
            order = np.argsort(h[at], kind="stable")
            h, at = h[at][order], at[order].astype(np.int32)
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[h >> np.uint64(64 - _BITS)] = True
            self.tables[size] = (h, at, np.packbits(bits))

    def items_of(self, size: int, hashed: np.uint64, words: bytes) -> list[str]:
        """Ids of the items in which these words, joined by blanks, are a window."""
        h, at, _ = self.tables[size]
        found = set()
        for k in at[np.searchsorted(h, hashed) : np.searchsorted(h, hashed, side="right")].tolist():
            if self._join(self.low, self.starts, self.ends, k, size) == words:
                found.add(self.ids[int(np.searchsorted(self.firsts, k, side="right")) - 1])
        return sorted(found)

    @staticmethod
    def _join(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, size: int) -> bytes:
        return b" ".join(low[a:b].tobytes() for a, b in zip(starts[first : first + size].tolist(), ends[first : first + size].tolist(), strict=True))

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: number of words, hit word spans (merged, end exclusive), items that occur."""
        low = tv.LOWER[data]
        starts, ends = tv.word_spans(low, tv.ALNUM)
        firsts = tv.words_per_text(starts, bounds)
        hashes = tv.word_hashes(low, starts, ends)
        hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for size, (known, _, bits) in self.tables.items():
            h = tv.window_hashes(hashes, size)
            slot = h >> np.uint64(64 - _BITS)
            maybe = np.flatnonzero(bits[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8) & 1)
            maybe = maybe[known[np.minimum(np.searchsorted(known, h[maybe]), known.size - 1)] == h[maybe]]
            verified: dict[bytes, list[str]] = {}  # of this slice
            for i, text in zip(maybe.tolist(), (np.searchsorted(firsts, maybe, side="right") - 1).tolist(), strict=True):
                if i + size > firsts[text + 1]:
                    continue  # it runs into the next text
                words = self._join(low, starts, ends, i, size)
                if words not in verified:
                    verified[words] = self.items_of(size, h[i], words)
                if items := verified[words]:
                    spans, seen = hits.setdefault(text, ([], set()))
                    at = i - int(firsts[text])
                    spans.append((at, at + size))
                    seen.update(items)
        out = []
        for text, count in enumerate(np.diff(firsts).tolist()):
            spans, seen = hits.get(text, ((), ()))
            out.append((count, merge_spans(spans), sorted(seen)))
        return out


def merge_spans(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of at most block_bytes bytes of text (one item at least)."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("b"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + r.b > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += r.b
    yield block


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column `hits`: words, merged spans of hit words, items that occur. An own column of that name is replaced.

    One scan and no shuffle for each block of the benchmark; a usual benchmark is one block. Where there are more, each
    scan's rows are written to the shared folder and its broadcast is freed before the next block is made.
    """
    spark = docs.sparkSession
    ship_package(spark)
    out = docs.drop("hits").withColumn("hits", F.lit(None).cast(f"struct<{HITS.replace(' long', ':long').replace(' array', ':array')}>"))
    held, old = None, None
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        if held is not None:
            out, path = materialise(out, "hits")
            held.destroy()
            if old:
                remove(spark, old)
            old = path
        held = spark.sparkContext.broadcast(NgramSet(block, n))
        out = _scan(out, text_col, held)
    return out


_HIT_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("item_ids", pa.list_(pa.string()))])


def _scan(docs: DataFrame, text_col: str, held) -> DataFrame:
    at, hits_at = docs.columns.index(text_col), len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        for batch in batches:
            found = []
            for _, data, bounds in tv.text_slices(batch.column(at)):
                found += grams.scan(data, bounds)
            rows = [{"n_words": c, "spans": [{"start": a, "end": b} for a, b in s], "item_ids": i} for c, s, i in found]
            for row, before in zip(rows, batch.column(hits_at).to_pylist(), strict=True):
                if before:
                    row["spans"] = [{"start": a, "end": b} for a, b in merge_spans([(x["start"], x["end"]) for x in (*before["spans"], *row["spans"])])]
                    row["item_ids"] = sorted({*before["item_ids"], *row["item_ids"]})
            cols = [*batch.columns[:-1], pa.array(rows, _HIT_TYPE)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def judge(hits: DataFrame, share: int = SHARE) -> DataFrame:
    """find_hits()'s rows with n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = hits.withColumns({"n_words": F.col("hits.n_words"), "n_hit": n_hit, "n_items": F.size("hits.item_ids").cast("long"), "items_sha256": F.sha2(F.array_join("hits.item_ids", ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).drop("hits")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns unchanged."""
    rows, back = carried(docs, text_col)
    return back(judge(find_hits(rows, items, block_bytes=block_bytes), share).where(~F.col("contaminated")))


def drop_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents, with the words that lie in a benchmark window taken out of their texts; other columns are unchanged."""
    rows, back = carried(docs, text_col)
    found = find_hits(rows, items, block_bytes=block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [remove_spans(t, [(x["start"], x["end"]) for x in h["spans"]]) for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return back(found.mapInArrow(run, rows.schema))


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the words of these spans and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode()
    data = np.frombuffer(raw + b" ", dtype=np.uint8)
    starts, ends = tv.word_spans(tv.LOWER[data], tv.ALNUM)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def digest_sha256(item_ids: list[str]) -> str:
    """items_sha256 of these ids."""
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
