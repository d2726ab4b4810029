"""Best-fit packing after Martello and Toth's dominance reduction.

Documents become token ids (word-level BPE, then an end id); only documents longer than a sequence are cut. What the
packing depends on is the number of pieces of each length, a table of at most `capacity` rows however large the
corpus is; it is all that the driver gets. The plan is made on that table, in bulk:

1. Reduction. For the longest open piece j, a set of at most three pieces that dominates every other set with j is
   fixed as a sequence for good: j alone if nothing fits beside it; j and k if they fill the sequence exactly, or
   if no two open pieces fit beside j and k is the longest that does; if no three fit, j and k if k is as long as
   any pair that fits, or j and the longest pair if one of it is k and no pair that fits has a longer lesser piece.
2. The remainder by best-fit decreasing. Only bins of the least sufficient rest can be chosen, so a run of equal
   pieces fills whole groups of equal bins in one step, exactly as one by one.

A plan is a list of patterns with counts. Pieces get their places by rank within their length: ranks are counted in
salted shares, so one frequent length is spread over many tasks.

Cases: null and empty texts are one end id; very long texts are cut in pieces; repeated rows and ids are packed row by
row; null ids pass through; an empty table gives none; other columns, of any name, are not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import materialise, ship_package

CAPACITY = 4096
END_ID = 1
#: Words kept with their ids in each worker.
CACHE_WORDS = 300_000
#: Rows of one length that one task ranks, about.
SHARE_ROWS = 100_000

# Fixed value: how the tokenizer file splits lower-cased text into words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


# Latin letters, general punctuation and currencies: all assigned, and classed alike by every version of Unicode.
_COMMON = re.compile("[^\x00-\u02ff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")


def _unassigned(first: int, last: int) -> re.Pattern:
    """Finds a code point between these that this Python's Unicode does not know; libraries may disagree on its class."""
    runs: list[list[int]] = []
    for c in range(first, last + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]")


class Unsure:
    """Whether a text has a code point that this Python's Unicode does not know. Usual texts cost one search of three ranges."""

    def __init__(self):
        self.plane = _unassigned(0x80, 0xFFFF).search  # a table; classes that reach beyond it are searched range by range
        self.beyond = re.compile("[\U00010000-\U0010ffff]").findall

    def __call__(self, text: str) -> bool:
        if not _COMMON.search(text):
            return False
        return bool(self.plane(text)) or any(unicodedata.category(c) == "Cn" for c in set(self.beyond(text)))


def default_tokenizer() -> str:
    """The installed vocabulary file; a path is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids of words as bytes; a word that is not there is asked for and kept. Full, it begins anew."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.model.tokenize(word if word.isascii() and word.isprintable() else self.to_bytes(word)[0][0])
        ids = self[word] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return ids


class WordTokenizer:
    """Ids of a text as little-endian bytes, by word, with the model asked once for each new word.

    The tokenizer normalises (NFC, lower case), splits in words and encodes each word by itself, so the ids of a text
    are those of its words. Texts for which that does not hold letter by letter (not in NFC; Σ and İ, whose
    lower case depends on the library; characters of special tokens; code points that the installed Unicode tables
    may class differently) go to the tokenizer whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex

        self.words = _Words(path, cache_words)
        self.split = regex.compile(_SPLIT).findall
        self.unsure = Unsure()

    def whole(self, text: str) -> bytes:
        """The tokenizer's own answer."""
        ids = self.words.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of text."""
        if not text.isascii() and ("Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text) or self.unsure(text)) or "<|" in text:
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))


_tokenizers: dict[str, WordTokenizer] = {}

_PIECES = "piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32, and ids (bytes) if they are kept."""
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        encode, end, step = _tokenizers[path].encode, struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                row, piece, length, crc, ids = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    packed = encode(text or "") + end
                    for k, at in enumerate(range(0, len(packed), step)):
                        own = packed[at : at + step]
                        row.append(i)
                        piece.append(k)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        ids.append(own if keep_ids else None)
                cols = [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array([k * capacity for k in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, {_PIECES}, ids binary")
    out = out.withColumnRenamed("id", id_col)
    return out if keep_ids else out.drop("ids")


class _Open:
    """Lengths that still have pieces, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)

    def take(self, n: int, k: int) -> None:
        self.counts[n] -= k
        if not self.counts[n]:
            del self.counts[n]
            self.lengths.pop(bisect.bisect_left(self.lengths, n))

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest pieces besides one of `without`."""
        out: list[int] = []
        for n in self.lengths:
            c = self.counts[n] - (n == without)
            out += [n] * min(c, k - len(out))
            if len(out) == k:
                break
        return out

    def longest(self, room: int, without: tuple[int, ...]) -> int:
        """The longest piece of at most room besides one of each of `without`, or 0."""
        i = bisect.bisect_right(self.lengths, room)
        while i:
            n = self.lengths[i - 1]
            if self.counts[n] > without.count(n):
                return n
            i -= 1
        return 0

    def best_pair(self, room: int, j: int) -> tuple[int, int]:
        """The two pieces that fill room best, besides one j; ties: the longer first piece. (0, 0) if none fit."""
        best = (0, 0)
        for a in reversed(self.lengths[: bisect.bisect_right(self.lengths, room)]):
            if 2 * a < sum(best):
                break
            if self.counts[a] <= (a == j):
                continue
            b = self.longest(min(a, room - a), (j, a))
            if b and a + b > sum(best):
                best = (a, b)
        return best


    def longest_lesser(self, room: int, j: int) -> int:
        """The longest piece that is the shorter one of a pair that fits, besides one j; 0 if there is none."""
        for i in range(bisect.bisect_right(self.lengths, room // 2) - 1, -1, -1):
            n = self.lengths[i]
            own = self.counts[n] - (n == j)
            if own > 1:
                return n
            for x in self.lengths[i + 1 : i + 3]:  # one of two longer lengths is not j's last
                if own and n + x <= room and self.counts[x] > (x == j):
                    return n
        return 0


def reduce_dominated(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that are in some best packing: (lengths, how many), and the counts that are left.

    Longest pieces first; a piece that no rule settles stays open and the next is tried, as in Martello and Toth's procedure.
    """
    todo, fixed = _Open(counts), []
    for j in sorted(todo.counts, reverse=True):
        while todo.counts.get(j):
            room = capacity - j
            k = todo.longest(room, (j,))
            if not k:
                pattern: tuple[int, ...] = (j,)
            elif k == room:
                pattern = (j, k)
            else:
                two = todo.smallest(2, j)
                three = todo.smallest(3, j)
                if len(two) < 2 or sum(two) > room:
                    pattern = (j, k)
                elif len(three) < 3 or sum(three) > room:
                    a, b = todo.best_pair(room, j)
                    if k >= a + b:
                        pattern = (j, k)
                    elif a == k and todo.longest_lesser(room, j) <= b:
                        pattern = (j, a, b)
                    else:
                        break
                else:
                    break
            # As pieces go, what made the pattern best stays true until one of its lengths is used up.
            need = Counter(pattern)
            many = min(todo.counts[n] // c for n, c in need.items())
            for n, c in need.items():
                todo.take(n, c * many)
            fixed.append((pattern, many))
    return fixed, todo.counts


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: (lengths of a sequence, how many of them)."""
    rests: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(rest: int, pattern: tuple[int, ...], n: int) -> None:
        if rest not in groups:
            groups[rest] = []
            bisect.insort(rests, rest)
        groups[rest].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rests, length)
            if i == len(rests):
                each = capacity // length
                full, more = divmod(left, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if more:
                    put(capacity - more * length, (length,) * more, 1)
                break
            rest = rests[i]
            pattern, n = groups[rest].pop()
            each = min(rest // length, left)
            use = min(n, left // each)
            if n > use:
                groups[rest].append((pattern, n - use))
            if not groups[rest]:
                del groups[rest]
                rests.pop(i)
            put(rest - each * length, pattern + (length,) * each, use)
            left -= each * use
    return [g for rest in rests for g in groups[rest]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """The whole packing of so many pieces of each length."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """Where the r-th piece of a length goes: a run of ranks for each pattern that holds the length."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        self.runs: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}  # first rank, first sequence, offsets
        used: Counter[int] = Counter()
        first = 0
        for pattern, n in patterns:
            offsets: dict[int, list[int]] = {}
            at = 0
            for length in pattern:
                offsets.setdefault(length, []).append(at)
                at += length
            for length, own in offsets.items():
                self.runs.setdefault(length, []).append((used[length], first, tuple(own)))
                used[length] += len(own) * n
            first += n
        self.sequences = first
        self.starts = {length: np.array([r[0] for r in runs]) for length, runs in self.runs.items()}

    def place(self, length: int, rank: int) -> tuple[int, int]:
        """Sequence and offset."""
        begin, first, offsets = self.runs[length][int(np.searchsorted(self.starts[length], rank, side="right")) - 1]
        q, r = divmod(rank - begin, len(offsets))
        return first + q, offsets[r]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a length) with sequence_id and offset. Read three times: give it a written table."""
    spark = pieces.sparkSession
    ship_package(spark)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))
    shares = max(8, -(-max(counts.values(), default=1) // SHARE_ROWS))
    order = [c for c in pieces.columns if c != "ids"]
    salted = pieces.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("_share").rowsBetween(W.unboundedPreceding, -1))
    offsets = salted.groupBy("length", "_share").agg(F.count("*").alias("n")).select("length", "_share", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("length", "_share").orderBy(*order))
    ranked = salted.withColumn("_within", within).join(offsets, ["length", "_share"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    ranked = ranked.select(*pieces.columns, "_rank")
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places.value.place
        for batch in batches:
            where = [place(n, r) for n, r in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            cols = [*batch.columns[:-1], pa.array([w[0] for w in where], pa.int64()), pa.array([w[1] for w in where], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*pieces_names, "sequence_id", "offset"])

    pieces_names = pieces.columns
    schema = pieces.limit(0).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    for f in schema.fields:
        f.nullable = True
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place."""
    pieces, _ = materialise(cut_pieces(docs, text_col, id_col, capacity, end_id, tokenizer, keep_ids), "pieces")
    return pack(pieces, capacity)
