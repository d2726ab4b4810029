"""N-gram Jaccard join: documents x n-grams as a sparse matrix, multiplied block by block.

Two documents link when the Jaccard similarity of their sets of word n-grams is at least 3/4. The result is each
document's component under all links; nothing is approximate but hashes of 53 bits or more standing for n-grams.

1. Incidence blocks. One scan turns texts into sets of n-gram hashes. A chunk of texts sends each column block (a
   range of hashes) one packed list of entries. A column block drops columns with one entry, which add to no
   overlap, and sends the rest back. A row that keeps fewer than 3/4 of its entries can reach no pair's bound:
   it is done. Equal texts are one row from here, and the same step runs again on the rows left, now counting.
2. Candidates. Of a row's entries, rarest first, the first n - ceil(3n/4) + 1 must meet those of any partner. Those
   with one entry meet nothing, so only the remainder of this prefix becomes a bucket entry.
3. Products with a pivot. Each bucket's most typical row (fewest lone entries) is its pivot; the overlap of each
   row with its pivots is counted exactly. Pairs at the bound are links; components of these links follow.
4. Remaining pairs. In one bucket but two components, a pair's overlap has two parts. Inside the pivot it is at most
   the pivot's size less what either misses of it; outside, at most what either has there less what the other
   lacks. Both are bounded by 256-bit signatures: a set bit of one side only is an entry at least. Only
   pairs for which the sum reaches the bound 3/7 of both sizes are counted, exactly.

Cases: a document with fewer words than n has its whole sequence as one n-gram; null, empty and blank texts have
none and link with nothing; very long texts are slices of their own; rows with a null id get their size and a null
component and take no part in links; an id that several rows bear stands for all of them; ids that are no whole
numbers are numbered first; an empty table gives an empty result; other columns, of any name, are not read.
Frequent keys (a text with very many copies, a bucket with very many rows) are joined by broadcast, which a bound on
their number allows; links() gives all pairs between different texts, components() and keep_one() do without.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexloom.llm import textvec as tv
from lexloom.llm.rows import carried
from lexloom.session import materialise, remove, ship_package

N = 5
#: Similarity 3/4 as integers: 100 * overlap >= PERCENT * union.
PERCENT = 75
_CHUNK_ROWS = 60_000
#: Packed entries of one column block, on average.
_BLOCK_BYTES = 12 << 20
_MIN_BITS, _MAX_BITS = 5, 16
_ENTRY = 8

_PACKED = "block int, chunk long, kind int, data binary"
_PACKED_TYPES = pa.schema([("block", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_SETS = "id long, key string, n long, lone long, kept array<long>"
_SETS_TYPES = pa.schema([("id", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("lone", pa.int64()), ("kept", pa.list_(pa.int64()))])
_HEADER = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8"), ("key", "S32")])


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Entries that a row of n must share with a partner, whatever its size."""
    return -(-percent * n // 100)


def _pack(h: np.ndarray, row: np.ndarray, bits: int) -> np.ndarray:
    """Entries of one block as 8 bytes: 48 bits of the hash below the block's, 16 of the row."""
    return (((h << np.uint64(bits)) >> np.uint64(16)) << np.uint64(16)) | row.astype(np.uint64)


def _chunk_rows(chunk: int, h: np.ndarray, row: np.ndarray, header: np.ndarray, bits: int) -> Iterator[dict]:
    """The packed rows of a chunk. h, row: its entries sorted by hash.

    A column that a chunk has once sends its entry to the column's block (kind 0). One that it has more often sends its
    number alone (kind 2), while its entries go to the chunk's own place (kind 3), as the header does (kind 1). So a block
    gets one entry of a frequent column from a chunk, not one from each document.
    """
    if h.size:
        new = np.concatenate([[True], h[1:] != h[:-1]])
        run = np.cumsum(new) - 1
        sizes = np.bincount(run)
        single = sizes[run] == 1
        yield from _by_block(0, chunk, h[single], bits, _pack(h[single], row[single], bits))
        columns = h[new][sizes > 1]
        if columns.size:
            many = sizes[sizes > 1].astype(np.uint32)
            yield from _by_block(2, chunk, columns, bits, _pack(columns, np.zeros(columns.size, np.int64), bits), many)
            home = columns.tobytes() + many.tobytes() + row[~single].astype(np.uint16).tobytes()
            yield {"block": chunk * 2654435761 % (1 << bits), "chunk": chunk, "kind": 3, "data": struct.pack("<q", columns.size) + home}
    yield {"block": chunk * 2654435761 % (1 << bits), "chunk": chunk, "kind": 1, "data": header.tobytes()}


def _by_block(kind: int, chunk: int, h: np.ndarray, bits: int, *arrays: np.ndarray) -> Iterator[dict]:
    """A row for each block that these sorted hashes fall in, with its part of each array."""
    block = (h >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [h.size]]).tolist(), strict=True):
        if b > a:
            yield {"block": int(block[a]), "chunk": chunk, "kind": kind, "data": b"".join(x[a:b].tobytes() for x in arrays)}


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Distinct n-gram hashes of a slice of texts: hash and text of each, sorted by both; set sizes; digests of the word sequences."""
    low = tv.LOWER[data]
    starts, ends = tv.word_spans(low, tv.NONSPACE)
    firsts = tv.words_per_text(starts, bounds)
    words = tv.word_hashes(low, starts, ends)
    count = np.diff(firsts)
    h = tv.window_hashes(words, n)
    text = np.searchsorted(firsts, np.arange(h.size), side="right") - 1
    inside = np.arange(h.size) + n <= firsts[text + 1] if h.size else np.zeros(0, bool)
    hs, texts = [h[inside]], [text[inside]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if short.size:
            hs.append(tv.window_hashes(words, k)[firsts[short]])
            texts.append(short)
    h, text = np.concatenate(hs), np.concatenate(texts)
    order = np.lexsort((text, h))
    h, text = h[order], text[order]
    new = np.ones(h.size, dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    keep = tv.NONSPACE[low]
    keep[1:] |= keep[:-1]  # of the white space behind a word, one byte
    keep[bounds[1:] - 1] = True
    sizes = np.concatenate([[0], np.cumsum(keep)])[bounds]
    clean = np.where(tv.NONSPACE[low], low, 0x20)[keep].tobytes()
    keys = [hashlib.blake2b(clean[a:b].rstrip(b" "), digest_size=16).hexdigest() for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
    return h, text, np.bincount(text, minlength=count.size), keys


def _scan_texts(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Packed entries of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK_ROWS):
                part = batch.slice(at, _CHUNK_ROWS)
                ids = part.column(0)
                for first, data, bounds in tv.text_slices(part.column(1)):
                    h, text, sizes, keys = shingle_sets(data, bounds, n)
                    h = h & ~np.uint64((1 << 16 - bits) - 1)  # the bits that are sent
                    header = np.zeros(sizes.size, dtype=_HEADER)
                    own = ids.slice(first, sizes.size)
                    header["id"], header["null"] = own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
                    header["n"], header["key"] = sizes, keys
                    yield pa.RecordBatch.from_pylist(list(_chunk_rows(chunk, h, text, header, bits)), _PACKED_TYPES)
                    chunk += 1

    return docs.mapInArrow(run, _PACKED)


def _scan_sets(sets: DataFrame, bits: int) -> DataFrame:
    """Packed entries of rows (id, key, n, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                kept = part.column("kept")
                h = kept.flatten().to_numpy().view(np.uint64)
                row = np.repeat(np.arange(part.num_rows), kept.value_lengths().to_numpy())
                order = np.argsort(h, kind="stable")
                header = np.zeros(part.num_rows, dtype=_HEADER)
                for name in ("id", "n"):
                    header[name] = part.column(name).to_numpy()
                header["key"] = part.column("key").to_pylist()
                yield pa.RecordBatch.from_pylist(list(_chunk_rows(chunk, h[order], row[order], header, bits)), _PACKED_TYPES)
                chunk += 1

    return sets.select("id", "key", "n", "kept").mapInArrow(run, _PACKED)


def _column_block(counting: bool):
    """Of a block's entries those whose column has two or more, with the column's count where it is asked for."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _many(key[0].as_py(), table, counting)

    return run


def _many(block: int, table: pa.Table, counting: bool) -> pa.Table:
    kinds = table.column("kind").to_numpy()
    chunks, data = table.column("chunk").to_pylist(), table.column("data")
    out = [{"block": block, "chunk": chunks[i], "kind": int(kinds[i]), "data": data[i].as_py()} for i in np.flatnonzero((kinds == 1) | (kinds == 3)).tolist()]
    lists = np.flatnonzero((kinds == 0) | (kinds == 2)).tolist()
    if lists:
        parts, weights = [], []
        for i in lists:
            raw = data[i].as_buffer()
            size = len(raw) // (_ENTRY + 4 * (kinds[i] == 2))
            parts.append(np.frombuffer(raw, dtype=np.uint64, count=size))
            weights.append(np.frombuffer(raw, dtype=np.uint32, offset=size * _ENTRY) if kinds[i] == 2 else np.ones(size, np.uint32))
        columns = np.concatenate(parts) >> np.uint64(16)
        order = np.argsort(columns, kind="stable")
        ranked = columns[order]
        run = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]])) - 1
        counts = np.empty(columns.size, dtype=np.uint32)
        counts[order] = np.bincount(run, np.concatenate(weights)[order])[run]
        at = 0
        for i, part in zip(lists, parts, strict=True):
            own = counts[at : at + part.size]
            many = own > 1
            if many.any() and (counting or kinds[i] == 0):  # a chunk knows that its own frequent columns have two entries
                out.append({"block": block, "chunk": chunks[i], "kind": int(kinds[i]), "data": part[many].tobytes() + (own[many].tobytes() if counting else b"")})
            at += part.size
    return pa.Table.from_pylist(out, _PACKED_TYPES)


def _assemble(bits: int, percent: int, counting: bool):
    """Joins what the blocks sent back to a chunk: a row for each text, entries only where it can reach a bound."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blocks = table.column("kind").to_pylist(), table.column("block").to_pylist()
        data = table.column("data")
        hs, rows, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        known, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        header, home = None, None
        for i, (kind, block) in enumerate(zip(kinds, blocks, strict=True)):
            raw = data[i].as_py()
            if kind == 1:
                header = np.frombuffer(raw, dtype=_HEADER)
            elif kind == 3:
                home = raw
            else:
                size = len(raw) // (_ENTRY + 4 * counting)
                entries = np.frombuffer(raw, dtype=np.uint64, count=size)
                h = (entries >> np.uint64(16)) << np.uint64(16 - bits) | np.uint64(block << 64 - bits)
                n = np.frombuffer(raw, dtype=np.uint32, offset=size * _ENTRY).astype(np.int32) if counting else np.zeros(size, np.int32)
                if kind == 2:
                    known.append(h)
                    total.append(n)
                else:
                    rows.append((entries & np.uint64(0xFFFF)).astype(np.int64))
                    hs.append(h)
                    counts.append(n)
        if header is None:
            return pa.Table.from_pylist([], _SETS_TYPES)
        if home is not None:
            size = struct.unpack_from("<q", home)[0]
            columns, many = np.frombuffer(home, np.uint64, size, 8), np.frombuffer(home, np.uint32, size, 8 + 8 * size)
            hs.append(np.repeat(columns, many))
            rows.append(np.frombuffer(home, np.uint16, offset=8 + 12 * size).astype(np.int64))
            n = np.zeros(size, np.int32)
            if counting:
                known, total = np.concatenate(known), np.concatenate(total)
                order = np.argsort(known)
                n = total[order][np.searchsorted(known[order], columns)]
            counts.append(np.repeat(n, many))
        h, row, count = map(np.concatenate, (hs, rows, counts))
        kept = np.bincount(row, minlength=header.size)
        alive = (100 * kept >= percent * header["n"]) & (header["n"] > 0) & (header["null"] == 0)
        use = alive[row]
        h, row, count = h[use], row[use], count[use]
        order = np.lexsort((h, count, row))
        offsets = np.concatenate([[0], np.cumsum(np.where(alive, kept, 0))])
        mask = pa.array(~alive)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[order].view(np.int64)), mask=mask)
        return pa.Table.from_arrays(
            [
                pa.array(header["id"], mask=header["null"] == 1), pa.array([k.decode() for k in header["key"].tolist()]), pa.array(header["n"]),
                pa.array(header["n"] - kept), lists,
            ],
            schema=_SETS_TYPES,
        )

    return run


def _product(packed: DataFrame, bits: int, percent: int, counting: bool) -> DataFrame:
    """Rows of _SETS after one exchange with the column blocks. kept is null for rows that are done, else sorted by hash, where counting by (count, hash)."""
    kept = packed.groupBy("block").applyInArrow(_column_block(counting), _PACKED)
    return kept.groupBy("chunk").applyInArrow(_assemble(bits, percent, counting), _SETS)


def _bits(entries: float) -> int:
    """Bits of the block number for so many entries."""
    blocks = max(1, int(entries * _ENTRY) // _BLOCK_BYTES)
    return max(_MIN_BITS, min(_MAX_BITS, blocks.bit_length()))


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of the nodes of links (a, b): smallest id, by alternating large and small stars.

    Each round is two grouped minima, joined back; the number of rounds grows with the logarithm of the longest chain.
    """
    edges, path = materialise(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        new, new_path = materialise(joined.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        remove(edges.sparkSession, path)
        edges, path = new, new_path
        if state == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct()).distinct()
        seen = state


def _signature(array: str) -> str:
    """SQL of the entries' 256-bit signature: an array of four longs."""
    spot = "pmod(shiftright(h, 20), 256)"
    words = (f"aggregate(filter({array}, h -> {spot} div 64 = {w}), 0L, (s, h) -> s | shiftleft(1L, cast({spot} % 64 AS int)))" for w in range(4))
    return f"array({', '.join(words)})"


def _bits_of(left: str, right: str, sign: str) -> F.Column:
    """Bits of one signature combined with the other."""
    return F.expr(" + ".join(f"bit_count({left}[{w}] {sign}{right}[{w}])" for w in range(4)))


def _overlaps(pairs: DataFrame, rows: DataFrame, *more: F.Column) -> DataFrame:
    """pairs (a, b) with both sizes, both numbers of kept entries, and the overlap; more: of ka and kb, the kept entries."""
    left = rows.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("kept").alias("ka"))
    right = rows.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("kept").alias("kb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", F.size("ka").alias("sa"), F.size("kb").alias("sb"), F.size(F.array_intersect("ka", "kb")).alias("overlap"), *more)


def _linked(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _frequent(rows: DataFrame, table: DataFrame, key: str, least: int) -> DataFrame:
    """rows with the columns of table, which has one row a key and says how many `members` bear it; null where it has none.

    Keys with more than `least` members, at most (members in all) / least of them, are joined by broadcast; the rest by a
    plain join, in which rows of frequent keys and without a key are spread.
    """
    names = [c for c in table.columns if c not in (key, "members")]
    hot = table.where(F.col("members") > least).select(key, F.struct(*names).alias("_hot"))
    zero = F.pmod("members", F.lit(1)).cast("int")  # a literal would be taken out of the join's keys
    cold = table.where(F.col("members") <= least).select(key, zero.alias("_salt"), F.struct(*names).alias("_cold"))
    there = rows.join(F.broadcast(hot), key, "left")
    salt = F.when(F.col(key).isNotNull() & F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(4096)).cast("int"))
    both = there.withColumn("_salt", salt).join(cold, [key, "_salt"], "left")
    return both.select(*rows.columns, F.coalesce("_hot", "_cold").alias("_found")).select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in names])


#: Members from which a key is joined by broadcast: these, or one in 2000 documents.
_HOT = 1000


def _incidence(docs: DataFrame, text_col: str, id_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame, str, int]:
    """Every row's set; the rows that can have partners, equal texts once, with their entries; the latter's path; members of a hot key."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = _bits((size[0] or 0) / 5)
    sets, _ = materialise(_product(_scan_texts(texts, n, bits), bits, percent, counting=False), "sets")
    # Equal word sequences are one row; its id is the smallest.
    once = sets.where("kept IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "n", "kept")).alias("r")).select("r.id", "key", "r.n", "r.kept")
    rows, path = materialise(_product(_scan_sets(once, bits), bits, percent, counting=True).where("kept IS NOT NULL"), "rows")
    return sets, rows, path, max(_HOT, size[1] // 2000)


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(id, n, size, lone, h): the entries of which any partner shares one."""
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - F.col("lone")
    return rows.where(prefix > 0).select("id", "n", F.size("kept").alias("size"), (F.col("lone") / F.col("n")).alias("lone"), F.explode(F.slice("kept", 1, prefix.cast("int"))).alias("h"))


def components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. See the module for method and cases."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        return _named(docs, text_col, id_col, n, percent)
    spark: SparkSession = docs.sparkSession
    sets, rows, first_path, least = _incidence(docs, text_col, id_col, n, percent)
    entries = _prefixes(rows, percent)
    buckets = entries.groupBy("h").agg(F.min_by("id", F.struct("lone", "id")).alias("pivot"), F.count("*").alias("members")).where("members > 1")
    filled, filled_path = materialise(_frequent(entries.drop("lone"), buckets, "h", least).where("pivot IS NOT NULL"), "buckets")

    pairs = filled.where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    signs = F.expr(_signature("array_except(kb, ka)")).alias("missing"), F.expr(_signature("array_except(ka, kb)")).alias("outside")
    counted, counted_path = materialise(_overlaps(pairs, rows, *signs), "pivots")
    near = _linked(counted, percent)
    first = connected(near)

    # What is left: pairs of one bucket in two components whose bound is in reach.
    to_pivot = counted.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "overlap", F.col("sb").alias("whole"))
    placed = filled.join(to_pivot, ["id", "pivot"], "left").join(first, "id", "left")
    own = F.col("id") == F.col("pivot")
    placed = placed.select("h", "id", "pivot", "n", F.coalesce("component", "id").alias("c"), F.when(own, F.col("size")).otherwise(F.col("overlap")).alias("o"), F.when(own, F.col("size")).otherwise(F.col("whole")).alias("whole"), "size")
    placed = placed.withColumn("rest", F.col("size") - F.col("o"))
    placed, placed_path = materialise(placed, "placed")
    by_component = placed.groupBy("h", "c").agg(F.count("*").alias("k"), F.max("rest").alias("rest"))
    mixed = by_component.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"), F.max("rest").alias("most"), F.sum("k").alias("members")).where("parts > 1")
    open_rows = _frequent(placed, mixed.drop("parts"), "h", least).where("main IS NOT NULL").where(100 * (F.col("o") + F.least("rest", "most")) >= percent * F.col("n"))
    marks = counted.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "missing", "outside")
    none = F.array(*[F.lit(0).cast("long")] * 4)
    open_rows = open_rows.join(marks, ["id", "pivot"], "left").withColumns({x: F.coalesce(x, none) for x in ("missing", "outside")})
    open_rows, open_path = materialise(open_rows, "open")
    fields = ("id", "n", "c", "rest", "missing", "outside")
    minor = open_rows.where("c != main").select("h", "whole", *(F.col(x).alias(f"{x}a") for x in fields))
    every = open_rows.select("h", *(F.col(x).alias(f"{x}b") for x in fields))
    inside = F.col("whole") - _bits_of("missinga", "missingb", "| ")
    bound = inside + F.least(F.col("resta") - _bits_of("outsidea", "outsideb", "& ~"), F.col("restb") - _bits_of("outsideb", "outsidea", "& ~"))
    left = minor.join(every, "h").where((F.col("ca") != F.col("cb")) & ((100 + percent) * bound >= percent * (F.col("na") + F.col("nb"))))
    left = left.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    late, late_path = materialise(_linked(_overlaps(left, rows), percent), "links")
    links = near.union(late).union(first.select(F.col("id").alias("a"), F.col("component").alias("b")))
    found, _ = materialise(connected(links) if late.take(1) else first, "components")
    for path in (first_path, filled_path, counted_path, placed_path, open_path, late_path):
        remove(spark, path)

    linkable = F.col("id").isNotNull() & (F.col("n") > 0)
    groups = sets.where(linkable).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("members"))
    by_key = groups.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("component"), "members")
    out = _frequent(sets.select("id", F.when(linkable, F.col("key")).alias("key"), "n"), by_key, "key", least)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), "id").alias("component_id"))


def _named(docs: DataFrame, text_col: str, id_col: str, n: int, percent: int) -> DataFrame:
    """components() of ids that are no whole numbers: these get numbers, and each component its smallest id."""
    ids, _ = materialise(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("name")).distinct().withColumn("number", F.monotonically_increasing_id()), "names")
    numbered = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(ids, "name", "left").select(F.col("number").alias("doc_id"), "text")
    found, _ = materialise(components(numbered, "text", "doc_id", n, percent), "numbered")
    own = found.join(ids, F.col("doc_id") == F.col("number"), "left").select("name", "n_shingles", "component_id")
    least = own.where("name IS NOT NULL").groupBy("component_id").agg(F.min("name").alias("first"))
    return own.join(least, "component_id", "left").select(F.col("name").alias(id_col), "n_shingles", F.col("first").alias("component_id"))


def links(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = N, percent: int = PERCENT, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """All links between different texts, and who bears them: (a, b, overlap, size_a, size_b) with a < b, and (doc_id, representative).

    A representative is the smallest id of the rows with equal word sequences; ids are whole numbers. The result has a row
    for each link, so in a group of m texts that are all alike it has m * (m - 1) / 2: components() does not need them. The
    overlaps of a bucket's rows are counted in blocks of rows, each pair of blocks by itself.
    """
    sets, rows, _, least = _incidence(docs, text_col, id_col, n, percent)
    entries = _prefixes(rows, percent).select("id", "n", "h")
    counts = entries.groupBy("h").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    placed = _frequent(entries, counts, "h", least).where("blocks IS NOT NULL").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed, _ = materialise(placed, "placed")
    left = placed.select("h", F.col("id").alias("x"), F.col("n").alias("nx"), "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    right = placed.select("h", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), "i")).alias("i"))
    met = left.join(right, ["h", "i", "j"]).where((F.col("i") != F.col("j")) | (F.col("x") < F.col("y"))).where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    overlaps = _overlaps(pairs, rows)
    found = overlaps.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b", "overlap", F.col("na").alias("size_a"), F.col("nb").alias("size_b"))
    linkable = sets.where("id IS NOT NULL AND n > 0").select("id", "key")
    groups = linkable.groupBy("key").agg(F.min("id").alias("representative"), F.count("*").alias("members"))
    return found, _frequent(linkable, groups, "key", least).select(F.col("id").alias(id_col), "representative")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each component the document with the smallest id, with all its columns unchanged.

    Rows that share an id, or have none, are documents of their own here: where there are such, rows are told apart by
    their place in a written copy. A row without an id comes behind those that have one.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    plain = isinstance(docs.schema[id_col].dataType, IntegralType) and not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").take(1)
    if plain:
        rows, back = carried(docs, text_col, id_col)
        found = components(docs, text_col, id_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("key0"))
        return back(rows.join(found.hint("shuffle_hash"), "key0", "left_semi"))
    rows, back = carried(docs, text_col, id_col)
    rows, _ = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = components(rows, "text", "number").select("number", "component_id")
    order = F.struct(F.col("key0").isNull().alias("none"), F.col("key0"), F.col("number"))
    best = rows.select("number", "key0").join(found, "number").groupBy("component_id").agg(F.min_by("number", order).alias("number"))
    return back(rows.join(best, "number", "left_semi"))
