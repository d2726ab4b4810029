"""Dictionary matching: every place of every term in texts.

A term stands as a whole: what comes before and behind it is no letter, digit or underscore. It is found in either case
unless its entry says otherwise. A dictionary of at most `most_bytes` bytes is broadcast and compiled to one automaton a
worker, which reads each text once whatever the number of terms. A larger one is joined on the first two tokens of its
terms (the first, for terms of one), salted, so neither side is paired with all of the other. Both ways give the same rows.

Cases: null and empty texts hold nothing; null and blank terms are in no text; a term may be entered several times, each entry
is found; repeated rows are found in each; places of one term may overlap one another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.functions.regex import WORD
from lexloom.session import ship_package

#: Bytes of terms that are broadcast; their automaton takes about a hundred times as much in each worker at worst.
MOST_BYTES = 1 << 20
_SALTS = 8
_TOKEN = re.compile(r"\w+|[^\w\s]")


def fold(text: str) -> str:
    """Lower case of the same length: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _inner(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class Matcher:
    """The automaton of a dictionary; entry k is (term, whether its case counts)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        import ahocorasick

        self.automata = []
        for case in (False, True):
            found: dict[str, list[int]] = {}
            for k, (term, own) in enumerate(terms):
                if term and term.strip() and bool(own) == case:
                    found.setdefault(term if case else fold(term), []).append(k)
            if found:
                automaton = ahocorasick.Automaton()
                for term, entries in found.items():
                    automaton.add_word(term, (len(term), entries))
                automaton.make_automaton()
                self.automata.append((case, automaton))

    def find(self, text: str | None) -> dict[int, list[int]]:
        """Where each entry that occurs begins, ascending."""
        out: dict[int, list[int]] = {}
        for case, automaton in self.automata if text else ():
            own = text if case else fold(text)
            for last, (size, entries) in automaton.iter(own):
                if not _inner(own, last + 1) and not _inner(own, last - size):
                    for k in entries:
                        out.setdefault(k, []).append(last - size + 1)
        return out


_matchers: dict[int, Matcher] = {}


def matcher(mark: int, terms: list[tuple[str, bool]]) -> Matcher:
    """This worker's automaton of a broadcast dictionary; mark: the broadcast's number."""
    if mark not in _matchers:
        _matchers.clear()
        _matchers[mark] = Matcher(terms)
    return _matchers[mark]


def find_terms(df: DataFrame, terms: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), term_keys: tuple[str, ...] = ("term_id",), term: str = "term", case: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(keys, term_keys, term, starts): a row for each row of df and entry of terms that it holds, with all places (from 0)."""
    own, entry = tuple(f"_k{i}" for i in range(len(keys))), tuple(f"_t{i}" for i in range(len(term_keys)))
    entries = terms.select(*[F.col(k).alias(n) for k, n in zip(term_keys, entry, strict=True)], F.col(term).alias("term"), (F.coalesce(F.col(case), F.lit(False)) if case else F.lit(False)).alias("case"))
    size = entries.agg(F.sum(F.coalesce(F.octet_length("term"), F.lit(0)) + 16)).first()[0] or 0
    ship_package(df.sparkSession)
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)], F.col(text).alias("text"))
    found = (_by_automaton if size <= most_bytes else _by_join)(rows, entries, own, entry)
    return found.toDF(*keys, *term_keys, "term", "starts")


def _by_automaton(df: DataFrame, entries: DataFrame, keys: tuple[str, ...], term_keys: tuple[str, ...]) -> DataFrame:
    rows = [r.asDict() for r in entries.collect()]
    held = df.sparkSession.sparkContext.broadcast(rows)
    schema = df.select(*keys).limit(0).crossJoin(entries.limit(0)).select(*keys, *term_keys, "term").withColumn("starts", F.lit(None).cast("array<long>")).schema
    for f in schema.fields:
        f.nullable = True
    types = [to_arrow_type(entries.schema[k].dataType) for k in term_keys]
    mark = held._jbroadcast.id()  # workers live on: the number tells dictionaries apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(mark, [(r["term"], r["case"]) for r in held.value]).find
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                at, entry, starts = [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    for k, places in find(t).items():
                        at.append(i)
                        entry.append(held.value[k])
                        starts.append(places)
                spot = pa.array(at, pa.int32())
                cols = [part.column(k).take(spot) for k in keys] + [pa.array([e[k] for e in entry], t) for k, t in zip(term_keys, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([e["term"] for e in entry], pa.string()), pa.array(starts, pa.list_(pa.int64()))], names=[*keys, *term_keys, "term", "starts"])

    return df.mapInArrow(run, schema)


def _by_join(df: DataFrame, entries: DataFrame, keys: tuple[str, ...], term_keys: tuple[str, ...]) -> DataFrame:
    entries = entries.where(F.trim("term") != "")
    longest = entries.agg(F.max(F.length("term"))).first()[0] or 0
    token = f"({WORD}++|[^\\s\\p{{L}}\\p{{N}}_])"
    low = F.lower("term")
    two = F.regexp_extract(low, f"^\\s*{token}\\s*{token}", 1), F.regexp_extract(low, f"^\\s*{token}\\s*{token}", 2)
    head = F.when(two[1] != "", F.concat(two[0], F.lit(" "), two[1])).otherwise(F.regexp_extract(low, f"^\\s*{token}", 1))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    wanted = entries.withColumn("head", head).withColumn("salt", salts)
    schema = df.select(*keys).withColumns({"row": F.lit(0).cast("long"), "at": F.lit(0).cast("long"), "head": F.lit(""), "tail": F.lit(""), "salt": F.lit(0)}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                at, rows, places, heads, tails = [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    low = fold(t or "")
                    tokens = [(m.start(), m[0]) for m in _TOKEN.finditer(low)]
                    for k, (p, w) in enumerate(tokens):
                        if not _inner(low, p - 1):
                            for h in (w, f"{w} {tokens[k + 1][1]}") if k + 1 < len(tokens) else (w,):
                                at.append(i)
                                rows.append(row)
                                places.append(p)
                                heads.append(h)
                                tails.append(t[p : p + longest + 1])
                    row += 1
                spot = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(spot) for k in keys), pa.array(rows, pa.int64()), pa.array(places, pa.int64()), pa.array(heads, pa.string()), pa.array(tails, pa.string()), pa.array([p % _SALTS for p in places], pa.int32())], names=[*keys, "row", "at", "head", "tail", "salt"])

    met = df.mapInArrow(run, schema).join(wanted, ["head", "salt"])
    begins = F.when(F.col("case"), F.startswith("tail", F.col("term"))).otherwise(F.startswith(F.lower("tail"), F.lower("term")))
    behind = F.substring(F.col("tail"), F.length("term") + 1, F.lit(1))
    met = met.where(begins & ~behind.rlike(f"^{WORD}"))
    return met.groupBy("row", *keys, *term_keys, "term", "case").agg(F.sort_array(F.collect_list("at")).alias("starts")).select(*keys, *term_keys, "term", "starts")
