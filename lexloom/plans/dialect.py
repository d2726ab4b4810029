"""Queries written once, in SQL that Spark and DuckDB share but for a few spellings.

RLIKE, SIZE, FILTER, MAP, HAS, ARR, EXPLODE, DIV and LISTAGG[x; separator; order] stand for what differs, R'...' is a string
without escapes, RXR(text, pattern, new RXR) replaces all matches, and `x -> ` begins a lambda. Views are the driver's tables
and the fixtures below; a query names those it reads, and only those are built.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import fixtures as fx
from lexloom.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_SPARK = {"RLIKE(": "regexp_like(", "SIZE(": "size(", "FILTER(": "filter(", "MAP(": "transform(", "HAS(": "array_contains(", "ARR(": "array(", "EXPLODE(": "explode(", " DIV ": " DIV ", "SPLIT(": "split(", "ITEM(": "try_element_at(", "DISTINCT_OF(": "array_distinct(", "INTERSECT_OF(": "array_intersect(", "CONCAT_OF(": "concat(", "sequence(": "sequence(", "SLICE(": "slice(", "ORD(": "ascii(", "STRPOS(": "instr(", "array_to_string(": "array_join("}
_DUCK = {"RLIKE(": "regexp_matches(", "SIZE(": "len(", "FILTER(": "list_filter(", "MAP(": "list_transform(", "HAS(": "list_contains(", "ARR(": "list_value(", "EXPLODE(": "unnest(", " DIV ": " // ", "SPLIT(": "string_split(", "ITEM(": "list_extract(", "DISTINCT_OF(": "list_distinct(", "INTERSECT_OF(": "list_intersect(", "CONCAT_OF(": "list_concat(", "sequence(": "generate_series(", "SLICE(": "list_slice(", "ORD(": "unicode(", "SHA256(": "sha256(", "STRPOS(": "strpos("}
_RAW = re.compile(r"(?<![\w'])R'")  # not the end of a string such as 'R'
#: Fixtures in SQL of this dialect, in an order in which each names earlier ones only.
VIEWS: dict[str, str] = {}
_FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pairs": fx.pairs,
    "glossary": lambda spark, _: fx.glossary(spark),
    "characters": lambda spark, _: fx.characters(spark),
    "lines": fx.lines,
    "hits": fx.hits,
    "tm": fx.tm,
    "tm_hits": fx.tm_hits,
    "rendered": fx.rendered,
    "scored": fx.scored,
}
_CTES = {"pairs": fx.PAIRS_SQL, "glossary": fx.GLOSSARY_SQL, "characters": fx.CHARACTERS_SQL, "lines": fx.LINES_SQL, "hits": fx.HITS_SQL, "tm": fx.TM_SQL, "tm_hits": fx.TM_HITS_SQL, "rendered": fx.RENDERED_SQL, "scored": fx.SCORED_SQL}


def _swap(sql: str, words: dict[str, str]) -> str:
    for word, to in words.items():
        sql = re.sub(r"(?<![A-Za-z_])" + re.escape(word), to.replace("\\", r"\\"), sql) if word[0] != " " else sql.replace(word, to)
    return sql


def to_spark(sql: str) -> str:
    """The query as Spark reads it; views get a prefix. Parentheses in an argument of SHA256 are balanced."""
    while (at := sql.find("SHA256(")) >= 0:
        end, depth = at + 7, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}sha2({sql[at + 7 : end - 1]}, 256){sql[end:]}"
    sql = re.sub(r"LISTAGG\[(.*?);(.*?);(.*?)\]", r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3)", sql, flags=re.S)
    sql = _swap(_RAW.sub("r'", sql.replace(" RXR)", ")").replace("RXR(", "regexp_replace(")), _SPARK)
    names = "|".join([*TABLES, *_FRAMES, *VIEWS])
    return re.sub(rf"\b(FROM|JOIN) ({names})\b", r"\1 lx_\2", sql)


def to_duck(sql: str) -> str:
    """The query as DuckDB reads it, without the fixtures."""
    sql = re.sub(r"LISTAGG\[(.*?);(.*?);(.*?)\]", r"string_agg(\1, \2 ORDER BY \3)", sql, flags=re.S)
    sql = _RAW.sub("'", sql.replace(" RXR)", ", 'g')").replace("RXR(", "regexp_replace("))
    sql = re.sub(r"\$([0-9])", r"\\\1", sql).replace(", 'utf-8')", ")")
    sql = re.sub(r"regexp_count\(([^,]+), ", r"len(regexp_extract_all(\1, ", sql).replace(") AS BIGINT) AS headings", ")) AS BIGINT) AS headings").replace(") AS BIGINT) AS paragraphs", ")) AS BIGINT) AS paragraphs").replace(") AS BIGINT) AS items", ")) AS BIGINT) AS items")
    sql = sql.replace("get(tw, i - 1) = get(tw, i) AND length(get(tw, i)) > 1", "tw[i] = tw[i + 1] AND length(tw[i + 1]) > 1")  # lists count from 1 there
    return re.sub(r"\b(\w+) -> ", r"lambda \1: ", _swap(sql, _DUCK))


def used(sql: str) -> list[str]:
    """Names of tables and fixtures that a query reads, directly or through fixtures, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in (*TABLES, *_FRAMES, *VIEWS):
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                if name in VIEWS or name in _CTES:
                    todo.append(VIEWS.get(name) or _CTES[name])
    return [n for n in (*TABLES, *_FRAMES, *VIEWS) if n in found]


def query(sql: str, doc: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a function of (spark, sf_dir)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in used(sql):
            if name in TABLES:
                table(spark, sf_dir, name).createOrReplaceTempView(f"lx_{name}")
            elif name in _FRAMES:
                _FRAMES[name](spark, sf_dir).createOrReplaceTempView(f"lx_{name}")
            else:
                spark.sql(to_spark(VIEWS[name])).createOrReplaceTempView(f"lx_{name}")
        return spark.sql(to_spark(sql))

    run.__doc__ = doc
    return run


def oracle(sql: str) -> str:
    """The query for DuckDB."""
    ctes = [_CTES[n] if n in _CTES else f"{n} AS ({to_duck(VIEWS[n])})" for n in used(sql) if n not in TABLES]
    body = to_duck(sql)
    if not ctes:
        return body
    if body.lstrip().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body.lstrip()[5:]}"
    return f"WITH {', '.join(ctes)} {body}"


def register(entries: dict[str, tuple[str, ...]]) -> tuple[dict, dict]:
    """(QUERIES, ORACLES) of name -> (what it does, SQL), or with another statement, for the second engine alone, behind it."""
    return {k: query(e[1], e[0]) for k, e in entries.items()}, {k: oracle(e[-1]) for k, e in entries.items()}
