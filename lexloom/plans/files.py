"""Files read and written, Unicode forms, segmentation folds, vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import segment
from lexloom.plans.fixtures import lines
from lexloom.session import ship_package, table
from lexloom.sources import files, sinks


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units: the first line is a heading."""
    rows = lines(spark, sf_dir).where("trim(line) <> ''")
    clean = F.trim(F.regexp_replace("line", r"\s+", " "))
    return rows.select("doc_id", F.col("line_no").alias("ord"), F.when(F.col("line_no") == 1, "heading").otherwise("paragraph").alias("kind"), F.when(F.col("line_no") == 1, 1).otherwise(0).alias("level"), clean.alias("text"))


def src_html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of pages by kind and level."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return files.parse_files(pages).groupBy("kind", "level").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _round_trip(fmt: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = sinks.render(_units(spark, sf_dir), fmt)
        parsed = files.parse_files(made.select(F.col("name").alias("path"), "content"))
        return parsed.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).alias("headings"), F.sum(F.length("text")).alias("chars"))

    query.__doc__ = f"Documents written as {fmt} and read again, counted."
    return query


def sink_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files."""
    return sinks.render(_units(spark, sf_dir), "txt").select("name", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha"))


def _sql_units(where: str = "") -> str:
    return f"""units AS (SELECT doc_id, i, trim(regexp_replace(l[i], '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) x WHERE trim(l[i]) <> '' {where})"""


def _sql_trip(fmt: str) -> str:
    return f"WITH {_sql_units()} SELECT concat(doc_id, '.{fmt}') AS path, count(*) AS n, CAST(sum(CASE WHEN i = 1 THEN 1 ELSE 0 END) AS BIGINT) AS headings, CAST(sum(length(line)) AS BIGINT) AS chars FROM units GROUP BY doc_id"


def norm_newlines_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in NFKC with line feeds, by hash."""
    ship_package(spark)

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else files.normalise(x, "NFKC"))

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(nfkc(F.concat("text", F.lit("\r\nﬁn²\r")))).alias("h"))


def norm_parser_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in NFC without control and invisible characters, by hash."""
    ship_package(spark)

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else files.normalise(x))

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(nfc(F.concat("text", F.lit("é\x07​\r\n")))).alias("h"))


def src_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in several encodings, decoded."""
    ship_package(spark)

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else files.decode(bytes(x)))

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16"))
    return docs.select("doc_id", F.md5(decode(content)).alias("text_md5"))


def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents packed to 100 words."""
    return segment.chunk_greedy(table(spark, sf_dir, "documents"))


def group_short_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents packed to 120 words."""
    return segment.group_short_paragraphs(table(spark, sf_dir, "documents"))


def segment_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents with ids and hashes."""
    return segment.segment_chapter(table(spark, sf_dir, "documents"))


def process_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents' segments, in order, by hash."""
    docs = table(spark, sf_dir, "documents")
    blank = r"[ \t\n\f\r]"  # a vertical tab and the mark of sentences are no blanks: they stay in their words
    words = lambda c: F.array_join(F.filter(F.split(c, f"{blank}+"), lambda w: w != ""), " ")
    joined = F.array_join(segment.pack_greedy(segment.sentences(F.col("text"), blank, also="")), " ")
    return docs.select("doc_id", F.md5(words(joined)).alias("words_md5"))


def sem_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to the next, by their dot product."""
    rows = table(spark, sf_dir, "embeddings")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cast = lambda c: F.transform(c, lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both = rows.join(nxt, "vec_id").select("vec_id", cast("embedding").alias("a"), cast("other").alias("b"))
    dot = total(F.zip_with("a", "b", lambda x, y: x * y))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
    return both.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (norm("a") * norm("b")))), 4).alias("score"))


# The folds in DuckDB: parts in one string with a mark between them, the last of which grows.
_COUNT = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"
_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?]["''”’)]?)\s+([^a-z\s])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""


def _packed(parts: str, limit: int, glue: str) -> str:
    last = _COUNT.replace("{x}", "split_part(a, chr(2), -1)")
    own = _COUNT.replace("{x}", "p")
    return f"string_split(list_reduce({parts}, lambda a, p: CASE WHEN {last} + {own} <= {limit} THEN concat(a, {glue}, p) ELSE concat(a, chr(2), p) END), chr(2))"


def _numbered(parts: str, number: str, name: str) -> str:
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS {number}, c[i] AS {name} FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM (SELECT doc_id, {parts} AS c FROM documents WHERE text IS NOT NULL AND trim(text) <> '') x) y"


QUERIES = {f.__name__: f for f in (src_html_units, sink_txt, norm_newlines_unicode, norm_parser_nfc, src_encoding, chunk_greedy, group_short_paragraphs, segment_chapter, process_document, sem_cosine)} | {"sink_docx": _round_trip("docx"), "src_docx": _round_trip("docx"), "sink_epub": _round_trip("epub"), "src_epub": _round_trip("epub")}
ORACLES = {k: _sql_trip(k.split("_")[1]) for k in ("sink_docx", "src_docx", "sink_epub", "src_epub")} | {
    "src_encoding": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "process_document": r"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ')) AS words_md5 FROM documents",
    "chunk_greedy": _numbered(_packed(_SENTENCES, segment.MAX_WORDS, "' '"), "chunk_no", "chunk"),
    "group_short_paragraphs": _numbered(_packed("list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')", segment.GROUP_WORDS, "concat(chr(10), chr(10))"), "group_no", "text"),
    "sem_cosine": "SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
