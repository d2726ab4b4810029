"""Queries of pages: documents set in lines of 60 characters and pages of 20, with a title line, a number, and pages that lost their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import pages
from lexloom.session import table

#: A line: up to 60 characters to a blank, or 60 of a longer word. Both engines take the first alternative that fits.
_LINE = r"\S(?:[^\n]{0,58}\S)?(?:\s+|$)|\S{1,60}"
_PER_PAGE = 20


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, line_no, line, conf): all text of all documents; of five pages of document d, d % 5 lost their text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit(_LINE), F.lit(0)).alias("l"))
    body = docs.select("doc_id", F.posexplode("l").alias("i", "x")).select("doc_id", (F.floor(F.col("i") / _PER_PAGE) + 1).cast("int").alias("page"), (F.col("i") % _PER_PAGE + 1).cast("int").alias("line_no"), F.trim(F.regexp_replace("x", r"\s+", " ")).alias("line"))
    lost = F.pmod(F.col("doc_id") + F.col("page"), F.lit(5)) < F.pmod(F.col("doc_id"), F.lit(5))
    body = body.withColumn("line", F.when(lost, F.repeat(F.lit("�"), F.length("line"))).otherwise(F.col("line")))
    last = F.ceil(F.size("l") / _PER_PAGE).cast("int")
    each = docs.where("size(l) > 0").select("doc_id", F.explode(F.sequence(F.lit(1), last)).alias("page"))
    extra = F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit("A Book of Looms").alias("line")), F.struct(F.lit(_PER_PAGE + 1).alias("line_no"), F.concat(F.lit("- "), F.col("page").cast("string"), F.lit(" -")).alias("line")))).alias("x")
    rows = body.unionByName(each.select("doc_id", "page", extra).select("doc_id", "page", "x.line_no", "x.line"))
    return rows.withColumn("conf", F.length("line") % 5 / 10 + 0.5)


def pdf_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document by its share of good pages."""
    return pages.classify(sheets(spark, sf_dir))


def src_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way each page is read."""
    return pages.route(sheets(spark, sf_dir))


def header_footer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur in margins, by place."""
    return pages.recurring(sheets(spark, sf_dir))


def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document without margins that recur and page numbers."""
    return pages.clean(sheets(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def pdf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each document's pages by kind."""
    units = pages.structure(pages.clean(sheets(spark, sf_dir)))
    return units.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("chapter").alias("chapters"))


def src_ocr_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence and size of each page, and whether it needs review."""
    return pages.confidence(sheets(spark, sf_dir))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pages.cache_key(F.sha2(F.col("doc_id").cast("string"), 256), F.col("page"), F.lit("engine"), F.lit("eng"))
    return pages.page_text(sheets(spark, sf_dir)).select("doc_id", "page", "text", key.alias("key"))


def ocr_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the cache, which has the even ones, lacks."""
    rows = _keyed(spark, sf_dir)
    return pages.to_recognise(rows, rows.where("page % 2 = 0")).select("doc_id", "page", "key")


def ocr_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after two reviews of every third one: the later text stands, the read one is kept."""
    rows = _keyed(spark, sf_dir).withColumn("conf", F.lit(0.6))
    seen = rows.where("page % 3 = 0").select("key", F.explode(F.array(F.struct(F.lit("first").alias("reviewed"), F.lit(1).alias("at")), F.struct(F.lit("second").alias("reviewed"), F.lit(2).alias("at")))).alias("x"))
    return pages.review(rows, seen.select("key", "x.*")).select("doc_id", "page", F.md5("text").alias("text_md5"), "conf", F.md5("original").alias("original_md5"))


QUERIES = {f.__name__: f for f in (pdf_classify, src_pdf, header_footer_filter, pdf_clean, pdf_structure, src_ocr_page, ocr_cache, ocr_review)}

_SHEETS = rf"""cut AS (SELECT doc_id, regexp_extract_all(text, '{_LINE}') AS l FROM documents WHERE text IS NOT NULL),
  numbered AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM cut),
  body AS (SELECT doc_id, CAST(i // {_PER_PAGE} + 1 AS INTEGER) AS page, CAST(i % {_PER_PAGE} + 1 AS INTEGER) AS line_no, trim(regexp_replace(x, '\s+', ' ', 'g')) AS line FROM numbered),
  leaves AS (SELECT doc_id, unnest(range(1, CAST(ceil(len(l) / {_PER_PAGE}) AS INTEGER) + 1)) AS page FROM cut WHERE len(l) > 0),
  printed AS (SELECT doc_id, page, line_no, CASE WHEN (doc_id + page) % 5 < doc_id % 5 THEN repeat(chr(65533), CAST(length(line) AS BIGINT)) ELSE line END AS line FROM body
    UNION ALL SELECT doc_id, page, 0, 'A Book of Looms' FROM leaves UNION ALL SELECT doc_id, page, {_PER_PAGE + 1}, concat('- ', page, ' -') FROM leaves),
  sheets AS (SELECT doc_id, CAST(page AS INTEGER) AS page, line_no, line, length(line) % 5 / 10 + 0.5 AS conf FROM printed),
  whole AS (SELECT doc_id, page, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS text FROM sheets GROUP BY doc_id, page)"""
_GOOD = r"""judged AS (SELECT doc_id, page, length(text) >= 40 AND length(regexp_replace(text, '[\p{C}\x{fffd}]', '', 'g')) >= 0.75 * length(text) AS good FROM whole),
  classed AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE good) AS good_pages, CASE WHEN count(*) FILTER (WHERE NOT good) / count(*) >= 0.8 OR NOT bool_or(good) THEN 'scanned' WHEN count(*) FILTER (WHERE good) / count(*) >= 0.85 THEN 'textual' ELSE 'mixed' END AS class FROM judged GROUP BY doc_id)"""
_MARGINS = """placed AS (SELECT doc_id, page, line_no, line, lower(line) AS low, row_number() OVER p AS spot, count(*) OVER q AS n, count(*) OVER q AS total_lines FROM sheets WHERE line <> '' WINDOW p AS (PARTITION BY doc_id, page ORDER BY line_no), q AS (PARTITION BY doc_id, page)),
  bounded AS (SELECT *, CASE WHEN n >= 3 THEN least(2, n // 2) WHEN n = 2 THEN 1 ELSE 0 END AS m FROM placed),
  spots AS (SELECT doc_id, page, 'top' AS place, low FROM bounded WHERE spot <= m UNION SELECT doc_id, page, 'bottom', low FROM bounded WHERE spot > n - m),
  known AS (SELECT s.doc_id, s.place, s.low, count(*) AS n FROM spots s JOIN (SELECT doc_id, count(DISTINCT page) AS total FROM sheets GROUP BY doc_id) t ON t.doc_id = s.doc_id WHERE t.total >= 2 GROUP BY s.doc_id, s.place, s.low, t.total HAVING count(*) >= greatest(2, floor(t.total * 0.35)))"""
_KEY = "concat_ws('_', substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16), CAST(page AS VARCHAR), 'engine', 'eng')"
ORACLES = {
    "pdf_classify": f"WITH {_SHEETS}, {_GOOD} SELECT * FROM classed",
    "src_pdf": f"WITH {_SHEETS}, {_GOOD} SELECT j.doc_id, j.page, CASE c.class WHEN 'textual' THEN 'text' WHEN 'scanned' THEN 'ocr' ELSE CASE WHEN j.good THEN 'text' ELSE 'ocr' END END AS way FROM judged j JOIN classed c ON c.doc_id = j.doc_id",
    "header_footer_filter": f"WITH {_SHEETS}, {_MARGINS} SELECT doc_id, place, low, n FROM known",
    "pdf_clean": f"WITH {_SHEETS}, {_MARGINS} SELECT b.doc_id, count(*) AS n, CAST(sum(length(b.line)) AS BIGINT) AS chars FROM bounded b LEFT JOIN known k ON k.doc_id = b.doc_id AND k.low = b.low AND k.place = CASE WHEN b.spot <= b.m THEN 'top' WHEN b.spot > b.n - b.m THEN 'bottom' END WHERE k.low IS NULL AND NOT ((b.spot <= b.m OR b.spot > b.n - b.m) AND regexp_matches(b.line, '{pages.PAGE_NUMBER}')) GROUP BY b.doc_id",
    "src_ocr_page": f"WITH {_SHEETS} SELECT doc_id, page, round(avg(conf), 4) AS conf, CAST(sum(len(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS BIGINT) AS words, CAST(sum(length(line)) AS BIGINT) AS chars, round(avg(conf), 4) < 0.7 AS needs_review FROM sheets GROUP BY doc_id, page",
    "ocr_cache": f"WITH {_SHEETS} SELECT doc_id, page, {_KEY} AS key FROM whole WHERE page % 2 <> 0",
    "ocr_review": f"WITH {_SHEETS} SELECT doc_id, page, md5(CASE WHEN page % 3 = 0 THEN 'second' ELSE text END) AS text_md5, CAST(CASE WHEN page % 3 = 0 THEN 1 ELSE 0.6 END AS DOUBLE) AS conf, CASE WHEN page % 3 = 0 THEN md5(text) END AS original_md5 FROM whole",
}
