"""Documents that come as lines of pages, from a text layer or from a recogniser of images.

page_lines: (doc_id, page, line_no, line) and, of recognised pages, conf. Whoever decodes PDF files or images makes these rows;
all that follows is here. A page is a group of lines, so windows are never larger than a page; structure() needs a document's
lines in one task. Null lines are empty ones.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import ship_package

# Key words of headings, marks of dialogue.
HEADING_WORDS = ("CHAPTER", "CAPÍTULO", "ACT", "SCENE", "PART", "PARTE", "BOOK", "LIVRO")
DASHES = "—–―-"
_NUMBER = r"(\d+|[ivxlcdm]+)"
#: A line that is a page's number: alone, behind a word for page, in front of a total, or between dashes.
PAGE_NUMBER = rf"(?i)^\s*((page|página|p\.)?\s*{_NUMBER}\s*((of|de|/)\s*\d+)?|[-—–]\s*{_NUMBER}\s*[-—–])\s*$"
STRUCTURE = "doc_id {key}, chapter int, ord int, kind string, page int, line_no int, text string"


def page_text(page_lines: DataFrame) -> DataFrame:
    """(doc_id, page, lines, text): each page's lines joined by line feeds, without blanks at the ends."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line"))))
    joined = F.regexp_replace(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), r"^\s+|\s+$", "")
    return page_lines.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), joined.alias("text"))


def good_pages(page_lines: DataFrame, least_chars: int = 40, least_printable: float = 0.75) -> DataFrame:
    """page_text() with good: 40 characters or more, and three quarters of them neither control characters nor replacements."""
    shown = F.length(F.regexp_replace("text", r"[\p{C}\x{FFFD}]", ""))
    return page_text(page_lines).withColumn("good", (F.length("text") >= least_chars) & (shown >= least_printable * F.length("text")))


def classify(page_lines: DataFrame, scanned: float = 0.8, textual: float = 0.85) -> DataFrame:
    """(doc_id, pages, good_pages, class): scanned if 0.8 of the pages or all are bad, else textual if 0.85 are good, else mixed."""
    counted = good_pages(page_lines).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.col("good").cast("long")).alias("good_pages"))
    bad = F.col("pages") - F.col("good_pages")
    kind = F.when((bad / F.col("pages") >= scanned) | (F.col("good_pages") == 0), "scanned").when(F.col("good_pages") / F.col("pages") >= textual, "textual").otherwise("mixed")
    return counted.withColumn("class", kind)


def route(page_lines: DataFrame) -> DataFrame:
    """(doc_id, page, way): whether a page is read from its text layer or goes to the recogniser: all of a scanned document, the bad ones of a mixed one."""
    pages = good_pages(page_lines).select("doc_id", "page", "good")
    way = F.when((F.col("class") == "textual") | ((F.col("class") == "mixed") & F.col("good")), "text").otherwise("ocr")
    return pages.join(classify(page_lines).select("doc_id", "class"), "doc_id").select("doc_id", "page", way.alias("way"))


def confidence(page_lines: DataFrame, review: float = 0.7) -> DataFrame:
    """(doc_id, page, conf, words, chars, needs_review) of recognised pages; pages without a confidence need review."""
    conf = F.round(F.avg("conf"), 4)
    words = F.size(F.filter(F.split(F.coalesce("line", F.lit("")), r"\s+"), lambda w: w != ""))
    found = page_lines.groupBy("doc_id", "page").agg(conf.alias("conf"), F.sum(words).cast("long").alias("words"), F.sum(F.length(F.coalesce("line", F.lit("")))).cast("long").alias("chars"))
    return found.withColumn("needs_review", F.coalesce(F.col("conf") < review, F.lit(True)))


def cache_key(file_hash: Column, page: Column, engine: Column, lang: Column) -> Column:
    """The key of a recognised page: 16 digits of the file's hash, page, engine and language."""
    return F.concat_ws("_", F.substring(file_hash, 1, 16), page.cast("string"), engine, lang)


def to_recognise(pages: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """pages whose key no cache row has."""
    return pages.join(cache.select(key).distinct(), key, "left_anti")


def review(pages: DataFrame, reviews: DataFrame, key: str = "key") -> DataFrame:
    """pages (key, text, conf) after reviews (key, reviewed, at): the last human text stands, with confidence 1; `original` keeps the read one."""
    last = reviews.groupBy(key).agg(F.max_by("reviewed", F.struct("at", "reviewed")).alias("reviewed"))
    both = pages.join(last, key, "left")
    human = F.col("reviewed").isNotNull()
    return both.withColumns({"original": F.when(human, F.col("text")), "conf": F.when(human, 1.0).otherwise(F.col("conf")), "text": F.coalesce("reviewed", "text")}).drop("reviewed")


def _margins(page_lines: DataFrame, most: int) -> DataFrame:
    """Lines that are not blank, with `top` and `bottom`: a page of three or more has `most` of each, but half of it at the most; of two, one; of one, none."""
    page = Window.partitionBy("doc_id", "page")
    rows = page_lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s", " "))).where("line <> ''")
    rows = rows.withColumns({"_n": F.count("*").over(page), "_at": F.row_number().over(page.orderBy("line_no"))})
    limit = F.when(F.col("_n") >= 3, F.least(F.lit(most), F.floor(F.col("_n") / 2))).when(F.col("_n") == 2, 1).otherwise(0)
    top = F.col("_at") <= limit
    return rows.withColumns({"top": top, "bottom": ~top & (F.col("_at") > F.col("_n") - limit), "_low": F.lower("line")})


def recurring(page_lines: DataFrame, share: float = 0.35, most: int = 2) -> DataFrame:
    """(doc_id, place, low, n): lower-cased lines in the tops or bottoms of max(2, 0.35 of the pages) or more."""
    total = page_lines.groupBy("doc_id").agg(F.count_distinct("page").alias("total"))
    marked = _margins(page_lines, most)
    limit = F.when(F.col("_n") >= 3, F.least(F.lit(most), F.floor(F.col("_n") / 2))).when(F.col("_n") == 2, 1).otherwise(0)
    places = F.filter(F.array(F.when(F.col("top"), "top"), F.when(F.col("_at") > F.col("_n") - limit, "bottom")), lambda p: p.isNotNull())
    counted = marked.select("doc_id", "page", F.explode(places).alias("place"), F.col("_low").alias("low")).groupBy("doc_id", "place", "low").agg(F.count_distinct("page").alias("n"))
    return counted.join(total, "doc_id").where((F.col("total") >= 2) & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("total") * share)))).drop("total")


def clean(page_lines: DataFrame, share: float = 0.35, most: int = 2) -> DataFrame:
    """page_lines without blank lines, recurring margin lines and page numbers in margins."""
    columns = page_lines.columns
    marked = _margins(page_lines, most).withColumn("_place", F.when(F.col("top"), "top").when(F.col("bottom"), "bottom"))
    numbers = F.col("_place").isNotNull() & F.col("line").rlike(PAGE_NUMBER)
    known = recurring(page_lines, share, most).select("doc_id", F.col("place").alias("_place"), F.col("low").alias("_low"))
    return marked.where(~numbers).join(known, ["doc_id", "_place", "_low"], "left_anti").select(*columns)


_WORD_END = re.compile(r"[a-zA-ZÀ-ÿ][-\xad]\s*$")
_LOWER_START = re.compile(r"\s*([a-zà-ÿ]+)(.*)", re.S)
_HEADING = re.compile(rf"\s*(?:{'|'.join(HEADING_WORDS)})\s+([0-9IVXLCDM]+[.:]?.*|[A-ZÀ-ÿ\s]+)\s*$", re.I)
_DONE = re.compile(r"[.?!:][\"'”’)]?$")
_END = re.compile(r"[.?!][\"'”’)]?$")


def _joined(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Lines with words that a line end cut put together; the rest of the second line stays a line."""
    out: list[tuple[int, str]] = []
    for no, line in lines:
        begin = _LOWER_START.match(line) if out and _WORD_END.search(out[-1][1]) else None
        if begin:
            out[-1] = (out[-1][0], re.sub(r"[-\xad]\s*$", "", out[-1][1]) + begin[1])
            line = begin[2].strip()
        if line:
            out.append((no, line))
    return out


def units_of(pages: list[tuple[int, list[tuple[int, str]]]]) -> list[tuple[int, str, int, int, str]]:
    """(chapter, kind, page, line_no, text) in reading order, of one document's clean pages (page, [(line_no, line)]).

    A heading has a chapter's key word and number, or is short and in capitals, but not inside an open sentence. A dash opens
    dialogue unless a sentence is open. A paragraph ends behind a closing mark on a line shorter than 0.72 of the page's longest
    if no lower-case line follows, and at the end of a page where the last line has a closing mark and the page has three lines
    or fewer or that line is short. Otherwise it goes on over the page's end, a word cut there included. What follows a
    cut word on its line stays a line, so a mark behind it gets a blank in front.
    """
    units: list[tuple[int, str, int, int, str]] = []
    held: list[str] = []
    at = (0, 0)
    chapter, filled = 1, False

    def flush() -> None:
        nonlocal filled
        if held:
            units.append((chapter, "paragraph", *at, " ".join(held)))
            held.clear()
            filled = True

    for page, raw in pages:
        lines = _joined(raw)
        if held and lines and _WORD_END.search(held[-1]) and (begin := _LOWER_START.match(lines[0][1])):
            held[-1] = re.sub(r"[-\xad]\s*$", "", held[-1]) + begin[1]
            rest = begin[2].strip()
            lines = [(lines[0][0], rest), *lines[1:]] if rest else lines[1:]
        widest = max((len(t) for _, t in lines), default=80)
        for k, (no, t) in enumerate(lines):
            inside = bool(held) and not _DONE.search(held[-1])
            capitals = len(t) < 50 and t.isupper() and len(t.split()) <= 6 and t[-1] not in "\"'”’,;-—" and not inside
            if _HEADING.match(t) or capitals:
                flush()
                chapter += filled
                units.append((chapter, "heading", page, no, t))
                filled = True
            elif (t[0] in DASHES and len(t.lstrip(DASHES).strip()) > 0 and not inside) or (t[0] in "\"“" and t[-1] in "\"”" and len(t) > 2):
                flush()
                units.append((chapter, "dialogue", page, no, t))
                filled = True
            else:
                if not held:
                    at = (page, no)
                held.append(t)
                if _END.search(t) and len(t) < widest * 0.72 and not (k + 1 < len(lines) and lines[k + 1][1][0].islower()):
                    flush()
        if held and lines and _END.search(held[-1]) and (len(lines) <= 3 or len(held[-1]) < widest * 0.72):
            flush()
    flush()
    return units


def structure(page_lines: DataFrame) -> DataFrame:
    """(doc_id, chapter, ord, kind, page, line_no, text): headings, dialogue and paragraphs of clean()ed lines; see units_of()."""
    ship_package(page_lines.sparkSession)
    field = page_lines.schema["doc_id"]
    rows = page_lines.select("doc_id", F.col("page").cast("int"), F.col("line_no").cast("int"), F.trim(F.coalesce("line", F.lit(""))).alias("line"))

    def run(table: pa.Table) -> pa.Table:
        pages: dict[int, list[tuple[int, str]]] = {}
        for page, no, line in sorted(zip(table["page"].to_pylist(), table["line_no"].to_pylist(), table["line"].to_pylist(), strict=True)):
            if line:
                pages.setdefault(page, []).append((no, line))
        units = units_of(sorted(pages.items()))
        made = [[u[0] for u in units], list(range(1, len(units) + 1)), *([u[k] for u in units] for k in range(1, 5))]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        key = pa.array([table["doc_id"][0].as_py()] * len(units), table["doc_id"].type)
        return pa.Table.from_arrays([key, *(pa.array(m, t) for m, t in zip(made, types, strict=True))], names=["doc_id", "chapter", "ord", "kind", "page", "line_no", "text"])

    return rows.groupBy("doc_id").applyInArrow(run, STRUCTURE.format(key=field.dataType.simpleString()))
