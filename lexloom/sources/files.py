"""Readers of document files: any store that Spark's binaryFile reads, one row a file, then units in reading order.

A unit is (path, chapter, ord, kind, level, text, spans); a span is a part of the text, end exclusive, that is bold, italic and so on.
Parsing is a function of one file's bytes, so files are the grain of parallelism and a lost task is repeated by itself. Files that
do not parse become one unit of kind `error`.
"""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import ship_package

UNITS = "path string, chapter int, ord int, kind string, level int, text string, spans array<struct<start:int,end:int,style:string>>"
_TYPES = pa.schema([("path", pa.string()), ("chapter", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("style", pa.string())])))])
MAX_BYTES = 100 << 20
#: Of a zip's members: together at most this many bytes, so that a small file cannot unpack into a large one.
MAX_UNPACKED = 500 << 20
_BLOCKS = {"p", "li", "blockquote", "aside", "h1", "h2", "h3", "h4", "h5", "h6"}

# Elements and what they make of a text.
STYLES = {"i": "italic", "em": "italic", "b": "bold", "strong": "bold", "u": "underline", "s": "strikethrough", "strike": "strikethrough", "del": "strikethrough", "code": "code", "a": "link"}

Unit = tuple[str, int, str]  # kind, level, text
Span = tuple[int, int, str]  # start, end, style
Marked = tuple[str, int, str, list[Span]]  # a unit with its spans


def plain(units: list[Marked]) -> list[Unit]:
    """Units without their spans."""
    return [u[:3] for u in units]


def collapse(parts: list[tuple[str, tuple[str, ...]]]) -> tuple[str, list[Span]]:
    """Runs (text, styles) as one text with single blanks, and its spans in order of start, end and style; runs of a style that touch are one."""
    out: list[str] = []
    open_at: dict[str, list[int]] = {}
    spans: list[Span] = []
    size, gap = 0, False
    for data, styles in parts:
        words = data.split()
        if not words:
            gap = gap or bool(data)
            continue
        lead = 1 if size and (gap or data[0].isspace()) else 0
        body = " ".join(words)
        out.append(" " * lead + body)
        start, size = size + lead, size + lead + len(body)
        for style in set(styles):
            last = open_at.get(style)
            if last and last[1] in (start, start - lead):
                last[1] = size
            else:
                if last:
                    spans.append((last[0], last[1], style))
                open_at[style] = [start, size]
        gap = data[-1].isspace()
    spans += [(a, b, style) for style, (a, b) in open_at.items()]
    return "".join(out), sorted(spans)


def decode(data: bytes) -> str:
    """Text by byte order mark, else strict UTF-8, else Windows-1252 with Latin-1 for what it lacks."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(codec, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        try:
            return data.decode("cp1252")
        except UnicodeDecodeError:
            return data.decode("latin-1")


def normalise(text: str, form: str = "NFC") -> str:
    """Line ends as \\n, a normal form, no control characters but \\n and tab, no invisible ones."""
    text = unicodedata.normalize(form, text.replace("\r\n", "\n").replace("\r", "\n"))
    return "".join(c for c in text if c in "\n\t" or (unicodedata.category(c) != "Cc" and c not in "​‌‍‎‏﻿"))


class _Html(HTMLParser):
    """Block elements in document order; scripts and styles are left out; nested blocks belong to the outer one.

    An aside is a footnote, and so is a block or division whose class, id, role or epub:type says so.
    """

    def __init__(self, base: str = ""):
        super().__init__(convert_charrefs=True)
        self.units: list[Marked] = []
        self.base = base
        self.open: str | None = None
        self.kind = ""
        self.depth = self.skip = 0
        self.parts: list[tuple[str, tuple[str, ...]]] = []
        self.inline: list[str] = []

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        note = tag == "aside" or "footnote" in at.get("class", "").split() or "footnote" in at.get("id", "").lower() or "footnote" in at.get("epub:type", "") + at.get("role", "")
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "img":
            src = at.get("src", "")
            self.units.append(("image", 0, at.get("alt") or (posixpath.normpath(posixpath.join(self.base, src)) if self.base and src else src), []))
        elif self.open == tag:
            self.depth += 1
        elif self.open is None and (tag in _BLOCKS or (tag == "div" and note)):
            self.open, self.depth, self.parts, self.inline = tag, 1, [], []
            self.kind = "footnote" if note else "heading" if tag[0] == "h" else "item" if tag == "li" else "paragraph"
        elif self.open and tag in STYLES:
            self.inline.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.open:
            self.depth -= 1
            if not self.depth:
                self._end()
        elif tag in self.inline:
            del self.inline[len(self.inline) - 1 - self.inline[::-1].index(tag)]

    def handle_data(self, data):
        if self.open and not self.skip:
            self.parts.append((data, tuple(STYLES[t] for t in self.inline)))

    def _end(self):
        tag, (text, spans) = self.open, collapse(self.parts)
        self.open = None
        if text:
            self.units.append((self.kind, int(tag[1]) if self.kind == "heading" else 0, text, spans))

    def close(self):
        super().close()
        if self.open:
            self._end()


_AMPERSAND = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")


def closed_references(text: str) -> str:
    """HTML in which only references that a semicolon closes, and whose name is known, still are references."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[0][1:]}", text)


def html_marked(text: str, base: str = "", bare: bool = True) -> list[Marked]:
    """Units of an HTML text; paths of images are resolved against base, if given. bare: references without a semicolon count, as in browsers."""
    p = _Html(base)
    p.feed(text if bare else closed_references(text))
    p.close()
    return p.units


def html_units(text: str) -> list[Unit]:
    """Units of an HTML text, without spans."""
    return plain(html_marked(text))


def text_units(text: str) -> list[Unit]:
    """Paragraphs between blank lines; CHAPTER lines are headings."""
    units: list[Unit] = []
    for block in normalise(text).split("\n\n"):
        joined = " ".join(block.split())
        if joined:
            heading = joined.upper().startswith(("CHAPTER ", "CAPÍTULO ")) and len(joined) <= 120
            units.append(("heading", 1, joined) if heading else ("paragraph", 0, joined))
    return units


#: Marks inside a line; each group is the marked text. Every alternative stops at its own mark, so a line is read in linear time.
_INLINE = re.compile(r"`([^`]+)`|\*\*((?:[^*]|\*(?!\*))+)\*\*|__((?:[^_]|_(?!_))+)__|~~([^~]+)~~|\*([^*\s][^*]*)\*|(?<!\w)_([^_\s][^_]*)_(?!\w)|(?<!!)\[([^\[\]]*)\]\([^()]*\)")
_INLINE_STYLES = ("code", "bold", "bold", "strikethrough", "italic", "italic", "link")


def inline_runs(text: str, styles: tuple[str, ...] = ()) -> list[tuple[str, tuple[str, ...]]]:
    """A marked line as runs (text, styles); marks within marks are read, but for code."""
    runs, at = [], 0
    for m in _INLINE.finditer(text):
        runs.append((text[at : m.start()], styles))
        style = _INLINE_STYLES[m.lastindex - 1]
        runs += [(m[1], (*styles, style))] if style == "code" else inline_runs(m[m.lastindex], (*styles, style))
        at = m.end()
    return [r for r in [*runs, (text[at:], styles)] if r[0]]


def markdown_marked(text: str) -> list[Marked]:
    """Headings, footnotes, images, items and paragraphs of marked text."""
    units: list[Marked] = []
    held: list[str] = []

    def add(kind: str, level: int, raw: str) -> None:
        units.append((kind, level, *collapse(inline_runs(raw))))

    def flush() -> None:
        if held:
            add("paragraph", 0, " ".join(held))
            held.clear()

    for line in [*normalise(text).split("\n"), ""]:
        s = line.strip()
        marks = len(s) - len(s.lstrip("#"))
        if 1 <= marks <= 6 and s[marks : marks + 1] == " ":
            flush()
            add("heading", marks, s[marks:].strip())
        elif s.startswith("[^") and "]:" in s:
            flush()
            add("footnote", 0, s.partition("]:")[2].strip())
        elif s.startswith("![") and "](" in s:
            flush()
            units.append(("image", 0, s[2:].partition("](")[0], []))
        elif s.startswith(("- ", "* ", "+ ")):
            flush()
            add("item", 0, s[2:].strip())
        elif not s:
            flush()
        else:
            held.append(s)
    return units


def markdown_units(text: str) -> list[Unit]:
    """Units of marked text, without spans."""
    return plain(markdown_marked(text))


def _zip(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED or any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in z.infolist()):
        raise ValueError("unsafe archive")
    return z


def _xml(data: bytes) -> ET.Element:
    if b"<!ENTITY" in data:
        raise ValueError("entities are not read")
    return ET.fromstring(data)


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


_RUN_STYLES = {"b": "bold", "i": "italic", "u": "underline", "strike": "strikethrough"}


def _val(e: ET.Element, name: str = "val") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def _run_text(run: ET.Element) -> str:
    return "".join((t.text or "") if _name(t) == "t" else "\t" if _name(t) == "tab" else "" for t in run.iter())


def _runs(node: ET.Element, styles: tuple[str, ...] = ()) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Runs (text, styles) below a paragraph; those of a hyperlink are links."""
    for child in node:
        if _name(child) == "r":
            own = tuple(_RUN_STYLES[_name(e)] for p in child if _name(p) == "rPr" for e in p if _name(e) in _RUN_STYLES and _val(e) not in ("0", "false", "none"))
            yield _run_text(child), (*styles, *own)
        elif _name(child) not in ("pPr", "p"):
            yield from _runs(child, (*styles, "link") if _name(child) == "hyperlink" else styles)


def docx_marked(data: bytes) -> list[Marked]:
    """Paragraphs and headings of a DOCX body, tables included, each followed by the footnotes it refers to."""
    z = _zip(data)
    notes: dict[str, str] = {}
    if "word/footnotes.xml" in z.namelist():
        for n in (e for e in _xml(z.read("word/footnotes.xml")).iter() if _name(e) == "footnote" and not _val(e, "type")):
            notes[_val(n, "id")] = " ".join(_run_text(n).split())
    units: list[Marked] = []
    for p in (e for e in _xml(z.read("word/document.xml")).iter() if _name(e) == "p"):
        text, spans = collapse(list(_runs(p)))
        style = next((_val(e) for e in p.iter() if _name(e) == "pStyle"), "").lower()
        heading = any(w in style for w in ("heading", "titulo", "title"))
        if text:
            level = next((int(c) for c in style if c in "123456"), 1)
            units.append(("heading", level, text, spans) if heading else ("paragraph", 0, text, spans))
        units += [("footnote", 0, notes[k], []) for k in (_val(e, "id") for e in p.iter() if _name(e) == "footnoteReference") if notes.get(k)]
    return units


def docx_units(data: bytes) -> list[Unit]:
    """Units of a DOCX body, without spans."""
    return plain(docx_marked(data))


def epub_marked(data: bytes) -> list[list[Marked]]:
    """Units of each spine item of an EPUB; navigation is left out."""
    z = _zip(data)
    opf = next(e.attrib["full-path"] for e in _xml(z.read("META-INF/container.xml")).iter() if _name(e) == "rootfile")
    root, base = _xml(z.read(opf)), posixpath.dirname(opf)
    items = {e.attrib["id"]: e.attrib for e in root.iter() if _name(e) == "item"}
    spine = next(e for e in root.iter() if _name(e) == "spine")
    out = []
    for ref in (e.attrib["idref"] for e in spine if _name(e) == "itemref"):
        item = items.get(ref)
        if item and "nav" not in item.get("properties", "").split() and item["href"] not in ("nav.xhtml", "toc.ncx") and ref != spine.attrib.get("toc"):
            at = posixpath.normpath(posixpath.join(base, item["href"]))
            out.append(html_marked(decode(z.read(at)), posixpath.dirname(at) or "."))
    return out


def epub_units(data: bytes) -> list[list[Unit]]:
    """Units of each spine item, without spans."""
    return [plain(units) for units in epub_marked(data)]


def detect(name: str, data: bytes) -> str:
    """Format by magic bytes, else by content, else by extension."""
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(b"PK\x03\x04"):
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        return "docx" if "word/document.xml" in names else "epub" if "META-INF/container.xml" in names else "zip"
    head = data[:4096].lower()
    if b"<html" in head or b"<!doctype html" in head:
        return "html"
    return "markdown" if name.lower().endswith((".md", ".markdown")) else "txt"


def parse_marked(name: str, data: bytes, bare: bool = True) -> list[list[Marked]]:
    """Chapters of units of one file, with spans. bare: as in html_marked, for HTML files."""
    kind = detect(name, data)
    if kind == "epub":
        return epub_marked(data)
    readers = {"html": lambda text: html_marked(text, bare=bare), "markdown": markdown_marked, "txt": lambda text: [(*u, []) for u in text_units(text)]}
    if kind != "docx" and kind not in readers:
        raise ValueError(f"no reader for {kind}")
    units = docx_marked(data) if kind == "docx" else readers[kind](decode(data))
    chapters: list[list[Marked]] = [[]]
    for u in units:
        if u[0] == "heading" and u[1] == 1 and chapters[-1]:
            chapters.append([])
        chapters[-1].append(u)
    return chapters


def parse(name: str, data: bytes) -> list[list[Unit]]:
    """Chapters of units of one file."""
    return [plain(units) for units in parse_marked(name, data)]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Units of all files under a path; empty files and those over 100 MB are errors."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def parse_files(files: DataFrame, bare: bool = True) -> DataFrame:
    """Units of rows (path, content). bare: as in html_marked, for HTML files."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if not data or len(data) > MAX_BYTES:
                        raise ValueError("empty or too large")
                    rows = [(path, c, o, *u) for c, units in enumerate(parse_marked(path or "", bytes(data), bare)) for o, u in enumerate(units)]
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ET.ParseError) as e:
                    rows = [(path, 0, 0, "error", 0, f"{type(e).__name__}: {e}", [])]
                rows = [(*r[:6], [{"start": a, "end": b, "style": style} for a, b, style in r[6]]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_TYPES)], schema=_TYPES)

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, UNITS)
