"""Writers of documents: units grouped by document become one file's bytes each.

A document's units are one row list, so a document has to fit in a task; files are rows (name, content) that any
Spark sink stores. Zip members have a fixed time, so equal documents give equal bytes.
"""

from __future__ import annotations

import io
import zipfile
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.session import ship_package

Unit = tuple[str, int, str]  # kind, level, text
# The parts that the file formats ask for.
_DOCX_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_DOCX_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _pack(members: list[tuple[str, str, bool]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text, deflate in members:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, text, zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED)
    return out.getvalue()


def to_txt(title: str, units: list[Unit]) -> bytes:
    """Title, then units with blank lines between them; headings are underlined."""
    parts = [f"{title}\n{'=' * len(title)}"]
    parts += [f"{t}\n{'-' * len(t)}" if k == "heading" else t for k, _, t in units]
    return ("\n\n".join(parts) + "\n").encode()


def to_docx(title: str, units: list[Unit]) -> bytes:
    """An OpenXML document; a heading of level 1 begins a page."""
    body = []
    for k, level, t in units:
        style = f'<w:pPr><w:pStyle w:val="Heading{level or 1}"/>{"<w:pageBreakBefore/>" if level == 1 else ""}</w:pPr>' if k == "heading" else ""
        body.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(t, quote=False)}</w:t></w:r></w:p>')
    return _pack([("[Content_Types].xml", _DOCX_TYPES, True), ("_rels/.rels", _DOCX_RELS, True), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>', True)])


def to_epub(title: str, units: list[Unit]) -> bytes:
    """An EPUB 3 with a chapter a heading of level 1; mimetype is stored first."""
    chapters: list[list[Unit]] = [[]]
    for u in units:
        if u[0] == "heading" and u[1] == 1 and chapters[-1]:
            chapters.append([])
        chapters[-1].append(u)
    names = [f"c{k:04d}.xhtml" for k in range(len(chapters))]
    pages = []
    for units_of in chapters:
        blocks = "".join(f"<h{v or 1}>{escape(t)}</h{v or 1}>" if k == "heading" else f"<p>{escape(t)}</p>" for k, v, t in units_of)
        pages.append(f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body>{blocks}</body></html>')
    nav = "".join(f'<li><a href="{n}">{n}</a></li>' for n in names)
    opf = f"""<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="i"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="i">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>und</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{"".join(f'<item id="{n}" href="{n}" media-type="application/xhtml+xml"/>' for n in names)}</manifest><spine>{"".join(f'<itemref idref="{n}"/>' for n in names)}</spine></package>"""
    return _pack([
        ("mimetype", "application/epub+zip", False), ("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="c.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', True),
        ("c.opf", opf, True), ("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>', True),
        *[(n, p, True) for n, p in zip(names, pages, strict=True)],
    ])


FORMATS = {"txt": to_txt, "docx": to_docx, "epub": to_epub}


def render(units: DataFrame, fmt: str, doc_col: str = "doc_id", order_col: str = "ord") -> DataFrame:
    """(name, content) of each document of units (doc, order, kind, level, text)."""
    ship_package(units.sparkSession)
    write = FORMATS[fmt]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["o"])
        name = str(rows[0]["d"])
        content = write(name, [(r["kind"], r["level"] or 0, r["text"] or "") for r in rows])
        return pa.Table.from_pydict({"name": [f"{name}.{fmt}"], "content": [content]}, pa.schema([("name", pa.string()), ("content", pa.binary())]))

    rows = units.selectExpr(f"`{doc_col}` AS d", f"CAST(`{order_col}` AS BIGINT) AS o", "kind", "level", "text")
    return rows.groupBy("d").applyInArrow(run, "name string, content binary")
