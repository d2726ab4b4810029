import pytest
from pyspark.sql import functions as F

from lexloom.operators import qa, segment
from lexloom.sources import files, sinks
from lexloom.streaming import incremental

UNITS = [("heading", 1, "One & two"), ("paragraph", 0, "Some <text> here"), ("heading", 1, "Next"), ("paragraph", 0, "é ü")]


@pytest.mark.parametrize("fmt", ["docx", "epub"])
def test_round_trip(fmt):
    data = sinks.FORMATS[fmt]("title", UNITS)
    assert files.detect("x", data) == fmt
    assert [u for c in files.parse("x", data) for u in c] == UNITS
    assert sinks.FORMATS[fmt]("title", UNITS) == data


def test_formats_agree():
    html = "<html><script>no</script><h1>One</h1><p>a <b>b</b> c<p>d</p></p><ul><li>x</li></ul><img alt='pic'></html>"
    assert files.html_units(html)[:2] == [("heading", 1, "One"), ("paragraph", 0, "a b cd")]
    assert files.markdown_units("# One\n\na b\nc\n\n- x\n![pic](u)\n[^1]: note") == [("heading", 1, "One"), ("paragraph", 0, "a b c"), ("item", 0, "x"), ("image", 0, "pic"), ("footnote", 0, "note")]
    assert files.text_units("CHAPTER I\r\n\r\na\r\nb") == [("heading", 1, "CHAPTER I"), ("paragraph", 0, "a b")]


def test_spans_and_notes():
    html = "<p> a <b>b  <i>c</i></b>d <code>x</code></p><div class='x footnote'>n <a href='u'>l</a></div><li id='footnote-1'>m</li><aside>o</aside>"
    assert files.html_marked(html) == [
        ("paragraph", 0, "a b cd x", [(2, 5, "bold"), (4, 5, "italic"), (7, 8, "code")]), ("footnote", 0, "n l", [(2, 3, "link")]), ("footnote", 0, "m", []), ("footnote", 0, "o", []),
    ]
    marked = "# A **b** c\n\nx *y* `*z*` ~~no~~ [l *i*](u) a_b_c 2 * 3 * 4 **open\n\n[^1]: see __it__"
    assert files.markdown_marked(marked) == [
        ("heading", 1, "A b c", [(2, 3, "bold")]),
        ("paragraph", 0, "x y *z* no l i a_b_c 2 * 3 * 4 **open", [(2, 3, "italic"), (4, 7, "code"), (8, 10, "strikethrough"), (11, 14, "link"), (13, 14, "italic")]),
        ("footnote", 0, "see it", [(4, 6, "bold")]),
    ]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:r><w:t xml:space="preserve"> a </w:t></w:r><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>b</w:t></w:r><w:hyperlink><w:r><w:t>c</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
    notes = '<w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note </w:t></w:r></w:p></w:footnote>'
    data = sinks._pack([("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>", True), ("word/footnotes.xml", f"<w:footnotes {w}>{notes}</w:footnotes>", True)])
    assert files.docx_marked(data) == [("paragraph", 0, "a bc", [(2, 3, "bold"), (3, 4, "link")]), ("footnote", 0, "note", [])]
    assert files.html_marked("<p>x</p><img src='../i/a.png'>", "text")[1] == ("image", 0, "i/a.png", [])


def test_references_without_a_semicolon(spark, tmp_path):
    html = "<html><h1>a&amp;&lt&amp</h1><p>&#39;&#39 &ampx; &nope; &copy; & b"
    assert files.html_units(html) == [("heading", 1, "a&<&"), ("paragraph", 0, "'' &x; &nope; © & b")]
    assert files.plain(files.html_marked(html, bare=False)) == [("heading", 1, "a&&lt&amp"), ("paragraph", 0, "'&#39 &ampx; &nope; © & b")]

    from lexloom.plans.misc import src_html

    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.kind: r.chars for r in src_html(spark, str(tmp_path)).collect()} == {"heading": 9, "paragraph": 25}


def test_marks_are_read_in_linear_time():
    import time

    for mark in ("**a ", "[", "*", "_a ", "`", "~~", "__", "[a](", "<b>"):
        began = time.time()
        files.markdown_marked(mark * 20000)
        files.html_marked("<p>" + "<b>x" * 5000)
        assert time.time() - began < 5, mark


def test_encodings():
    for codec in ("utf-8", "utf-8-sig", "utf-16", "cp1252"):
        assert files.decode("caf\xe9 —".encode(codec)) == "café —"


def test_files_that_do_not_parse(spark):
    rows = [("a.docx", b"PK\x03\x04junk"), ("b.txt", b""), ("c.txt", None), ("d.md", b"# T")]
    out = {r.path: r.kind for r in files.parse_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out == {"a.docx": "error", "b.txt": "error", "c.txt": "error", "d.md": "heading"}


def test_segments_lose_nothing(spark):
    text = "One two. Three four five! " * 80 + "\n\nShort.\nLast " + "word " * 200
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    chunks = segment.chunk_greedy(df).where("doc_id = 1").orderBy("chunk_no").collect()
    assert " ".join(r.chunk for r in chunks).split() == text.split()
    assert all(len(r.chunk.split()) <= 100 or len(r.chunk.split(". ")) == 1 for r in chunks)
    assert segment.segment_chapter(df).where("doc_id = 1").agg(F.sum("words")).first()[0] == len(text.split())


def test_sentences_keep_their_digits(spark):
    text = "0th. 12 men came. 2 left! 33 stayed.\n4 slept? 5"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert df.select(segment.sentences(F.col("text"))).first()[0] == ["0th.", "12 men came.", "2 left!", "33 stayed.", "4 slept?", "5"]
    assert [r.chunk for r in segment.chunk_greedy(df, limit=5).orderBy("chunk_no").collect()] == ["0th. 12 men came.", "2 left! 33 stayed.", "4 slept? 5"]


def test_process_document_keeps_all_words(spark, tmp_path):
    from hashlib import md5

    from lexloom.plans.files import process_document

    text = "Call. 1 800 1. 2381604611877803 is a card of 12. 3"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert process_document(spark, str(tmp_path)).first()["words_md5"] == md5(text.encode()).hexdigest()


def test_process_document_on_odd_characters(spark, tmp_path):
    import duckdb

    from lexloom.plans.files import ORACLES, process_document

    texts = ["one\x01two. Three", "a\x0bb. \x0bC! 4", "x.\x0b\x0bY", "\x01", "\x0b. A", "", " ", None, "q\x02r. S\x00t", "u\x85v.\x85W \u2028 X. \u3000Y", "e.\" F' g.) H. i"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["process_document"]).fetchall())
    assert sorted((r.doc_id, r.words_md5) for r in process_document(spark, str(tmp_path)).collect()) == want


def test_dictionary_join_both_ways(spark):
    df = spark.createDataFrame([(1, "The old House, by Baker Street"), (2, "housing"), (3, None), (4, "house house"), (5, "5 $ a$")], "doc_id long, source string")
    terms = spark.createDataFrame([("house",), ("Baker Street",), ("street",), ("$",)], "term string")
    small, large = (sorted((r.doc_id, r.term) for r in qa.dictionary_join(df, terms, "source", "term", most).collect()) for most in (10**6, 1))
    assert small == large == [(1, "Baker Street"), (1, "house"), (1, "street"), (4, "house"), (5, "$")]


def test_incremental(spark, tmp_path):
    source, cache, state = (str(tmp_path / n) for n in ("in", "cache", "state"))
    upper = lambda df: df.withColumn("target", F.upper("source"))
    schema = "segment_id long, source string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema).write.parquet(source)
    incremental.run_incremental(spark, source, cache, state, schema, upper)
    spark.createDataFrame([(4, "b"), (5, "c")], schema).write.mode("append").parquet(source)
    incremental.run_incremental(spark, source, cache, state, schema, upper)
    assert sorted(r.target for r in spark.read.parquet(cache).collect()) == ["A", "B", "C"]
