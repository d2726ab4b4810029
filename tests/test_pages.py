"""Pages of lines against results known by reading."""

from lexloom.operators import pages

SCHEMA = "doc_id long, page int, line_no int, line string"


def test_classify_and_route(spark):
    good, bad, short = "a line that is long enough to be a page " * 2, "�" * 50 + "abc", "x" * 39
    rows = [(1, p, 1, good) for p in range(1, 8)] + [(1, 8, 1, bad)]  # 7 of 8 are good
    rows += [(2, 1, 1, good), (2, 2, 1, short), (3, 1, 1, bad), (3, 2, 1, None), (4, 1, 1, good)] + [(4, p, 1, bad) for p in (2, 3, 4, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: (r["pages"], r["good_pages"], r["class"]) for r in pages.classify(df).collect()} == {1: (8, 7, "textual"), 2: (2, 1, "mixed"), 3: (2, 0, "scanned"), 4: (5, 1, "scanned")}
    ways = {(r.doc_id, r.page): r.way for r in pages.route(df).collect()}
    assert ways[1, 8] == "text" and ways[2, 1] == "text" and ways[2, 2] == "ocr" and ways[4, 1] == "ocr"
    assert pages.classify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_margins(spark):
    rows = []
    for p in range(1, 5):
        rows += [(1, p, 1, "My Title"), (1, p, 2, f"body {p} my title"), (1, p, 3, "" if p == 2 else None), (1, p, 4, f"more {p}"), (1, p, 5, "My Title"), (1, p, 6, f"page {p} of 9")]
    rows += [(2, 1, 1, "My Title"), (2, 1, 2, "- iv -"), (3, 1, 1, "12")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.place, r.low, r.n) for r in pages.recurring(df).collect()) == [(1, "bottom", "my title", 4), (1, "top", "my title", 4)]
    left = sorted((r.doc_id, r.page, r.line) for r in pages.clean(df).collect())
    assert left == sorted([(1, p, t) for p in range(1, 5) for t in (f"body {p} my title", f"more {p}")] + [(2, 1, "My Title"), (3, 1, "12")])


def test_structure(spark):
    rows = [
        (1, 1, 1, "CHAPTER IV"), (1, 1, 2, "The weaver went on through the long and win-"), (1, 1, 3, "ding road that led to the old house by the"), (1, 1, 4, "— so they said — sea."),
        (1, 1, 5, "— Who is there?"), (1, 1, 6, "“Nobody.”"), (1, 1, 7, "He turned away from the door and wan-"),
        (1, 2, 1, "dered."), (1, 2, 2, "THE END OF IT"), (1, 2, 3, "A last line that nobody ends"), (1, 2, 4, "NOT A HEADING"), (2, 1, 1, None), (3, 1, 1, ""),
    ]
    got = [(r.chapter, r.ord, r.kind, r.page, r.line_no, r.text) for r in pages.structure(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, 1, "heading", 1, 1, "CHAPTER IV"),
        (1, 2, "paragraph", 1, 2, "The weaver went on through the long and winding road that led to the old house by the — so they said — sea."),
        (1, 3, "dialogue", 1, 5, "— Who is there?"), (1, 4, "dialogue", 1, 6, "“Nobody.”"),
        (1, 5, "paragraph", 1, 7, "He turned away from the door and wandered ."),
        (2, 6, "heading", 2, 2, "THE END OF IT"), (2, 7, "paragraph", 2, 3, "A last line that nobody ends NOT A HEADING"),
    ]


def test_recognised_pages(spark):
    df = spark.createDataFrame([(1, 1, 1, "a b", 0.9), (1, 1, 2, "c", 0.4), (1, 2, 1, None, None), (1, 3, 1, "d", 0.7)], SCHEMA + ", conf double")
    assert sorted((r.page, r.conf, r.words, r.chars, r.needs_review) for r in pages.confidence(df).collect() if r.conf) == [(1, 0.65, 3, 4, True), (3, 0.7, 1, 1, False)]
    assert [r.needs_review for r in pages.confidence(df).where("page = 2").collect()] == [True]
    rows = spark.createDataFrame([("a", "read", 0.5), ("b", "kept", 0.6)], "key string, text string, conf double")
    seen = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("z", "three", 3)], "key string, reviewed string, at int")
    assert sorted((r.key, r.text, r.conf, r.original) for r in pages.review(rows, seen).collect() if r.key) == [("a", "two", 1.0, "read"), ("b", "kept", 0.6, None)]
    assert [r.key for r in pages.to_recognise(rows, seen).collect()] == ["b"]
