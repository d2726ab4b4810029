import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, items, n=13):
    w = words(doc)
    hit, seen = set(), set()
    for i, t in items:
        x = words(t)
        size = min(n, len(x))
        for a in range(len(x) - size + 1) if x else ():
            for p in range(len(w) - size + 1):
                if w[p : p + size] == x[a : a + size]:
                    hit |= set(range(p, p + size))
                    seen.add(i)
    return len(w), len(hit), sorted(seen)


text = st.text(alphabet="abAB é0.-\n", max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(text, min_size=1, max_size=4), st.lists(text, min_size=1, max_size=3), st.integers(1, 4))
def test_scan_is_brute_force(docs, items, n):
    import pyarrow as pa

    named = [(str(k), t) for k, t in enumerate(items)]
    grams = dc.NgramSet(named, n)
    got = []
    for _, data, bounds in dc.tv.text_slices(pa.array(docs), limit=30):
        got += grams.scan(data, bounds)
    assert [(c, sum(b - a for a, b in s), i) for c, s, i in got] == [brute(d, named, n) for d in docs]


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def frames(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(7, LONG.upper()), (8, "short item"), (None, None), (9, ""), (10, "short item")], "item_id long, text string")
    return docs, items


ROWS = [(1, "x " * 20 + LONG + " y", "a"), (2, None, "a"), (3, "", "a"), (4, "a SHORT, item", "a"), (4, "a SHORT, item", "a"), (None, "clean text " * 40, "a"), (5, "pad " * 400 + "short item", "a")]


def test_judge(spark):
    docs, items = frames(spark, ROWS)
    rows = {r.doc_id: r for r in dc.judge(dc.find_hits(docs, items)).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].n_items, rows[1].contaminated) == (35, 14, 1, True)
    assert (rows[2].n_words, rows[2].n_hit, rows[2].contaminated) == (0, 0, False)
    assert rows[4].n_hit == 2 and rows[4].items_sha256 == dc.digest_sha256(["10", "8"])
    assert rows[5].n_hit == 2 and not rows[5].contaminated
    kept = sorted(str(r.doc_id) for r in dc.drop_contaminated(docs, items).collect())
    assert kept == ["2", "3", "5", "None"]


def test_blocks_give_the_same(spark):
    docs, items = frames(spark, ROWS)
    one, many = (sorted(map(str, dc.judge(dc.find_hits(docs, items, block_bytes=k)).collect())) for k in (10**6, 1))
    assert one == many


def test_empty_tables(spark):
    docs, items = frames(spark, ROWS)
    assert dc.judge(dc.find_hits(docs.limit(0), items)).count() == 0
    assert dc.judge(dc.find_hits(docs, items.limit(0))).where(F.col("n_hit") > 0).count() == 0


def test_remove_spans():
    assert dc.remove_spans("Aé b, c d!", [(1, 3)]) == "Aé  d!"


def test_own_columns_stay(spark):
    docs, items = frames(spark, ROWS)
    docs = docs.selectExpr("doc_id", "n_words", "text", "7L AS hits", "true AS contaminated", "'r' AS row", "1 AS n_hit")
    for block in (10**6, 1):
        kept = dc.drop_contaminated(docs, items, block_bytes=block)
        assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id IS NULL OR doc_id IN (2, 3, 5)").collect()))
    cut = dc.drop_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert {r.doc_id: r.text for r in cut.collect() if r.doc_id in (2, 4)} == {2: None, 4: "a "}


def test_equal_windows_of_many_items():
    import pyarrow as pa

    grams = dc.NgramSet([(str(k), "a b " + LONG) for k in range(5)] + [("x", None)])
    _, data, bounds = next(iter(dc.tv.text_slices(pa.array([LONG + " z", "z"]))))
    assert grams.scan(data, bounds) == [(15, [(0, 14)], list("01234")), (1, [], [])]
