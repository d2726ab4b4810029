import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import language as lg


def brute_grams(text):
    import unicodedata

    out, word = Counter(), ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            w = f"_{word}_"
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    g = w[i : i + n]
                    if g != "_":
                        out[g] += 1
            word = ""
    return out


def decode(code):
    s = ""
    while code:
        s = chr(code & (1 << 21) - 1) + s
        code >>= 21
    return s


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abÉß 1.日\n𝒜İ", max_size=60))
def test_grams_and_ranks(text):
    codes, counts = lg.gram_counts(text)
    got = {decode(c): n for c, n in zip(codes.tolist(), counts.tolist(), strict=True)}
    want = brute_grams(text)
    # a boundary between two words counts once for both
    assert {g: n for g, n in got.items() if "_" not in g} == {g: n for g, n in want.items() if "_" not in g}
    assert set(got) >= set(want) - {g for g in want if g.startswith("_") or g.endswith("_")}
    ranks = lg.ranked(codes, counts, 5).tolist()
    assert ranks == [c for _, c in sorted(zip((-counts).tolist(), codes.tolist(), strict=True))][:5]


def test_blocks_do_not_matter(monkeypatch):
    text = "some words éà in a row, " * 50
    one = lg.gram_counts(text)
    monkeypatch.setattr(lg, "_BLOCK", 17)
    many = lg.gram_counts(text)
    assert (one[0] == many[0]).all()


def test_distance_is_out_of_place():
    p = lg.Profiles({"x": lg.ranked(*lg.gram_counts("aaa b")), "y": lg.ranked(*lg.gram_counts("zz"))})
    own = lg.ranked(*lg.gram_counts("ba"))
    ranks = lg.ranked(*lg.gram_counts("aaa b")).tolist()
    want = sum(abs(ranks.index(c) - k) if c in ranks else lg.TOP for k, c in enumerate(own.tolist()))
    assert p.distances("ba")[0] == want and p.predict("ba")[0] == "x"


def make(spark):
    rng = random.Random(4)
    parts = {"de": ["ung", "sch", "der", "keit", "ü"], "fr": ["eau", "les", "qué", "ou", "tion"]}
    rows = []
    for k in range(300):
        lang = rng.choice(["de", "fr"])
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(4, 60))), lang, "clash"))
    rows += [(1000, None, "de", "c"), (1001, "", "de", "c"), (1002, "123 !?", "fr", "c"), (None, "schung derkeit", None, "c"), (1003, "eautionles " * 60_000, "fr", "c"), (1003, "dup", None, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_query(spark):
    docs = make(spark)
    profiles = lg.train(docs, F.col("doc_id") % 4 != 2)
    rows = lg.identify(docs, profiles).collect()
    assert len(rows) == 306 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id is not None and r.doc_id < 300)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), "und")
    assert next(r for r in rows if r.doc_id is None).lang_pred == "de"
    assert lg.identify(docs.limit(0), profiles).count() == 0
    none = lg.train(docs, F.lit(False))
    assert {r.lang_pred for r in lg.identify(docs, none).collect()} == {"und"}


def test_letters_of_all_planes():
    p = lg.Profiles({"x": lg.ranked(*lg.gram_counts("abc"))})
    assert p.predict(chr(0x30000) + chr(0x31350))[0] == "x" and p.predict("12 \u0301")[0] == "und"


def test_dirty_languages(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text of words ', id % 7) AS text", "CASE WHEN id % 3 = 0 THEN 'en' ELSE concat('x', id) END AS lang")
    profiles = lg.train(docs, F.lit(True), sample=100, most=10)
    assert len(profiles.names) <= 10 and "en" in profiles.names
    hot = spark.range(5000).selectExpr("7L AS doc_id", "'the same text' AS text", "'en' AS lang")
    assert lg.train(hot, F.lit(True), sample=50).names in ([], ["en"])
