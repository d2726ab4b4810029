"""Queries against brute force in Python, on rows whose defects lie in the body of a document, not in the head before it."""

import math
import re
from collections import Counter

import pytest

from lexloom import registry
from lexloom.operators import semantic
from lexloom.plans import fixtures as fx
from lexloom.plans import misc
from lexloom.plans.text import HEAD

BODY = {0: "All quiet.", 3: "At the end the doctor came. O doctor chegou, né.", 11: "“So you are home” he said.\nActually the masterpiece was sold. Atualmente um bom trabalho.", 14: "Count Count again.", 20: "guilty, yet inocente"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, t, "en", "s", len(t)) for i, t in BODY.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(2, "a passage of the memory")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows(spark, sf, name):
    return [r.asDict() for r in registry.queries()[name](spark, sf).collect()]


def whole(k):
    return tuple(f"{head}\n{BODY[k]}" for head in fx.PAIRS[k % len(fx.PAIRS)])


def test_bodies_are_checked(spark, sf):
    assert {r["doc_id"] for r in rows(spark, sf, "sem_register")} == {3}
    assert {(3, "doctor")} <= {(r["doc_id"], r["en"]) for r in rows(spark, sf, "style_titles")}
    assert {(11, "actually")} <= {(r["doc_id"], r["found"]) for r in rows(spark, sf, "sem_false_friend")}
    assert {(11, "masterpiece")} <= {(r["doc_id"], r["found"]) for r in rows(spark, sf, "sem_intensity")}
    assert {(20, "guilty")} <= {(r["doc_id"], r["found"]) for r in rows(spark, sf, "sem_antonym")}


def similarity(a, b):
    """Cosine of the counts of characters by code modulo 32 and of three for each anchor word."""

    def vector(x):
        words, out = set(re.findall(r"\w+", x.lower())), Counter(ord(c) % semantic.BINS for c in x.lower())
        for k, (en, pt) in enumerate(semantic.ANCHORS.items()):
            if words & {en, *pt.split()}:
                out[semantic.BINS + k] = semantic.ANCHOR_WEIGHT
        return out

    x, y = vector(a), vector(b)
    return sum(x[k] * y[k] for k in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_divergence(spark, sf):
    got = {r["doc_id"]: (r["similarity"], r["divergent"]) for r in rows(spark, sf, "sem_divergence")}
    want = {k: similarity(*whole(k)) for k in BODY}
    assert {k: x for k, (x, _) in got.items()} == pytest.approx(want, abs=1e-5)
    assert all(d == (want[k] < 0.55 and len(whole(k)[0].split()) > 3) for k, (_, d) in got.items())


def brute_chrf(source, target, orders, beta=2):
    found = []
    for n in range(1, orders + 1):
        s, t = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (source.replace(" ", ""), target.replace(" ", "")))
        m = (s & t).total()
        p, r = m / t.total(), m / s.total()
        found.append((1 + beta**2) * p * r / (beta**2 * p + r) if m else 0)
    return sum(found) / orders


def test_chrf(spark, sf):
    got = {r["doc_id"]: r["chrf"] for r in rows(spark, sf, "bench_chrf6")}
    assert got == pytest.approx({k: brute_chrf(*whole(k), 6) for k in BODY}, abs=2e-6)


def back(k):
    """The target's words by the dictionary the other way."""
    return re.sub("[A-Za-z]+", lambda m: misc.Reverse.words.get(m[0].lower(), m[0]), whole(k)[1])


def pooled_chrf(a, b, orders=4, beta=2):
    x, y = (Counter(t[i : i + n] for n in range(1, orders + 1) for i in range(len(t) - n + 1)) for t in (a.strip().lower(), b.strip().lower()))
    p, r = (x & y).total() / y.total(), (x & y).total() / x.total()
    return (1 + beta**2) * p * r / (beta**2 * p + r)


def test_back_translations_are_whole(spark, sf):
    assert any(back(k) != whole(k)[1] for k in BODY)
    assert {r["doc_id"]: r["chrf"] for r in rows(spark, sf, "bt_chrf")} == pytest.approx({k: pooled_chrf(whole(k)[0], back(k)) for k in BODY}, abs=2e-6)
    assert {r["doc_id"]: r["f1"] for r in rows(spark, sf, "bt_token_f1")} == pytest.approx({k: f1(whole(k)[0], back(k)) for k in BODY}, abs=2e-6)


def test_candidates_are_whole(spark, sf):
    assert all(r["target"] in (whole(r["doc_id"])[1], whole(r["doc_id"])[0], " ".join([whole(r["doc_id"])[1]] * 2), whole(r["doc_id"])[1][:15]) for r in rows(spark, sf, "selected_candidate"))


def f1(source, target):
    a, b = (Counter(re.findall(r"\w+", x.lower())) for x in (source, target))
    return 2 * (a & b).total() / (a.total() + b.total())


LINES = {1: "He said ‘no’ and “yes”.\nthe inter-\nnational and self-\nmade man: a ninety-\n  nine", 2: "a:b/c*d  e..f\n“x”-\nCo-\noperate"}


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in LINES.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.range(1).write.parquet(f"{d}/part.parquet")  # a head line has the word, so the dialect looks for the table
    return d


def book():
    """(doc_id, line_no, line) with the constant lines in front."""
    return [(i, n, x) for i, t in LINES.items() for n, x in [*HEAD, *enumerate(t.split("\n"), 1)]]


def test_quotes_of_all_lines(spark, lines):
    table = str.maketrans("“”‘’", "\"\"''")
    assert sorted(tuple(r.values()) for r in rows(spark, lines, "norm_quotes")) == sorted((i, n, x.translate(table)) for i, n, x in book())


def test_safe_names_of_all_lines(spark, lines):
    safe = lambda x: re.sub(r"\.\.+", ".", re.sub(r"(?a)\s+", "_", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "", x)))[:120]
    assert sorted(tuple(r.values()) for r in rows(spark, lines, "sink_safe_name")) == sorted((i, n, safe(x)) for i, n, x in book())


def test_hyphens_of_all_lines(spark, lines):
    got = {r["doc_id"]: r["t"] for r in rows(spark, lines, "dehyphenate")}
    assert got[1].endswith("the international and self-made man: a ninety-nine")
    assert got[2].endswith("a:b/c*d  e..f\n“x”-\nCooperate")  # as before, prefixes are looked for in lower case only
    assert all("the international and well-known road" in x for x in got.values())


def test_repetition_counts_groups(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("groups"))
    docs = [(i, "Header\n" * (i < 7) + "pair\n" * (i < 2) + f"own {i}", "en", "big") for i in range(10)]
    docs += [(10 + i, "Small\nlong " + "x" * 100, "en", "two") for i in range(2)] + [(20 + i, "none", "en", None) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    total, seen = Counter(s for *_, s in docs), Counter((s, x) for _, t, _, s in docs for x in {x.lower() for x in t.split("\n") if x and len(x) <= 100})
    drop = {k: n for k, n in seen.items() if n >= max(2, int(total[k[0]] * 0.6))}
    assert drop == {("big", "header"): 7, ("two", "small"): 2, (None, "none"): 3}
    assert sorted((r["source"] or "", r["groups"]) for r in rows(spark, d, "repetition_detect")) == sorted((s or "", n) for (s, _), n in drop.items())
    want = Counter(i for i, t, _, s in docs for x in t.split("\n") if (s, x.lower()) not in drop)
    assert {r["doc_id"]: r["n"] for r in rows(spark, d, "repetition_filter")} == want


def test_memory_search_of_short_lines(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("memory"))
    text, terms = "old house\n\nthe old house stands\nroad", {3: "old house", 5: "the old house stands here", 1: "road"}
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(terms.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    inside = lambda x, y: re.search(rf"\b{re.escape(x)}\b", y) is not None
    want = {(1, n, t, "exact" if x == y else "partial") for n, x in enumerate(text.split("\n"), 1) for t, y in terms.items() if t >= 3 and x and (inside(x, y) or inside(y, x))}
    assert {tuple(r.values()) for r in rows(spark, d, "tm_search")} == want
    assert len(want) == 4


def test_scores_join_every_entry(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("entries"))
    memory = {2: "a locked passage", 3: "an open passage", 4: "another locked one"}
    texts = {9: "The house of der Mann. a locked passage, an open passage", 29: "Doctor Watson and Ann left: another locked one.", 49: "under warehouses"}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(memory.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    has = lambda x, t: re.search(rf"\b{re.escape(t.lower())}\b", x.lower()) is not None
    want = {}
    for i, text in texts.items():
        s, t = (f"{h}\n{text}" for h in fx.PAIRS[i % len(fx.PAIRS)])
        for cand, target in [(1, t), (2, s), (3, f"{t} {t}")] + [(4, t[:15])] * (i % 2 == 0):
            terms = sum(0.4 * (not has(target, y)) + 0.35 * (has(target, x) and x.lower() != y.lower()) for _, x, y, _, locked, aliases in fx.GLOSSARY if locked and any(has(s, a) for a in [x, *filter(None, aliases.split("|"))]))
            kept = sum(0.2 * (not has(target, x if k % 3 == 0 else f"pt {x}")) for k, x in memory.items() if k % 2 == 0 and has(text, x))
            names = 0
            for _, name, aliases, _ in fx.CHARACTERS:
                parts = [w for w in name.lower().split() if len(w) > 2]
                if len(name.split()) > 1 and any(has(s, a) for a in [name, *filter(None, aliases.split("|"))]):
                    names += 0.15 * (0 < sum(w in target.lower() for w in parts) < len(parts))
            want[i, cand] = [max(0, 1 - x) for x in (terms, kept, names)]
    assert {x for row in want.values() for x in row} > {1}
    for at, name in enumerate(("rank_terminology", "rank_consistency", "rank_character")):
        assert {(r["doc_id"], r["cand"]): r["score"] for r in rows(spark, d, name)} == pytest.approx({k: v[at] for k, v in want.items()})
