import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same = sets[a][0] is not None and sets[a][0] == sets[b][0] and x and y
            if x and y and None not in (sets[a][0], sets[b][0]) and (same or 100 * len(x & y) >= 75 * len(x | y)):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), None if i is None else least[find(a)]) for a, (i, s) in enumerate(sets)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.components(df).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passage = [word() for _ in range(60)]
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice((3, 6, 30, 90, 200)))]
        for _ in range(rng.choice((1, 2, 5, 25))):
            x = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 9))):
                x[rng.randrange(len(x))] = word()
            if rng.random() < 0.2:
                x = passage + x
            if rng.random() < 0.2:
                x = x[: len(x) * 5 // 6 + 1]
            rows.append((len(rows) + family * 100, rng.choice((" ", "\n", " \t ")).join(x).upper() if rng.random() < 0.3 else " ".join(x)))
    rows += [(9001, None), (9002, ""), (9003, " \n "), (None, rows[0][1]), (9004, rows[5][1]), (9004, rows[5][1]), (9005, "a b c"), (3, "A b\tc"), (9006, "w " * 30_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_keep_one(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words here"), (3, "other words here"), (3, "one id but another text"), (None, "a b c d e f g"), (None, "no id and no copy"), (4, ""), (4, "")]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, _keep long, component_id string")
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r._keep for r in kept.collect())) == [0, 2, 4, 6, 7, 8]
    plain = docs.where("_keep IN (0, 1, 2, 7)")
    assert sorted(r._keep for r in nj.keep_one(plain).collect()) == [0, 2, 7]
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "_keep")
    assert sorted(r._keep for r in nj.keep_one(named).collect()) == [0, 2, 4, 6, 7, 8]


def test_named_documents(spark):
    docs = spark.createDataFrame([("b", "a b c d e f"), ("a", "A b c d e f"), ("c", "x"), (None, "y z"), ("d", None)], "doc_id string, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.components(docs).collect()), key=str)
    assert got == [("a", 2, "a"), ("b", 2, "a"), ("c", 1, "c"), ("d", 0, "d"), (None, 1, None)]


@pytest.mark.parametrize("block", [2, 256])
def test_links_are_brute_force(spark, block):
    rows = [r for r in {i: (i, t) for i, t in corpus(3) if i is not None}.values()]
    found, members = nj.links(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    sets = {i: shingles(t) for i, t in rows}
    words = {i: tuple(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows}
    first = {}
    for i in sorted(words):
        first.setdefault(words[i], i)
    own = {i: first[words[i]] for i in words if words[i]}
    assert {r.doc_id: r.representative for r in members.collect()} == own
    reps = sorted(set(own.values()))
    want = {(a, b, len(sets[a] & sets[b])) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [(r.a, r.b, r.overlap) for r in found.collect()]
    assert len(got) == len(set(got)) and {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want} and set(got) == want


def test_frequent_columns_and_keys(spark, monkeypatch):
    """Copies, near copies and a passage in every text, with every key taken for a hot one."""
    monkeypatch.setattr(nj, "_HOT", 3)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(30))
    base = [f"w{k}" for k in range(60)]
    rows = [(k, passage + " " + " ".join(base if k % 3 == 0 else base[: rng.randrange(40, 60)] if k % 3 == 1 else [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 30))])) for k in range(400)] + [(1000 + k, None) for k in range(50)]
    assert run(spark, rows) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abB \n\té", max_size=40), min_size=1, max_size=5))
def test_sets(texts):
    import numpy as np
    import pyarrow as pa

    sizes, keys, pairs = [], [], {}
    base = 0
    for _, data, bounds in nj.tv.text_slices(pa.array(texts), limit=25):
        h, text, n, k = nj.shingle_sets(data, bounds)
        for x in range(n.size):
            pairs[base + x] = set(h[text == x].tolist())
        sizes += n.tolist()
        keys += k
        base += n.size
        assert (np.diff(h.astype(object)) >= 0).all()
    assert sizes == [len(shingles(t)) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            assert len(pairs[a] & pairs[b]) == len(shingles(texts[a]) & shingles(texts[b]))
            low = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[x])) for x in (a, b)]
            assert (keys[a] == keys[b]) == (low[0] == low[1])


def test_connected_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in nj.connected(df).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
