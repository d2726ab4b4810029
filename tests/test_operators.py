"""The operators on small tables, against results worked out by hand or by plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.operators import backtranslation as bt
from lexloom.operators import consistency, context, memory, ranking, ranks, semantic, style

SEMANTIC = [
    ("The doctor sat by the fireplace, listening carefully.", "O doutor sentou perto da lareira, ouvindo atentamente.", True, set()),
    ("The prisoner is alive in the old tower tonight.", "O prisioneiro está morto na velha torre esta noite.", False, {"meaning_reversal"}),
    ("He did not open it.", "Ele abriu isto.", False, {"polarity_inversion"}),
    ("Holmes asked whether the train had arrived at the station.", "Lestrade perguntou se o trem tinha chegado na estação.", False, {"subject_shift"}),
    ("She left the house.", "Ele deixou a casa.", False, {"subject_shift"}),
    ("The colonel was furious with the lazy servants.", "O coronel estava chateado com os criados preguiçosos.", True, {"intensity_loss"}),
    ("He actually read the long letter twice.", "Ele atualmente leu a longa carta duas vezes.", True, {"problematic_literal_translation"}),
    ("The detective examined every footprint near the broken window.", "Detetive.", False, {"semantic_omission"}),
    ("", "qualquer", True, set()),
]


def test_semantic(spark):
    df = spark.createDataFrame([(k, s, t) for k, (s, t, *_) in enumerate(SEMANTIC)], "k int, source string, target string")
    for r in semantic.evaluate(df).collect():
        kinds = {i.check for i in r.issues} - {"semantic_divergence"}
        assert kinds == SEMANTIC[r.k][3], SEMANTIC[r.k]
        if "semantic_divergence" not in {i.check for i in r.issues}:
            assert r.passed == SEMANTIC[r.k][2], (SEMANTIC[r.k], r.overall)
        want = sum(w * r[k] for k, w in semantic.WEIGHTS.items())
        assert abs(r.overall - want) < 6e-5
    informal = spark.createDataFrame([("Good evening, my lord.", "Boa noite, cara.")], "source string, target string")
    assert [i.check for i in semantic.evaluate(informal, formality="muito formal").first().issues if i.check == "relationship_shift"]
    assert not [i for i in semantic.evaluate(informal).first().issues if i.check == "relationship_shift"]


def test_own_encoder(spark):
    df = spark.createDataFrame([("one two three four", "um dois três quatro")], "source string, target string")
    assert semantic.evaluate(df, encoder=lambda a, b: F.lit(0.1)).first().issues[0].check == "semantic_divergence"


def test_ranking(spark):
    cands = [(1, 1, "The Count met 3 men?", "O Conde encontrou 3 homens?"), (1, 2, "The Count met 3 men?", "O Count encontrou homens"), (1, 3, "The Count met 3 men?", "o homem o homem com"), (2, 1, "Sherlock Holmes said", "Holmes disse (isso")]
    df = spark.createDataFrame(cands, "doc_id int, cand int, source string, target string")
    terms = spark.createDataFrame([(1, "Count", "Conde")], "doc_id int, term string, target_term string")
    tm = spark.createDataFrame([(2, "falou")], "doc_id int, target_term string")
    names = spark.createDataFrame([(2, "Sherlock Holmes")], "doc_id int, name string")
    got = {(r.doc_id, r.cand): r for r in ranking.rank(ranking.score(df, terms, tm, names)).collect()}
    assert got[1, 1].terminology == 1 and got[1, 2].terminology == pytest.approx(0.25) and got[1, 3].terminology == pytest.approx(0.6)
    assert got[1, 1].fidelity == 1 and got[1, 2].fidelity == pytest.approx(0.75)
    assert got[1, 3].naturalness == pytest.approx(0.65) and got[1, 3].fluency == pytest.approx(0.7) and got[2, 1].fluency == pytest.approx(0.8)
    assert got[2, 1].consistency == pytest.approx(0.8) and got[2, 1].character_score == pytest.approx(0.85)
    assert [got[1, k].rank for k in (1, 2, 3)] == [1, 2, 3]
    assert got[1, 1].final_score == pytest.approx(sum(w * got[1, 1][k] for k, w in ranking.WEIGHTS.items()), abs=1e-6)


def plain_apply(text, changes):
    import re

    for old, new in changes:
        if old.strip().lower() == new.strip().lower():
            continue
        m = re.search(rf"(?<!\w){re.escape(old)}(?!\w)", text, re.I)
        at = m.start() if m else text.lower().find(old.lower()) if old else -1
        if at >= 0:
            text = text[:at] + new + text[at + len(old) :]
    return text


def test_fixes_and_rollback(spark):
    rng = random.Random(3)
    words = ["Count", "conde", "count's", "recount", "o", "$1", "\\x", "Earl", "é", "\n", "of"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for k in range(80)]
    changes = [(k, s, rng.choice(words), rng.choice(["Conde", "$2", "a\\b", "é"])) for k in range(80) for s in range(rng.randrange(4))]
    fixed = consistency.apply_fixes(spark.createDataFrame(texts, "doc_id int, target string"), spark.createDataFrame(changes, "doc_id int, step int, old string, new string"))
    got = {r.doc_id: (r.fixed, len(r.audits)) for r in fixed.collect()}
    want = {k: plain_apply(t, [(o, n) for i, _, o, n in changes if i == k]) for k, t in texts}
    assert {k: t for k, t in want.items() if t != dict(texts)[k]}.items() <= {k: t for k, (t, _) in got.items()}.items()
    assert all(want[k] == t for k, (t, _) in got.items())
    assert {r.doc_id: r.restored for r in consistency.rollback(fixed).collect()} == {k: dict(texts)[k] for k in got}


def test_budget(spark):
    items = [("semantic", "a", 300, False, 1), ("semantic", "b", 300, False, 2), ("fact", "f", 100, False, 1), ("fact", "g", 100, True, 2), ("preceding", "p", 200, False, -2), ("preceding", "q", 200, False, -1), ("glossary", "t", 0, False, 1)]

    def kept(limit):
        df = spark.createDataFrame([(1, c, i, 1.0, t, k, p) for c, i, t, k, p in items], "doc_id int, category string, item_id string, score double, tokens long, locked boolean, place long")
        return "".join(sorted(r.item_id for r in context.prune(df, limit).where("kept").collect()))

    assert kept(1200) == "abfgpqt" and kept(1100) == "afgpqt" and kept(800) == "fgpqt"[:0] + "fgpqt"
    assert kept(599) == "gpqt" and kept(450) == "gqt" and kept(10) == "gqt"


def test_relevant_facts_are_brute_force(spark):
    rng = random.Random(8)
    words = ["house", "never", "castle", "road", "river", "sword", "it"]
    facts = [(k, " ".join(rng.choice(words) for _ in range(2)), rng.random() < 0.05) for k in range(60)]
    segs = [(k, " ".join(rng.choice(words) for _ in range(3)).title()) for k in range(40)] + [(99, "")]
    got = context.relevant_facts(spark.createDataFrame(segs, "doc_id int, text string"), spark.createDataFrame(facts, "fact_id int, statement string, locked boolean"), 5).collect()
    want = {(d, str(f)) for d, t in segs for f in [f for f, s, lock in facts if lock or any(len(w) > 4 and w in t.lower().split() for w in s.split())][:5]}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_pronouns(spark):
    segs = spark.createDataFrame([(1, 0, 0, "Ann met Holmes"), (2, 0, 1, "They went"), (3, 0, 2, "She smiled"), (4, 0, 3, "He saw it")], "doc_id int, chapter int, seq int, text string")
    mentions = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "chapter int, seq int, character_id int")
    people = spark.createDataFrame([(1, "female"), (2, "male")], "character_id int, gender string")
    got = {(r.doc_id, r.character_id): r.score for r in context.pronoun_referents(segs, mentions, people, 2).collect()}
    assert got == {(2, 1): 0.95, (2, 2): 0.95, (3, 1): 0.85}


def plain_chrf(a, b, n=4, beta=2.0):
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b or a == b:
        return float(bool(a) and a == b)
    x, y = (Counter(t[j : j + i] for i in range(1, n + 1) for j in range(len(t) - i + 1)) for t in (a, b))
    common = sum((x & y).values())
    p, r = common / sum(y.values()), common / sum(x.values())
    return (1 + beta**2) * p * r / (beta**2 * p + r) if common else 0.0


def test_chrf_is_the_plain_count():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab é") for _ in range(rng.randrange(9))) for _ in range(2))
        assert bt.chrf(a, b) == pytest.approx(plain_chrf(a, b)), (a, b)


def test_back_translation(spark):
    rows = [("He did not go to the house of Holmes.", "he did not go to the house of holmes", False), ("He did not go.", "He did go.", True), ("He went home.", "She went home.", True), ("one two three four five six", "one two", True), ("Holmes came in.", "Watson came in.", True)]
    df = spark.createDataFrame([(s, b, k) for s, b, k in rows], "source string, back string, want boolean")
    assert all(r.issue == r.want for r in bt.verify(df).collect())


def test_upsert(spark):
    schema = "k int, v string, locked boolean, more array<string>"
    old = spark.createDataFrame([(1, "a", True, ["x"]), (2, "b", False, ["x"]), (3, "c", False, None), (5, None, False, [])], schema)
    new = spark.createDataFrame([(1, "z", False, ["y"]), (2, "z", True, ["y", "x"]), (4, "d", True, ["n"]), (5, None, False, ["q"])], schema)
    after, outcomes = memory.upsert(old, new, ("k",), ("v",), ("more",))
    assert {r.k: (r.v, r.locked, r.more) for r in after.collect()} == {1: ("a", True, ["x", "y"]), 2: ("z", True, ["x", "y"]), 3: ("c", False, []), 4: ("d", True, ["n"]), 5: (None, False, ["q"])}
    assert {r.k: r.outcome for r in outcomes.collect()} == {1: "rejected", 2: "updated", 4: "added", 5: "unchanged"}
    forced, _ = memory.upsert(old, new, ("k",), ("v",), force=True)
    assert {(r.k, r.field, r.old_value, r.new_value) for r in memory.differences(old, forced, ("k",), ("v",)).collect()} == {(1, "v", "a", "z"), (2, "v", "b", "z")}
    assert memory.upsert(old.limit(0), new, ("k",), ("v",))[0].count() == 4 and memory.upsert(old, new.limit(0), ("k",), ("v",))[1].count() == 0
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in memory.latest(rows, ("k",), F.col("t")).collect()} == {(1, "b"), (2, "c")}


def test_style(spark):
    rules = spark.createDataFrame([("a", "x", False, False, 1.0, ["e"]), ("b", "x", False, True, 0.5, [])], style.RULES)
    seen = spark.createDataFrame([("a", "y", "1"), ("a", "x", "2"), ("a", "x", "3"), ("b", "z", "4"), ("c", "u", "5"), ("c", "v", "6")], "rule string, value string, evidence string")
    got = {r.rule: (r.value, r.inferred, r.evidence) for r in style.infer(rules, seen).collect()}
    assert got == {"a": ("x", False, ["2", "3", "e"]), "b": ("z", True, ["4"])}
    assert [(r.rule, r.other, r.n) for r in style.contradictions(rules, seen).orderBy("rule").collect()] == [("a", "y", 1), ("b", "z", 1)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_global_rank(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(1000).selectExpr("id % 3 AS a", "id")
        got = [(r.a, r.id) for r in ranks.global_rank(df, F.desc("a"), F.asc("id")).orderBy("pos").collect()]
        assert got == sorted([(k % 3, k) for k in range(1000)], key=lambda r: (-r[0], r[1]))
        assert ranks.global_rank(df.limit(0), F.asc("id")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
