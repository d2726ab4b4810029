"""Look-ups in a story's memory, with nulls, small casts and replaced rows."""

from pyspark.sql import functions as F

from lexloom.operators import story

RELATION = "rel_id long, src int, tgt int, rel_type string, chapter int, inferred boolean"


def test_relations(spark):
    rows = spark.createDataFrame([(1, 1, 2, "friend", 1, False), (2, 1, 2, "friend", 1, True), (3, 2, 3, "enemy", 1, True), (4, 1, 1, "self", 1, None), (5, None, 1, "x", 1, False)], RELATION)
    new = spark.createDataFrame([(0, 1, 2, "friend", 1, False), (9, 7, 8, "friend", 1, False)], RELATION)
    assert sorted(r.rel_id for r in story.record(rows, new).collect()) == [0, 3, 4, 5, 9]
    assert sorted(r.rel_id for r in story.between(rows, [1, 2, 2]).collect()) == [1, 2, 4]
    assert story.between(rows, [1, 1]).count() == 0 and story.between(rows, []).count() == 0
    assert sorted(r.rel_id for r in story.of(rows, 1).collect()) == [1, 2, 4, 5]
    assert sorted(r.rel_id for r in story.of(rows, 2, inferred=True).collect()) == [2, 3]


def test_facts_and_references(spark):
    rows = spark.createDataFrame([(1, "rule", ["a", "b"], True, False), (2, "rule", None, False, False), (3, None, ["a"], True, True)], "id int, category string, entities array<string>, locked boolean, inferred boolean")
    assert sorted(r.id for r in story.facts(rows).collect()) == [1, 2, 3]
    assert sorted(r.id for r in story.facts(rows, entity="a").collect()) == [1, 3]
    assert sorted(r.id for r in story.facts(rows, category="rule", locked=False).collect()) == [2]
    assert sorted(r.id for r in story.facts(rows, entity="a", inferred=False).collect()) == [1]
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "src int, tgt int")
    assert story.references(refs, 2).count() == 2


def test_fact_compliance_reads_a_text_once(spark, tmp_path):
    import time

    from lexloom.plans.story import QUERIES

    words = " ".join(f"wordy{k:05d}" for k in range(40000))
    rows = [(15 * k, f"{words} house roads" if k == 1 else "a house" if k % 2 else "no house", "src0 roads") for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    assert [tuple(r) for r in QUERIES["fact_compliance"](spark, str(tmp_path)).collect()] == [("src0 roads", 12)]
    assert time.time() - began < 20


def plainly_stated(statement, text):
    """The restricted words of a statement that a text states, in order, by plain patterns."""
    import re

    low, text = statement.lower(), text.lower()
    if not re.search("não|proibido|nunca|cannot|never|impossível", low):
        return []
    idle = "não pode deve proibido nunca cannot never impossível regra universo fora para sobre".split()
    there = [w for w in re.findall(r"\w{4,}", low) if w not in idle and re.search(rf"\b{w}\b", text)]
    return [w for w in there if not re.search(rf"\b(não|nunca|jamais|proibido|impossível de|not|never|no)\s+(\w+\s+)?{w}\b", text)]


def odd_texts(n, seed):
    import random

    rng = random.Random(seed)
    parts = ["house", "road", "roads", "src0", "HOUSE", "sea_1", "não", "nunca", "impossível de", "de", "not", "never", "no", "No", "knot", "a", "old", "é", ".", ",", "\n", " ", "\xa0", "-", "\x1c", "\x0b"]
    return ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_fact_compliance_looks_for_negation_near_the_word(spark, tmp_path):
    import oracle
    from lexloom.plans import fixtures
    from lexloom.plans.story import ORACLES, QUERIES

    kinds = ["src0", "SEA_1, nunca", "roads", "old", None]
    texts = ["He never came. A road to the house.", "no old house, no very old road", "not a big house", "road\nno house", "no road. road", None, *odd_texts(594, 7)]
    for name, step, first in (("locked", 1, 0), ("free", 5, 3)):  # in the second no fact is locked, so all of them count
        rows = [(first + step * k, t, kinds[k % 5]) for k, t in enumerate(texts)]
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).write.parquet(folder + "/documents.parquet")
        facts = [(s, f"{'never' if i % 3 == 0 else 'always'} {s} house road") for i, _, s in rows if s and (step == 5 or i % 5 == 0)]
        whole = [f"{fixtures.PAIRS[i % 20][0]}\n{t}" for i, t, _ in rows if t is not None]
        each, want = {s: sum(len(plainly_stated(s, t)) for t in whole) for _, s in facts}, {}
        for category, statement in facts:
            if each[statement]:
                want[category] = want.get(category, 0) + each[statement]
        got = QUERIES["fact_compliance"](spark, folder)
        assert {r.category: r.n for r in got.collect()} == want and want
        import duckdb

        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        assert oracle.compare(spark, con, "fact_compliance", QUERIES["fact_compliance"], ORACLES["fact_compliance"], folder) is None


def test_violations_give_the_first_word_of_each_fact(spark):
    statements = ["Never a road to the House", "cannot sea_1 house", "road house", "não pode para fora", None, "Nunca roads, src0"]
    texts = list(enumerate(["the house has a road", "no house. A road", "no road, no old house", "no very old house", "", None, *odd_texts(300, 11)]))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for flags in ((True, False, True, None, False, True), (False, False, None, False, False, None)):
        facts = [(k, s, b) for k, (s, b) in enumerate(zip(statements, flags))]
        chosen = [f for f in facts if f[2]] or facts
        want = {(k, i): plainly_stated(s, t)[0] for k, s, _ in chosen for i, t in texts if s and t and plainly_stated(s, t)}
        got = story.violations(spark.createDataFrame(facts, "fact_id long, statement string, locked boolean"), docs).collect()
        assert {(r.fact_id, r.doc_id): r.word for r in got} == want and len(got) == len(want) > 100


def test_ranking_joins_no_sources(spark):
    from lexloom.plans.translate import QUERIES

    for name in ("rank_topk", "rank_weighted"):
        todo, joins = [QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()], []
        while todo:
            plan = todo.pop()
            joins += [plan.output().mkString(",")] if plan.nodeName() == "Join" else []
            todo += [plan.children().apply(k) for k in range(plan.children().size())]
        assert joins and not [j for j in joins if "source#" in j]


def test_selected_candidate_ranks_without_texts(spark):
    from lexloom.plans.translate import QUERIES

    todo, windows = [QUERIES["selected_candidate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()], []
    while todo:
        plan = todo.pop()
        windows += [plan.output().mkString(",")] if plan.nodeName() == "Window" else []
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    assert windows and not [w for w in windows if "target#" in w]


def test_ranking_joins_no_targets(spark):
    from lexloom.plans.translate import QUERIES

    todo, joins, passes = [QUERIES["rank_weighted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()], [], 0
    while todo:
        plan = todo.pop()
        joins += [plan.output().mkString(",")] if plan.nodeName() == "Join" else []
        passes += plan.nodeName() in ("ArrowEvalPython", "MapInArrow")
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    assert joins and not [j for j in joins if "target#" in j] and passes == 1


def test_ranking_of_large_dictionaries_is_the_same(spark, monkeypatch):
    from lexloom.operators import matching, ranking

    texts = ["Ann Lee saw 12 roads and the house", "ann saw the casa casa", "", "1a 12\u2003b 3 the, LEE", "x\x1cx x x y x y"]
    rows = spark.createDataFrame([(k, c, s, t) for k, s in enumerate(texts) for c, t in enumerate(texts)], "doc_id long, cand int, source string, target string")
    terms = spark.createDataFrame([(0, "house", "casa"), (1, "saw", "viu")], "doc_id long, term string, target_term string")
    memory = spark.createDataFrame([(0, "the house"), (3, "lee")], "doc_id long, target_term string")
    names = spark.createDataFrame([(0, "Ann Lee"), (1, "Ann Lee")], "doc_id long, name string")
    first = sorted(map(tuple, ranking.score(rows, terms, memory, names).collect()))
    monkeypatch.setattr(matching, "MOST_BYTES", 1)
    assert first == sorted(map(tuple, ranking.score(rows, terms, memory, names).collect()))
    assert len({r[-1] for r in first}) > 5 and {r[8] for r in first} == {0.85, 1.0}
