"""Dictionary matching against a plain regular expression, both ways."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.operators import matching


def plain(text, terms):
    out = []
    for k, (term, case) in enumerate(terms):
        if text and term and term.strip():
            own, t = (text, term) if case else (matching.fold(text), matching.fold(term))
            places = [m.start() for m in re.finditer(rf"(?<!\w)(?={re.escape(t)}(?!\w))", own)]
            if places:
                out.append((k, places))
    return out


PARTS = ["the", "The", "other", " ", "  ", "$", "$5", "é", "École", "no", "no no", ".", "a_b", "-", "C++", "\n", "İ", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=3).map("".join), st.booleans()), max_size=5))
def test_automaton_is_the_pattern(text, terms):
    assert sorted(matching.Matcher(terms).find(text).items()) == plain(text, terms)


@pytest.mark.parametrize("most", [0, 10**6])
def test_both_ways(spark, most):
    texts = ["the Count met a counter; the count, THE COUNT of the house", "$5 or $ 5, a$5 and $5.", None, "", "no no no", "in Baker Street Baker Street", "C++ and C+", "the Count met a counter; the count, THE COUNT of the house"]
    terms = [("count", False), ("Count", True), ("the count", False), ("$", False), ("$5", False), ("no no", False), ("Baker Street", False), ("C++", True), (" ", False), (None, False), ("house", None), ("count", False)]
    df = spark.createDataFrame([(k % 7, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, term string")
    entries = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(terms)], "term_id int, term string, case boolean")
    got = sorted((r.doc_id, r.term_id, r.starts) for r in matching.find_terms(df, entries, case="case", most_bytes=most).collect())
    assert got == sorted((k % 7, i, places) for k, t in enumerate(texts) for i, places in plain(t, terms))
    assert matching.find_terms(df.limit(0), entries, most_bytes=most).count() == 0
    assert matching.find_terms(df, entries.limit(0), most_bytes=most).count() == 0
