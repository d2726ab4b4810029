import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import automaton as am
from lexloom.llm import secrets as sc

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(t):
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    out += [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[1], s[0]))


PARTS = ["password", "PassWd", "token", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAKIA", "ABCDEFGH0123", "abc", "0123456789abcdef", "é", "x", "=secret=", "\n", "ß€", "-_./+"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=4))
def test_base_is_the_rules(texts):
    import pyarrow as pa

    scan, got = sc.scanner(), []
    for _, data, bounds in sc.tv.text_slices(pa.array(texts), limit=60):
        found = scan.spans(data, bounds)
        got += [[s for s in found.get(i, []) if s[0] < 3] for i in range(bounds.size - 1)]
    assert got == [base(t) for t in texts]


@pytest.mark.parametrize("rule", ["a(b|c)*d?", "[^a]{2,3}c", "(ab|a)(c|bcd)", "a{2}", r"\d+\.\w", "x|y|"])
def test_automaton_is_the_regex(rule):
    rng = random.Random(3)
    forward, backward = am.compile_rules([(rule, False)], search=False), am.compile_rules([(rule, False)], backward=True)
    for _ in range(300):
        s = "".join(rng.choice("abcdxy1.") for _ in range(rng.randrange(9)))
        every = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if re.fullmatch(rule, s[i:j])]
        want, at = [], 0
        for i in range(len(s)):
            ends = [j for a, j in every if a == i]
            if i >= at and ends:
                want.append((i, max(ends)))
                at = max(ends)
        assert am.leftmost_longest(forward, backward, s.encode()) == want


def test_lanes_do_not_matter():
    a = am.compile_rules([("[0-9a-f]{32,}", False), ("abc", True)])
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abcABC f0", np.uint8), 5000)
    one = am._one_by_one(a, data)
    for lane in (1, 7, 64, 512):
        many = am.accepting_positions(a, data, lane, few=0)
        assert (one[0] == many[0]).all() and (one[1] == many[1]).all()


def test_minimal():
    assert am.compile_rules([("abc|abd|xbc|xbd", False)], search=False).next.shape[0] == 5  # 4 and the dead state


def test_added_kinds():
    t = "é ghp_" + "a" * 36 + " AIza" + "b" * 35 + " -----BEGIN RSA PRIVATE KEY----- sk_live_" + "c" * 20
    import pyarrow as pa

    (_, data, bounds), = sc.tv.text_slices(pa.array([t]))
    assert [sc.RULES[k].kind for k, *_ in sc.scanner().spans(data, bounds)[0]] == ["github", "hex", "google", "hex", "private_key", "stripe"]


def test_query_and_redaction(spark):
    key = "AKIA" + "A" * 16
    rows = [(1, f"é password={key} end", "c"), (2, None, "c"), (3, "", "c"), (None, "clean", "c"), (4, "x " * 100_000 + "token: 12345678", "c"), (4, "token: 12345678", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = {(r.doc_id, r.n_assign, r.n_access, r.spans): r for r in sc.digest(sc.find_secrets(df)).collect()}
    assert (1, 1, 1, "assign:2:31,access:11:31") in got and (2, 0, 0, "") in got and (4, 1, 0, "assign:200000:200015") in got
    assert got[2, 0, 0, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = {r.doc_id: r.text for r in sc.redact(df).collect()}
    assert out[1] == "é [SECRET] end" and out[2] is None and out[3] == "" and out[None] == "clean" and out[4].endswith("[SECRET]")
    assert sc.find_secrets(df.limit(0)).count() == 0


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh12 b", "own", 5), (None, None, None, None)], "doc_id long, text string, secrets string, row int")
    got = sc.redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a [SECRET] b", "own", 5), (None, None, None, None)]
