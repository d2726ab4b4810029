import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import pii


def rules(t):
    """The contract's patterns, as they are written."""
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(d(m[0])) <= 15]


PARTS = ["a", "B.c", "@", "x@y.z", ".", "1", "25", "300", "0042", "4539578763621486", "4539 5787 6362 1486", "+1 (824) 555-5244", "+", "-", " ", "(", ")", "é", "\n", "%", "_", "1.2.3.4", "@h-1.org"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_is_the_rules(text):
    assert pii.base_spans(text) == rules(text)


DOCS = [f"word {k} call +1 ({200 + k}) 555-{1000 + k * 7} or u{k}.n@mail{k % 3}.example.com from 10.0.{k}.{k * 3 % 250}, version 3.{k}. year 19{k % 90 + 10} 2024-01-0{k % 9 + 1} card 4539 5787 6362 1486 end" for k in range(60)]


@pytest.fixture(scope="module")
def model():
    return pii.fit(DOCS)


def test_adds_spans_and_keeps_base(model):
    t = "reach (824) 555-5244 or 4539.5787.6362.1486, a@b.org; version 3.0 of 12 2024-01-02 in 300.1.2.3"
    base, every = pii.find(t, model)
    assert base == rules(t) and set(base) <= set(every)
    assert ("phone", t.index("(824"), t.index(" or")) in every and ("card", t.index("4539"), t.index(", a@")) in every
    assert len(every) == 3


def test_gradient_is_the_derivative():
    text = "(824) 555-5244 x 4539 5787 6362 1486"
    r = pii.region_of(text, 0, len(text), [])
    gold = pii.truth_of(text, r, [("phone", 0, 14), ("card", 17, len(text))])
    assert len(gold) == 2
    m, rng = pii.Model(), np.random.default_rng(1)
    m.w[:], m.t[:] = rng.normal(0, 0.3, m.w.shape), rng.normal(0, 0.3, m.t.shape)
    at, dw, dt = m.gradient(r, gold)
    assert at < 0
    for key in list(dw)[:40]:
        m.w[key] += 1e-5
        assert abs((m.gradient(r, gold)[0] - at) / 1e-5 - dw[key]) < 1e-3
        m.w[key] -= 1e-5
    for key in ((0, 4), (4, 0), (0, 0), (0, 3)):
        m.t[key] += 1e-5
        assert abs((m.gradient(r, gold)[0] - at) / 1e-5 - dt[key]) < 1e-3
        m.t[key] -= 1e-5


def test_decode_is_the_best_segmentation():
    text = "+1 (824) 555-5244 4539 5787 6362 1486"
    r = pii.region_of(text, 0, len(text), [])
    rng = np.random.default_rng(2)

    def every(m, j, y):
        """Best score of atoms before j whose last type is y, by recursion."""
        if j == 0:
            return 0.0 if y == 0 else -np.inf
        best = -np.inf
        for i, z, _, s in m.segments(r, j):
            if z == y:
                best = max(best, s + (max(every(m, i, p) + m.t[p, y] for p in range(5)) if i else 0.0))
        return best

    for _ in range(3):
        m = pii.Model()
        m.w[:], m.t[:] = rng.normal(0, 1, m.w.shape), rng.normal(0, 1, m.t.shape)
        got = m.decode(r)
        place = {c: i for i, c in enumerate(r.starts)}
        path, at = [], 0
        for y, a, b in got:
            path += [(x, x + 1, 0) for x in range(at, place[a])] + [(place[a], place[b], y)]
            at = place[b]
        path += [(x, x + 1, 0) for x in range(at, r.size)]
        score, last = 0.0, 0
        for i, j, y in path:
            score += next(s for b, z, _, s in m.segments(r, j) if (b, z) == (i, y)) + (m.t[last, y] if i else 0)
            last = y
        small = pii.Region(r.size, r.starts, r.by_end, r.plain)
        if small.size <= 16:
            assert abs(score - max(every(m, r.size, y) for y in range(5))) < 1e-9


def test_query(spark, model):
    t = "é mail a@b.org now"
    rows = [(1, t, "c"), (2, None, "c"), (3, "", "c"), (None, "clean", "c"), (4, "x " * 100_000 + "a@b.org", "c"), (1, t, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = sorted(((r.doc_id or 0, r.n_email, r.spans, r.base_sha256) for r in pii.digest(pii.find_pii(df, model)).collect()), key=str)
    assert got[1][1:3] == got[2][1:3] == (1, "email:7:14") and got[0][1:3] == (0, "") and got[5][2] == "email:200000:200007"
    assert got[1][3] == hashlib.sha256(b"email:7:14").hexdigest() and got[3][3] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(df.limit(0), model).count() == 0
    assert not pii.train(df.limit(0)).trained


def full_decode(m, r):
    """The dynamic program over all atoms of a region."""
    k = len(pii.KINDS) + 1
    best = np.full((r.size + 1, k), -np.inf)
    best[0, 0] = 0
    back = {}
    for j in range(1, r.size + 1):
        for i, y, _, s in m.segments(r, j):
            into = best[i] + m.t[:, y] if i else np.where(np.arange(k) == 0, best[0], -np.inf)
            p = int(into.argmax())
            if into[p] + s > best[j, y]:
                best[j, y], back[j, y] = into[p] + s, (i, p)
    j, y, out = r.size, int(best[r.size].argmax()), []
    while j:
        i, p = back[j, y]
        out += [(y, r.starts[i], r.starts[j])] if y else []
        j, y = i, p
    return out[::-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, "(824) 555-5244", "4539.5787.6362.1486", " ", " "]), max_size=14).map("".join), st.integers(0, 5))
def test_stretches_are_the_whole_program(text, seed):
    rng = np.random.default_rng(seed)
    m = pii.Model()
    m.w[:], m.t[:] = rng.normal(0, 1, m.w.shape), rng.normal(0, 1, m.t.shape)
    r = pii.region_of(text, 0, len(text), [])
    if r.plain:
        assert m.decode(r) == full_decode(m, r)
    every = {(i, j) for j, segs in enumerate(r.by_end) for i, _, _ in segs}
    atoms = [x[0] for x in pii._ATOM.finditer(text)]
    for i in range(len(atoms)):
        for j in range(i + 1, min(len(atoms), i + pii.MAX_ATOMS) + 1):
            inside = (atoms[i][0].isalnum() or atoms[i] in "+(") and atoms[j - 1][-1].isalnum() and not (i and atoms[i - 1][-1].isalnum()) and not (j < len(atoms) and atoms[j][0].isalnum())
            assert ((i, j) in every) == bool(inside and pii.admissible("".join(atoms[i:j])))


@pytest.mark.parametrize("unit", ["u{k}.n@mail.example.com ", "10.0.{k}.7 ", "u{k}@a.org\n", "+1 (824) 555-{k} ", "x{k} "])
def test_long_lines_take_linear_time(model, unit):
    import time

    text = "".join(unit.format(k=1000 + k % 200) if "555" in unit else unit.format(k=k % 200) for k in range((1 << 20) // len(unit)))
    began = time.process_time()
    base, every = pii.find(text, model)
    assert time.process_time() - began < 15 and set(base) <= set(every)
