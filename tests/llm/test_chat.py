import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import chat
from lexloom.session import materialise

CONTROLS = ["<|turn|>", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\-", "-", "<", "[", "a", "é\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(CONTROLS), max_size=12).map("".join))
def test_escape(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def expected(rows):
    groups = {}
    for c, n, r, t, *_ in rows:
        groups.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        text = "".join(chat.TURN + chat.escape(r) + chat.TEXT + chat.escape(t) + chat.END for *_, r, t in turns)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
    return out


def corpus():
    rng = random.Random(1)
    rows = []
    for c in range(300):
        turns = [("user", "hello" if rng.random() < 0.7 else f"é{rng.randrange(9)} <|end|>")] + [(r, f"{rng.choice('abc')} </s>\\") for _ in range(rng.randrange(4)) for r in ("assistant", "user")]
        rows += [(c, k, r, t, "clash") for k, (r, t) in enumerate(turns)]
    rows += [(400, 0, None, None, "c"), (401, None, "system", "x", "c"), (401, 0, "assistant", None, "c"), (401, 0, "assistant", None, "c"), (None, 0, "assistant", "y" * 100_000, "c"), (None, 1, "tool", "", "c")]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **limits):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    trees = chat.format_trees(df, **limits)
    trees, _ = materialise(trees, "trees")
    got = chat.read_trees(trees).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return trees, {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got}


def lists(pieces):
    """Each tree's token list and nodes, its pieces put together; every token is there once."""
    out = {}
    for p in sorted(pieces, key=lambda p: (p.tree_id, p.start, len(p.token_ids))):
        tokens, nodes = out.setdefault(p.tree_id, ([], []))
        assert p.start == len(tokens)
        tokens += p.token_ids
        nodes += p.nodes
    return out


def distinct_prefixes(rows):
    groups = {}
    for c, n, r, t, *_ in rows:
        groups.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    seen = set()
    for turns in groups.values():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        seen |= {tuple(turns[: k + 1]) for k in range(len(turns))}
    return len(seen)


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 40, "max_members": 2}])
def test_round_trip(spark, limits):
    rows = corpus()
    for adaptive in ("true", "false"):  # without it the hot first turn runs across partitions
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            trees, got = run(spark, rows, **limits)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert got == expected(rows)
        held = lists(trees.collect())
        assert sum(len(nodes) for _, nodes in held.values()) == distinct_prefixes(rows)
        for tokens, nodes in held.values():
            at, places = 0, {}
            for n in nodes:
                assert n.start == at and n.position == sum(s.end - s.start for s in n.attends)
                assert (n.parent == -1) == (n.depth == 0) and (n.depth == 0 or places[n.parent] == n.depth - 1)
                at, places[n.start] = n.end, n.depth
            assert at == len(tokens)


def test_pieces_inherit(spark):
    trees, _ = run(spark, corpus(), max_tokens=40)
    assert trees.where("size(inherited) > 0").count() > 20


def test_empty(spark):
    assert run(spark, [])[1] == {}


def test_intervals_are_ancestors():
    b = chat.Builder(lambda s: list(s.encode()))
    for k, turns in enumerate([[("u", "a")], [("u", "a"), ("assistant", "b"), ("u", "c")], [("u", "a"), ("assistant", "d"), ("u", "e")]]):
        b.add(k, "".join(f"{hash(t) % 10**8:032d}" for t in turns), turns)
    t = chat.settle(b.close()[0], {})
    spans = [[(s["start"], s["end"]) for s in n["attends"]] for n in t["nodes"]]
    n = t["nodes"]
    assert [x["parent"] for x in n] == [-1, 0, n[1]["start"], 0, n[3]["start"]]
    assert spans[2] == [(0, n[1]["end"])] and spans[3] == [(0, n[0]["end"])]
    assert spans[4] == [(0, n[0]["end"]), (n[3]["start"], n[3]["end"])]
