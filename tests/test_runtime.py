"""Loops against plain patterns, tokens, machines and versions."""

import random
import re
import threading
import time

import pytest

from lexloom.operators import loops, runtime


def test_repeats_against_the_pattern():
    pattern = re.compile(r"\b((?:\w+\s+){2,}\w+)(?:\s+\1)+\b", re.I)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "B", "cd", "é"]) + rng.choice([" ", " ", " ", " ", "\n", ". "]) for _ in range(rng.randrange(24)))
        if rng.random() < 0.2:  # groups long enough to be looked up
            text = " ".join([text.replace(". ", " ")] * rng.randrange(1, 4))
        assert loops.without_repeats(text) == pattern.sub(r"\1", text), text


def test_steps():
    assert loops.clean_text("") == "" and loops.clean_text("plain text") == "plain text"
    assert loops.clean_text("model_input = a b - c\nA b\nkept\nsee Wikipedia\nwikipedias") == "kept\nwikipedias"
    assert loops.clean_text("x\nX\ny\ny\nY\n\n\n\nz") == "x\n\nz"
    assert loops.clean_text("He came. he came! He left. He came.") == "He came. He left. He came."
    assert loops.clean_text("as he said that as he said that As he said that he went") == "as he said that he went"


def test_long_texts():
    rng = random.Random(1)
    began = time.time()
    loops.clean_text(" ".join(rng.choice("the a of and weaver loom thread".split()) for _ in range(200_000)))
    loops.clean_text("the " * 200_000)
    assert time.time() - began < 30


def test_clean_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a\na\na\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in loops.clean(df).collect()) == [(1, "b"), (2, None), (3, "")]


def test_machines(spark):
    rows = [(1, 32.0, True, 12.0, 50.0), (2, 32.0, True, 4.0, 1.0), (3, 8.0, False, 12.0, 50.0), (4, None, None, None, None)]
    got = {r.id: (r.profile, r.suitable, r.warnings) for r in runtime.hardware_profile(spark.createDataFrame(rows, "id int, ram_gb double, gpu boolean, vram_gb double, disk_gb double")).collect()}
    assert got == {1: ("quality", True, []), 2: ("balanced", True, ["disk", "gpu memory"]), 3: ("economy", True, ["economy only"]), 4: ("economy", False, ["disk", "memory"])}


def test_token(spark):
    token, done = runtime.Token(spark), []
    steps = [lambda k=k: spark.range(10).count() + k for k in range(4)]
    with pytest.raises(runtime.Cancelled):
        for n in token.run(steps):
            done.append(n)
            if len(done) == 2:
                token.cancel()
    assert done == [10, 11]

    held = runtime.Token(spark)
    held.pause()
    threading.Timer(0.5, held.resume).start()
    began = time.time()
    assert list(held.run(steps)) == [10, 11, 12, 13] and time.time() - began >= 0.4


def test_token_ends_a_running_job(spark):
    token = runtime.Token(spark)
    slow = spark.range(0, 8, 1, 8).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L) AS x")
    threading.Timer(2, token.cancel).start()
    began = time.time()
    with pytest.raises(runtime.Cancelled):
        list(token.run([lambda: slow.write.format("noop").mode("overwrite").save()]))
    assert time.time() - began < 15
