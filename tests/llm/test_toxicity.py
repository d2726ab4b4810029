import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import toxicity as tx

BAD = ["scumlord", "morondo", "vejuté", "loweiß"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgäèñ") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((k, " ".join(w), y))
    return rows


def test_learns_and_slices_do_not_matter():
    rows = corpus(600)
    y = np.array([r[2] for r in rows], dtype=np.float32)
    model = tx.fit([r[1] for r in rows[:400]], y[:400], np.ones(400))
    texts = pa.array([r[1] for r in rows[400:]] + ["", "x"])
    one = np.concatenate([model.scores(d, b) for _, d, b in tx.tv.text_slices(texts)])
    many = np.concatenate([model.scores(d, b) for _, d, b in tx.tv.text_slices(texts, 50)])
    assert np.allclose(one, many, atol=1e-5)
    assert ((one[:200] >= tx.THRESHOLD) == (y[400:] == 1)).mean() > 0.97
    assert one[600 - 400] < tx.THRESHOLD


def test_gradient_descends():
    rows = corpus(64)
    y = np.array([r[2] for r in rows], dtype=np.float32)

    def loss(epochs):
        m = tx.fit([r[1] for r in rows], y, np.ones(64), epochs)
        _, data, bounds = next(iter(tx.tv.text_slices(pa.array([r[1] for r in rows]))))
        p = 1 / (1 + np.exp(-m.logits(data, bounds)[0]))
        return -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))

    assert loss(6) < loss(1)


def test_best_cut():
    assert tx.best_cut(np.array([3.0, 1.0, -1.0]), np.array([1, 0, 0]), np.ones(3)) == 2.0


@pytest.fixture
def frames(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, "plain", "c"), (9000, None, "c"), (9001, "", "c"), (9002, "word " * 50_000, "c"), (9002, "scumlord morondo", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 0), (9003, None, 0), (0, 0, 0)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_train_and_score(frames):
    docs, labels = frames
    model = tx.train(docs, labels, tx.crc_mod("doc_id", 3) != 1)
    rows = tx.score(docs, model).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id and r.doc_id < 9000}
    assert np.mean([truth[r.doc_id] == r.predicted for r in rows if r.doc_id in truth]) > 0.95
    assert all(r.predicted == 0 for r in rows if r.doc_id in (9000, 9001))
    kept = tx.reject(docs.drop("score"), model)
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(r.predicted == 0 for r in rows)


def test_nothing_to_learn(frames):
    docs, labels = frames
    model = tx.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r.score for r in tx.score(docs, model).collect()} == {0.0}
    assert tx.score(docs.limit(0), model).count() == 0


def test_own_columns_stay(frames):
    docs, labels = frames
    docs = docs.selectExpr("doc_id", "score", "text", "'p' AS predicted", "1 AS row")
    model = tx.train(docs, labels, F.lit(True))
    kept = tx.reject(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and {(r.score, r.predicted) for r in kept.collect()} <= {("clash", "p"), ("c", "p")}


def plain_score(model, text):
    """The classifier as loops: embedded words, each window of each width, each filter's largest response, the logit."""
    import re

    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))

    def bucket(w):
        data = np.frombuffer(w + b" ", np.uint8)
        return int(tx.tv.word_hashes(data, np.array([0]), np.array([len(w)]))[0] % np.uint64(tx.BUCKETS))

    x = [model.embed[bucket(w)] + model.embed[tx.BUCKETS + bucket(w[: tx.PREFIX])] for w in words]
    zero = np.zeros(tx.DIM)
    logit = model.bias
    for j, conv in enumerate(model.conv):
        for f in range(tx.FILTERS):
            most = -1e9
            for i in range(len(x)):
                most = max(most, sum(float((x[i + k] if i + k < len(x) else zero) @ conv[k, :, f]) for k in range(len(conv))))
            logit += max(0.0, most + model.offset[j * tx.FILTERS + f]) * model.out[j * tx.FILTERS + f]
    groups = [int(tx._word_groups()[bucket(w)]) for w in words]
    counts = [0] + [groups.count(g) for g in range(1, len(tx.GROUPS))]
    cut = model.cuts.get(int(np.argmax(counts)), 0.0)
    return 1 / (1 + np.exp(-(logit - cut + np.log(tx.THRESHOLD / (1 - tx.THRESHOLD)))))


def test_score_is_the_plain_loops():
    rows = corpus(120)
    y = np.array([r[2] for r in rows], dtype=np.float32)
    model = tx.fit([r[1] for r in rows], y, np.ones(120), 3)
    model.cuts = {g: 0.1 * g for g in range(len(tx.GROUPS))}
    texts = [r[1] for r in rows[:25]] + ["", "one", "The of AND scumlord", "der die und morondo das", "le les et", "!?"]
    got = np.concatenate([model.scores(d, b) for _, d, b in tx.tv.text_slices(pa.array(texts))])
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-4)


def test_language_groups():
    texts = pa.array(["It was the best of days", "Der Hund ist nicht von mir und das ist gut", "les mots et le temps pour vous", "el perro y los gatos por la casa con su amo", "zzz", ""])
    _, data, bounds = next(iter(tx.tv.text_slices(texts)))
    assert [tx.GROUPS[g] for g in tx.tokens(data, bounds)[3]] == ["en", "de", "fr", "es", "other", "other"]


def test_every_labelled_row_counts(spark, monkeypatch):
    calm = [t for _, t, y in corpus(300, 5) if not y]
    long = [" ".join(calm[(7 * k + j) % len(calm)] for j in range(90)) + " scumlord morondo" for k in range(40)]
    assert min(map(len, long)) > 20_000
    rows = [(k, t, 0) for k, t in enumerate(calm)] + [(1000 + k, t, 1) for k, t in enumerate(long)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    fitted, held = [], []
    average, counts = tx._average, tx._held_counts
    monkeypatch.setattr(tx, "_average", lambda state, moved: (fitted.append(sum(r["n"] for r in moved if r["block"] < 0)), average(state, moved)))
    monkeypatch.setattr(tx, "_held_counts", lambda *a: (held.append(counts(*a)), held[-1])[1])
    assert tx.train(docs, labels, F.lit(True)).trained
    assert len(fitted) == tx.EPOCHS and {n + held[0][3].sum() for n in fitted} == {len(rows)}
    assert (held[0][2] * held[0][3]).sum() > 0


def test_shards_make_one_model(spark, monkeypatch):
    rows = corpus(600, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(tx, "SHARD_ROWS", 150)
    first, again = (tx.train(d, labels, F.col("doc_id") < 400) for d in (docs, docs.repartition(5)))
    assert np.array_equal(first.embed, again.embed) and first.cuts == again.cuts
    texts, y = pa.array([r[1] for r in rows[400:]]), np.array([r[2] for r in rows[400:]])
    got = np.concatenate([first.scores(d, b) for _, d, b in tx.tv.text_slices(texts)])
    assert ((got >= tx.THRESHOLD) == (y == 1)).mean() > 0.9


def test_texts_without_a_label_stay_where_they_lie(spark, monkeypatch):
    rows = corpus(600, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 10 == 0], "doc_id long, toxic int")
    seen, write = {}, tx.materialise
    monkeypatch.setattr(tx, "materialise", lambda df, name: (seen.setdefault(name, (df._jdf.queryExecution().executedPlan().toString(), df.count())), write(df, name))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx.train(docs, labels, F.lit(True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in seen["toxicity_rows"][0] and "Join" not in seen["toxicity_rows"][0]
    assert 60 <= seen["toxicity_rows"][1] < 90
    assert seen["toxicity_shards"][0].count("Exchange") == 2  # the rows and their labels


def test_filter_holds_every_id(spark):
    known = spark.range(0, 40_000, 4)
    words = tx._id_filter(known)
    keys = spark.range(0, 40_000).select((F.col("id") % 4 == 0).alias("own"), F.xxhash64("id").alias("key")).toArrow()
    own, found = keys.column("own").to_numpy(), tx._may_hold(words, keys.column("key").to_numpy())
    assert found[own].all() and found[~own].mean() < 0.03
    assert not tx._may_hold(tx._id_filter(known.limit(0)), keys.column("key").to_numpy()).any()


@pytest.mark.parametrize("kind", ["int", "string"])
def test_filter_does_not_move_the_model(spark, monkeypatch, kind):
    rows = corpus(300, 6)
    docs = spark.createDataFrame([(i // 2, t) for i, t, _ in rows] + [(None, "scumlord"), (7000, "plain")], "doc_id long, text string")
    labels = spark.createDataFrame([(i // 2, y) for i, _, y in rows if i < 200] + [(None, 1), (8000, 1)], "doc_id long, toxic int")
    fitted, average = [], tx._average
    monkeypatch.setattr(tx, "_average", lambda state, moved: (fitted.append(sum(r["n"] for r in moved if r["block"] < 0)), average(state, moved)))
    monkeypatch.setattr(tx, "SHARD_ROWS", 60)
    sharp = tx.train(docs, labels.withColumn("doc_id", F.col("doc_id").cast(kind)), F.lit(True))
    monkeypatch.setattr(tx, "FILTER_BITS", 64)  # lets every row through
    blunt = tx.train(docs, labels, F.lit(True))
    assert np.array_equal(sharp.embed, blunt.embed) and sharp.cuts == blunt.cuts and sharp.trained
    assert len(set(fitted)) == 1 and 100 < fitted[0] < 200
