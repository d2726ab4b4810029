import random

import corpus_pipeline as cp
import test_decontaminate as td
import test_ngram_join as tn
from lexloom.llm import secrets


def build(spark, path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 8)))
    docs, labels = [], []
    bench = [(k, " ".join(word() for _ in range(30))) for k in range(4)]
    for k in range(260):
        w = [word() for _ in range(rng.randrange(20, 90))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["scumlord", "vilething"]))
        elif docs and rng.random() < 0.2:
            w = docs[rng.randrange(len(docs))][1].split(" ")
            w[rng.randrange(len(w))] = word()
            toxic = "scumlord" in w or "vilething" in w
        elif rng.random() < 0.15:
            w += bench[rng.randrange(4)][1].upper().split(" ")
        if rng.random() < 0.1:
            w.insert(3, "password=" + "x1" * 8)
        docs.append((k, " ".join(w), "en", "src0", 0, "extra"))
        if rng.random() < 0.9:
            labels.append((k, 1, int(toxic)))
    docs += [(900, None, None, None, None, None), (901, "", "en", None, 0, "e"), (902, "long " * 30_000, "en", "s", 0, "e"), (None, "no id here", "en", "s", 0, "e"), (902, "long " * 30_000, "en", "s", 0, "e")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return bench, {i: y for i, _, y in labels}


def test_stages(spark, tmp_path):
    bench, toxic = build(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, docs
    inputs = {}
    for name, stage in cp.STAGES:
        inputs[name] = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        kept = stage(spark, kept, str(tmp_path))
        if name != "pack":
            assert kept.columns == columns
            kept.write.parquet(f"{tmp_path}/{name}")
            kept = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {i for i, _ in inputs["ngram_jaccard"]}
    wrong = [i for i, y in toxic.items() if (i in ids) == (y == 1)]
    assert len(wrong) <= 5 and {900, 901, 902, None} <= ids
    groups = tn.brute(inputs["ngram_jaccard"])
    stay = sorted({str(i) for i, _, c in groups if i == c})
    assert [str(i) for i, _ in sorted(inputs["decontaminate"], key=lambda r: str(r[0]))] == stay
    clean = [(i, t) for i, t in inputs["decontaminate"] if not (n := td.brute(t, [(str(k), x) for k, x in bench]))[1] or 20 * n[1] < n[0]]
    assert inputs["secrets"] == clean and len(clean) < len(inputs["decontaminate"])
    marked = [(i, t and t.replace("password=" + "x1" * 8, "[SECRET]")) for i, t in clean]
    assert inputs["pack"] == sorted(marked, key=str) and any("[SECRET]" in (t or "") for _, t in marked)
    packed = kept.collect()
    assert {r.doc_id for r in packed} == {i for i, _ in inputs["pack"]}
    assert sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in packed) == sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in cp.run(spark, str(tmp_path)).collect())
    assert secrets.MARK == "[SECRET]"
