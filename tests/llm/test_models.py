"""Language and quality models: accuracy on rows that were not learnt from, edge cases."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsframe.llm.catalog import op3_language_id, op8_quality
from newsframe.llm.language_id import UNDETERMINED, fit_kernel, fit_language_model, predict_language, presence
from newsframe.llm.quality import STATISTICS, FactorisationMachine, features, fit_quality_model, score_quality


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, "the house is here and the tree", "en"), (2, "das Haus ist hier und der Baum", "de"), (3, None, "en"), (4, "12 34 !!", "de"), (5, "der Baum und das Haus", None), (None, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(frame)
    got = {(r["doc_id"], r["lang_pred"]) for r in predict_language(frame, model).collect()}
    assert got == {(1, "en"), (2, "de"), (3, UNDETERMINED), (4, UNDETERMINED), (5, "de"), (None, UNDETERMINED)}
    none = fit_language_model(frame.filter("lang = 'xx'"))
    assert {r["lang_pred"] for r in predict_language(frame, none).collect()} == {UNDETERMINED}
    assert predict_language(frame.limit(0), model).collect() == []


def test_presence_counts_grams_of_each_text_alone():
    (bits,) = presence(pa.array(["ab", "", None, "b", "ab"]))
    assert bits.sum(axis=1).tolist() == [3, 0, 0, 1, 3] and (bits[0] == bits[4]).all()


def test_nystroem_on_all_rows_is_kernel_ridge():
    texts = [f"{a} {b}" for a in ("red", "blue", "green", "black") for b in ("cat", "dog", "cow")]
    labels = ["x" if "cat" in t else "y" for t in texts]
    bits = np.concatenate(list(presence(pa.array(texts))))
    model = fit_kernel(bits, labels, landmarks=100, ridge=0.01)
    unit = bits / np.sqrt(bits.sum(axis=1))[:, None]
    kernel = unit @ unit.T
    targets = np.where(np.array(labels)[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    exact = kernel @ np.linalg.solve(kernel + 0.01 * len(texts) * np.eye(len(texts)), targets)
    assert np.abs(model.scores(bits) - exact).max() < 1e-3


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op8_quality(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.98
    assert np.mean([r["predicted"] for r in got if r["quality"] == 1]) > 0.98


def test_machine_equals_the_sum_over_pairs():
    (pair,) = features(pa.array(["a few words a few", "", "UPPER!! lower\nlower"]))
    flat, counts = pair
    dice = np.random.default_rng(1)
    model = FactorisationMachine(0.3, dice.normal(size=20_000).astype(np.float32), dice.normal(size=(20_000, 4)).astype(np.float32))
    got, at, x, _, _ = model.terms(flat, counts)
    for i, (a, n) in enumerate(zip(at, counts + STATISTICS, strict=True)):
        own, w = flat[a : a + n], x[a : a + n]
        pairs = sum(model.factors[own[j]] @ model.factors[own[k]] * w[j] * w[k] for j in range(n) for k in range(j))
        assert abs(got[i] - (0.3 + model.linear[own] @ w + pairs)) < 1e-2


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (2, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, 0), (1, None)], "doc_id long, quality int")
    got = score_quality(docs, fit_quality_model(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    empty = score_quality(docs, fit_quality_model(docs, labels.limit(0))).collect()
    assert {r["score"] for r in empty} == {0.5}
    assert score_quality(docs.limit(0), fit_quality_model(docs.limit(0), labels)).collect() == []


def test_texts_are_not_cut(spark):
    long = "wort " * 200_000 + "!"
    frame = spark.createDataFrame([(1, long)], "doc_id long, text string").withColumn("lang", F.lit("de"))
    assert predict_language(frame, fit_language_model(frame)).first()["lang_pred"] == "de"


def test_every_language_is_learnt(spark):
    """More languages than the 64 most frequent, the others with one row less."""
    words = [["".join(chr(0x4E00 + 40 * k + (7 * i + j) % 40) for j in range(3)) for i in range(12)] for k in range(80)]
    rows = [(10 * k + i, " ".join(words[k][i : i + 8]), f"l{k}") for k in range(80) for i in range(4 if k < 70 else 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict_language(frame, fit_language_model(frame)).collect()
    assert len(got) == len(rows) and all(r["lang"] == r["lang_pred"] for r in got)


def grams(text):
    """Hashed n-grams of a text, one at a time."""
    data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()]
    found = set()
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            code = 0
            for b in data[i : i + n]:
                code = (code * 256 + b) % 2**32
            found.add(((code ^ (n << 29) % 2**32) * 0x9E3779B1 % 2**32) >> 18)
    return found


def test_language_against_brute_force(spark):
    """The whole operator over the smallest table: kernels by sets, the regression in the landmarks' span solved by least squares."""
    sf = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    learnt = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    order = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.xxhash64("doc_id")).collect()}
    chosen = []
    for lang in sorted({r["lang"] for r in learnt}):
        own = sorted((r for r in learnt if r["lang"] == lang), key=lambda r: (order[r["doc_id"]], r["doc_id"]))[:300]
        chosen += sorted(own, key=lambda r: r["doc_id"])
    languages = sorted({r["lang"] for r in chosen})
    sets = {r["doc_id"]: grams(r["text"]) for r in rows if r["text"]}
    kernel = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a]) * len(sets[b])) ** 0.5
    marks = [r["doc_id"] for lang in languages for r in [r for r in chosen if r["lang"] == lang][:32]]
    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    seen = np.array([[kernel(r["doc_id"], b) for b in marks] for r in chosen])
    targets = np.array([[1.0 if r["lang"] == lang else -1.0 for lang in languages] for r in chosen])
    weights = np.linalg.lstsq(seen.T @ seen + 1e-3 * len(chosen) * among, seen.T @ targets, rcond=None)[0]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op3_language_id(spark, sf).collect()}
    for r in rows:
        if any(c.isalpha() for c in r["text"] or ""):
            values = np.array([kernel(r["doc_id"], b) for b in marks]) @ weights
            assert got[r["doc_id"]][0] == languages[int(values.argmax())]
            assert abs(got[r["doc_id"]][1] - min(1.0, (values.max() + 1) / 2)) < 0.02


def test_quality_against_brute_force(spark):
    """Scores of the registered query from the fitted model's numbers, features and pairs one at a time."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = fit_quality_model(docs, labels)
    got = {r["doc_id"]: r["score"] for r in op8_quality(spark, sf).collect()}
    for r in docs.collect():
        ((flat, counts),) = features(pa.array([r["text"] or ""]))
        weights = [1 / max(1, counts[0]) ** 0.5] * int(counts[0]) + [1.0] * STATISTICS
        assert len(flat) == len(weights)
        total = model.bias + sum(float(model.linear[f]) * w for f, w in zip(flat, weights, strict=True))
        vectors = model.factors[flat].astype(np.float64) * np.array(weights)[:, None]
        gram = vectors @ vectors.T
        total += (gram.sum() - np.trace(gram)) / 2
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-total))) < 1e-3


def test_repeated_keys_are_determined(spark):
    rows = [(1, "first text of the key"), (1, "second text of the key"), (2, "bad bad bad"), (2, "bad bad bad")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    models = [fit_quality_model(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), labels) for step, n in ((1, 1), (-1, 3))]
    assert (models[0].linear == models[1].linear).all() and models[0].bias == models[1].bias


def test_landmarks_of_many_languages_are_bounded(monkeypatch):
    from newsframe.llm import language_id

    monkeypatch.setattr(language_id, "MOST_LANDMARKS", 8)
    texts = [f"{c * 3} {c * n}" for c in "abcd" for n in range(1, 6)]
    bits = np.concatenate(list(presence(pa.array(texts))))
    model = fit_kernel(bits, [t[0] for t in texts])
    assert model.landmarks.shape[1] == 8 and [model.languages[k] for k in model.scores(bits).argmax(axis=1)] == [t[0] for t in texts]


def test_clashing_columns_ties_and_long_texts(spark):
    """Columns with the names of results are replaced; equal languages go to the first in order; very long texts are scored whole."""
    rows = [(1, "one two three four", "b"), (2, "one two three four", "a"), (3, "uno due tre", "c"), (4, "one two three four " * 50_000 + "!", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "fits": F.lit("y"), "predicted": F.lit("z"), "label": F.lit(5), "key": F.lit(9), "__rank": F.lit(3)})
    model = fit_language_model(frame)
    got = {r["doc_id"]: r for r in predict_language(frame, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["a", "a", "c", "a"] and all(isinstance(r["score"], float) and isinstance(r["fits"], bool) and r["key"] == 9 for r in got.values())
    labels = spark.createDataFrame([(1, 1, 7), (2, 1, 7), (3, 0, 7)], "doc_id long, quality int, key int")
    scored = score_quality(frame, fit_quality_model(frame, labels)).collect()
    assert len(scored) == 4 and all(isinstance(r["score"], float) and r["predicted"] in (0, 1) and r["lang_pred"] == 1 for r in scored)
