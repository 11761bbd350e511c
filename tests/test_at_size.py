"""What only shows on larger or odder tables than the supplied ones."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsframe.catalog import ORACLES, QUERIES
from newsframe.functions.vectors import unit
from newsframe.operators import greedy, grouping, joins, similarity

from .oracle import TABLES, connection, same


def tables_with(tmp_path, sf_dir, **own):
    """The supplied tables, with some replaced by frames."""
    for name in TABLES:
        place = tmp_path / f"{name}.parquet"
        if name in own:
            own[name].write.parquet(str(place))
        else:
            place.symlink_to(Path(sf_dir) / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("clusters", [0, 1])
def test_largest_clusters_are_less_than_two(spark, tmp_path, sf_dir, clusters):
    """As at a size where every vector is linked with every other."""
    axis = F.when(F.col("vec_id") < 3, 0).otherwise(F.col("vec_id")) if clusters else F.col("vec_id")
    rows = spark.range(60).select(F.col("id").alias("vec_id")).withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (i == axis).cast("float"))).withColumn("label", F.lit(1))
    folder = tables_with(tmp_path, sf_dir, embeddings=rows)
    name = "m9_merge_clusters"
    assert QUERIES[name](spark, folder).count() == clusters
    same(spark, connection(folder), QUERIES[name], ORACLES[name], folder)


def uniform(spark, n, seed, dimensions=16):
    import numpy as np

    v = np.random.default_rng(seed).normal(size=(n, dimensions))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v, spark.createDataFrame([(i, i % 7, x) for i, x in enumerate(v.tolist())], "vec_id long, label long, v array<double>").repartition(3)


@pytest.mark.parametrize("n", [900, 2700])
def test_rows_are_copied_no_more_often_as_tables_grow(spark, n):
    """Vectors without clusters, in small cells and blocks."""
    _, frame = uniform(spark, n, n)
    for threshold in (0.4, 0.93):
        cells = similarity._Cells(similarity._rows(frame, threshold, "vec_id", "v"), threshold, 16)
        assert cells.groups().count() <= 24 * n


def test_pairs_in_tiles_are_all_pairs(spark, monkeypatch):
    import numpy as np

    v, frame = uniform(spark, 500, 3, 5)
    score = v @ v.T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(score >= 0.8), strict=True) if a < b}
    monkeypatch.setattr(similarity, "SPREAD", 1)  # one block, which a task goes through in tiles
    monkeypatch.setattr(similarity, "TILE", 64)
    cells = similarity._Cells(similarity._rows(frame, 0.8, "vec_id", "v"), 0.8, 1000)
    got = [(r["a"], r["b"]) for r in cells.met(similarity._pairs_of(0.8), "a long, b long, score double").collect()]
    assert len(got) == len(want) and set(got) == want


def test_labels_and_nearest_earlier_against_all_pairs(spark):
    import numpy as np

    v, frame = uniform(spark, 400, 5, 4)
    score = v @ v.T
    i, j = np.nonzero(np.triu(score >= 0.99, 1))
    got = [(r["x"], r["y"]) for r in similarity.similar_labels(frame, 0.99, "label", block=32).collect()]
    assert sorted(got) == sorted({(min(a, b), max(a, b)) for a, b in zip((i % 7).tolist(), (j % 7).tolist(), strict=True) if a != b}) and 0 < len(got) < 21
    score[np.triu_indices(400)] = -2
    want = {k: int(score[k].argmax()) for k in range(400) if score[k].max() >= 0.9}
    assert {r["id"]: r["earlier"] for r in similarity.nearest_earlier(frame, 0.9, block=32).collect()} == want


def test_groups_in_order_take_rounds_that_do_not_grow(spark, monkeypatch):
    """Blocks grow with the table, and no round meets the members of the rounds before."""
    _, frame = uniform(spark, 130, 8, 4)
    rounds, step = [], grouping._join_in_order
    monkeypatch.setattr(grouping, "SPREAD", 3)
    monkeypatch.setattr(grouping, "_join_in_order", lambda threshold: rounds.append(1) or step(threshold))
    whole = {r["vec_id"]: r["group_id"] for r in grouping.grouped_in_order(frame, 0.8, block=2048).collect()}
    assert len(rounds) == 1
    assert {r["vec_id"]: r["group_id"] for r in grouping.grouped_in_order(frame, 0.8, block=8).collect()} == whole
    assert len(rounds) == 1 + 3


@pytest.mark.parametrize("n", [150, 600])
def test_greedy_choices_take_rounds_that_do_not_grow(spark, monkeypatch, n):
    """Blocks grow with the largest group; equal vectors with other words, of which the first taken counts, come in several blocks."""
    import numpy as np

    v, _ = uniform(spark, n, n, 4)
    v[1::3] = v[np.arange(1, n, 3) % 40]
    words = [[f"w{i % 5}", f"x{i % 2}"] for i in range(n)]
    near = lambda score, overlap: score <= 0.8 or overlap >= 0.9
    taken: list[int] = []
    for i in range(n):
        scores = np.round(v[taken] @ v[i], 9)  # equal ones are equal
        best = int(scores.argmax()) if taken else 0
        shared = len(set(words[i]) & set(words[taken[best]])) / len({*words[i], *words[taken[best]]}) if taken and scores[best] > 0 else 0.0
        if not taken or near(max(0.0, scores[best]), shared):
            taken.append(i)
    frame = spark.createDataFrame([(k, i + 10_000 * k, i, x, w, i == 0) for k in range(2) for i, (x, w) in enumerate(zip(v.tolist(), words, strict=True))], "group long, id long, place long, v array<double>, words array<string>, forced boolean").repartition(3)
    rounds, own = [], greedy.stored
    monkeypatch.setattr(greedy, "stored", lambda frame, *by: rounds.append(1) or own(frame, *by))
    monkeypatch.setattr(greedy, "SPREAD", 4)
    monkeypatch.setattr(greedy, "STEP", 16)
    got = sorted(r["id"] for r in greedy.taken_greedily(frame, near, 8).collect())
    assert got == taken + [i + 10_000 for i in taken] and 20 < len(taken) < n
    assert len(rounds) == 3 + 4


def test_length_of_a_vector_is_asked_once(spark):
    """Its square in components, as it was, takes minutes."""
    import time

    begun = time.time()
    own = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.when(i % 2 == 0, 3.0).otherwise(0.0)).alias("v"))
    (r,) = own.select(unit(F.col("v")).alias("v")).collect()
    assert r["v"][:2] == [0.01, 0.0] and len(r["v"]) == 20_000 and time.time() - begun < 60
    odd = spark.createDataFrame([(0, None), (1, []), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (4, [None, 1.0])], "i int, v array<double>")
    assert dict(odd.select("i", unit(F.col("v"))).collect()) == {0: None, 1: [], 2: [0.0, 0.0], 3: [0.6, 0.8], 4: [None, None]}


def test_texts_are_not_shuffled_for_their_keywords(spark, monkeypatch):
    """Matches stay beside their text; passes over the keywords, pieces of long texts, ids and texts that come twice against brute force."""
    import random
    import re

    dice = random.Random(5)
    texts = [(i % 40, "".join(dice.choice("abcé? \t🙂") for _ in range(dice.choice((0, 7, 60, 300))))) for i in range(60)] + [(7, None), (7, "abcabc abcab"), (7, "abcabc abcab")]
    keys = [(i, "".join(dice.choice("abcé? 🙂") for _ in range(dice.randrange(1, 9)))) for i in range(150)] + [(200, "?"), (201, "é"), (202, "abcabc"), (203, "abcabca"), (204, ""), (205, " "), (206, None)]
    text, keywords = spark.createDataFrame(texts, "article_id long, text string"), spark.createDataFrame(keys, "keyword_id long, keyword string")
    want = sorted((i, a) for i, k in keys for a, t in texts if t is not None and k is not None and k in t)
    plan = joins.gram_matches(text, keywords)._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\([^)]*", plan)
    assert all(re.match(r"Exchange hashpartitioning\(row#\w+, keyword_id#\w+, keyword#", x) for x in shuffles), shuffles  # pieces of texts over PIECE only
    assert sorted(tuple(r) for r in joins.gram_matches(text, keywords).collect()) == want
    monkeypatch.setattr(joins, "PIECE", 16)
    monkeypatch.setattr(joins, "PASS_BYTES", 8000)
    assert sorted(tuple(r) for r in joins.gram_matches(text, keywords).collect()) == want
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], "keyword_id long, keyword string")
    told = sorted((i, a) for a, t in texts if t is not None for i, some in ((1, "ab"), (2, "c")) if any(k in t for k in some))
    assert sorted(tuple(r) for r in joins.gram_matches(text, twice).collect()) == told


def test_keywords_without_blanks_are_looked_for_in_words(spark, monkeypatch):
    """Within one word, over two, at the ends, with signs; whole texts are asked only for keywords with blanks."""
    texts = [(1, "alpha beta\tgamma"), (2, "alphabet soup"), (3, ""), (4, None), (5, "a  b c++ (x.y)"), (6, "beta gamma beta\n")]
    keys = ["a", "alpha", "bet", "beta gamma", "c++", "x.y", "(x", "a  b", "beta\tgamma", "soup", "nowhere", " ", ""]
    asked, plain = [], joins._texts_with
    monkeypatch.setattr(joins, "_texts_with", lambda text, keywords: asked.append([r["keyword"] for r in keywords.collect()]) or plain(text, keywords))
    text = spark.createDataFrame(texts, "article_id long, text string")
    keywords = spark.createDataFrame(list(enumerate(keys)), "keyword_id long, keyword string")
    want = sorted((i, a) for i, k in enumerate(keys) for a, t in texts if t is not None and k in t)
    assert sorted(tuple(r) for r in joins.gram_matches(text, keywords).collect()) == want
    assert all(k == "" or k.isspace() or " " in k or "\t" in k for k in asked[1]) and len(asked) == 2
