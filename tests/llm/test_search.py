"""Similarity join, decontamination, neighbours, shards, licences and chat formatting against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsframe.llm import ann_search, catalog, chat_format, decontamination, license_scan, ngram_join, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made_texts(seed=4):
    """Unrelated texts, groups of copies and near copies, a passage that many share."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(dice.randrange(1, 4)))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(dice.randrange(0, 120))) for _ in range(60)]
    texts += [passage + " " + " ".join(word() for _ in range(dice.randrange(0, 20))) for _ in range(60)]
    for base in (60, 100, 160):
        words = [word() for _ in range(base)]
        for _ in range(40):
            own = list(words)
            for _ in range(dice.randrange(0, 4)):
                own[dice.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += ["", None, "one", "ONE", "one two three", "\tone  two\nthree", "one two three four five"] + texts[:10]
    return texts


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block, hot_sets, bucket", [(4_000_000, 16, 4_000_000), (500, 2, 200)])
def test_join_equals_brute_force(spark, monkeypatch, block, hot_sets, bucket):
    """In one block and bucket, and with many of them and every shingle of two sets or more in a task hot."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    rows = list(enumerate(made_texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", F.lit("own")).withColumn("hot", F.lit(1))
    assert {tuple(r) for r in ngram_join.jaccard_components(frame, hot_sets=hot_sets, bucket_shingles=bucket).collect()} == brute_components(rows)


def test_join_of_very_long_texts(spark):
    dice = random.Random(6)
    long = [str(dice.randrange(10**6)) for _ in range(60_000)]
    other = long[:30_000] + ["new"] + long[30_001:]
    rows = [(3, " ".join(long)), (1, " ".join(other)), (2, " ".join(long[:40_000]))]
    got = {tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and {r[2] for r in got if r[0] != 2} == {1}


def test_blocks_links_are_components():
    """Components of a block are those of all its links, whichever sets are searched."""
    dice = random.Random(9)
    sets, sizes = [], []
    for group in range(12):
        base = dice.sample(range(1000 * group, 1000 * group + 300), 100)
        for _ in range(dice.randrange(1, 30)):
            base = [x if dice.random() > 0.05 else dice.randrange(1000 * group, 1000 * group + 300) for x in base]
            sets.append(np.array(sorted({*base, 10**6}), np.uint64))
    sizes = np.array([len(s) for s in sets])
    order = dice.sample(range(len(sets)), len(sets))
    sets, sizes = [sets[i] for i in order], sizes[order]
    root = list(range(len(sets)))
    index = ngram_join.DivideSkip(sets, sizes)
    for i in range(len(sets)):
        for j in index.search(i).tolist():
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert ngram_join.block_links(sets, sizes).tolist() == root


def test_join_edges(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(frame).collect() == []
    frame = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (None, None), (7, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(frame).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 0, None), (7, 0, 7)], key=str)


def test_divide_skip_finds_every_link():
    dice = random.Random(8)
    base = [np.array(dice.sample(range(400), 60), np.uint64) for _ in range(6)]
    sets = []
    for _ in range(150):
        own = set(dice.choice(base).tolist())
        for _ in range(dice.randrange(0, 12)):
            own.discard(dice.choice(sorted(own)))
            own.add(dice.randrange(400, 500))
        sets.append(np.array(sorted(own), np.uint64))
    sizes = np.array([len(s) for s in sets])
    index = ngram_join.DivideSkip(sets, sizes)
    for i in range(len(sets)):
        want = [j for j in range(len(sets)) if j != i and 100 * len(c := set(sets[i].tolist()) & set(sets[j].tolist())) >= 80 * (sizes[i] + sizes[j] - len(c))]
        assert sorted(index.search(i).tolist()) == want


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for name, item in items:
        w = words_of(item)
        n = min(10, len(w))
        for k in range(max(1, len(w) - 9) if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def brute_spans(text, items):
    """Where the runs of hit words begin and end in the text."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
    own, hit = [m.group() for m in words], set()
    for _, item in items:
        w = words_of(item)
        n = min(10, len(w))
        for k in range(max(1, len(w) - 9) if w else 0):
            hit.update(j for i in range(len(own) - n + 1) if own[i : i + n] == w[k : k + n] for j in range(i, i + n))
    first = [i for i in sorted(hit) if i - 1 not in hit]
    last = [i for i in sorted(hit) if i + 1 not in hit]
    return [(words[a].start(), words[b].end()) for a, b in zip(first, last, strict=True)]


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_decontamination_equals_brute_force(spark, block_words):
    dice = random.Random(6)
    word = lambda: dice.choice(["der", "Été", "x9", "the", "OF", "naïve", "b"])
    items = [(i, " ".join(word() for _ in range(dice.randrange(0, 25)))) for i in range(12)] + [(50, "only, seven! words: in (this) short-item"), (None, "b b b"), (7, None)]
    texts = [" ".join(word() for _ in range(dice.randrange(0, 60))) for _ in range(40)]
    texts += [f"before {dice.choice(items[:12])[1].upper()} other {items[3][1]}, after" for _ in range(30)] + ["", None, "b b b", items[5][1] * 3]
    frame = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.mark_contamination(frame, bench, block_words=block_words, cleaned="cleaned").orderBy("doc_id").collect()
    named = [("" if i is None else i, t) for i, t in items]
    for text, row in zip(texts, got, strict=True):
        assert (row["n_words"], row["n_hit"], row["item_ids"]) == brute_hits(text, named)
        data = (text or "").encode()
        cut = b"".join(data[a:b] for a, b in zip([0, *(s["end"] for s in row["spans"])], [*(s["start"] for s in row["spans"]), len(data)], strict=True))
        assert row["cleaned"] == (None if text is None else cut.decode())
        assert len(words_of(row["cleaned"])) == row["n_words"] - row["n_hit"]


def test_decontamination_of_empty_tables_and_very_long_texts(spark):
    dice = random.Random(3)
    words = [f"w{dice.randrange(5000)}" for _ in range(150_000)]
    text = " ".join(words)
    documents = spark.createDataFrame([(1, text, "old"), (2, "", "old"), (3, None, "old"), (4, "w1 " * 30, "old"), (4, "w1 " * 30, "old")], "doc_id long, text string, n_words string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.mark_contamination(documents, none).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["item_ids"]), len(r["spans"])) for r in got) == [(1, 150_000, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 30, 0, 0, 0), (4, 30, 0, 0, 0)]
    items = spark.createDataFrame([(1, " ".join(words[70_000:70_040])), (2, "... !"), (3, None), (4, "w1 " * 12)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.mark_contamination(documents, items).collect()}
    assert (found[1]["n_hit"], found[1]["item_ids"]) == (40, ["1"]) and (found[4]["n_hit"], found[4]["item_ids"]) == (30, ["4"])
    begin = len(" ".join(words[:70_000])) + 1
    assert [tuple(s) for s in found[1]["spans"]] == [(begin, begin + len(" ".join(words[70_000:70_040])))]
    assert decontamination.mark_contamination(documents.limit(0), items).collect() == []


def test_suffix_order():
    dice = np.random.default_rng(1)
    for n, kinds in ((1, 1), (40, 2), (400, 2), (400, 50)):
        text = dice.integers(0, kinds + 1, n).astype(np.int32)
        text[-1] = 0
        ends = np.cumsum(text == 0)
        key = lambda i: [(0, int(ends[j])) if text[j] == 0 else (1, int(text[j])) for j in range(i, n)]
        assert decontamination._suffix_order(text).tolist() == sorted(range(n), key=key)


def test_fm_index_locates_all(spark):
    dice = np.random.default_rng(2)
    text = dice.integers(1, 4, 500).astype(np.int32)
    text[[40, 41, 300, 499]] = 0
    index = decontamination.FMIndex(text, 3)
    for n in (1, 2, 5, 9):
        for _ in range(20):
            at = int(dice.integers(0, 490 - n))
            pattern = text[at : at + n]
            if (pattern == 0).any():
                continue
            _, low, high = index.search(pattern, np.array([0]), np.array([n]))
            assert sorted(index.locate(low, high).tolist()) == [i for i in range(500 - n + 1) if (text[i : i + n] == pattern).all()]


def test_neighbours(spark):
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(8, 32))
    vectors = (centres[dice.integers(0, 8, 3000)] + dice.normal(size=(3000, 32)) * 0.6).astype(np.float32)
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5100, [0.0] * 32), (5200, [float("nan")] * 32), (5300, [None] * 32), (5400, [1.0, 2.0]), (None, vectors[1].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann_search.nearest_neighbours(frame, lambda i: i % 100 == 0).collect()
    found, exact = {}, 0
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 3000, 100))
    wide = vectors.astype(np.float64)
    for q, near in found.items():
        distance = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3000), distance)) if i != q][:10]
        exact += len({i for i, _ in near} & set(order))
        assert all(abs(s - distance[i]) < 1e-9 for i, s in near) and near == sorted(near, key=lambda x: (x[1], x[0]))
    assert exact / (10 * len(found)) > 0.95
    assert [i for i, _ in found[200]] == [i for i in range(100, 112) if i != 200][:10]
    assert ann_search.nearest_neighbours(frame.limit(0), lambda i: i % 100 == 0).collect() == []
    few = ann_search.nearest_neighbours(frame.filter("vec_id < 4"), lambda i: i % 100 == 0).collect()
    assert len(few) == 3


def brute_nearest(ids, vectors, queries, k=10):
    """Ids of each query's k nearest, ties to the smaller id."""
    out = {}
    for q in queries:
        distance = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        out[q] = [int(i) for i in ids[np.lexsort((ids, distance))] if i != q][:k]
    return out


def test_recall_on_the_embeddings(spark, monkeypatch):
    """The registered query, and the same with many cells, against brute force over the whole table."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)
    want = brute_nearest(ids, vectors, [q for q in ids.tolist() if q % 100 == 0])
    for cell in (4096, 100):
        monkeypatch.setattr(ann_search, "CELL", cell)
        got = catalog.op4_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
        assert len(got) == 10 * len(want)
        assert sum(r["vec_id"] in want[r["query_id"]] for r in got) / len(got) >= 0.95


def test_cells_part_the_space():
    dice = np.random.default_rng(6)
    points = dice.normal(size=(5000, 8))
    points[:2000] = points[0]
    cells = ann_search.Cells(points, 37)
    where = cells.find(points)
    assert 30 <= len(cells.lows) <= 37 and len(np.unique(where[:2000])) == 1
    assert ((points >= cells.lows[where]) & (points <= cells.highs[where])).all()
    clustered = np.repeat(dice.normal(size=(40, 8)) * 100, 100, axis=0) + dice.normal(size=(4000, 8)) * 0.01
    cells = ann_search.Cells(clustered, 40)
    assert np.mean([len(cells.within(p, 1.0)) for p in clustered[::50]]) < 4
    assert len(cells.within(clustered[0], math.inf)) == len(cells.lows)


def test_chi_square():
    assert abs(float(ann_search.chi_square(ann_search.quantile(0.97))) - 0.97) < 1e-9
    draws = (np.random.default_rng(1).standard_normal((100_000, 8)) ** 2).sum(axis=1)
    assert abs((draws < ann_search.quantile(0.9)).mean() - 0.9) < 0.01


def test_shards(spark):
    rows = [(i, "t" * (i % 50)) for i in range(3000)] + [(None, None), (5, "again"), (5, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_records(frame, [1.0] * 24, pieces=5).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r["grown_shard"] == 24 for r in got) / len(got)
    assert 0.02 < moved < 0.07
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows}
    other = {(r["doc_id"], r["size"], r["slot"], r["shard"]) for r in sharding.shard_records(frame.repartition(3), [1.0] * 24, pieces=64).collect()}
    assert other == {(r["doc_id"], r["size"], r["slot"], r["shard"]) for r in got}
    heavy = sharding.shard_records(frame, [3.0, 1.0, 0.0]).collect()
    share = sum(r["shard"] == 0 for r in heavy) / len(heavy)
    assert 0.70 < share < 0.80 and not any(r["shard"] == 2 for r in heavy)
    assert sharding.shard_records(frame.limit(0), [1.0] * 3).collect() == []


def test_a_hot_key_is_parted(spark):
    rows = [(None, "t" * (i % 9)) for i in range(900)] + [(7, "same")] * 600 + [(i, "x") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("own")).repartition(4)
    got = sharding.shard_records(frame, [1.0] * 4, pieces=12).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append((r["slot"], r["doc_id"], r["size"]))
    assert len(got) == len(rows) and all(sorted(s)[0][0] == 0 and len({x[0] for x in s}) == len(s) == max(x[0] for x in s) + 1 for s in by.values())
    nulls = sorted((r["slot"], r["size"]) for r in got if r["doc_id"] is None)
    assert [s for _, s in nulls] == sorted(s for _, s in nulls) and nulls[-1][0] - nulls[0][0] == 899


def brute_shard(key, n):
    cost = lambda i: -math.log((int(hashlib.md5(f"{i}/{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)
    return min(range(n), key=cost)


def test_rendezvous_law(spark):
    got = sharding.shard_records(spark.createDataFrame([(i, "") for i in range(200)], "doc_id long, text string"), [1.0] * 7).collect()
    assert all(r["shard"] == brute_shard(f"k{r['doc_id']}", 7) and r["grown_shard"] == brute_shard(f"k{r['doc_id']}", 8) for r in got)


def test_repeated_rows_leave_room_for_neighbours(spark):
    dice = np.random.default_rng(12)
    near = [(i, v) for i, v in enumerate(dice.normal(size=(40, 6)).tolist())]
    query = (100, [0.0, 0.0, 0.0, 0.0, 0.0, 0.01])
    rows = [query] * 30 + [(200, [0.01, 0.0, 0.0, 0.0, 0.0, 0.0])] * 100 + [(300, [x, 0.02, 0.0, 0.0, 0.0, 0.01]) for x in (-0.02, 0.02)] + near
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_search.nearest_neighbours(frame, lambda i: i == 100, k=10, confidence=0.999999).orderBy("rank").collect()
    want = sorted({(round(math.dist(v, query[1]), 9), i) for i, v in rows if i != 100})[:10]
    assert [(round(r["score"], 9), r["vec_id"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, 11))


def test_licenses(spark):
    mit = license_scan.KNOWN[4][1]
    rows = [(1, "Released under the MIT Licence!"), (2, None), (3, ""), (4, "Copyright (c) 2020 A. Person\n\n" + mit.upper()), (5, "© 2019 x\n/* " + license_scan.KNOWN[5][1] + " */"), (6, "some prose"), (1, "  released UNDER the mit license "), (7, "Copyright 2020 nobody")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["license_id"] or "") for r in license_scan.scan_licenses(frame, license_scan.known_licenses(spark)).collect())
    assert got == [(1, "MIT"), (1, "MIT"), (2, ""), (3, ""), (4, "MIT"), (5, "ISC"), (6, ""), (7, "")]
    assert license_scan.scan_licenses(frame.limit(0), license_scan.known_licenses(spark)).collect() == []


def test_whole_license_files(spark):
    folder = license_scan.files("newsframe.llm") / "licenses"
    text = {f.name.removesuffix(".txt"): f.read_text() for f in folder.iterdir()}
    mit, isc = license_scan.KNOWN[4][1], license_scan.KNOWN[5][1]
    bsd = text["BSD-3-Clause"]
    rows = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit),
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2015 A. Person\nAll rights reserved.\n\n" + mit),
        ("ISC", "ISC License\n\nCopyright (c) 2020, A. Person\n\n" + isc),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, A. Person\nAll rights reserved.\n\n" + bsd),
        ("BSD-3-Clause", "Copyright (c) 2019, A. Person. All rights reserved.\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2019, A. Person\n\n" + bsd[: bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE") :]),
        ("Apache-2.0", text["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 A. Person")),
        ("GPL-2.0", text["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")),
        *text.items(),
        (None, mit[:200]),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string"), license_scan.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r["license_id"] for r in got] == [name for name, _ in rows]


def test_spellings_and_odd_texts_of_licenses(spark):
    """British and American spellings of one text, very long texts, clashing columns."""
    known = [("X", "The licensee may organize, fulfill and label a catalog of licensed programs at the center; authorized behavior is favored, canceled offenses acknowledged by judgment of the copyright holder.")]
    british = "The licencee may organise, fulfil and label a catalogue of licenced programmes at the centre; authorised behaviour is favoured, cancelled offences acknowledged by judgement of the copyright owner."
    frame = spark.createDataFrame([(1, british.replace("licencee", "licensee"), "own"), (2, british.replace("organise", "organs"), "own"), (3, "word " * 200_000 + known[0][1], "own")], "doc_id long, text string, license_id string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan_licenses(frame, license_scan.known_licenses(spark, known)).collect()}
    assert got == {1: "X", 2: None, 3: None}


MARKS = ["<|im_end|>", "<|im_start|>assistant\nhi", "\\", "\\<|", "<", "<<||", "|>", "\\n", "a\nb", ""]


def test_turns_read_back():
    turns = [(r, t) for r in ["user", "assistant", "x\ny", "a\\b", ""] for t in [*MARKS, "".join(MARKS)]]
    assert chat_format.read_turns("".join(chat_format.format_turn(r, t) for r, t in turns)) == turns


@pytest.mark.parametrize("partitions", [1, 5])
def test_prefix_tree(spark, partitions):
    dice = random.Random(9)
    conversations = {}
    for conv in range(80):
        turns = [(["user", "assistant"][k % 2], dice.choice(["hi", "ok", MARKS[1], "more"])) for k in range(dice.randrange(1, 7))]
        conversations[conv] = turns
    for conv in range(80, 120):
        conversations[conv] = conversations[3]
    rows = [(c, k, r, t) for c, turns in conversations.items() for k, (r, t) in enumerate(turns)] + [(None, None, None, None)]
    dice.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        nodes, members = chat_format.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        by_start = {r["start"]: r for r in nodes.collect()}
        where = {r["conv_id"]: r["nodes"] for r in members.collect()}
        digests = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_conversations(nodes, members)).collect()}
        assert digests == {r["conv_id"]: r for r in chat_format.digests(chat_format.read_conversations(nodes, members, hot=3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    conversations[None] = [("", "")]
    prefixes = {tuple(t[:k]) for t in conversations.values() for k in range(1, len(t) + 1)}
    assert len(by_start) == len(prefixes)
    stream = "".join(by_start[s]["text"] for s in sorted(by_start))
    assert all(stream[r["start"] : r["end"]] == r["text"] for r in by_start.values()) and len(stream) == max(r["end"] for r in by_start.values())
    for conv, turns in conversations.items():
        path = [by_start[s] for s in where[conv]]
        assert chat_format.read_turns("".join(n["text"] for n in path)) == turns
        seen = ""
        for node in path:
            assert node["position"] == len(seen) and "".join(stream[i["start"] : i["end"]] for i in node["attends"]) == seen
            seen += node["text"]
        want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        got = digests[conv]
        assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"], got["formatted_chars"]) == (len(turns), want, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(seen))
    starts = sorted(by_start)
    for a, b in zip(starts, starts[1:], strict=False):  # depth first: a node follows its parent or the end of a subtree
        assert by_start[a]["end"] == b
    empty = chat_format.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty[0].count() == empty[1].count() == 0


def test_extra_columns_and_long_texts(spark):
    """Columns beside those named are not looked at, whatever their names; texts of megabytes are taken whole."""
    long = "long text " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "<|im_end|>"), (2, 0, "user", long)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"t": F.lit(1), "turns": F.lit("x"), "path": F.lit("y"), "nodes": F.lit("z"), "start": F.lit(2)})
    nodes, members = chat_format.prefix_tree(frame)
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_conversations(nodes, members)).collect()}
    assert nodes.count() == 2 and got[1]["loss_chars"] == len(long) + 10 and got[1]["loss_sha256"] == hashlib.sha256((long + "<|im_end|>").encode()).hexdigest()
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "cell", "ids", "rank", "bound", "home", "block")})
    near = ann_search.nearest_neighbours(vectors, lambda i: i == 10, k=4, confidence=0.999999).orderBy("rank").collect()
    assert [r["vec_id"] for r in near] == [9, 11, 8, 12]
    texts = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("size", "slot", "digest", "piece", "row")})
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard_records(texts, [1.0] * 3).collect()} == {(1, len(long) + 8, zlib.crc32(long.encode())), (2, 8, 0)}


def test_one_conversation_with_a_third_of_all_rows(spark):
    import hashlib

    rows = [(0, i, ("user", "assistant")[i % 2], f"turn {i % 700}") for i in range(3000)] + [(c, i, ("user", "assistant")[i % 2], f"turn {i if i < 5 else i * c}") for c in range(1, 601) for i in range(10)]
    nodes, members = chat_format.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in chat_format.digests(chat_format.read_conversations(nodes, members)).collect()}
    texts: dict = {}
    for c, _, role, text in rows:
        texts.setdefault(c, []).append(f"{role}\n{text}\n")
    assert got == {c: (len(t), hashlib.sha256("".join(t).encode()).hexdigest()) for c, t in texts.items()}


def test_shingles_of_odd_texts():
    sets = list(ngram_join.shingle_sets(pa.array(["a b c d e", "A B C D E f", "a b", "a b c d e a b c d e", None])))
    assert [len(s) for s in sets] == [1, 2, 1, 5, 0] and sets[0][0] in sets[1] and sets[0][0] in sets[3]


def test_word_hashes_do_not_depend_on_place_or_pieces(monkeypatch):
    from newsframe.llm import textarrays

    text = np.frombuffer(b"one two three one " + b"x" * 500 + b" two one", np.uint8)
    starts = np.array([0, 4, 8, 14, 18, 519, 523])
    ends = np.array([3, 7, 13, 17, 518, 522, 526])
    whole = textarrays.word_hashes(text, starts, ends)
    monkeypatch.setattr(textarrays, "CHUNK_BYTES", 16)
    assert (textarrays.word_hashes(text, starts, ends) == whole).all()
    assert whole[0] == whole[3] == whole[6] and whole[1] == whole[5] and len(set(whole.tolist())) == 4
