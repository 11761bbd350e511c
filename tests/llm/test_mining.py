"""Hard negatives, source mixing and the prefix trie against brute-force versions."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsframe.llm import hard_negatives, prefix_trie, source_mix


def brute_negatives(rows, n_positives=5, n_negatives=3):
    """rows: id, label, whole components."""
    rows = sorted({(i, lab, tuple(q)) for i, lab, q in rows})
    out = []
    for anchor, label, q in rows:
        if anchor % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, p, strict=True)), i, lab) for i, lab, p in rows if i != anchor and len(p) == len(q)))
        for s, i, _ in [x for x in scored if x[2] == label][:n_positives]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_negatives]
            out += [(anchor, i, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(frame, **given):
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(frame, lambda ids: ids % 50 == 0, **given).select(COLUMNS).collect())


def scaled(x):
    return [int(np.floor(256 * np.float64(v))) for v in x]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 16), ("LEAST_BLOCKS", 2), ("PAGE", 5), ("ANCHORS", 2), ("ZONES", 3), ("PAGES", 1)):
        monkeypatch.setattr(hard_negatives, name, value)


def test_hilbert_curve_goes_to_neighbours():
    side, dims = 8, 3
    points = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
    keys = hard_negatives.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(side**dims))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_bounds_hold():
    dice = np.random.default_rng(1)
    a, b = dice.integers(-300, 300, (20, 7)).astype(float), dice.integers(-300, 300, (30, 7)).astype(float)
    low, high = hard_negatives.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    scores = hard_negatives.exact_products(a, b)
    assert (low <= scores).all() and (scores <= high).all()
    big = a * 1e13
    assert hard_negatives.exact_products(big[:2], b[:2])[0, 0] == sum(int(x) * int(y) for x, y in zip(big[0], b[0], strict=True))


@pytest.mark.parametrize("kind", ["clusters", "uniform", "copies"])
def test_negatives_against_brute_force(spark, small_blocks, kind):
    dice = np.random.default_rng(len(kind))
    base = dice.normal(size=(4, 6))
    rows = []
    for i in range(600):
        lab = int(dice.integers(0, 4))
        x = base[lab] + 0.4 * base[(lab + 1) % 4] + dice.normal(size=6) * 0.3 if kind == "clusters" else dice.normal(size=6)
        if kind == "copies" and i % 3 == 0:
            x = np.ones(6)
        rows.append((i - 100, lab, [float(np.float32(v)) for v in x]))
    given = [*rows, *rows[:40], (None, 1, rows[0][2]), (700, None, rows[0][2]), (750, 1, None), (800, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (850, 1, [float("nan")] * 6), (900, 2, [float("inf")] * 6), (950, 2, []), (1000, 1, [1.0, 2.0]), (1001, 1, [1.0, 1.0]), (1002, 2, [0.5, 1.0])]
    frame = spark.createDataFrame(given, "vec_id long, label int, embedding array<float>").withColumn("q", F.lit("extra"))
    want = brute_negatives([(i, lab, scaled(x)) for i, lab, x in [*rows, *given[-3:]]])
    got = mined(frame)
    assert got == want and len(got) > 60


def test_zone_maps_leave_out_blocks(spark, small_blocks):
    """On clustered vectors most pages and pieces need not meet."""
    dice = np.random.default_rng(3)
    base = dice.normal(size=(12, 8)) * 4
    rows = [(i, i % 12, (base[i % 12] + dice.normal(size=8) * 0.1).tolist()) for i in range(1200)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    blocks = hard_negatives.candidate_blocks(hard_negatives.whole_components(frame, "vec_id", "embedding", F.col("label")))
    anchors = hard_negatives._anchors(blocks, lambda ids: ids % 50 == 0, 5)
    met = hard_negatives._meetings(anchors, hard_negatives._zones(blocks), False).count()
    pages, pieces = anchors.select("page").distinct().count(), blocks.select("piece").distinct().count()
    assert pages > 2 and pieces > 20 and met < 0.5 * pages * pieces
    assert mined(frame) == brute_negatives([(i, lab, scaled(np.float32(x))) for i, lab, x in rows])


def test_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")) == []
    assert mined(spark.createDataFrame([(50, 1, [0.1, 0.2])], "vec_id long, label int, embedding array<float>")) == []
    zero = [(i, i % 2, [0.0, 0.0]) for i in range(4)]
    assert mined(spark.createDataFrame(zero, "vec_id long, label int, embedding array<float>")) == [(0, 2, 1, 1, 0, 0), (0, 2, 2, 3, 0, 0)]


def filled(sizes, weights, epochs):
    """Targets by clamping and dealing out again, one step after the other."""
    total, caps, open_ = sum(sizes), [epochs * s for s in sizes], set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        rest = total - sum(caps[i] for i in range(len(sizes)) if i not in open_)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > caps[i]}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        open_ -= over
    return [caps[i] if i not in open_ else target[i] for i in range(len(sizes))]


def test_mix_against_a_model(spark):
    dice = np.random.default_rng(4)
    sources = ["b", "a", None, "é", "z", "B", "empty"]
    rows = []
    for i in range(400):
        s = int(dice.choice(7, p=[0.5, 0.2, 0.1, 0.08, 0.06, 0.03, 0.03]))
        words = 0 if sources[s] == "empty" else int(dice.integers(0, 30)) if i % 50 else 3000
        rows.append((i if i % 7 else None, None if i % 31 == 5 else "w\t" * words, sources[s]))
    rows += [(1000, "one two three", "a")] * 120
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("extra"))
    got = source_mix.mix_sources(frame, (1, 2, 3)).collect()
    again = source_mix.mix_sources(frame.repartition(9), (1, 2, 3)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    order = sorted((s for s in sources if s), key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in order]
    want = dict(zip(order, filled(sizes, [i % 3 + 1 for i in range(len(order))], 3), strict=True))
    for name, size in zip(order, sizes, strict=True):
        own = [r for r in got if r["source"] == name]
        assert {r["source_size"] for r in own} == {size}
        assert all(abs(r["target"] - want[name]) < 1e-6 * max(1, want[name]) and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert sum(r["taken"] for r in own) == int(want[name] + 0.5)
        assert len({r["taken"] // r["size"] for r in own if r["size"] and r["taken"] % r["size"] == 0}) <= 2
        assert sum(r["taken"] % r["size"] > 0 for r in own if r["size"]) <= 1  # one document a source is cut
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _ in rows)


def test_mix_with_given_weights_and_its_texts(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 5 + 1)), "xy"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1.0)], "source string, weight double")
    mixed = source_mix.mix_sources(frame, weights, share=0.5, seed=3)
    taken = {r["doc_id"]: r for r in mixed.collect()}
    assert all(r["taken"] == 0 for r in taken.values() if r["source"] == "y")
    total = sum(i % 5 + 1 for i in range(60))
    assert sum(r["taken"] for r in taken.values()) == int(total * 0.5 + 0.5)
    texts = source_mix.repetitions(frame, mixed).collect()
    words = {}
    for r in texts:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert rows[r["doc_id"]][1].startswith(r["text"])
    assert words == {i: r["taken"] for i, r in taken.items() if r["taken"]}
    assert source_mix.mix_sources(frame.limit(0), (1, 2)).collect() == []
    assert [r["taken"] for r in source_mix.mix_sources(spark.createDataFrame([(1, None, None)], frame.schema), (1, 2)).collect()] == [0]


def test_node_layouts_grow():
    root, keys = prefix_trie.Node(), [bytes([b, b ^ 1]) for b in range(256)]
    for n, key in enumerate(keys, 1):
        prefix_trie.insert(root, key, n)
        assert root.places == next(p for p in (4, 16, 48, 256) if n <= p)
    assert [k.path for k in root.children()] == keys
    for key in keys:
        assert root.child(key[0]).path == key


def plain_trie(conversations):
    """conversations: id -> list of (role, text). By prefix: conv_id, depth, parent, members, children, leaves, saved, digest."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in own) or 1
        saved[node] = sum(saved[k] for k in own) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, ids in members.items():
        ends = sorted(c for c in ids if len(conversations[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids.get(node, [])), leaves[node], saved[node], digest))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_trie_against_a_model(spark, pieces, monkeypatch):
    """Copies and chains over many partitions, one conversation that begins all others, a very long one, conversations without turns."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    dice = np.random.default_rng(5)
    texts = ["", "hi", "ünï", "x" * 50, "y"]
    conversations = {}
    for c in range(-20, 300):
        n = int(dice.integers(0, 7))
        conversations[c] = [("ab"[int(dice.integers(2))], texts[int(dice.integers(5))]) for _ in range(n)]
    for c in range(300, 420):
        conversations[c] = [("a", "hi"), ("b", "ünï"), ("a", "hi")]
    for c in range(420, 460):
        conversations[c] = [("a", "hi")] * (c - 419)
    conversations[500] = [("a", f"turn {i % 11}") for i in range(2000)]
    keys = spark.createDataFrame([(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string").repartition(5)
    listed = prefix_trie.conversation_keys(keys)
    turnless = spark.createDataFrame([(c,) for c, turns in conversations.items() if not turns], "conv_id long").select("conv_id", F.array().cast("array<binary>").alias("turn_ids"), F.array().cast("array<int>").alias("chars"))
    got = prefix_trie.prefix_trie(listed.unionByName(turnless), pieces)
    assert sorted((tuple(r) for r in got.select(TRIE).collect()), key=str) == plain_trie(conversations)
    named = got.join(prefix_trie.turn_texts(keys), "turn_id")
    assert named.count() == got.filter("depth > 0").count()


def rebuilt(rows):
    own = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def test_donated_turns_against_a_model(spark):
    dice = np.random.default_rng(6)
    rows = []
    for c in [*range(90, 260), 777, 1000]:
        if c % 17:
            rows += [(c, None if k == 3 else k, [None, "a"][k % 2], [None, "t", "u"][int(dice.integers(3))]) for k in range(int(dice.integers(1, 8)))]
    rows += rows[:9]
    schema = "conv_id long, turn int, role string, text string"
    frame = spark.createDataFrame([*rows, (None, 0, "a", "lost")], schema).withColumn("turn_ids", F.lit("extra"))
    keys = prefix_trie.with_donated_turns(prefix_trie.conversation_keys(frame), F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, 5)
    got = prefix_trie.prefix_trie(keys)
    want = rebuilt(rows)
    assert any(not t for t in want.values())
    assert sorted((tuple(r) for r in got.select(TRIE).collect()), key=str) == plain_trie(want)
    empty = prefix_trie.conversation_keys(spark.createDataFrame([], schema))
    assert prefix_trie.prefix_trie(empty).collect() == []
