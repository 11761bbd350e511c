"""Order-dependent and iterative operators against small models; edge cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsframe.functions import dates, text, urls
from newsframe.operators import clustering, filters, graph, grouping, joins, similarity, vector_search, windows
from newsframe.streaming import monitor


def test_components_against_union_find(spark):
    import random

    dice = random.Random(3)
    edges = [(dice.randrange(60), dice.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_hamming_bands_lose_no_pair(spark):
    import random

    dice = random.Random(5)
    base = [dice.getrandbits(60) for _ in range(20)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(60):
        fp = dice.choice(base)
        for bit in dice.sample(range(60), dice.randrange(8)):
            fp ^= 1 << bit
        rows.append((len(rows), fp))
    distinct = {}
    for i, fp in rows:
        distinct.setdefault(fp, i)
    firsts = sorted((i, fp) for fp, i in distinct.items())
    want = {(a, b, (x ^ y).bit_count()) for a, x in firsts for b, y in firsts if a < b and (x ^ y).bit_count() < 6}
    want |= {(distinct[fp], i, 0) for i, fp in rows if distinct[fp] != i}
    frame = spark.createDataFrame(rows, "id long, fp long")
    for together in (None, 2, 3):
        assert {tuple(r) for r in joins.hamming_pairs(frame, together=together).collect()} == want
    kept = []
    for i, fp in rows:
        if all((fp ^ y).bit_count() >= 6 for _, y in kept):
            kept.append((i, fp))
    assert sorted(r["id"] for r in joins.keep_first_near(frame).collect()) == [i for i, _ in kept]


def test_until_consecutive_old(spark):
    flags = [False, True, True, False, True, None, True, True, False, True]
    rows = [("a", i, f) for i, f in enumerate(flags)] + [("b", i, False) for i in range(3)]
    frame = spark.createDataFrame(rows, "g string, i int, old boolean")
    got = sorted((r["g"], r["i"]) for r in windows.until_consecutive_old(frame, "g", "i", F.col("old")).collect())
    want, streak, over = [("b", 0), ("b", 1), ("b", 2)], 0, False
    for i, f in enumerate(flags):
        streak = streak + 1 if f else 0 if f is False else streak
        over = over or streak >= 3
        if not over and not f:
            want.append(("a", i))
    assert got == sorted(want)


@pytest.mark.parametrize("pieces", [1, 3, 20])
def test_consecutive_old_over_pieces(spark, pieces):
    """A group over many pieces, runs that go on from one to the next, pieces of old rows only, groups that never end."""
    import random

    dice = random.Random(pieces)
    groups = {
        "long": [False] * 90 + [None if i % 3 else True for i in range(60)] + [False] * 30,
        "never": [i % 3 != 2 for i in range(120)],
        "old": [True] * 50,
        **{f"g{k}": [dice.choice([True, False, None]) for _ in range(40)] for k in range(6)},
    }
    rows = [(g, i, f) for g, flags in groups.items() for i, f in enumerate(flags)]
    want = []
    for g, flags in groups.items():
        streak = 0
        for i, f in enumerate(flags):
            streak = streak + 1 if f else 0 if f is False else streak
            if streak >= 4:
                break
            if not f:
                want.append((g, i))
    got = windows.until_consecutive_old(spark.createDataFrame(rows, "g string, i int, old boolean"), "g", "i", F.col("old"), 4, pieces)
    assert got.columns == ["g", "i", "old"] and sorted((r["g"], r["i"]) for r in got.collect()) == sorted(want)


def plain_refinement(rows, threshold):
    """(cluster, article) that stay; rows: cluster, article, headline, content length, position, vector."""
    out = set()
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v]
    for cluster in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == cluster), key=lambda r: r[4])
        primary = max(own, key=lambda r: r[3])
        taken = [primary]
        for r in own:
            if r is primary:
                continue
            best, shared = 0.0, 0.0
            for m in taken:
                score = sum(x * y for x, y in zip(unit(r[5]), unit(m[5]), strict=True))
                if score > best:
                    a, b = set(r[2].split()), set(m[2].split())
                    best, shared = score, len(a & b) / len(a | b) if a and b else 0.0
            if best >= 0.93 or (best >= threshold and shared >= 0.10) or (shared >= 0.60 and best >= 0.75) or (shared >= 0.35 and best >= 0.80):
                taken.append(r)
        if len(taken) > 1:
            out |= {(cluster, r[1]) for r in taken}
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_refinement_against_a_model(spark, monkeypatch, block):
    """Small groups in one block, one group over many blocks, copies, headlines without words."""
    import numpy as np

    from newsframe.operators import greedy

    monkeypatch.setattr(greedy.taken_greedily, "__defaults__", (block,))
    dice = np.random.default_rng(block)
    rows, names = [], ["rain floods city", "Rain floods city streets", "city council meets", "sport today", ""]
    for cluster, size in enumerate([70, *[5] * 12, 1]):
        base = dice.normal(size=6)
        for k in range(size):
            v = base if k % 9 == 0 else base + dice.normal(size=6) * dice.choice([0.2, 0.6, 1.2])
            rows.append((cluster, len(rows), names[int(dice.integers(5))], int(dice.integers(20, 60)), int(1000 - len(rows)), [float(x) for x in v]))
    frame = spark.createDataFrame([*rows, (0, 5000, "no vector", 99, 0, None)], "cluster_id long, article_id long, headline string, content_length long, position long, v array<double>")
    got = {tuple(r) for r in clustering.refine(frame, 0.8).collect()}
    want = plain_refinement(rows, 0.8)
    assert got == want and 20 < len(want) < len(rows)
    assert clustering.refine(frame.limit(0)).collect() == []


@pytest.mark.parametrize(("size", "block"), [(200, 2048), (200, 16), (20_000, 2048)])
def test_long_chains_are_settled_block_by_block(spark, monkeypatch, size, block):
    """Each row is near enough to the one before alone, so each verdict waits for the last: rounds are blocks, not rows."""
    import numpy as np

    from newsframe.operators import greedy

    rounds: list[int] = []
    own = greedy.stored
    monkeypatch.setattr(greedy, "stored", lambda frame, *by: rounds.append(1) or own(frame, *by))
    turn = 0.5  # cosine 0.878 to the row before, 0.540 to the one before that
    angles = np.where(np.arange(size) % 1000 == 999, 2.0, turn).cumsum()  # a row far from all before it ends the chain for good
    rows = [(7, i, i, [float(np.cos(a)), float(np.sin(a)), float(i // 1000) * 50], [], i == 0) for i, a in enumerate(angles)]
    frame = spark.createDataFrame(rows, "group long, id long, place long, v array<double>, words array<string>, forced boolean").repartition(4)
    got = sorted(r["id"] for r in greedy.taken_greedily(frame, lambda score, _: score >= 0.8, block).collect())
    v = np.array([r[3] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    taken = [0]
    for i in range(1, size):
        if (v[taken] @ v[i]).max() >= 0.8:
            taken.append(i)
    assert got == taken and len(taken) > 100
    assert len(rounds) <= 3 + -(-size // block)


def test_discarded_tables_leave_no_files(spark):
    import os

    from newsframe.sources import checkpoints

    kept = checkpoints.stored(spark.range(5))
    made = checkpoints.stored(kept.filter("id > 2"))
    path = kept.stored_at.removeprefix("file:")
    assert os.path.isdir(path)
    checkpoints.discard(kept)
    checkpoints.discard(made.filter("id > 3"))
    assert not os.path.exists(path) and made.count() == 2


def test_numbers_along_an_order(spark):
    rows = [(i % 3 if i % 5 else 0, (i * 37) % 101, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g int, x int, id int").repartition(7)
    for pieces in (1, 5, 40):
        got = [(r["n"], r["id"]) for r in windows.numbered(frame, "n", F.desc("x"), F.asc("id"), pieces=pieces).collect()]
        assert sorted(got) == [(k, r[2]) for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)]
    got = {(r["g"], r["n"]): r["id"] for r in windows.numbered(frame, "n", F.col("x"), F.col("id"), group="g").collect()}
    want = {(g, k): r[2] for g in range(3) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1)}
    assert got == want


def test_co_occurrence_against_a_model(spark):
    import numpy as np

    dice = np.random.default_rng(8)
    rows = []
    for g in range(6):
        base = dice.normal(size=5)
        for _ in range(int(dice.integers(2, 14))):
            rows.append((len(rows), int(dice.integers(0, 6)), [float(x) for x in base + dice.normal(size=5) * dice.choice([0.05, 0.9])], float(dice.integers(0, 5)), g))
    want = {}
    for g in range(6):
        one = {}
        for r in [r for r in rows if r[4] == g]:
            one.setdefault(r[1], r)
        kept = []
        for r in sorted(one.values()):
            unit = lambda v: np.array(v) / np.linalg.norm(v)
            if all(unit(r[2]) @ unit(k[2]) <= 0.95 for k in kept):
                kept.append(r)
        if len(kept) > 1:
            want[g] = (len(kept), min(kept, key=lambda r: (-r[3], r[0]))[0])
    frame = spark.createDataFrame(rows, "vec_id long, asset_id long, v array<double>, target_score double, group_id long")
    got = vector_search.co_occurrence(frame.drop("group_id"), frame.select("vec_id", "group_id")).collect()
    assert {r["group_id"]: (r["n_assets"], r["representative"]) for r in got} == want and len(want) > 2
    assert [r["n_assets"] for r in got] == sorted((r["n_assets"] for r in got), reverse=True)


def test_index_on_disk_equals_a_whole_build(spark, tmp_path):
    """Builds one after another over the stored bands; a build reads the folders that its keys fall into."""
    import random

    dice = random.Random(4)
    fps = [dice.getrandbits(60) for _ in range(60)]
    rows = [(i, fps[dice.randrange(60)] ^ sum(1 << dice.randrange(60) for _ in range(dice.randrange(5)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, fp long")
    kept = []
    for i, fp in rows:
        if all(bin(fp ^ k).count("1") >= 6 for _, k in kept):
            kept.append((i, fp))
    got = []
    for a, z in ((0, 250), (250, 251), (251, 251), (251, 400)):
        got += [tuple(r) for r in vector_search.extend_index(str(tmp_path / "index"), frame.filter(f"id >= {a} AND id < {z}")).collect()]
    assert sorted(got) == kept and 60 <= len(kept) < 400


def test_sitemap_files(spark, tmp_path):
    from newsframe.sources import readers

    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://x/y">' + "".join(f"<url><loc><![CDATA[https://x.example/a&b/{i}]]></loc><lastmod>2024-01-{i % 28 + 1:02d}T00:00:00Z</lastmod></url>\n" for i in range(3000)) + "</urlset>")
    (tmp_path / "b.xml").write_text('<s:urlset xmlns:s="u"><s:url><s:loc>https://x.example/c/1</s:loc></s:url></s:urlset>')
    (tmp_path / "c.xml").write_text("<urlset><url><loc>https://x.example/d/1</loc></url>\n<url><loc>broken <b</url></urlset>")
    entries, broken = readers.read_sitemaps(spark, str(tmp_path))
    found = {r["loc"]: r["lastmod"] for r in entries.collect()}
    assert len(found) == 3002 and found["https://x.example/a&b/5"] == "2024-01-06T00:00:00Z" and found["https://x.example/c/1"] is None
    assert broken.count() == 1 and "broken" in broken.first()["text"]
    newest = readers.newest_of_sitemaps(spark, str(tmp_path), F.expr("TIMESTAMP_NTZ '2024-01-28 00:00:00'"), 200).collect()
    assert len(newest) == 109 and newest[0]["url"] == "https://x.example/a&b/1007"


def test_index_is_built_in_steps(spark):
    rows = [(1, 0), (2, 0b111), (3, 0b1111111), (4, 127 << 40), (5, (127 << 40) + 3), (6, 0b11111111111111)]
    frame = spark.createDataFrame(rows, "id long, fp long")
    nothing = frame.limit(0)
    index, processed, counts = vector_search.build_index(frame.filter("id <= 3"), nothing, nothing)
    assert {r["id"] for r in index.collect()} == {1, 3} and {r["id"] for r in processed.collect()} == {1, 2, 3}
    index, processed, counts = vector_search.build_index(frame, index, processed)
    assert {r["id"] for r in index.collect()} == {1, 3, 4, 6} and processed.count() == 6
    assert counts.first().asDict() == {"n_new": 3, "n_added": 2, "n_index": 4, "n_skipped": 1}


def test_an_encoder_of_the_caller(spark):
    frame = spark.createDataFrame([(i, None if i == 3 else "w " * i) for i in range(80)], "id long, text string").repartition(2)
    got = {r["id"]: r for r in clustering.embed_texts(frame, encoder=lambda texts: [[len(t), len(texts) <= 32] for t in texts]).collect()}
    assert all(got[i]["embedding"] == [0.0 if i == 3 else 2.0 * i, 1.0] for i in range(80))
    assert got[3]["text_hash"] == got[0]["text_hash"] != got[1]["text_hash"]


def test_a_run_replaces_the_last_and_is_logged(spark, tmp_path):
    as_of = datetime(2024, 1, 10)
    rows = [(i, f"rain floods city {i % 2}", "c" * (50 + i), 50 + i, datetime(2024, 1, 1 + i), "s", "x", "a, b") for i in range(6)]
    articles = spark.createDataFrame(rows, "id long, headline string, content string, content_length long, published_at timestamp_ntz, source_site string, category string, tags string")
    vectors = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(6)], "vec_id long, v array<double>")
    for hours, n in ((24 * 30, 6), (24 * 6, 3)):
        found, members = clustering.full_run(articles, vectors, as_of, hours, str(tmp_path))
        assert found.select("article_count").collect()[0][0] == n == members.count()
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2
    assert clustering.full_run(articles.limit(0), vectors, as_of, 1, str(tmp_path))[0].collect() == []


def test_assets_by_extension(spark, tmp_path):
    from newsframe.sources import readers

    (tmp_path / "below").mkdir()
    for name in ("a.jpg", "b.PNG", "below/c.WebP", "below/d.jpeg", "e.gif", "jpg", "f.jpg.txt"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    got = {(r["path"].rsplit("/", 1)[1], r["length"]) for r in readers.assets(spark, str(tmp_path)).collect()}
    assert got == {("a.jpg", 5), ("b.PNG", 5), ("c.WebP", 12), ("d.jpeg", 12)}


def test_late_updates_are_taken(spark, tmp_path):
    day = lambda n, h=0: datetime(2024, 1, n, h)
    rows = [("a", day(2), None), ("a", day(2), day(3)), ("b", day(1), day(3, 5)), ("b", day(1), day(3, 5)), ("b", day(1), day(4)), ("c", day(1), day(9)), ("d", None, day(2, 1)), ("e", None, None), ("f", day(5), day(2))]
    frame = spark.createDataFrame(rows, "key string, published timestamp_ntz, modified timestamp_ntz")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.late_updates(monitor.read_files(spark, str(tmp_path / "in"), frame.schema), "key", "published", "modified", day(1), day(5))
    got = spark.read.parquet(monitor.run_to_end(stream)).collect()
    assert sorted((r["key"], r["effective"]) for r in got) == [("a", day(2)), ("b", day(3, 5)), ("b", day(4)), ("d", day(2, 1)), ("f", day(5))]


def test_a_cluster_needs_a_shared_folder():
    from newsframe.sources import checkpoints

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        checkpoints.shared_folder(Session())


LABELS = [("7", " ", "7"), ("7", "news", "news"), (" 12 ", None, "12"), ("", None, "Uncategorized"), (None, "  x ", "x"), (None, "", "Uncategorized"), (" a ", "x", "a"), ("7a", "x", "7a")]
ASSETS = [("https://x.example/img/photo.jpg", True), ("https://x.example/AVATAR/photo.jpg", False), ("https://x.example/img/default.jpg", True), ("https://x.example/load-1.jpg", False), ("https://x.example/placeholder.jpg", True), ("data:image/png;base64,AAAAAAAA", False), ("https://x.ex/1.jpg", False), (None, False), ("", False)]
HEADLINES = [("Headline!", "Headline", "Headline", "Headline"), ("a \"b\"", "a \"b", "a \"b", "a \"b"), ("costs 5$", "costs 5", "costs 5$", "costs 5$"), ("শেষ।।", "শেষ", "শেষ", "শেষ"), ("x - ", "x - ", "x - ", "x -"), ("[x]", "[x", "[x", "[x]"), ("x\\^-&", "x", "x", "x\\^-&"), ("?!", "", "", ""), ("a!\n", "a!\n", "a!\n", "a!")]
DURATIONS = [(0, "0s"), (59, "59s"), (60, "1m"), (180, "3m"), (185, "3m 5s"), (3600, "1h"), (7200, "2h"), (7259, "2h"), (7260, "2h 1m"), (86399, "23h 59m")]
LEVELS = [("country-news", "a", "Main Category"), ("x/country-news/dhaka", "a", "Division"), ("country-news/a/b", "a", "District"), ("country-news/a/b/c", "a", "Upazilla"), ("country-news/a/b/c/d", "a", "Area"), ("country-news/a/country-news", "a", "Main Category"), ("world", "one", "Root"), ("world", "one-two", "Main Category"), ("world", "a-b-c", "Sub-Category"), ("world", "a-b-c-d", "Sub-Sub Category"), ("world", "a-b-c-d-e-f", "Deep Category")]
LINES = [
    ("✓ Inserted new article id 5", (True, False, False, False, 1)),
    ("[OK] Updated existing article", (False, True, False, False, 1)),
    ("Updating existing article", (False, True, False, False, 1)),
    ("Inserted new article (id 5) ✓ SUCCESS", (True, False, True, False, 2)),
    ("Inserted new article", (False, False, False, False, 0)),
    ("an exception, failed", (False, False, False, False, 0)),
    ("Failed to scrape", (False, False, False, True, 0)),
    ("ERROR: no", (False, False, False, True, 0)),
    ("✗ no", (False, False, False, True, 0)),
]
PLACES = [
    (lambda c: urls.location_fixed(c, "one-country-news"), "one-country-news-dhaka-gazipur-kaliakair", ("dhaka", "gazipur", "kaliakair")),
    (lambda c: urls.location_fixed(c, "one-country-news"), "one-country-news-dhaka-gazipur", ("dhaka", "gazipur", None)),
    (lambda c: urls.location_fixed(c, "one-country-news"), "one-country-news-dhaka", None),
    (lambda c: urls.location_fixed(c, "one-country-news"), "two-country-news-dhaka-gazipur", None),
    (urls.location_known, "two-dhaka-gazipur", ("dhaka", "gazipur", None)),
    (urls.location_known, "two-chittagong-cox-s-bazar", ("chittagong", "cox", "s-bazar")),
    (urls.location_known, "two-dhaka", None),
    (urls.location_known, "two-Dhaka-gazipur", None),
    (urls.location_known, "two-chattogram-x", None),
    (urls.location_scan, "Three-Country-Barisal-Bhola-Char-Fasson", ("barisal", "bhola", "char-fasson")),
    (urls.location_scan, "three-country-sylhet", ("sylhet", "sylhet", None)),
    (urls.location_scan, "three-world-sylhet", None),
    (urls.location_scan, "three-country-nowhere", None),
]


def test_values_as_the_sites_write_them(spark):
    """Labels, image addresses, headlines, durations, levels and log lines, hand-made."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = table([r[:2] for r in LABELS], "a string, b string").select(filters.category_label(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [r[2] for r in LABELS]
    rows = table([(r[0],) for r in ASSETS], "a string").select(filters.is_asset_url(F.col("a"))).collect()
    assert [r[0] for r in rows] == [r[1] for r in ASSETS]
    kinds = text.without_trailing_marks(F.col("a")), text.without_trailing_marks(F.col("a"), text.TRAILING_MARKS_NO_DOLLAR), text.without_trailing_marks(F.col("a"), text.FEW_TRAILING_MARKS, True)
    assert [tuple(r) for r in table([(r[0],) for r in HEADLINES], "a string").select(*kinds).collect()] == [r[1:] for r in HEADLINES]
    rows = table([(r[0],) for r in DURATIONS], "a long").select(text.duration(F.col("a"))).collect()
    assert [r[0] for r in rows] == [r[1] for r in DURATIONS]
    rows = table([r[:2] for r in LEVELS], "a string, b string").select(urls.level_label(F.split("a", "/"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [r[2] for r in LEVELS]
    rows = table([(r[0],) for r in LINES], "a string").select(text.log_flags(F.col("a"))).collect()
    assert [tuple(r[0]) for r in rows] == [r[1] for r in LINES]
    states = table([("[STATUS:finding:page 1]",), ("[STATUS:sleeping:x]",), ("[STATUS:waiting:a:b]",)], "a string").select(text.status_state(F.col("a")), text.status_detail(F.col("a"))).collect()
    assert [tuple(r) for r in states] == [("finding", "page 1"), (None, None), ("waiting", "a:b")]


@pytest.mark.parametrize("parse, label, want", PLACES)
def test_locations(spark, parse, label, want):
    got = spark.range(1).select(parse(F.lit(label))).first()[0]
    assert (got and tuple(got)) == want


def test_retry_stream_equals_table(spark, tmp_path):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), *(("c", i, False) for i in range(12)), *(("d", i, i == 11) for i in range(12))]
    frame = spark.createDataFrame(rows, "key string, position long, ok boolean")
    want = sorted(tuple(r) for r in monitor.retry_table(frame).collect())
    assert want == [("a", 2, "success"), ("b", 1, "retry"), ("c", 10, "exhausted"), ("d", 10, "exhausted")]
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.retry_states(monitor.read_files(spark, str(tmp_path / "in"), frame.schema))
    out = monitor.run_to_end(stream, mode="update")
    assert sorted(tuple(r)[:3] for r in spark.read.parquet(out).collect()) == want


def test_retry_stream_takes_files_in_any_order(spark, tmp_path):
    """Later attempts come in earlier files and micro-batches, and a key in many batches of Arrow."""
    rows = [*(("a", i, i == 7) for i in range(1, 20)), *(("b", i, i == 30) for i in range(1, 40)), *(("c", i, False) for i in range(6)), *(("d", i, i in (3, 9)) for i in range(1, 12))]
    frame = spark.createDataFrame(rows, "key string, position long, ok boolean")
    want = sorted(tuple(r) for r in monitor.retry_table(frame).collect())
    assert want == [("a", 7, "success"), ("b", 10, "exhausted"), ("c", 6, "retry"), ("d", 3, "success")]
    for k in range(3):
        part = spark.createDataFrame([r for r in rows if (r[1] + k) % 3 == 0][::-1], frame.schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for files in (1, 9):
            stream = monitor.retry_states(monitor.read_files(spark, str(tmp_path / "in"), frame.schema, files))
            out = monitor.run_to_end(stream, mode="update")
            told = spark.read.schema("key string, attempts int, state string, batch int").option("basePath", out).parquet(f"{out}/batch=*")
            last = told.groupBy("key").agg(F.max_by(F.struct("attempts", "state"), "batch").alias("r")).select("key", "r.*")
            assert sorted(tuple(r) for r in last.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def plain_groups(v, threshold, merge=True):
    """Groups of vectors of length 1 in their order, one step after another: lists of row numbers, oldest first."""
    import numpy as np

    unit = lambda x: x / (np.linalg.norm(x) or 1.0)
    groups = []
    for i in range(len(v)):
        best, at = 0.0, -1
        for k, g in enumerate(groups):
            score = max(unit(v[g].mean(axis=0)) @ v[i], (v[g] @ v[i]).max())
            if score > best:
                best, at = score, k
        if best >= threshold and at >= 0:
            groups[at].append(i)
        else:
            groups.append([i])
    merged = merge
    while merged:
        merged, i = False, 0
        while i < len(groups):
            j = i + 1
            while j < len(groups):
                a, b = v[groups[i]], v[groups[j]]
                if unit(a.mean(axis=0)) @ unit(b.mean(axis=0)) >= threshold or (a @ b.T).max() >= threshold:
                    groups[i] += groups.pop(j)
                    merged = True
                else:
                    j += 1
            i += 1
    return groups


@pytest.mark.parametrize(("seed", "threshold", "block"), [(1, 0.6, 2048), (2, 0.75, 64), (3, 0.45, 100), (4, 0.9, 50)])
def test_groups_in_order_against_a_model(spark, seed, threshold, block):
    """Vectors around moving means, lone ones, copies; in one block and over several."""
    import numpy as np

    dice = np.random.default_rng(seed)
    base = dice.normal(size=(14, 7))
    v = np.concatenate([base[dice.integers(0, 14, 380)] + dice.normal(size=(380, 7)) * dice.choice([0.2, 0.6, 1.0], (380, 1)), dice.normal(size=(120, 7))])
    v = v[dice.permutation(500)]
    v[40] = v[3]
    v /= np.linalg.norm(v, axis=1)[:, None]
    frame = spark.createDataFrame([(7 * i + 3, x) for i, x in enumerate(v.tolist())], "vec_id long, v array<double>").repartition(3)
    first = {7 * i + 3: 7 * g[0] + 3 for g in plain_groups(v, threshold, merge=False) for i in g}
    found = grouping.grouped_in_order(frame, threshold, block=block)
    assert {r["vec_id"]: r["group_id"] for r in found.collect()} == first
    merged = {7 * i + 3: 7 * g[0] + 3 for g in plain_groups(v, threshold) for i in g}
    got = grouping.merged_in_order(found.join(frame, "vec_id"), threshold)
    assert {r["vec_id"]: r["group_id"] for r in got.collect()} == merged
    assert grouping.grouped_in_order(frame.limit(0)).collect() == []


def test_merged_groups_against_a_model(spark):
    import numpy as np

    dice = np.random.default_rng(4)
    centres = dice.normal(size=(5, 8))
    vectors = [(i, int(i % 15), (centres[i % 5] + dice.normal(size=8) * 0.5).tolist()) for i in range(60)]
    group = {i: g for i, g, _ in vectors}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in vectors}
    while True:
        names = sorted(set(group.values()))
        means = {g: np.mean([unit[i] for i in group if group[i] == g], axis=0) for g in names}
        near = [(a, b) for a in names for b in names if a < b and means[a] @ means[b] / (np.linalg.norm(means[a]) * np.linalg.norm(means[b])) >= 0.8]
        if not near:
            break
        root = {g: g for g in names}
        for _ in names:
            for a, b in near:
                root[a] = root[b] = min(root[a], root[b])
        group = {i: root[g] for i, g in group.items()}
    got = vector_search.merge_groups(spark.createDataFrame(vectors, "vec_id long, group_id long, v array<double>"), 0.8)
    assert {r["vec_id"]: r["group_id"] for r in got.collect()} == group and len(set(group.values())) < 15


@pytest.mark.parametrize("kind", ["clusters", "uniform", "copies", "one cell"])
def test_pairs_by_cells_are_all_pairs(spark, kind):
    """Against all pairs, on vectors with and without clusters, with many copies, and near a single direction; links connect the same."""
    import numpy as np

    dice = np.random.default_rng(len(kind))
    base = dice.normal(size=(30, 8))
    v = {
        "clusters": lambda: base[dice.integers(0, 30, 700)] + dice.normal(size=(700, 8)) * 0.15,
        "uniform": lambda: dice.normal(size=(500, 8)),
        "copies": lambda: np.concatenate([np.tile(base[0], (200, 1)), base[0] * dice.uniform(0.5, 3, (60, 1)), dice.normal(size=(200, 8)), np.zeros((5, 8))]),
        "one cell": lambda: base[0] * 5 + dice.normal(size=(400, 8)) * 0.1,
    }[kind]()
    frame = spark.createDataFrame([*((i, x) for i, x in enumerate(v.tolist())), (None, v[0].tolist()), (9000, None), (9001, [])], "vec_id long, v array<double>").repartition(3)
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    score = unit @ unit.T
    for threshold in (0.93, 0.6, 0.0) if kind != "one cell" else (0.999,):
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(score >= threshold - 1e-12), strict=True) if a < b}
        sure = {(int(a), int(b)) for a, b in zip(*np.nonzero(score >= threshold + 1e-12), strict=True) if a < b}
        got = [(r["a"], r["b"]) for r in similarity.similar_pairs(frame, threshold, block=24).collect()]
        assert len(got) == len(set(got)) and sure <= set(got) <= want
        if threshold > 0:
            links = [(r["a"], r["b"]) for r in similarity.similar_links(frame, threshold, block=24).collect()]
            root = list(range(len(v)))

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in links:
                root[max(find(a), find(b))] = min(find(a), find(b))
            groups = similarity._components(len(v), *(np.array([p[k] for p in got], np.int64) for k in (0, 1)))
            assert [find(i) for i in range(len(v))] == groups.tolist()
    if kind == "clusters":
        work = similarity.similarity_work(frame, 0.93, block=24)
        assert work["cells"] > 20 and work["compared"] < 0.3 * work["all"]


def test_approximate_pairs_find_near_ones(spark):
    import numpy as np

    dice = np.random.default_rng(5)
    base = dice.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + dice.normal(size=base.shape) * 0.02]))]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    exact = {(r["a"], r["b"]) for r in similarity.similar_pairs(frame, 0.95, block=16).collect()}
    found = {(r["a"], r["b"]) for r in joins.approx_similar_pairs(frame, 0.95).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 0


DATES = [
    (dates.date_first_marked, "প্রকাশ: ০৯ জানুয়ারি ২০২৬, ০৩:৩৫ পিএম", datetime(2026, 1, 9, 15, 35)),
    (dates.date_first_marked, "০৯ জানুয়ারি ২০২৬, ১২:০৫ এএম", datetime(2026, 1, 9, 0, 5)),
    (dates.date_first_marked, "০৯ জানুয়ারি ২০২৬, ১২:০৫ পিএম", datetime(2026, 1, 9, 12, 5)),
    (dates.date_first_marked, "০৯ জানুয়ারি ২০২৬, ০৩:৩৫", None),
    (dates.date_first, "৩১ ফেব্রুয়ারি ২০২৬, ০৩:৩৫", None),
    (dates.date_first, "09 Nonsense 2026, 03:35", None),
    (dates.either_first, "০৮:৫২ এএম, ০১ ফেব্রুয়ারি ২০২৬", datetime(2026, 2, 1, 8, 52)),
    (dates.either_first, "১২:৫২, ০১ ফেব্রুয়ারি ২০২৬", datetime(2026, 2, 1, 0, 52)),
    (dates.piped, "প্রকাশ: ১৭ ফেব্রুয়ারি ২০২৬ | ০৫:৪৫", datetime(2026, 2, 17, 5, 45)),
    (dates.date_only, "বৃহস্পতিবার, ১৯ ফেব্রুয়ারি ২০২৬", datetime(2026, 2, 19)),
    (dates.local_to_utc, "বৃহস্পতিবার, ১৯ ফেব্রুয়ারি ২০২৬, ০৪:৪১ এএম", datetime(2026, 2, 18, 22, 41)),
    (dates.english, "Publish : 15 Feb 2026, 07:56 PM Update", datetime(2026, 2, 15, 19, 56)),
    (dates.iso_local, "2026-02-15T19:56:00+06:00", datetime(2026, 2, 15, 19, 56)),
    (dates.iso_local, "", None),
    (dates.meta_time, "soon", None),
]


@pytest.mark.parametrize(("parse", "raw", "want"), DATES)
def test_dates(spark, parse, raw, want):
    assert spark.range(1).select(parse(F.lit(raw))).first()[0] == want


def test_urls_and_locations(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(urls.canonical_url(F.lit("/a/b/12/?q=1#x"), "https://x.example")) == "https://x.example/a/b/12"
    assert one(urls.canonical_url(F.lit("https://other.org/a"), "https://x.example")) is None
    assert one(urls.canonical_url(F.lit("mailto:a@b.c"), "https://x.example")) is None
    assert one(urls.item_id(F.lit("https://x.example/2024/01/news/77/some-slug"))) == "77"
    assert one(urls.clean_image_url(F.lit("https://a.b/https://a.b/og/x-fb.jpg?watermark=9"))) == "https://a.b/x.jpg"
    assert one(text.without_last_word(F.lit("one"))) == ""


def test_empty_and_null_inputs(spark):
    empty = spark.createDataFrame([], "vec_id long, v array<double>")
    assert similarity.similar_pairs(empty, 0.5).count() == 0
    assert clustering.similarity_clusters(empty, 0.5).count() == 0
    nulls = spark.createDataFrame([(None, None, None)], "headline string, published string, content string")
    assert nulls.select(filters.reject_reason(F.col("headline"), F.col("published"), F.col("content"))).first()[0] == "headline"


def test_many_keywords_are_joined_by_their_parts(spark):
    """Keywords of all lengths against brute force; no Python in the plan, and nothing but sizes comes to the driver."""
    import random

    dice = random.Random(3)
    letters = "abcdeé🙂 .*"
    words = [f"k{i}" for i in range(joins.KEYWORD_BLOCK + 100)] + ["k1", "Head", "", "a", "É", "ab", ".*", "🙂🙂"] + ["".join(dice.choice(letters) for _ in range(dice.randrange(1, 9))) for _ in range(900)] + [None]
    keywords = spark.createDataFrame([(i, w, int(i % 50 != 3)) for i, w in enumerate(words)], "id long, keyword string, is_active int")
    texts = [("head K12", "k300 k5"), (None, "xk1y"), ("none", None), (None, None), ("", "")] + [("".join(dice.choice(letters) for _ in range(30)), "".join(dice.choice(letters).upper() for _ in range(dice.randrange(200)))) for _ in range(60)]
    articles = spark.createDataFrame([*((i, *t) for i, t in enumerate(texts)), (1, "second k12", "version"), (None, "k1", "k1")], "id long, headline string, content string")
    frame = joins.keyword_matches(articles, keywords)
    got = [tuple(r) for r in frame.collect()]
    rows = [*enumerate(texts), (1, ("second k12", "version"))]
    want = [(k, i) for i, t in rows for k, w in enumerate(words) if w is not None and k % 50 != 3 and w.lower() in " ".join(x for x in t if x is not None).lower()]
    assert sorted(got) == sorted(want) and len(want) > 1000
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    few = keywords.filter("id < 50 OR id > 1400")
    assert sorted(tuple(r) for r in joins.keyword_matches(articles, few).collect()) == sorted((k, i) for k, i in want if k < 50 or k > 1400)
    assert joins.keyword_matches(articles, keywords.limit(0)).collect() == []


def test_pages_laid_out_in_folders(spark, monkeypatch):
    monkeypatch.setattr(windows, "PAGES_A_SPAN", 4)
    frame = spark.createDataFrame([((i * 7919) % 1000, i) for i in range(1000)], "x int, id int").repartition(6)
    listing = windows.pages(frame, 10, F.desc("x"), F.asc("id"))
    for number in (1, 4, 5, 100):
        assert sorted(r["x"] for r in windows.page_of(listing, number).collect()) == sorted(999 - k for k in range((number - 1) * 10, number * 10))
    assert windows.page_of(listing, 101).collect() == []
    scan = windows.page_of(listing, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(span" in scan


def test_job_tails_over_micro_batches(spark, tmp_path):
    """The stream's counters, states and tails equal those of the table, in whatever order lines arrive."""
    import random

    dice = random.Random(1)
    lines = ["[STATUS:finding:a]", "[STATUS:extracting:b c]", "Error: x", "✓ Inserted new article", "plain", "✓ SUCCESS"]
    rows = [(f"j{dice.choice([0, 0, 0, 1, 2])}", datetime(2024, 1, 1, 0, dice.randrange(60)), i, dice.choice(lines) + ("" if i % 3 else f" {i}")) for i in range(700)]
    schema = "job string, ts timestamp, event_id long, line string"
    dice.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k * 140 : (k + 1) * 140], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.createDataFrame(rows, schema)
    out = monitor.run_to_end(monitor.job_tails(monitor.read_files(spark, str(tmp_path / "in"), frame.schema, 1), 100), mode="update", state_store=monitor.ROCKS)
    told = spark.read.option("basePath", out).parquet(out)
    assert told.select("batch").distinct().count() == 5
    got = {r["job"]: r["r"] for r in told.groupBy("job").agg(F.max_by(F.struct("lines", "errors", "processed", "state", "detail", "tail"), "batch").alias("r")).collect()}
    counted = {r["job"]: r for r in monitor.job_counters(frame).collect()}
    tails: dict = {}
    for r in windows.last_n(frame, "job", 100, "ts", "event_id").collect():
        tails.setdefault(r["job"], []).append((-r["rank"], r["line"]))
    states = {r["job"]: r["state"] for r in windows.latest_of_each(frame.withColumn("state", text.status_state(F.col("line"))).filter("state IS NOT NULL"), "job", "state", "ts", "event_id").collect()}
    assert set(got) == set(counted)
    for job, r in got.items():
        assert (r["lines"], r["errors"], r["processed"]) == (counted[job]["lines"], counted[job]["errors"], counted[job]["processed"])
        assert r["state"] == states[job] and r["tail"] == [line for _, line in sorted(tails[job])]


def test_monitor_keeps_no_state_and_inserts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monitor, "SPAN", 3)
    keywords = spark.createDataFrame([(1, "alpha", 1), (2, "beta", 1)], "id long, keyword string, is_active int")
    schema = "id long, headline string, content string"
    files = [[(1, "alpha", ""), (2, "beta alpha", "")], [(1, "alpha", "again"), (5, "none", "")], [(2, "beta", "alpha"), (9, "beta", ""), (9, "beta", ""), (1, "beta", "a later version")], []]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = monitor.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    got = monitor.monitor_keywords(stream, keywords)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 9)]


def test_a_query_set_larger_than_a_plan_holds(spark):
    import numpy as np

    dice = np.random.default_rng(2)
    queries = dice.normal(size=(vector_search.MOST_QUERIES + 200, 4)).tolist()
    rows = [(i % 50, i % 7, v) for i, v in enumerate(dice.normal(size=(90, 4)).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, asset_id long, v array<double>")
    got = vector_search.set_scores(frame, spark.createDataFrame([(q,) for q in [*queries, queries[0]]], "v array<double>"), block=64).collect()
    q, v = np.array([*queries, queries[0]]), np.array([r[2] for r in rows])
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    want = 0.7 * unit(v) @ unit(q.mean(axis=0)) + 0.3 * (unit(v) @ unit(q).T).max(axis=1)
    assert sorted((r["vec_id"], r["asset_id"], round(r["score"], 9)) for r in got) == sorted((a, b, round(s, 9)) for (a, b, _), s in zip(rows, want.tolist(), strict=True))
    assert vector_search.set_scores(frame, frame.limit(0)).collect() == []


PAGES = [
    ("kalbela", '<h1>other</h1><h1 class="big details-title">Head!।</h1><div class="dtl_content_section"><p>short</p><p>a paragraph of more than twenty</p><p>another paragraph of that length</p></div><img src="/a/1.jpg"><img src="/a/2.jpg?x=1" class="img-fluid detailImg">', "Head", "a paragraph of more than twenty", "2.jpg?x=1"),
    ("desh", '<h2 class="details-title">Head</h2><section class="dtl_content_section">All <b>the</b> text</section>', "Head", "All the text", None),
    ("jugantor", '<h1>Head</h1><div class="desktopDetailBody"><script>x()</script><p>One</p><p>Two</p></div><figure class="f"><img alt="" src="https://x/y/3.png"></figure>', "Head", "One\nTwo", "3.png"),
    ("jugantor", '<h1 class="my-3">Head</h1><div class="desktopDetailPhotoDiv"><img src="4.png"></div>', "Head", None, "4.png"),
    ("ittefaq", '<h1 class="title mb">Head</h1><div class="content_detail_each_group"><p>One</p><p> </p><p>Two</p></div><meta property="og:image" content="https://x/5.jpg?w=1">', "Head", "One Two", "5.jpg"),
    ("bdnews24", '<h1>Head</h1><div id="contentDetails"></div><div class="custombody"><p>Body</p></div><img class="img-responsive" src="6.jpg">', "Head", "Body", "6.jpg"),
    ("prothomalo", '<h1>Head</h1><div class="x-story-element-text-y"><p>One</p></div><div class="story-element-text">Two</div><img src="7.jpg">', "Head", "One Two", "7.jpg"),
    ("dhakapost", '<h1>Head</h1><div class="news-details-x"><p>One</p></div><img class="a w-full" src="https://cdn.dhakapost.com/media/imgAll/8.jpg">', "Head", "One", "8.jpg"),
    ("dhakapost", '<h1>Head</h1><img class="w-full" src="https://other/8.jpg">', "Head", None, None),
    ("jagonews24", '<h2>Head</h2><div class="content-details"><p>One</p></div><meta property="og:image" content="https://cdn.jagonews24.com/9.jpg">', "Head", "One", "9.jpg"),
    ("samakal", '<h1>Head</h1><div class="dNewsDesc"><p>brief</p><p>a paragraph of more than twenty</p></div><div class="DNewsImg"><img src="lazy.gif" data-src="10.jpg"></div>', "Head", "a paragraph of more than twenty", "10.jpg"),
    ("sangbad", '<h2 class="title">Head</h2><p>a paragraph of much more than thirty characters</p><img src="/images/1/main_image/11.jpg">', "Head", "a paragraph of much more than thirty characters", "11.jpg"),
    ("amadershomoy", '<meta property="og:title" content="Head"><article><p>a paragraph of much more than thirty characters</p><p>short</p></article><img src="12.jpg">', "Head", "a paragraph of much more than thirty characters", "12.jpg"),
    ("bd-pratidin", '<h1 class="card-title">Head</h1><article><p>a paragraph of much more than thirty characters</p></article><meta property="og:image" content="https://x/og/13.jpg">', "Head", "a paragraph of much more than thirty characters", "13.jpg"),
    ("mzamin", '<h1>Head</h1><div class="content"><p>a paragraph of much more than thirty characters</p></div><img src="a.jpg"><img class="article-image" src="14.jpg">', "Head", "a paragraph of much more than thirty characters", "14.jpg"),
    ("dhakatribune", '<h1>Head</h1><article class="jw_detail_content_holder x"><p>a paragraph of much more than thirty characters</p></article>', "Head", "a paragraph of much more than thirty characters", None),
    ("janakantha", '<h1>Head</h1><article class="DDetailsContent"><p>a paragraph of much more than thirty characters</p></article><img class="TopImg" src="16.jpg">', "Head", "a paragraph of much more than thirty characters", "16.jpg"),
    ("boishakhi", '<h1>Head</h1><div class="dtl_content_section"><p>a paragraph of much more than thirty characters</p></div><div class="dtl_img_section"><img src="17.jpg"></div>', "Head", "a paragraph of much more than thirty characters", "17.jpg"),
    ("mzamin", '<h1>Head</h1><div class="article-content"><p>short</p></div><article><p>a paragraph of much more than thirty characters</p></article>', "Head", None, None),
    ("sangbad", '<h1>Head</h1><img alt="no address"><img src="/images/x.jpg"><img src="/images/main_image/y.jpg"><meta property="og:image" content="z.jpg">', "Head", None, "z.jpg"),
    ("desh", '<article class="details-title">Head <div>line</div></article>', "Head line", None, None),
    ("unknown", "<h1>Head</h1>", None, None, None),
    ("kalbela", None, None, None, None),
]


def test_elements_end_at_their_own_tags(spark):
    from newsframe.functions import html

    one = lambda c: spark.range(1).select(c).first()[0]
    page = F.lit('<p>0</p><div class="content"><div>a<DIV>q</div></div><p>b</p></DIV ><div>z</div><divider>')
    div, content = r"(?i)<div\b[^>]*>", r'(?i)<div\b[^>]*\bclass="content"[^>]*>'
    assert one(html.inside(page, content)) == "<div>a<DIV>q</div></div><p>b</p>"
    assert one(html.paragraphs(page, (content,))) == ["b"]
    assert one(html.every_inside(page, div)) == ["<div>a<DIV>q</div></div><p>b</p>", "a<DIV>q</div>", "q", "z"]
    assert one(html.inside(page, r"(?i)<section\b[^>]*>")) is None and one(html.every_inside(page, r"(?i)<section\b[^>]*>")) == []
    assert one(html.inside(F.lit("<div>a<div>b</div>"), div)) == "a<div>b</div>" and one(html.inside(F.lit("<div></div>"), div)) == ""
    assert one(html.inside(F.lit(None).cast("string"), div)) is None


def test_json_ld_of_any_shape(spark):
    from newsframe.functions import html

    def one(script, *fields):
        return spark.range(1).select(html.json_ld(F.lit(f"<html>{script}"), *fields)).first()[0]

    ld = lambda x: f'<script data-x="1" type="application/ld+json">{x}</script>'
    graph = '{"@graph": [' + '{"a": 1}, ' * 12 + '{"datePublished": "2024-01-01", "image": {"url": "u"}}]}'
    assert one(ld("not json") + ld(graph), "datePublished") == "2024-01-01"
    assert one(ld(graph), "image.url", "image") == "u" and one(ld(graph), "image") is None
    assert one(ld('[{}, 1, null, "x", {"author": "me"}, {"author": "you"}]'), "author") == "me"
    assert one(ld('{"a": null}') + ld('{"a": 7}'), "a") == "7"
    assert one(ld("{"), "a") is None and one(ld(""), "a") is None and one("", "a") is None


def test_rules_of_the_sites(spark):
    from newsframe.sources import sites

    frame = spark.createDataFrame([(i, f"The {p[0]} online", p[1]) for i, p in enumerate(PAGES)], "page_id long, source_site string, html string")
    got = sites.extract_articles(frame).orderBy("page_id").collect()
    assert [(r["headline"], r["content"], r["image_name"]) for r in got] == [p[2:] for p in PAGES]
    assert {s for _, s in sites.SITES} == set(sites.HEADLINES) == set(sites.BODIES) == set(sites.IMAGES)
