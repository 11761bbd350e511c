"""The registered queries of this package against their SQL, and the pipeline's stages."""

import base64

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from newsframe.llm.catalog import ORACLES, QUERIES
from newsframe.llm.language_id import fit_language_model, predict_language
from newsframe.llm.quality import fit_quality_model, score_quality
from newsframe.llm.sampling import fold

from ..oracle import connection, same
from .test_search import brute_components, brute_spans


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, connection(sf_dir), QUERIES[name], ORACLES[name], sf_dir)


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and set(ids) <= docs and len(ids) > len(docs) // 2
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in got)


def test_pipeline_equals_brute_force(spark, sf_dir):
    """The models' verdicts are asked for a row at a time; everything after them is worked out here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_language_model(docs.filter(fold(docs["doc_id"], 3) != 1))
    first = predict_language(docs, model).filter("lang_pred <> 'und' AND fits").select(docs.columns).persist()
    second = score_quality(first, fit_quality_model(first, labels.filter(fold(labels["doc_id"], 4) != 2))).filter("score >= 0.7").collect()
    text = {r["doc_id"]: r["text"] for r in second}
    left = {i: text[i] for i, _, root in brute_components(list(text.items())) if i == root}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in left.items():
        for a, b in reversed(brute_spans(t, items)):
            t = t[:a] + t[b:]
        want[i] = library.encode_ordinary(t)
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == want
    assert 0 < len(want) < len(text) < first.count() + 1


def test_language_stage_leaves_out_what_fits_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    german = docs.filter("lang = 'de'").withColumn("doc_id", docs["doc_id"] + 10_000).withColumn("lang", docs["source"].substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang", "source", "n_chars")
    other = spark.createDataFrame([(20_000, "Это совсем другой язык и другая письменность, которой здесь нет", None, "s", 60), (20_001, "これは学習されていない言語の文章です。日本語です", None, "s", 24)], docs.schema)
    learnt = docs.filter("lang <> 'de'")
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, learnt.unionByName(german).unionByName(other), sf_dir).collect()}
    assert not kept & {20_000, 20_001}
    clean = {r["doc_id"] for r in learnt.filter("text rlike '\\\\p{L}'").collect()}
    assert len(clean & kept) >= 0.98 * len(clean) and len(kept - clean) <= 0.1 * german.count()


def test_stages_take_empty_tables_and_nulls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None)], docs.schema)
    for frame in (docs.limit(0), nulls):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.count() <= frame.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_stages_take_extra_columns_with_clashing_names(spark, sf_dir):
    """Columns beside those of documents change nothing, whatever they are called."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("score", "predicted", "fits", "lang_pred", "key", "row", "file", "number", "bucket", "hot", "hashes", "ids", "n_tokens", "decoded", "given", "cleaned", "spans", "n_words", "component_id", "n_shingles", "label", "quality")
    wide = docs.select("*", *(F.lit("extra").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        plain, other = (sorted((str(tuple(r)) for r in stage(spark, d, sf_dir).collect())) for d in (docs, wide))
        assert plain == other, name


@pytest.mark.parametrize("most_bitmaps, in_files", [(25_000, False), (25_000, True), (0, True)])
def test_one_row_of_each_group_stays(spark, sf_dir, monkeypatch, tmp_path, most_bitmaps, in_files):
    monkeypatch.setattr(corpus_pipeline, "MOST_BITMAPS", most_bitmaps)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    near = text["a"].replace("a39", "other")
    rows = [(5, text["a"])] * 30 + [(7, near), (7, text["b"]), (None, text["a"]), (None, text["c"]), (None, text["c"]), (9, text["d"]), (8, text["d"]), (3, ""), (3, "")]
    frame = spark.createDataFrame([(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate(rows)], schema).repartition(3)
    if in_files:
        frame.write.parquet(str(tmp_path / "docs"))
        frame = spark.read.schema(schema).parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.near_duplicate_stage(spark, frame, sf_dir)
    want = [(5, text["a"]), (7, text["b"]), (None, text["c"]), (8, text["d"]), (3, ""), (3, "")]
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
