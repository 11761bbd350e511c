"""The corpus pipeline: language ID, quality, near duplicates, decontamination, encoding. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe.llm.byte_bpe import encode
from newsframe.llm.catalog import tokenizer
from newsframe.llm.decontamination import mark_contamination
from newsframe.llm.language_id import UNDETERMINED, fit_language_model, predict_language
from newsframe.llm.ngram_join import jaccard_components
from newsframe.llm.quality import fit_quality_model, score_quality
from newsframe.llm.sampling import fold
from newsframe.llm.session import prepare, stored
from newsframe.sources.checkpoints import discard

#: Bitmaps of kept rows that are broadcast.
MOST_BITMAPS = 25_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and fit the language found, of those learnt from the labelled ones."""
    model = fit_language_model(docs.filter(fold(F.col("doc_id"), 3) != 1))
    found = predict_language(docs.select(COLUMNS), model)
    return found.filter((F.col("lang_pred") != UNDETERMINED) & F.col("fits")).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id"), 4) != 2)
    return score_quality(docs.select(COLUMNS), fit_quality_model(docs, labels)).filter("predicted = 1").select(COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with `file` and `number`, which name a row: of a table in files where it is, of anything else a number that is written with a copy, as reading again may deal
    rows otherwise."""
    try:
        return docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"))
    except AnalysisException:
        return stored(docs.select(*COLUMNS, F.lit("").alias("file"), F.monotonically_increasing_id().alias("number")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one, that with the smallest doc_id (none: after all others); rows without words are in no group and stay.

    Rows, not ids, are linked and kept, so repeated, shared and missing ids make no difference. What is kept of each file is written as bitmaps, of 32,768 rows each;
    up to MOST_BITMAPS they are broadcast (4 kB each), so that the texts stay where they are, beyond that the kept rows are joined.
    """
    rows = _numbered(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "number")
    groups = jaccard_components(rows.select(order.alias("row"), "text"), doc_id="row")
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id.file", "doc_id.number")
    place, bucket = F.bitmap_bit_position(F.col("number") + 1), F.bitmap_bucket_number(F.col("number") + 1).alias("bucket")
    bitmaps = stored(kept.groupBy("file", bucket).agg(F.bitmap_construct_agg(place).alias("bits")))
    if bitmaps.count() > MOST_BITMAPS:
        return rows.join(kept, ["file", "number"], "left_semi").select(COLUMNS)
    found = rows.withColumn("bucket", bucket).join(F.broadcast(bitmaps), ["file", "bucket"])
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.filter(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their spans of benchmark text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = mark_contamination(docs.select(COLUMNS), benchmark, cleaned="cleaned").select("doc_id", F.col("cleaned").alias("text"), "lang", "source")
    return marked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text."""
    encoded = encode(docs.select("doc_id", "lang", "source", "text", F.coalesce("text", F.lit("")).alias("given")), tokenizer("byte_bpe_multi_50k.tiktoken"), outputs=("ids", "decoded"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.col("given").cast("binary")).alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Two stages apply fitted models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents after all stages; each stage's result is written to the shared folder and read again, and deleted when the next one is written."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
