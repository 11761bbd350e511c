"""Bounded samples of labelled rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of a model; more are an error, as none is left out.
MOST_LABELS = 2048


def sample_by_label(rows: DataFrame, label: str, key: Column, n: int, most_rows: int | None = None) -> DataFrame:
    """n rows of each label at most, those least by a hash of key: the same rows whenever the table is the same.

    With most_rows, n is less where that many labels have no more rows together (one a label at least). The labels' counts come to the driver, MOST_LABELS at
    most. They give the share of hashes that leaves about 2 n rows a label (n + 200 at least), so that the window that takes the n least sees few rows however many there are.
    """
    order = F.xxhash64(key)
    counts = {r[0]: r[1] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if most_rows is not None:
        n = max(1, min(n, most_rows // max(1, len(counts))))
    shares = {value: int(min(1.0, (2 * n + 200) / count) * (1 << 20)) + 1 for value, count in counts.items()}
    some = F.pmod(order, F.lit(1 << 20)) < F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col(label)] if shares else F.lit(False)
    ranked = rows.filter(some).withColumn("__rank", F.row_number().over(Window.partitionBy(label).orderBy(order, key)))
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null keys are in none."""
    return F.crc32(key.cast("string").cast("binary")) % folds
