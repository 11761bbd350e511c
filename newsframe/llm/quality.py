"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

A text's features are its distinct words (runs of ASCII letters and digits and of bytes from 0x80, in lower case, hashed into
WORD_BUCKETS; each weighs one over the root of their number) and, as metadata and structure, one bin out of BINS for each statistic:
shares of capitals, digits, marks, blanks and bytes beyond ASCII, of distinct words, of the most frequent word, of repeated lines, the lengths of words and lines, the
length of the text. Its score is logistic(bias + sum w x + 1/2 sum over factors of (sum v x)^2 - sum (v x)^2), linear in
the number of features. Whole texts are read.

A model is fitted on at most SAMPLE labelled rows of each label, whose features the driver gets (at most 4 bytes for each of
WORD_BUCKETS a row). The broadcast model has a fixed size. Labels are sampled first; that bounded sample of keys is broadcast to find its texts.

Null text is scored as empty: no words, all statistics in their first bin. Without labels every score is 0.5. Each row gives one row; columns
with the names of results are replaced. Of rows with one key that with the least features is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample_by_label
from .session import prepare
from .textarrays import LOWER, byte_table, chunks, giving_back, word_hashes, word_spans

WORD_BUCKETS = 1 << 14
BINS = 16
FACTORS = 8
SAMPLE = 3000
EPOCHS = 8
THRESHOLD = 0.7

_IN_WORD = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_CAPITAL = byte_table(lambda b: 65 <= b <= 90)
_DIGIT = byte_table(lambda b: 48 <= b <= 57)
_BLANK = byte_table(lambda b: b == 32 or 9 <= b <= 13)
_BEYOND = byte_table(lambda b: b >= 128)
_MARK = byte_table(lambda b: 33 <= b <= 126 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_NO_BREAK = byte_table(lambda b: b != 10)
STATISTICS = 11
FEATURES = WORD_BUCKETS + STATISTICS * BINS


def _repeated(values: np.ndarray) -> tuple[int, int]:
    """Distinct values and the number of the most frequent one."""
    ordered = np.sort(values)
    runs = np.diff(np.append(np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])), len(ordered)))
    return len(runs), int(runs.max())


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pieces of the column: all feature numbers, text after text, and how many are words and statistics of each text (words, then STATISTICS)."""
    for _, _, data, offsets in chunks(texts):
        n = len(offsets) - 1
        size = np.maximum(1, np.diff(offsets))
        lowered = LOWER[data]
        starts, ends, first = word_spans(data, offsets, _IN_WORD)
        hashes = word_hashes(lowered, starts, ends)
        line_starts, line_ends, line_first = word_spans(data, offsets, _NO_BREAK)
        lines = word_hashes(lowered, line_starts, line_ends)
        shares = []
        for table in (_CAPITAL, _DIGIT, _MARK, _BLANK, _BEYOND):
            total = np.append(0, np.cumsum(table[data], dtype=np.int64))
            shares.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
        count, n_lines = np.diff(first), np.diff(line_first)
        distinct, most, once = np.ones(n), np.zeros(n), np.zeros(n)
        words = []
        for i, (a, b, c, d) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), line_first[:-1].tolist(), line_first[1:].tolist(), strict=True)):
            words.append(np.unique((hashes[a:b] >> np.uint64(50)).astype(np.int32)))
            if b > a:
                kinds, top = _repeated(hashes[a:b])
                distinct[i], most[i] = kinds / (b - a), top / (b - a)
            if d > c:
                once[i] = 1 - _repeated(lines[c:d])[0] / (d - c)
        total = np.append(0, np.cumsum(ends - starts))
        length = (total[first[1:]] - total[first[:-1]]) / np.maximum(1, count)
        stats = np.array([*shares, distinct, most, once, length / 24, np.log2(1 + size / np.maximum(1, n_lines)) / 20, np.log2(1 + np.diff(offsets)) / 24])
        stats[:8] = np.sqrt(stats[:8])
        bins = np.clip((stats * BINS).astype(np.int32), 0, BINS - 1) + WORD_BUCKETS + np.arange(STATISTICS, dtype=np.int32)[:, None] * BINS
        counts = np.array([len(w) for w in words])
        flat = np.concatenate([x for w, b in zip(words, bins.T, strict=True) for x in (w, b)]).astype(np.int32)
        yield flat, counts


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.terms(flat, counts)[0]))

    def terms(self, flat: np.ndarray, counts: np.ndarray):
        at, x = _weights(counts)
        vx = self.factors[flat] * x[:, None]
        sums = np.add.reduceat(vx, at)
        pairs = (sums**2 - np.add.reduceat(vx**2, at)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.linear[flat] * x, at) + pairs, at, x, vx, sums


def _weights(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's features begin, and their values."""
    lengths = counts + STATISTICS
    at = np.cumsum(lengths) - lengths
    x = np.repeat(1 / np.sqrt(np.maximum(1, counts)), lengths).astype(np.float32)
    x[(at + counts)[:, None] + np.arange(STATISTICS)] = 1.0
    return at, x


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-2) -> FactorisationMachine:
    """By Adam on the logistic loss, batches of 64 in a fixed order."""
    dice = np.random.default_rng(7)
    model = FactorisationMachine(0.0, np.zeros(FEATURES, np.float32), dice.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32))
    if not len(rows):
        return FactorisationMachine(0.0, model.linear, np.zeros_like(model.factors))
    state = [np.zeros_like(model.linear), np.zeros_like(model.linear), np.zeros_like(model.factors), np.zeros_like(model.factors)]
    step = 0
    for _ in range(epochs):
        order = dice.permutation(len(rows))
        for i in range(0, len(order), 64):
            own = order[i : i + 64]
            flat = np.concatenate([rows[k] for k in own])
            y, at, x, vx, sums = model.terms(flat, np.array([len(rows[k]) - STATISTICS for k in own]))
            lengths = np.diff(np.append(at, len(flat)))
            error = np.repeat(((1 / (1 + np.exp(-y))) - labels[own]) / len(own), lengths).astype(np.float32)
            used, where = np.unique(flat, return_inverse=True)
            gradient = [np.bincount(where, error * x, len(used)).astype(np.float32), np.zeros((len(used), FACTORS), np.float32)]
            part = (np.repeat(sums, lengths, axis=0) - vx) * (error * x)[:, None]
            for f in range(FACTORS):
                gradient[1][:, f] = np.bincount(where, part[:, f], len(used))
            step += 1
            for g, p, m, v in ((gradient[0], model.linear, *state[:2]), (gradient[1], model.factors, *state[2:])):
                g += decay * p[used]
                m[used] = 0.9 * m[used] + 0.1 * g
                v[used] = 0.99 * v[used] + 0.01 * g**2
                p[used] -= rate * (m[used] / (1 - 0.9**step)) / (np.sqrt(v[used] / (1 - 0.99**step)) + 1e-6)
            model.bias -= rate * 10 * float(error[at].sum())
    return model


def fit_quality_model(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> FactorisationMachine:
    """From labels that may be learnt from (0 and 1; others are left out) and the texts of their keys."""
    prepare(documents.sparkSession)
    given = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).filter("label IN (0, 1) AND key IS NOT NULL")
    chosen = sample_by_label(given, "label", F.col("key"), sample).groupBy("key").agg(F.max("label").alias("label"))
    texts = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "key").select("key", "label", "text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            packed = []
            for flat, counts in features(batch.column(2)):
                ends = np.cumsum(counts + STATISTICS)
                packed += [flat[a:b].tobytes() for a, b in zip((ends - counts - STATISTICS).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["key", "label", "features"])

    got = rows.mapInArrow(batches, rows.select("key", "label").schema.add("features", "binary")).groupBy("key").agg(F.min(F.struct("label", "features")).alias("r")).select("key", "r.*").toArrow().sort_by("key")
    return fit_machine([np.frombuffer(x, np.int32) for x in got.column("features").to_pylist()], np.array(got.column("label").to_pylist(), np.float32))


def score_quality(documents: DataFrame, model: FactorisationMachine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """documents with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0)."""
    spark = documents.sparkSession
    prepare(spark)
    keep = [c for c in documents.columns if c.lower() not in ("score", "predicted")]
    frame = documents.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = frame.drop("__text").schema.add("score", "double").add("predicted", "integer")
    sent = spark.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            score = np.concatenate([np.zeros(0), *(sent.value.scores(*x) for x in features(batch.column(len(keep))))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return frame.mapInArrow(giving_back(batches), schema)
