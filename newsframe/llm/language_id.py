"""Language identification by string kernels: Nyström landmarks and one-versus-rest kernel ridge regression.

Two texts' kernel is the number of byte n-grams of 1 to LONGEST bytes that are present in both (the blended spectrum, in lower case, all
ASCII but letters as blanks, hashed into BUCKETS), over the geometric mean of their own numbers. LANDMARKS texts of
each language span the Nyström approximation; ridge regression in it gives weights on the landmarks for each language. Batches of
texts are scored by two matrix products: presence by landmarks, kernel by weights. Whole texts are read.

A model is fitted on at most SAMPLE labelled rows of every language, MOST_ROWS in all; their presence bits are what the driver gets (BUCKETS / 8
bytes a row). Beyond MOST_LANDMARKS / LANDMARKS languages each has fewer landmarks and rows, so that the broadcast model has a fixed size; more than
sampling.MOST_LABELS languages are an error. Nothing is shuffled but the sample.

Whether a text fits the language found is another question, as each text is nearest to some language: `fits` asks for the share of the text's n-grams that the
language's landmarks have (FIT_PRIOR counted in addition, so that a few n-grams decide nothing), and compares it to FIT_MARGIN of what all but one in a hundred of the
language's own labelled rows have (of a landmark, in the others).

Null texts and texts without letters are `und` with score 0 and don't fit, as is everything where no row is labelled. Ties go to the language first in
order. Each row gives one row; columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample_by_label
from .session import prepare
from .textarrays import chunks, giving_back

LONGEST = 3
BUCKETS = 1 << 14
LANDMARKS = 32
SAMPLE = 300
#: Of all languages together.
MOST_LANDMARKS = 64 * LANDMARKS
MOST_ROWS = 64 * SAMPLE
RIDGE = 1e-3
FIT_PRIOR = 8
FIT_MARGIN = 0.9
#: Texts in one matrix product.
ROWS = 256
UNDETERMINED = "und"

_LETTER = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def presence(texts: pa.Array) -> Iterator[np.ndarray]:
    """Which buckets the n-grams of each text are in, ROWS texts at a time."""
    for _, _, data, offsets in chunks(pc.utf8_lower(texts)):
        data = _LETTER[data]
        grams, code = [], np.zeros(len(data), np.uint32)
        for n in range(1, LONGEST + 1):
            code = code[: len(data) - n + 1] * np.uint32(256) + data[n - 1 :]
            grams.append(((code ^ np.uint32(n << 29)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14))
        for top in range(0, len(offsets) - 1, ROWS):
            bounds = offsets[top : top + ROWS + 1]
            bits = np.zeros((len(bounds) - 1, BUCKETS), bool)
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                for n, codes in enumerate(grams):
                    bits[i][codes[a : max(a, b - n)]] = True
            yield bits


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # BUCKETS x landmarks, each column scaled by the root of its number of n-grams
    weights: np.ndarray  # landmarks x languages
    owners: np.ndarray  # the language of each landmark
    least_fit: np.ndarray  # of each language

    def scores(self, bits: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, bits.sum(axis=1, dtype=np.float32)))
        return (bits.astype(np.float32) @ self.landmarks / size[:, None]) @ self.weights

    @cached_property
    def known(self) -> np.ndarray:
        """Buckets x languages: whether a landmark of the language has the n-gram."""
        return np.stack([(self.landmarks[:, self.owners == k] > 0).any(axis=1) for k in range(len(self.languages))], axis=1).astype(np.float32)

    def fit(self, bits: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The share of each text's n-grams that a language has."""
        own = (bits.astype(np.float32) @ self.known)[np.arange(len(bits)), language]
        return (own + FIT_PRIOR) / (bits.sum(axis=1) + FIT_PRIOR)


def fit_kernel(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """From presence bits and labels; the first rows of each label are its landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return KernelModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.int64), np.zeros(0))
    own = np.searchsorted(languages, labels)
    unit = lambda rows: rows.astype(np.float32) / np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.float32)))[:, None]
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(languages)))
    chosen = np.concatenate([np.flatnonzero(own == k)[:landmarks] for k in range(len(languages))])
    marks = unit(bits[chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = np.concatenate([unit(bits[a : a + 4 * ROWS]) @ marks.T for a in range(0, len(bits), 4 * ROWS)]).astype(np.float64) @ root
    targets = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * len(own) * np.eye(len(root)), features.T @ targets)
    model = KernelModel(languages, np.ascontiguousarray(marks.T), (root @ solved).astype(np.float32), own[chosen], np.zeros(len(languages)))
    for k in range(len(languages)):
        mine = np.flatnonzero(own == k)
        times = bits[chosen[own[chosen] == k]].sum(axis=0)  # landmarks with each n-gram; a landmark is not asked about its own
        shares = [(int((times[b] > (i in chosen)).sum()) + FIT_PRIOR) / (int(b.sum()) + FIT_PRIOR) for i, b in zip(mine.tolist(), bits[mine], strict=True)]
        model.least_fit[k] = FIT_MARGIN * np.quantile(shares, 0.01)
    return model


def fit_language_model(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> KernelModel:
    """From rows that may be learnt from; those without label or letters are left out."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label"))
    chosen = sample_by_label(rows.filter(F.col("text").rlike(r"\p{L}")), "label", F.col("key"), sample, MOST_ROWS)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            packed = [x.tobytes() for bits in presence(batch.column(1)) for x in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["key", "label", "bits"])

    got = chosen.select("key", "text", "label").mapInArrow(batches, rows.select("key", "label").schema.add("bits", "binary")).toArrow().sort_by([("label", "ascending"), ("key", "ascending")])
    bits = np.array([np.unpackbits(np.frombuffer(b, np.uint8)) for b in got.column("bits").to_pylist()], bool).reshape(-1, BUCKETS)
    return fit_kernel(bits, got.column("label").to_pylist())


def predict_language(documents: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """documents with lang_pred, score (the best language's regression, from -1 to 1, brought to 0 to 1) and fits."""
    spark = documents.sparkSession
    prepare(spark)
    keep = [c for c in documents.columns if c.lower() not in ("lang_pred", "score", "fits")]
    words = F.col(f"`{text}`").cast("string")
    frame = documents.select(*(F.col(f"`{c}`") for c in keep), F.when(words.rlike(r"\p{L}"), words).alias("__text"))
    schema = frame.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("fits", "boolean")
    sent = spark.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array([*own.languages, UNDETERMINED], object)
        for batch in it:
            texts = batch.column(len(keep))
            best, score, fits = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at = 0
            for bits in presence(texts) if own.languages else ():
                found, here = own.scores(bits), slice(at, at := at + len(bits))
                best[here], score[here] = found.argmax(axis=1), np.clip((found.max(axis=1) + 1) / 2, 0, 1)
                fits[here] = own.fit(bits, best[here]) >= own.least_fit[best[here]]
            none = texts.is_null().to_numpy(zero_copy_only=False) | (not own.languages)
            best[none], score[none], fits[none] = len(own.languages), 0.0, False
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(fits)], names=[*keep, "lang_pred", "score", "fits"])

    return frame.mapInArrow(giving_back(batches), schema)
