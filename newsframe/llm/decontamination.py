"""Benchmark decontamination by an FM-index over each shard of the training texts.

Words are runs of ASCII digits, letters (A-Z in lower case) and bytes from 0x80; a window is WINDOW consecutive words of a
benchmark item (an item of fewer words is one window). A shard is some SHARD_BYTES of the texts of one partition. Its words are
numbered by its own vocabulary and indexed once, whole, whatever the benchmark is: their Burrows-Wheeler transform in a wavelet matrix, with
the positions of every SAMPLE-th suffix. Windows of which the shard has every word are searched backward together, a step of each at a time, with ranks from
the wavelet matrix; the occurrences are located by walking to a sampled suffix; a document's hit words that stand together are one
removal span.

The texts are not shuffled. The benchmark is the stated query set: it is taken in blocks of about BLOCK_WORDS words, each
broadcast by itself (some 20 bytes a word). A shard's index meets block after block, of which a worker holds one at a time; those that don't
fit in Spark's memory it keeps on disk.

Null text has no words. An item with a null id counts under the empty name; rows of one item id are one item. Empty tables,
texts without words and benchmarks without words give no hits. Each row of documents gives one row; its columns are kept except those
with the names of results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import prepare
from .textarrays import LOWER, byte_table, chunks, giving_back, word_hashes, word_spans

WINDOW = 10
SHARD_BYTES = 4 << 20
SAMPLE = 8
BLOCK_WORDS = 1_000_000

_IN_WORD = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, _IN_WORD)
    return word_hashes(data, starts, ends), starts, ends, first


class Windows:
    """The windows of some benchmark items: their words by number in the vocabulary, and the items of each window."""

    def __init__(self, names: list[str], texts: list[str], window: int = WINDOW):
        hashes, firsts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
            own, _, _, first = _words(data, offsets)
            hashes.append(own)
            firsts.append(first[1:] + firsts[-1][-1])
        self.vocabulary, words = np.unique(np.concatenate(hashes), return_inverse=True)
        self.words = words.astype(np.int32)
        first = np.concatenate(firsts)
        lengths = np.diff(first)
        count = np.where(lengths == 0, 0, np.maximum(1, lengths - window + 1))
        item = np.repeat(np.arange(len(count)), count)
        start = np.repeat(first[:-1], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(window, lengths)[item]
        columns = [np.where(k < length, self.words[np.minimum(start + k, len(self.words) - 1)], -1) if len(start) else start for k in range(window)]
        order = np.lexsort(columns[::-1])
        same = np.all([c[order][1:] == c[order][:-1] for c in columns], axis=0) if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(np.append(True, ~same)[: len(order)])
        self.start, self.length = start[order][at], length[order][at]
        self.items, self.items_at = item[order].astype(np.int32), np.append(at, len(order))
        self.names = names


class WaveletMatrix:
    """Symbols level by level from their highest bit; rank() counts a symbol before a position."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.before = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=1 << bits), out=self.before[1:])
        # where the symbols of a value begin after the last level
        values = np.arange(1 << bits)
        reverse = sum(((values >> k) & 1) << (bits - 1 - k) for k in range(bits)) if bits else values
        counts = np.diff(self.before)[np.argsort(reverse)]
        begin = np.cumsum(counts) - counts
        self.begin = begin[reverse]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            before = ones[at]
            at = np.where((symbol >> level) & 1, zeros + before, at - before)
        return at - self.begin[symbol]


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling of those that are still equal; each 0 differs from all others, so that no comparison goes beyond one."""
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    first = np.append(True, rank[order[1:]] != rank[order[:-1]])[: len(order)]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))  # from here on, where its group begins
    width, equal = 1, order[~(first & np.append(first[1:], True))]
    while len(equal):
        equal = equal[np.argsort(rank[equal] * (len(text) + 1) + rank[equal + width], kind="stable")]
        old, follow, at = rank[equal], rank[equal + width], np.arange(len(equal))
        group = np.append(True, old[1:] != old[:-1])
        part = group | np.append(True, follow[1:] != follow[:-1])
        begin = np.maximum.accumulate(np.where(group, at, 0))
        order[old + at - begin] = equal
        rank[equal] = old + np.maximum.accumulate(np.where(part, at, 0)) - begin
        equal = equal[~(part & np.append(part[1:], True))]
        width *= 2
    return order


class FMIndex:
    """Over runs of symbols from 1 on, each ended by a 0 of its own."""

    def __init__(self, text: np.ndarray, highest: int):
        n = len(text)
        order = _suffix_order(text)
        bwt = text[order - 1]
        self.matrix = WaveletMatrix(bwt, max(1, int(highest).bit_length()))
        self.bwt, self.n = bwt, n
        first = np.append(True, text[:-1] == 0)
        sampled = (np.arange(n) % SAMPLE == 0) | first
        self.sampled = sampled[order]
        self.positions = order[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1

    def _back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.matrix.before[symbol] + self.matrix.rank(symbol, at)

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows words[start:start + length] that occur, and the rows from low to high of the suffixes that begin so."""
        ids = np.arange(len(start))
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        for step in range(int(length.max(initial=0))):
            on = np.flatnonzero(step < length[ids])
            symbol = words[start[ids[on]] + length[ids[on]] - 1 - step]
            low[on], high[on] = self._back(symbol, low[on]), self._back(symbol, high[on])
            some = low < high
            ids, low, high = ids[some], low[some], high[some]
        return ids, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The text positions of rows low to high, range after range."""
        counts = high - low
        rows = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        steps, open_ = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_ := open_[~self.sampled[rows[open_]]]):
            rows[open_] = self._back(self.bwt[rows[open_]], rows[open_])
            steps[open_] += 1
        return self.positions[self.nth[rows]] + steps


class Shard:
    """The words of some texts, of which text i has those from first[i] on, and their index."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.vocabulary, words = np.unique(hashes, return_inverse=True)
        self.first, n = first, len(first) - 1
        text = np.zeros(len(words) + n, np.int32)
        text[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words + 1
        self.index = FMIndex(text, len(self.vocabulary)) if n else None

    def occurrences(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, the texts that they are in, and the numbers of the words where they begin."""
        none = np.zeros(0, np.int64)
        if not len(windows.start) or not len(self.vocabulary):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, windows.vocabulary), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[at] == windows.vocabulary, at + 1, 0)[windows.words]
        missing = np.append(0, np.cumsum(symbols == 0))
        some = np.flatnonzero(missing[windows.start + windows.length] == missing[windows.start])
        ids, low, high = self.index.search(symbols, windows.start[some], windows.length[some])
        places = self.index.locate(low, high)
        texts = np.searchsorted(self.first[1:] + np.arange(1, len(self.first)), places, "right")
        return np.repeat(some[ids], high - low), texts, places - texts


def _held(block: Broadcast) -> Windows:
    """The block's windows, without the worker keeping them once they are done with."""
    windows = block.value
    if hasattr(block, "_value"):
        del block._value
    return windows


def _shard(data: np.ndarray, offsets: np.ndarray, blocks: list[Broadcast]):
    """Of each text: words, hit words, item names, and removal spans as byte ranges."""
    hashes, starts, ends, first = _words(data, offsets)
    n = len(first) - 1
    marks = np.zeros(len(hashes) + 1, np.int64)
    names: list[set[str]] = [set() for _ in range(n)]
    shard = Shard(hashes, first)
    for block in blocks:
        windows = _held(block)
        ids, doc, at = shard.occurrences(windows)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + windows.length[ids], -1)
        pairs = np.unique(doc.astype(np.int64) * (len(windows.start) + 1) + ids)
        for d, w in zip(*(x.tolist() for x in np.divmod(pairs, len(windows.start) + 1)), strict=True):
            names[d].update(windows.names[i] for i in windows.items[windows.items_at[w] : windows.items_at[w + 1]].tolist())
    hit = np.cumsum(marks)[:-1] > 0
    total = np.append(0, np.cumsum(hit))
    n_hit = total[first[1:]] - total[first[:-1]]
    heads = first[:-1][first[1:] > first[:-1]]
    begin, stop = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1]
    begin[heads] = hit[heads]
    stop[:-1] &= ~hit[1:]
    stop[heads[1:] - 1] = hit[heads[1:] - 1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
    return np.diff(first), n_hit, names, starts[begin], ends[stop]


def mark_contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, cleaned: str | None = None) -> DataFrame:
    """documents with n_words, n_hit, item_ids (sorted strings) and spans (bytes from start to end of the text in UTF-8).

    cleaned names a column for the text without its spans; it may be the text column itself.
    """
    spark = documents.sparkSession
    prepare(spark)
    added = ["n_words", "n_hit", "item_ids", "spans", *([cleaned] if cleaned else [])]
    keep = [c for c in documents.columns if c.lower() not in {a.lower() for a in added}]
    frame = documents.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    spans = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    schema = frame.drop("__text").schema.add("n_words", "long").add("n_hit", "long").add("item_ids", T.ArrayType(T.StringType())).add("spans", spans)
    if cleaned:
        schema = schema.add(cleaned, "string")

    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // (6 * block_words)))
    blocks = []
    for b in range(n_blocks):  # the query set, a bounded block at a time
        own = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("name"), F.lit(n_blocks)) == b)
        rows = own.toArrow()
        windows = Windows(rows.column("name").to_pylist(), rows.column("text").to_pylist())
        blocks.append(spark.sparkContext.broadcast(windows))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in it:
            texts = batch.column(len(keep))
            nulls = texts.is_null().to_numpy(zero_copy_only=False)
            for a, z, data, offsets in chunks(texts, SHARD_BYTES):
                n_words, n_hit, names, begin, end = _shard(data, offsets, blocks)
                at = np.searchsorted(begin, offsets)
                base = np.repeat(offsets[:-1], np.diff(at))
                pairs = pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(end - base, pa.int32())], ["start", "end"])
                out = [*batch.slice(a, z - a).columns[: len(keep)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs).cast(arrow_spans)]
                if cleaned:
                    out.append(pa.array(_without(data, offsets, begin, end, nulls[a:z]), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*keep, *added])

    return frame.mapInArrow(giving_back(batches), schema)


def _without(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray, nulls: np.ndarray) -> list[bytes | None]:
    stay = np.zeros(len(data) + 1, np.int8)
    stay[begin] += 1
    np.add.at(stay, end, -1)
    stay = np.cumsum(stay[:-1], dtype=np.int8) == 0
    left = np.append(0, np.cumsum(stay))[offsets]
    data = data[stay].tobytes()
    return [None if null else data[a:b] for a, b, null in zip(left[:-1].tolist(), left[1:].tolist(), nulls.tolist(), strict=True)]
