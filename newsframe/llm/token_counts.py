"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch of texts lie one after another in one flat array of symbols. In each round every
sequence's lowest-ranked pair is merged, in all sequences at once, until no pair is in the merge list; what is left of a
sequence is its count. Counts of pre-tokens are kept for the texts that follow, up to a bound; a text's count is the sum
over its pre-tokens. No shuffle; a task holds one Arrow batch and that table.

Null text counts as empty; repeated rows, ties and empty tables need no care, each row is counted by itself; columns of
the input with the names of result columns are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import find_pretokens
from .session import prepare
from .textarrays import chunks, giving_back

#: Pre-tokens that a Python worker keeps with their counts; beyond, it starts anew.
KEPT_WORDS = 1_000_000

_NONE = np.iinfo(np.int32).max


class MergeTable:
    """Byte-level merges by rank: (left, right) -> (rank, merged id), as an open-addressed hash table in arrays."""

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray, merged: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        self.shift = np.uint64(64 - max(8, int(np.ceil(np.log2(max(len(pairs), 1) * 4)))))
        size = 1 << int(64 - int(self.shift))
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1].astype(np.int64)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 1
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free][::-1]] = keys[todo[free]][::-1]  # of several that want a slot, the first gets it
            got = self.keys[at] == keys[todo]
            self.ranks[at[got]], self.merged[at[got]] = todo[got], merged[todo[got]]
            todo, at = todo[~got], (at[~got] + 1) % size
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) of each pair, and the slot that tells the merged symbol."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        got = self.keys[slots]
        for _ in range(self.probes - 1):
            off = np.flatnonzero((got != keys) & (got != -1))
            if not len(off):
                break
            slots[off] = (slots[off] + 1) % len(self.keys)
            got[off] = self.keys[slots[off]]
        return np.where(got == keys, self.ranks[slots], _NONE), slots

    @classmethod
    def from_json(cls, path: str) -> tuple[MergeTable, list[str]]:
        """The merges of a tokenizer.json file, and its added tokens."""
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        ids = read["model"]["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in read["model"]["merges"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        byte_ids = np.array([ids[letters[b]] for b in range(256)])
        table = cls(byte_ids, np.array([(ids[a], ids[b]) for a, b in pairs]), np.array([ids[a + b] for a, b in pairs]))
        return table, [x["content"] for x in read["added_tokens"]]


def merge_counts(words: list[bytes], table: MergeTable) -> np.ndarray:
    """How many symbols each byte string comes to."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = lengths.copy()
    ids = np.flatnonzero(lengths > 1)
    lengths = lengths[ids]
    symbols = table.byte_ids[np.frombuffer(b"".join([words[i] for i in ids]), np.uint8)]
    while len(ids):
        starts = np.zeros(len(ids), np.int64)
        np.cumsum(lengths[:-1], out=starts[1:])
        ranks = np.full(len(symbols), _NONE, np.int32)
        slots = np.zeros(len(symbols), np.int64)
        ranks[:-1], slots[:-1] = table.find(symbols[:-1], symbols[1:])
        ranks[starts[1:] - 1] = _NONE  # no pair goes over the end of a sequence
        least = np.minimum.reduceat(ranks, starts)
        here = (ranks == np.repeat(least, lengths)) & (ranks != _NONE)
        at = np.flatnonzero(here)
        if len(at):  # of overlapping pairs of one symbol, every second one from the left
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            follows = np.repeat(at[run], np.diff(np.append(run, len(at)))) + nth
            at = at[(nth % 2 == 0) & (follows == at)]
        symbols[at] = table.merged[slots[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        lost = np.add.reduceat(~keep, starts)
        lengths = lengths - lost
        counts[ids] = lengths
        going = (least != _NONE) & (lengths > 1)
        keep &= np.repeat(going, lengths + lost)
        symbols, ids, lengths = symbols[keep], ids[going], lengths[going]
    return counts


_loaded: dict[str, tuple[MergeTable, re.Pattern | None, dict[str, int]]] = {}


def _table(path: str) -> tuple[MergeTable, re.Pattern | None, dict[str, int]]:
    """Read once in each Python worker."""
    if path not in _loaded:
        table, added = MergeTable.from_json(path)
        split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        _loaded[path] = table, split, {}
    return _loaded[path]


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text; an added token of the vocabulary inside a text is one token."""
    table, split, known = _table(path)
    found, extra = [], []
    for text in texts:
        parts = split.split(text) if split and split.search(text) else [text]
        extra.append(len(parts) - 1)
        found.append(find_pretokens(text) if len(parts) == 1 else [w for part in parts for w in find_pretokens(part)])
    new = set().union(*found)
    if len(known) + len(new) > KEPT_WORDS:
        known.clear()
    new = [w for w in new if w not in known]
    if new:
        known.update(zip(new, merge_counts([w.encode() for w in new], table).tolist(), strict=True))
    return [n + sum(map(known.__getitem__, words)) for n, words in zip(extra, found, strict=True)]


def count_tokens(documents: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """documents with n_bytes (of the text in UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    prepare(documents.sparkSession)
    keep = [c for c in documents.columns if c.lower() not in (text.lower(), "n_bytes", "n_tokens", "over_limit")]
    frame = documents.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = frame.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in it:
                texts, sizes, counts = batch.column(len(keep)), [], []
                for first, last, _, offsets in chunks(texts):
                    sizes += np.diff(offsets).tolist()
                    counts += count_texts(texts.slice(first, last - first).to_pylist(), path)
                counts = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])
        finally:
            _table(path)[2].clear()  # the words of this task; the worker goes on to others

    return frame.mapInArrow(giving_back(batches), schema)
