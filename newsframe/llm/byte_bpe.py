"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Spark deals out the texts; a Python worker splits its texts into pre-tokens, and a DuckDB database in that worker encodes
those it has not met yet. A recursive query starts from one row per byte (word, position, token); each round joins
adjacent tokens to the merge table and contracts every word's leftmost pair of least rank, until no pair joins. A text's
ids are those of its pre-tokens one after another. Decoding starts from the ids alone: they are joined to the vocabulary
and put together by an ordered aggregation. No shuffle; a task holds one piece of its texts and a bounded table of words.

Words over CUT_PIECE bytes are first cut where no token of the vocabulary, as it stands in the word, reaches across: no merge
does either, so the two sides don't meet. That makes short words of the runs of scripts without spaces.

A recursive query keeps the rows of all its rounds, the square of a word's length. So parts that are still over LONG_PIECE bytes are encoded in chunks of CHUNK bytes by
the same query, and put together by a rule that is exact for any merge table: if x alone ends with token t and y alone begins with token u, then xy has the tokens of x and those
of y if and only if tu alone has the tokens t and u. (The pair contracted next is the least of all, so within x, within y and within tu the contractions of xy come in the order in which each has them
alone, as long as none crosses the border; the first to cross it would join the last token in t to the first in u, and is the least of xy's pairs at a time at which it is the least of tu's as well.) Where two
chunks don't fit, the tokens beside the border are encoded anew as one word, more of them until both its ends fit. All of these are short words, encoded together and each once; a chunk's end costs a few of them
whatever the length of the part.

Null text counts as empty (no ids, empty bytes). Repeated rows are encoded each; an empty table gives an empty result;
columns of the input with the names of result columns are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import find_pretokens
from .session import prepare
from .textarrays import chunks, give_back

#: Texts that are encoded together, in bytes; a longer text is taken alone.
TEXT_BYTES = 3 << 19
#: Words that a task keeps with their ids; beyond, it starts anew.
KEPT_WORDS = 300_000
CUT_PIECE = 32
LONG_PIECE = 128
CHUNK = 64
#: Chunks that are encoded together, and tokens beside a border that are encoded anew at first.
CHUNKS, BESIDE = 8192, 3
#: Rows that a recursive query keeps at most: half of the sum of its words' squared lengths.
QUERY_ROWS = 1_500_000
#: Ids that one query decodes, and ids in one of its groups; longer sequences are decoded group by group.
DECODED_IDS = 200_000
GROUP_IDS = 50_000

_BASE = np.uint64(0x9E3779B97F4A7C15)

#: A row is one number k, so that a sort takes little: word, position in it (20 bits), token (17 bits).
_WORD, _POSITION, _TOKEN = "({0} >> 37)", "(({0} >> 17) & 1048575)", "({0} & 131071)"
_w, _p, _t = (x.format("k") for x in (_WORD, _POSITION, _TOKEN))
_w1, _p1, _t1 = (x.format("n") for x in (_WORD, _POSITION, _TOKEN))

#: b is a word's least (rank, position, position after): rank is the pair's token as well.
ENCODE = f"""
WITH RECURSIVE s AS (
  SELECT k, lead(k) OVER (ORDER BY k) AS n, 0 AS step FROM base
  UNION ALL
  SELECT k, lead(k) OVER (ORDER BY k) AS n, step FROM (
    SELECT CASE WHEN {_p} = ((b >> 20) & 1048575) THEN k - {_t} + (b >> 40) ELSE k END AS k, step + 1 AS step
    FROM s JOIN (
      SELECT {_w} AS w, min((r << 40) + ({_p} << 20) + {_p1}) AS b
      FROM s JOIN merges ON ab = ({_t} << 17) + {_t1} WHERE {_w} = {_w1} GROUP BY {_w}) best ON {_w} = w
    WHERE {_p} <> (b & 1048575))
)
SELECT {_w}::INTEGER AS w, {_t}::INTEGER AS tok
FROM s JOIN (SELECT {_w} AS w, max(step) AS step FROM s GROUP BY {_w}) last ON {_w} = last.w AND s.step = last.step
ORDER BY k
"""

#: Pieces are written with one character for each byte, as bytes that are no UTF-8 can't be aggregated as text.
DECODE = "SELECT k, string_agg(piece, '' ORDER BY p) AS text FROM sequences JOIN vocabulary USING (tok) GROUP BY k ORDER BY k"


def _starts(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... lengths[i] numbers, for each i."""
    at = _starts(lengths)
    return np.repeat(first - at[:-1], lengths) + np.arange(at[-1])


def _prefix_tables(tokens: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 2 on the hashes of the tokens' beginnings of that length, sorted, and whether one is a whole token."""
    data, lengths = np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))
    at = _starts(lengths)[:-1]
    h = data[at].astype(np.uint64) + np.uint64(1)
    tables = []
    for n in range(2, int(lengths.max()) + 1):
        keep = lengths >= n
        at, lengths, h = at[keep], lengths[keep], h[keep] * _BASE + data[at[keep] + n - 1] + np.uint64(1)
        table, number = np.unique(h, return_inverse=True)
        tables.append((table, np.bincount(number, lengths == n, len(table)) > 0))
    return tables


def _reaches(data: np.ndarray, ends: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each byte how far the tokens reach that begin at it or before it, as they stand in its word (which ends at ends). Hashes that meet by chance reach too far, never too short."""
    at = np.arange(len(data))
    reach, h = at + 1, data.astype(np.uint64) + np.uint64(1)
    for n, (table, whole) in enumerate(tables, 2):
        inside = at + n <= ends[at]
        at = at[inside]
        if not len(at):
            break
        h = h[inside] * _BASE + data[at + n - 1] + np.uint64(1)
        spot = np.minimum(np.searchsorted(table, h), len(table) - 1)
        found = table[spot] == h
        at, h, spot = at[found], h[found], spot[found]
        reach[at[whole[spot]]] = at[whole[spot]] + n
    return np.maximum.accumulate(reach)


class Codec:
    """A vocabulary of ranks in a DuckDB database of its own, and the words met so far by number."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 17:
            raise ValueError("ids of more than 17 bits")
        self.pieces = {r: t for t, r in ranks.items()}
        self.prefixes = _prefix_tables(list(ranks))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        made = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(made, np.int64).reshape(-1, 3).T
        self._table("merges", ab=(left << 17) + right, r=rank)
        self._table("vocabulary", tok=pa.array(ranks.values(), pa.int32()), piece=pa.array([t.decode("latin-1") for t in ranks]))
        self.forget()

    def _table(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given").fetchall()
        self.con.unregister("given")

    def _one_byte_rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return np.repeat(np.arange(len(words)), lengths), _ragged(np.zeros(len(words), np.int64), lengths), self.bytes[np.frombuffer(b"".join(words), np.uint8)]

    def _recursive(self, words: list[bytes]) -> pa.Table:
        w, p, tok = self._one_byte_rows(words)
        self._table("base", k=(w << 37) + (p << 17) + tok)
        return self.con.sql(ENCODE).to_arrow_table()

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has, by as many queries as QUERY_ROWS asks for."""
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
        cost = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) ** 2 // 2)
        at = 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + QUERY_ROWS, "right")))
            got = self._recursive(words[at:end])
            ids.append(got["tok"].to_numpy())
            counts[at:end] = np.bincount(got["w"].to_numpy(), minlength=end - at)
            at = end
        return np.concatenate(ids), counts

    def _cut(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The parts of words that no merge can join, one after another, and how many each word has."""
        data = b"".join(words)
        at = _starts(np.fromiter(map(len, words), np.int64, len(words)))
        reach = _reaches(np.frombuffer(data, np.uint8), np.repeat(at[1:], np.diff(at)), self.prefixes)
        first = np.r_[True, reach[:-1] <= np.arange(1, len(data))]
        starts = np.flatnonzero(first)
        parts = [data[a:z] for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True)]
        return parts, np.diff(np.searchsorted(starts, at))

    def _stitched(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of long parts, each of chunks that are put together."""
        known: dict[bytes, list[int]] = {}
        pieces = self.pieces

        def learn(words) -> None:
            new = [w for w in dict.fromkeys(words) if w not in known]
            ids, counts = self._contract(new)
            ends = _starts(counts).tolist()
            known.update((w, ids[a:z].tolist()) for w, a, z in zip(new, ends[:-1], ends[1:], strict=True))

        def ids_of(word: bytes) -> list[int]:
            if word not in known:
                learn([word])
            return known[word]

        def pair(t: int, u: int) -> bytes:
            return pieces[t] + pieces[u]

        def between(left: list[int], right: list[int], n: int, m: int) -> bytes:
            return b"".join(map(pieces.__getitem__, left[-n:] + right[:m]))

        outs: list[list[int]] = [[] for _ in parts]
        every = ((i, part[a : a + CHUNK]) for i, part in enumerate(parts) for a in range(0, len(part), CHUNK))
        while chunks := list(islice(every, CHUNKS)):
            if len(known) > 8 * CHUNKS:
                known.clear()
            learn(c for _, c in chunks)
            # what the borders will ask for if nothing reaches further than their own chunks, encoded together
            open_ = [(known[x], known[y]) for (i, x), (j, y) in zip(chunks[:-1], chunks[1:], strict=True) if i == j]
            n = BESIDE
            while open_:
                learn(pair(x[-1], y[0]) for x, y in open_)
                open_ = [(x, y) for x, y in open_ if known[pair(x[-1], y[0])] != [x[-1], y[0]]]
                learn(between(x, y, n, n) for x, y in open_)
                ends = [(x, y, known[between(x, y, n, n)]) for x, y in open_]
                learn(pair(*p) for x, y, z in ends for p in ([(x[-n - 1], z[0])] if len(x) > n else []) + ([(z[-1], y[n])] if len(y) > n else []))
                fits = lambda t, u: known[pair(t, u)] == [t, u]
                open_ = [(x, y) for x, y, z in ends if n < max(len(x), len(y)) and not ((len(x) <= n or fits(x[-n - 1], z[0])) and (len(y) <= n or fits(z[-1], y[n])))]
                n *= 2
            for i, chunk in chunks:
                out, new = outs[i], known[chunk]
                if not out or ids_of(pair(out[-1], new[0])) == [out[-1], new[0]]:
                    out += new
                    continue
                n = m = BESIDE
                while True:
                    both = ids_of(between(out, new, n, m))
                    left = len(out) <= n or ids_of(pair(out[-n - 1], both[0])) == [out[-n - 1], both[0]]
                    right = len(new) <= m or ids_of(pair(both[-1], new[m])) == [both[-1], new[m]]
                    if left and right:
                        out[-n:] = both + new[m:]
                        break
                    n, m = (n if left else 2 * n), (m if right else 2 * m)
        return [np.array(out, np.int32) for out in outs]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        long = [i for i, w in enumerate(words) if len(w) > CUT_PIECE]
        if not long:
            return self._encode_parts(words)
        parts, n_own = self._cut([words[i] for i in long])
        distinct = {p: i for i, p in enumerate(dict.fromkeys(parts), len(words))}
        is_long, n_parts = np.zeros(len(words), bool), np.ones(len(words), np.int64)
        is_long[long], n_parts[long] = True, n_own
        ids, counts = self._encode_parts([b"" if cut else w for w, cut in zip(words, is_long.tolist(), strict=True)] + list(distinct))
        numbers = np.repeat(np.arange(len(words)), n_parts)
        numbers[np.repeat(is_long, n_parts)] = list(map(distinct.__getitem__, parts))
        own = counts[numbers]
        return ids[_ragged(_starts(counts)[:-1][numbers], own)], np.diff(_starts(own)[_starts(n_parts)])

    def _encode_parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")  # words of like length together, the long ones last
        short = int((lengths <= LONG_PIECE).sum())
        ids, own = self._contract([words[i] for i in order[:short].tolist()])
        stitched = self._stitched([words[i] for i in order[short:].tolist()])
        counts, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[order] = np.r_[own, np.fromiter(map(len, stitched), np.int64, len(stitched))]
        first[order] = _starts(counts[order])[:-1]
        return np.concatenate([ids, *stitched])[_ragged(first, counts)], counts

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids that lie one after another; of an empty one, none."""
        groups = -(-lengths // GROUP_IDS)
        sizes = np.full(int(groups.sum()), GROUP_IDS, np.int64)
        last = np.cumsum(groups)[groups > 0] - 1
        sizes[last] = (lengths - (groups - 1) * GROUP_IDS)[groups > 0]
        texts: list[bytes] = []
        at, ends, a = 0, np.cumsum(sizes), 0
        while a < len(sizes):
            z = max(a + 1, int(np.searchsorted(ends, at + DECODED_IDS, "right")))
            own = ids[at : ends[z - 1]]
            self._table("sequences", k=np.repeat(np.arange(z - a, dtype=np.int32), sizes[a:z]), p=np.arange(len(own), dtype=np.int32), tok=own)
            texts += [t.encode("latin-1") for t in self.con.sql(DECODE).to_arrow_table()["text"].to_pylist()]
            at, a = int(ends[z - 1]), z
        if len(texts) != len(sizes):
            raise ValueError("ids that are not in the vocabulary")
        if int(groups.max(initial=0)) <= 1 and len(texts) == len(lengths):
            return texts
        first = _starts(groups).tolist()
        return [b"".join(texts[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]

    def forget(self) -> None:
        """Give back the memory of words: a Python worker outlives its task and serves other operators."""
        self.numbers: dict[str, int] = {}
        self.ids, self.counts, self.names = np.zeros(0, np.int32), np.zeros(0, np.int64), pa.array([], pa.string())
        for name in ("base", "sequences"):
            self.con.execute(f"DROP TABLE IF EXISTS {name}").fetchall()

    def learn(self, words: set[str]) -> None:
        """Encode the words that were not met before."""
        if len(self.numbers) + len(words) > KEPT_WORDS:
            self.forget()
        new = [w for w in words if w not in self.numbers]
        if not new:
            return
        ids, counts = self.encode_words([w.encode() for w in new])
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array(_starts(counts), pa.int32()), pa.array(ids).cast(pa.string())), ",")
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.ids, self.counts, self.names = np.append(self.ids, ids), np.append(self.counts, counts), pa.concat_arrays([self.names, names])

    def encode(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Of each text its ids as decimals joined by commas; all ids one after another; how many each text has."""
        found = [find_pretokens(t) for t in texts]
        self.learn(set().union(*found))
        at = _starts(np.fromiter(map(len, found), np.int64, len(found)))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(found)), np.int64, at[-1])
        counts = self.counts[numbers]
        flat = self.ids[_ragged(_starts(self.counts)[:-1][numbers], counts)]
        decimals = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.names.take(pa.array(numbers))), ",")
        return decimals, flat, np.diff(_starts(counts)[at])


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """Read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(documents: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """documents with n_tokens and the outputs asked for: ids (array), ids_text (decimals joined by commas), decoded (bytes
    that the ids decode to)."""
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_text": T.StringType(), "decoded": T.BinaryType()}
    added = ["n_tokens", *outputs]
    prepare(documents.sparkSession)
    keep = [c for c in documents.columns if c.lower() not in (text.lower(), *added)]
    frame = documents.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = frame.drop("__text").schema
    for name in added:
        schema = schema.add(name, kinds[name])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            for batch in it:
                for first, last, _, _ in chunks(texts := batch.column(len(keep)), TEXT_BYTES):
                    decimals, flat, counts = own.encode(texts.slice(first, last - first).to_pylist())
                    out = {"n_tokens": pa.array(counts, pa.int64()), "ids_text": decimals}
                    if "ids" in outputs:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(_starts(counts), pa.int32()), pa.array(flat, pa.int32()))
                    if "decoded" in outputs:
                        out["decoded"] = pa.array(own.decode(flat, counts), pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns[: len(keep)], *(out[x] for x in added)], names=[*keep, *added])
        finally:
            own.forget()
            give_back()

    return frame.mapInArrow(batches, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """frame with the bytes that a column of id lists decodes to; null lists give null. Ids must be in the vocabulary."""
    prepare(frame.sparkSession)
    keep = [c for c in frame.columns if c.lower() != output.lower()]
    at = keep.index(ids)
    schema = frame.select(*(F.col(f"`{c}`") for c in keep)).schema.add(output, "binary")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(at).cast(pa.list_(pa.int32()))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            done = codec(path).decode(lists.flatten().to_numpy(zero_copy_only=False), lengths)
            valid = lists.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x if ok else None for x, ok in zip(done, valid, strict=True)], pa.binary())], names=[*keep, output])

    return frame.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(batches, schema)
