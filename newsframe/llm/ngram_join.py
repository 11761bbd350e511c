"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the components that its links make.

Words are the runs of anything but ASCII white space, A-Z in lower case; a document's set holds its distinct 5-word
shingles as 64-bit hashes (fewer words: the whole sequence as one). Documents of one set are one representative: its key
is a 64-bit sum over the set. Two sets link when 100 * |intersection| >= 80 * |union|.

1. A pass over the texts gives every row its set's key and size, and tells of the shingles that are in HOT_SHARE of the sets or more (at most
   MOST_HOT, as the share grows with the mean size of a set).
2. Every other shingle of every set goes to the bucket of its hash, many in one packed row; a task sends a set once. A bucket makes the inverted
   lists and keeps those of two sets or more: no other shingle can be in an intersection. The hot ones are shared without asking, so that no
   bucket has to hold a list of a large part of all sets. Buckets are as many as the shingles need, BUCKET_SHINGLES each.
3. Each set gets its shared shingles back with the lengths of their lists (hot ones: longest). A link needs 0.8 of a set in common, so a set
   with fewer shared ones is done. The others order them by list length; a linked pair has one in common among the
   first ones (those not among the last T - 1).
4. Sets with a common shingle among the first ones meet in a block: that of the smallest set key on that list. Blocks over
   BLOCK_SHINGLES are dealt into parts, and every two parts meet.
5. In a block an inverted index is searched, set by set, for the sets that occur on T lists at least: the L longest lists
   are left out, the others merged by a heap, and what occurs T - L times there is looked up in the long lists by binary
   search. Sets of one component need no search of their own once every set outside the block's largest component has been
   searched: a link between components has an end outside the largest one.
6. The links (a forest for each block) are made into components by alternating large-star and small-star rounds.

Each step moves packed rows by key; no pairs of a group are written out, and the driver gets counts and the hot shingles only. Hashes have
64 bits and stand for shingles; nothing is verified on texts. Null and empty texts have no shingles and no links. Repeated rows are one set. An empty table gives an
empty result. Columns beside the two named ones are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .session import cut, prepare
from .textarrays import LOWER, byte_table, chunks, give_back, giving_back, mix, word_hashes, word_spans

WORDS = 5
#: Shingles that one part of a block holds at most, about 8 bytes each.
BLOCK_SHINGLES = 4_000_000
#: Shingles that a bucket gets about, some 20 bytes each.
BUCKET_SHINGLES = 4_000_000
MOST_BUCKETS = 1 << 18
#: Shingles of sets that a task packs together, and keys of sets that it remembers having sent.
HELD_SHINGLES = 1_000_000
SENT_KEYS = 500_000
HOT_SHARE = 0.01
MOST_HOT = 100_000
#: Sets with a hot shingle that a task must have met together to tell of it.
HOT_SETS = 16
#: DivideSkip's constant for how many lists count as long.
MU = 0.0085

_IN_WORD = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
_TURNS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)
#: The length of a hot list.
_LONGEST = np.uint32(0xFFFFFFFF)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in chunks(texts):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, _IN_WORD)
        words = word_hashes(data, starts, ends)
        shingles = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            shingles += words[k : len(words) - WORDS + 1 + k] * _TURNS[k]
        shingles = mix(shingles)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(shingles[a : b - WORDS + 1])
            elif b > a:
                yield mix((words[a:b] * _TURNS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> int:
    return int(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _held(sets: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Non-empty sets in lists of about HELD_SHINGLES shingles, those that a task met before left out."""
    held, size, sent = [], 0, set()
    for s in sets:
        if not len(s) or (key := set_key(s)) in sent:
            continue
        if len(sent) >= SENT_KEYS:
            sent.clear()
        sent.add(key)
        held.append(s)
        size += len(s)
        if size > HELD_SHINGLES:
            yield held
            held, size = [], 0
    if held:
        yield held


_ROWS = "doc_id {}, n_shingles bigint, key bigint, hot bigint"


def _documents(hot_share: float, hot_sets: int):
    """A row a document, and rows with `hot`: key is a shingle that so many of a task's sets have."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        kind: list[pa.DataType] = []

        def sets() -> Iterator[np.ndarray]:
            for batch in it:
                kind.append(batch.column(0).type)
                sizes, keys = [], []
                for s in shingle_sets(batch.column(1)):
                    sizes.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    yield s
                out.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(len(sizes), pa.int64())], names=["doc_id", "n_shingles", "key", "hot"]))

        for held in _held(sets()):
            yield from out
            out.clear()
            ordered = np.sort(np.concatenate(held))
            at, counts = _runs(ordered)
            many = counts >= max(hot_sets, int(hot_share * len(held)))
            n = int(many.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind[0]), pa.nulls(n, pa.int64()), pa.array(ordered[at[many]].astype(np.int64)), pa.array(counts[many])], names=["doc_id", "n_shingles", "key", "hot"])
        yield from out

    return batches


_PACKED = "bucket int, keys binary, sizes binary, counts binary, hashes binary"


def _pack(bucket: int, keys, sizes, counts, hashes) -> tuple:
    return bucket, keys.astype(np.uint64).tobytes(), sizes.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), hashes.tobytes()


def _unpack(table) -> tuple[np.ndarray, ...]:
    """Key and size of the set, and hash, for each posting of packed rows."""
    read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    counts = read("counts", np.uint32)
    return np.repeat(read("keys", np.uint64), counts), np.repeat(read("sizes", np.uint32), counts), read("hashes", np.uint64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    at = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(sorted_values)))


def _postings(buckets: int, parts: int, hot: np.ndarray):
    """Packed rows of each bucket; those of hot shingles go to bucket -1 - part of their sets."""

    def rows(sets: list[np.ndarray]) -> Iterator[tuple]:
        keys = np.array([set_key(s) for s in sets], np.int64).astype(np.uint64)
        sizes = np.array([len(s) for s in sets])
        docs, hashes = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
        bucket = ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
        if len(hot):
            known = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
            bucket[known] = -1 - (keys[docs[known]] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        docs, hashes, bucket = docs[order], hashes[order], bucket[order]
        at, lengths = _runs(bucket)
        for b, a, n in zip(bucket[at].tolist(), at.tolist(), lengths.tolist(), strict=True):
            own, counts = _runs(docs[a : a + n])
            ids = docs[a : a + n][own]
            yield _pack(b, keys[ids], sizes[ids], counts, hashes[a : a + n])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(s for batch in it for s in shingle_sets(batch.column(0))):
            yield _batch(rows(held), _PACKED)

    return batches


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows, schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_SHARED = "part int, keys binary, sizes binary, counts binary, hashes binary, lists binary"


def _shared_lists(parts: int):
    """The inverted lists of a bucket: those of two sets or more, back by the sets' keys. Hot shingles are passed on."""

    def bucket(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        if b < 0:
            lists = [np.full(len(h) // 8, _LONGEST, np.uint32).tobytes() for h in table.column("hashes").to_pylist()]
            return pa.table([pa.array([-1 - b] * len(lists), pa.int32()), *(table.column(c) for c in ("keys", "sizes", "counts", "hashes")), pa.array(lists, pa.binary())], names=["part", "keys", "sizes", "counts", "hashes", "lists"])
        keys, sizes, hashes = _unpack(table)
        order = np.argsort(hashes)
        at, lengths = _runs(hashes[order])
        order = order[np.repeat(lengths > 1, lengths)]
        order = order[np.lexsort((keys[order], hashes[order]))]
        keys, sizes, hashes = keys[order], sizes[order], hashes[order]
        once = np.append(True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]))[: len(keys)]
        keys, sizes, hashes = keys[once], sizes[once], hashes[once]
        at, lengths = _runs(hashes)
        lists = np.repeat(lengths, lengths)
        more = lists > 1
        keys, sizes, hashes, lists = keys[more], sizes[more], hashes[more], lists[more]
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((keys, part))
        keys, sizes, hashes, lists, part = keys[order], sizes[order], hashes[order], lists[order], part[order]
        rows = []
        for a, n in zip(*(x.tolist() for x in _runs(part)), strict=True):
            own, counts = _runs(keys[a : a + n])
            _, *packed = _pack(b, keys[a : a + n][own], sizes[a : a + n][own], counts, hashes[a : a + n])
            rows.append((int(part[a]), *packed, lists[a : a + n].astype(np.uint32).tobytes()))
        give_back()
        return pa.Table.from_batches([_batch(rows, _SHARED)])

    return bucket


_SETS = "key bigint, size int, first int, hashes binary"


def _candidate_sets(table: pa.Table) -> pa.Table:
    """Sets of which 0.8 or more is shared; their shared hashes, those on the shortest lists first."""
    keys, sizes, hashes = _unpack(table)
    lists = np.frombuffer(b"".join(table.column("lists").to_pylist()), np.uint32)
    order = np.lexsort((hashes, keys))
    keys, sizes, hashes, lists = keys[order], sizes[order], hashes[order], lists[order]
    once = np.append(True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]))[: len(keys)]  # hot ones come from each task that met the set
    keys, sizes, hashes, lists = keys[once], sizes[once], hashes[once], lists[once]
    order = np.argsort(keys, kind="stable")
    at, counts = _runs(keys[order])
    enough = counts >= -(-80 * sizes[order][at].astype(np.int64) // 100)
    rows = []
    for a, n in zip(at[enough].tolist(), counts[enough].tolist(), strict=True):
        own = order[a : a + n]
        own = own[np.lexsort((hashes[own], lists[own]))]
        size = int(sizes[own[0]])
        rows.append((int(keys[own[0]].astype(np.int64)), size, n - -(-80 * size // 100) + 1, hashes[own].tobytes()))
    give_back()
    return pa.Table.from_batches([_batch(rows, _SETS)])


def _first_ones(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        firsts = batch.column(1).to_pylist()
        hashes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(h, np.int64, n) for h, n in zip(batch.column(2).to_pylist(), firsts, strict=True))])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(batch.column(0).to_pylist(), np.int64), firsts)), pa.array(hashes)], names=["key", "hash"])


def linked(size_a, size_b, common):
    """100 * |intersection| >= 80 * |union|."""
    return 100 * common >= 80 * (size_a + size_b - common)


class DivideSkip:
    """Inverted lists over sets; search() finds the sets that share enough with one of them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        values = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        self.owners = owners[order]
        self.at, self.lengths = _runs(values[order])
        self.values = values[order][self.at]

    def search(self, i: int) -> np.ndarray:
        """The other sets linked with set i."""
        where = np.searchsorted(self.values, self.sets[i])
        where = where[self.lengths[where] > 1]
        least = -(-80 * int(self.sizes[i]) // 100)  # no linked set shares fewer
        if len(where) < least:
            return np.zeros(0, np.int64)
        where = where[np.argsort(self.lengths[where], kind="stable")]
        n_long = min(least - 1, int(least / (MU * np.log2(self.lengths[where[-1]]) + 1)))
        short, long = where[: len(where) - n_long], where[len(where) - n_long :]
        merged = heapq.merge(*(self.owners[a : a + n].tolist() for a, n in zip(self.at[short].tolist(), self.lengths[short].tolist(), strict=True)))
        found = [(owner, k) for owner, k in ((owner, sum(1 for _ in same)) for owner, same in groupby(merged)) if k >= least - n_long and owner != i]
        if not found:
            return np.zeros(0, np.int64)
        others, counts = np.array(found).T
        ok = linked(self.sizes[i], self.sizes[others], np.minimum(np.minimum(self.sizes[i], self.sizes[others]), counts + n_long))
        others, counts = others[ok], counts[ok]
        for a, n in zip(self.at[long].tolist(), self.lengths[long].tolist(), strict=True):
            at = np.searchsorted(own := self.owners[a : a + n], others)
            counts = counts + (own[np.minimum(at, n - 1)] == others)
        return others[linked(self.sizes[i], self.sizes[others], counts)]


def block_links(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """For each set the first set of its component, by links within the block."""
    index = DivideSkip(sets, sizes)
    root, members = np.arange(len(sets)), {i: [i] for i in range(len(sets))}
    searched = np.zeros(len(sets), bool)
    largest = 0
    while len(todo := np.flatnonzero(~searched & (root != largest))):
        for i in todo.tolist():
            if root[i] == largest:
                continue
            searched[i] = True
            for other in np.unique(root[index.search(i)]).tolist():
                big, small = sorted((int(root[i]), int(root[other])), key=lambda r: -len(members[r]))
                if big != small:  # the smaller one is renamed
                    root[members[small]] = big
                    members[big] += members.pop(small)
            if len(members[int(root[i])]) > len(members[largest := int(root[largest])]):
                largest = int(root[i])
    first = {r: min(m) for r, m in members.items()}
    return np.array([first[r] for r in root.tolist()], np.int64)


def _search_block(table: pa.Table) -> pa.Table:
    keys = np.array(table.column("key").to_pylist(), np.int64)
    sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
    root = block_links(sets, np.array(table.column("size").to_pylist(), np.int64))
    off = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": pa.array(keys[off]), "b": pa.array(keys[root[off]])})


def candidate_sets(texts: DataFrame, shingles: int, hot: np.ndarray, bucket_shingles: int = BUCKET_SHINGLES) -> DataFrame:
    """Steps 2 and 3: sets that may have a link, with the hashes that they share. shingles: how many there are in all sets."""
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // (4 * bucket_shingles)))
    parts = max(tasks, min(MOST_BUCKETS, -(-shingles // bucket_shingles)))
    packed = texts.mapInArrow(giving_back(_postings(parts, parts, np.sort(hot))), _PACKED)
    shared = packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_shared_lists(parts), _SHARED)
    return shared.repartition(tasks, "part").groupBy("part").applyInArrow(_candidate_sets, _SETS)


def block_edges(sets: DataFrame) -> DataFrame:
    """Steps 4 and 5: links between sets, as a forest for each block."""
    first = sets.select("key", "first", "hashes").mapInArrow(_first_ones, "key bigint, hash bigint")
    lists = first.groupBy("hash").agg(F.min("key").alias("anchor"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "anchor")
    members = first.join(lists, "hash").select("anchor", "key").distinct().join(sets.select("key", "size", "hashes"), "key")
    members = cut(members)
    weights = members.groupBy("anchor").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("parts"))
    own = F.pmod(F.xxhash64("key"), F.col("parts"))
    met = members.join(weights, "anchor").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    met = met.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "size", "hashes")
    return met.groupBy("anchor", "i", "j").applyInArrow(_search_block, "a bigint, b bigint")


def jaccard_components(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_share: float = HOT_SHARE, hot_sets: int = HOT_SETS, bucket_shingles: int = BUCKET_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of documents. doc_id is of any type that has an order."""
    spark = documents.sparkSession
    prepare(spark)
    frame = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = cut(frame.mapInArrow(giving_back(_documents(hot_share, hot_sets)), _ROWS.format(frame.schema["doc_id"].dataType.simpleString())))
    rows = found.filter("hot IS NULL").select("doc_id", "n_shingles", "key")
    total, n_sets = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("key")).first()
    share = max(hot_share, total / max(1, n_sets) / MOST_HOT)  # a mean set has no more than MOST_HOT * share shingles
    hot = found.filter("hot IS NOT NULL").groupBy("key").agg(F.sum("hot").alias("n")).filter(F.col("n") >= F.lit(share * n_sets)).select("key").toArrow()["key"].to_numpy().astype(np.uint64)
    sets = cut(candidate_sets(frame.select("text"), total, hot, bucket_shingles))
    roots = components(block_edges(sets)).withColumnRenamed("node", "key")
    # rows meet their component once, by their set: copies are one row until then
    least = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    return rows.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
