"""Conversation prefix trie: adaptive radix trees over the turns' ids, in ranges of the sorted conversations.

A turn's id is WIDTH bytes of a digest of role and text, so a conversation is a key of WIDTH bytes a turn and keys sort as the trie does depth first. A range
partitioning by (turn ids, conv_id) deals the keys out, equal ones over several partitions if they are many. Each partition puts its keys into an
adaptive radix tree: inner nodes of 4, 16, 48 or 256 places that grow as they fill, and whole runs of bytes on one edge. A walk emits a
node at each depth in bytes that ends a turn, also inside a run; branches within a turn's bytes are passed through.

Nodes on the first or last path of a partition that go on in a neighbour are told in part by each partition that has them. A partition knows by the number of
turns that its first key shares with the key before (two numbers a partition come to the driver) which nodes were met earlier, and counts those as no
child and no text anew; so all parts add up. The parts, a path's length for each partition at most, are joined by an aggregation over digests of their
prefixes. Ids of conversations that end at such a node are hashed from sorted pieces of joined ids, one piece after another, in bounded memory.

Null role or text: empty. Turns come by turn (null first), then by role and digest. Rows with a null conv_id are left out. Repeated rows are turns of their own. A
conversation's ids and lengths are one row (partly collected before they are shuffled), its texts are not. An empty table has no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, prepare, stored
from .textarrays import giving_back

WIDTH = 16
#: Turns of the keys of one partition, about: what a tree in memory is made of.
PIECE_TURNS = 1_000_000
#: Ids of conversations that are hashed as one piece.
PIECE_IDS = 10_000


class Node:
    """A node of a radix tree: path, the bytes of the edge that leads to it; and of the rows that end in it, which follow each other, the first and how many."""

    __slots__ = ("path", "places", "keys", "kids", "first", "count")

    def __init__(self, path: bytes = b""):
        self.path, self.places, self.keys, self.kids = path, 4, bytearray(), []
        self.first, self.count = -1, 0

    def child(self, byte: int) -> Node | None:
        if self.places <= 16:
            i = self.keys.find(byte)
            return self.kids[i] if i >= 0 else None
        if self.places == 48:
            i = self.keys[byte]
            return self.kids[i - 1] if i else None
        return self.kids[byte]

    def put(self, kid: Node) -> None:
        """Add a child under the first byte of its path, or replace the one there."""
        byte = kid.path[0]
        if self.places <= 16:
            i = bisect_left(self.keys, byte)
            if i < len(self.keys) and self.keys[i] == byte:
                self.kids[i] = kid
            elif len(self.keys) < self.places:
                self.keys.insert(i, byte)
                self.kids.insert(i, kid)
            else:
                self._grow()
                self.put(kid)
        elif self.places == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
            else:
                self._grow()
                self.put(kid)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            index = bytearray(256)
            for i, byte in enumerate(self.keys, 1):
                index[byte] = i
            self.places, self.keys = 48, index
        else:
            kids: list[Node | None] = [None] * 256
            for byte, i in enumerate(self.keys):
                if i:
                    kids[byte] = self.kids[i - 1]
            self.places, self.keys, self.kids = 256, bytearray(), kids

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.places == 48:
            return (self.kids[i - 1] for i in self.keys if i)
        return (kid for kid in self.kids if kid is not None)


def insert(root: Node, key: bytes, row: int) -> None:
    node, at = root, 0
    while at < len(key):
        kid = node.child(key[at])
        if kid is None:
            kid = Node(key[at:])
            node.put(kid)
            node, at = kid, len(key)
        elif key.startswith(kid.path, at):
            node, at = kid, at + len(kid.path)
        else:
            same, path = 0, kid.path
            while key[at + same : at + same + WIDTH] == path[same : same + WIDTH]:
                same += WIDTH
            while at + same < len(key) and key[at + same] == path[same]:
                same += 1
            above = Node(path[:same])
            kid.path = path[same:]
            above.put(kid)
            node.put(above)
            node, at = above, at + same
    if node.first < 0:
        node.first = row
    node.count += 1


class _Walk:
    """What is known of a subtree while it is walked through."""

    __slots__ = ("node", "start", "left", "n", "least", "kids", "new", "leaves", "saved", "row", "has_first", "has_last")

    def __init__(self, node: Node, start: int):
        self.node, self.start, self.left = node, start, node.children()
        self.n, self.least, self.row = node.count, None, node.first
        self.kids: list[int] = []
        self.new = self.leaves = self.saved = 0
        self.has_first = self.has_last = False

    def add(self, other: _Walk) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.kids += other.kids
        self.new, self.leaves, self.saved = self.new + other.new, self.leaves + other.leaves, self.saved + other.saved
        if self.row < 0:
            self.row = other.row
        self.has_first, self.has_last = self.has_first or other.has_first, self.has_last or other.has_last


def trie_of(keys: list[bytes], ids: list[int], chars: list[list[int]], shared_before: int = -1, shared_after: int = -1) -> dict[str, list]:
    """The nodes, children first, of keys sorted together with their ids. shared_before, shared_after: turns that the first key shares with the key before it in
    another partition and the last one with the key after it; -1 where there is none.

    row, depth: a key and how many of its turns name the node; spine: whether another partition may have it as well; new: whether none before has; up: its parent's number.
    """
    names = ("row", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "first", "count", "spine", "up")
    out: dict[str, list] = {name: [] for name in names}
    root = Node()
    for row, key in enumerate(keys):
        insert(root, key, row)
    stack, done = [_Walk(root, -1)], None
    while stack:
        walk = stack[-1]
        if done is not None:
            walk.add(done)
            done = None
        kid = next(walk.left, None)
        end = max(walk.start, 0) + len(walk.node.path)
        if kid is not None:
            stack.append(_Walk(kid, end))
            continue
        node = walk.node
        if node.count:
            own = ids[node.first]
            walk.least = own if walk.least is None else min(walk.least, own)
            walk.has_first = walk.has_first or node.first == 0
            walk.has_last = walk.has_last or node.first + node.count == len(keys)
        for depth in range(end // WIDTH, walk.start // WIDTH, -1):
            before, after = walk.has_first and depth <= shared_before, walk.has_last and depth <= shared_after
            if not walk.kids and not after:
                walk.leaves = 1
            if depth:
                walk.saved += (walk.n - (not before)) * chars[walk.row][depth - 1]
            number = len(out["row"])
            for i in walk.kids:
                out["up"][i] = number
            ends = node.count and depth * WIDTH == end
            one = (walk.row, depth, walk.least, walk.n, walk.new, walk.leaves, walk.saved, node.first if ends else 0, node.count if ends else 0, before or after, -1)
            for name, value in zip(names, one, strict=True):
                out[name].append(value)
            walk.kids, walk.new = [number], int(not before)
        done = stack.pop()
    return out


_PARTS = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, turn_id binary, ends binary, n_ends long, spine binary, up binary, ids string, first_id long"


def _prefix_digests(key: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0, 1, ... turns."""
    h = hashlib.sha256()
    out = [h.digest()]
    for at in range(0, turns * WIDTH, WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.copy().digest())
    return out


def _read(table: pa.Table) -> tuple[list[bytes], list[int], list[list[int]]]:
    turns = table.column("turn_ids").combine_chunks()
    data = b"".join(turns.flatten().to_pylist())
    ends = turns.offsets.to_pylist()
    return [data[(a - ends[0]) * WIDTH : (z - ends[0]) * WIDTH] for a, z in zip(ends[:-1], ends[1:], strict=True)], table.column("conv_id").to_pylist(), table.column("chars").to_pylist()


def _parts(it: Iterator[pa.RecordBatch], shared: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition: rows with the column spine are parts, ids and first_id are pieces of the ids that end at a part."""
    batches = list(it)
    if not sum(b.num_rows for b in batches):
        return
    keys, ids, chars = _read(pa.Table.from_batches(batches))
    before, after = shared[TaskContext.get().partitionId()]
    nodes = trie_of(keys, ids, chars, before, after)
    on_first, on_last = _prefix_digests(keys[0], max(before, 0)), _prefix_digests(keys[-1], max(after, 0))
    lists = list(zip(*nodes.values(), strict=True))
    spines: list[bytes | None] = [None] * len(lists)
    for i, (row, depth, *_, spine, _) in enumerate(lists):
        if spine:
            spines[i] = on_first[depth] if depth <= before and keys[row].startswith(keys[0][: depth * WIDTH]) else on_last[depth]
    rows: list[tuple] = []
    schema = pa.schema([pa.field(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k]) for n, k in (c.split() for c in _PARTS.split(", "))])
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for i, (row, depth, conv, n, kids, leaves, saved, first, count, _, up) in enumerate(lists):
        digest, above = None, spines[up] if up >= 0 else None
        if count and spines[i] is None:
            digest = hashlib.sha256()
            for a in range(first, first + count, PIECE_IDS):
                digest.update(("," if a > first else "").encode() + ",".join(map(str, ids[a : min(a + PIECE_IDS, first + count)])).encode())
            digest = digest.digest()
        elif count:
            for a in range(first, first + count, PIECE_IDS):
                own = ids[a : min(a + PIECE_IDS, first + count)]
                rows.append((None,) * 10 + (spines[i], None, ",".join(map(str, own)), own[0]))
        turn = keys[row][(depth - 1) * WIDTH : depth * WIDTH] if depth else None
        rows.append((depth, conv, lists[up][2] if up >= 0 else None, n, kids, leaves, saved, turn, digest, count, spines[i], above, None, None))
        if len(rows) >= 20_000:
            yield pack()
            rows.clear()
    if rows:
        yield pack()


def _boundaries(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """By partition: turns that its first key shares with the key before and its last one with the key after, -1 without one."""

    def edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in it:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() if first is None else first
                last = batch.column(0)[batch.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.list_(pa.binary())), pa.array([last], pa.list_(pa.binary()))], names=["piece", "first", "last"])

    by_piece = Window.orderBy("piece")  # a row a partition
    met = ranged.select("turn_ids").mapInArrow(edges, "piece int, first array<binary>, last array<binary>")
    pairs = met.select("piece", F.lag("piece").over(by_piece).alias("earlier"), "first", F.lag("last").over(by_piece).alias("last")).filter("earlier IS NOT NULL")
    differ = F.array_position(F.zip_with("first", "last", lambda a, b: F.coalesce(a != b, F.lit(True))), True)
    same = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("first"), F.size("last")))
    shared: dict[int, list[int]] = {}
    for piece, earlier, n in pairs.select("piece", "earlier", same).collect():
        shared.setdefault(piece, [-1, -1])[0] = n
        shared.setdefault(earlier, [-1, -1])[1] = n
    every = range(ranged.rdd.getNumPartitions())
    return {i: tuple(shared.get(i, (-1, -1))) for i in every}


def _hashed_ids(pieces: DataFrame) -> DataFrame:
    """(spine, ends): digests of the joined ids of each spine. The pieces of one, PIECE_IDS ids a row, come sorted and one after another."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spine, h = None, None
        for batch in it:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != spine:
                    if spine is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([spine], pa.binary()), pa.array([h.digest()], pa.binary())], names=["spine", "ends"])
                    spine, h = own, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if spine is not None:
            yield pa.RecordBatch.from_arrays([pa.array([spine], pa.binary()), pa.array([h.digest()], pa.binary())], names=["spine", "ends"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("spine", "first_id", "ids").repartition(n, "spine").sortWithinPartitions("spine", "first_id")
    return dealt.mapInArrow(batches, "spine binary, ends binary")


def turn_id(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))


def conversation_keys(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn_ids and chars (code points of the texts) of each conversation in the order of its turns."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    number = F.col(f"`{turn}`")
    slim = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.struct(number.isNotNull().alias("known"), number.alias("turn"), empty(role).alias("role"), turn_id(empty(role), empty(text)).alias("id"), F.length(empty(text)).alias("chars")).alias("t"))
    listed = slim.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.col("t.id").alias("turn_ids"), F.col("t.chars").alias("chars"))


def turn_texts(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """(turn_id, role, text): what the ids of nodes stand for."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return turns.select(turn_id(empty(role), empty(text)).alias("turn_id"), empty(role).alias("role"), empty(text).alias("text")).dropDuplicates(["turn_id"])


def with_donated_turns(keys: DataFrame, donor: Column, turns: Column, most: int) -> DataFrame:
    """Conversations that begin with the first `turns` (0 to most) turns of another one, all if it has fewer, and go on with their own after as many."""
    keys = cut(keys)
    first = keys.select(F.col("conv_id").alias("donor"), F.slice("turn_ids", 1, most).alias("d_ids"), F.slice("chars", 1, most).alias("d_chars"))
    wanted = keys.withColumn("donor", donor).withColumn("h", turns.cast("int"))
    asked = first.join(wanted.select("donor").distinct(), "donor", "left_semi")
    rest = lambda mine, theirs: F.concat(F.coalesce(F.slice(theirs, F.lit(1), F.col("h")), F.slice(mine, 1, 0)), F.slice(mine, F.col("h") + 1, F.greatest(F.size(mine) - F.col("h"), F.lit(0))))
    return wanted.join(asked, "donor", "left").select("conv_id", rest("turn_ids", "d_ids").alias("turn_ids"), rest("chars", "d_chars").alias("chars"))


def prefix_trie(keys: DataFrame, pieces: int | None = None) -> DataFrame:
    """The trie's nodes: conv_id (the smallest member), depth, parent_conv_id, turn_id (of the last turn; see turn_texts), n_convs, n_children, n_leaves, saved_tokens,
    n_ends (members that end here) and ends_sha256 (of their ids, ascending, joined by commas).

    keys: conv_id (each once), turn_ids, chars, as conversation_keys() gives them.
    """
    spark = keys.sparkSession
    prepare(spark)
    keys = cut(keys.select("conv_id", "turn_ids", "chars"))
    turns = keys.agg(F.coalesce(F.sum(F.size("turn_ids") + 1), F.lit(0))).first()[0]
    n = pieces or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // PIECE_TURNS))
    ranged = cut(keys.repartitionByRange(n, "turn_ids", "conv_id").sortWithinPartitions("turn_ids", "conv_id"))
    sent = spark.sparkContext.broadcast(_boundaries(ranged))
    parts = stored(ranged.mapInArrow(giving_back(lambda it: _parts(it, sent.value)), _PARTS))
    sent.destroy()

    ends = _hashed_ids(parts.filter("ids IS NOT NULL"))
    told = parts.filter("spine IS NOT NULL AND ids IS NULL").groupBy("spine").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")), F.first("turn_id").alias("turn_id"), F.first("up").alias("up"))
    joined = stored(told.join(ends, "spine", "left"))
    names = joined.select(F.col("spine").alias("up"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "turn_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "ends", "up"]
    whole = parts.filter("spine IS NULL AND ids IS NULL").select(*columns, "parent_conv_id").unionByName(joined.select(*columns, F.lit(None).cast("long").alias("parent_conv_id")))
    digest = F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256)).alias("ends_sha256")
    named = whole.filter("up IS NOT NULL").join(names, "up").select(*whole.columns[:-1], F.col("above").alias("parent_conv_id"))
    every = named.unionByName(whole.filter("up IS NULL").drop("up"), allowMissingColumns=True)
    return every.select("conv_id", "depth", "parent_conv_id", "turn_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", digest)
