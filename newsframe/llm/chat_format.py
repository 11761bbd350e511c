"""Chat formatting over a prefix tree: turns that conversations begin alike are written once, depth first.

A turn is written as START role newline text END newline, with backslashes and `<|` escaped inside role and text, so that no text can
look like a mark and every text can be read back. Conversations in the order of their turns' digests are the tree depth first: what one
shares with the one before it is already written, the rest of its turns are new nodes. A range partitioning deals them out by that order (and by
conv_id, so that equal conversations can be parted); each partition tells its first and last path and its size, from which the driver, a row for
each partition, finds where each partition's nodes begin in the stream and which ancestors they have before it. Then every node gets its place in the
stream, its position ids (from the end of its ancestors on) and the intervals of the stream that its characters attend to besides those
before them in the node itself: its ancestors, adjacent ones merged.

Null role, text and turn: an empty string, an empty string, first. Turns of one number come by role and text; repeated rows are turns of their
own. A null conv_id is one conversation. An empty table gives empty results. Other columns are not looked at. One conversation is one row with all its turns, as its digest needs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, prepare

START, END = "<|im_start|>", "<|im_end|>"
_DIGEST = 16
#: Conversations of one turn that a task joins, and the most turns that have more.
HOT_NODE = 50_000
MOST_HOT = 100_000


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> str:
    return f"{START}{escaped(role).replace('\n', '\\n')}\n{escaped(text)}{END}\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        close = formatted.index(END, line)
        out.append((unescaped(formatted[at + len(START) : line]), re.sub(r"\\(.)", r"\1", formatted[line + 1 : close], flags=re.S)))
        at = close + len(END) + 1
    return out


def _formatted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        paths, texts = [], []
        for turns in batch.column(1).to_pylist():
            texts.append([format_turn(t["role"], t["text"]) for t in turns])
            paths.append(b"".join(hashlib.blake2b(t.encode(), digest_size=_DIGEST).digest() for t in texts[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary()), pa.array(texts, pa.list_(pa.string()))], names=["conv_id", "path", "turns"])


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths begin alike."""
    n = min(len(a), len(b)) // _DIGEST
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * _DIGEST] == b[: middle * _DIGEST] else (low, middle - 1)
    return low


def _walk(it: Iterator[pa.RecordBatch], path: bytes, stack: list[tuple[int, int]], base: int):
    """Each conversation in order: its id, path, turns, how many of its turns were written before, and all its turns' places."""
    for batch in it:
        for conv, own, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            known = _shared(path, own)
            stack = stack[:known]
            for turn in turns[known:]:
                stack.append((base, base + len(turn)))
                base += len(turn)
            path = own
            yield conv, own, turns, known, list(stack)


def _summary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, last = None, None
    size = 0
    for _, path, turns, known, places in _walk(it, b"", [], 0):
        first = first or (path, [len(t) for t in turns])
        last = path, [a for a, _ in places], [b for _, b in places]
        size = max(size, max((b for _, b in places), default=0))
    if first:
        row = [TaskContext.get().partitionId()], [first[0]], [first[1]], [last[0]], [last[1]], [last[2]], [size]
        kinds = pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["pid", "first", "sizes", "last", "starts", "ends", "size"])


_SUMMARY = "pid int, first binary, sizes array<bigint>, last binary, starts array<bigint>, ends array<bigint>, size bigint"


def _beginnings(summaries: list) -> dict[int, tuple[int, bytes, list[tuple[int, int]]]]:
    """For each partition: where its nodes begin, and the path and places that it goes on from."""
    out, base, path, stack = {}, 0, b"", []
    for s in sorted(summaries, key=lambda s: s["pid"]):
        known = _shared(path, s["first"])
        skipped = sum(s["sizes"][:known])
        out[s["pid"]] = base, path, stack
        before = stack
        path = bytes(s["last"])
        stack = [before[i] if a < skipped else (base + a - skipped, base + b - skipped) for i, (a, b) in enumerate(zip(s["starts"], s["ends"], strict=True))]
        base += s["size"] - skipped
    return out


def _merged(places: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in places:
        if out and out[-1]["end"] == a:
            out[-1]["end"] = b
        elif b > a:
            out.append({"start": a, "end": b})
    return out


_NODES = "start bigint, end bigint, position bigint, attends array<struct<start: bigint, end: bigint>>, text string, loss_start int, loss_end int"
_MEMBERS = "conv_id bigint, nodes array<bigint>"


def prefix_tree(conversations: DataFrame, loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """The nodes of the tree and the conversations in it.

    Nodes: start and end in the stream, position (of the first character; the others follow), attends (intervals of the stream), text, and
    the part of the text under the loss mask (empty for other roles). Conversations: conv_id and the starts of its nodes in order.
    """
    spark = conversations.sparkSession
    prepare(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).mapInArrow(_formatted, "conv_id bigint, path binary, turns array<string>")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(whole.repartitionByRange(partitions, "path", "conv_id").sortWithinPartitions("path", "conv_id"))
    begin = _beginnings(ordered.mapInArrow(_summary, _SUMMARY).collect())

    def nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, path, stack = begin.get(TaskContext.get().partitionId(), (0, b"", []))
        out: list[tuple] = []
        for _, _, turns, known, places in _walk(it, path, stack, base):
            position = sum(b - a for a, b in places[:known])
            for i in range(known, len(turns)):
                turn, (a, b) = turns[i], places[i]
                head = turn.index("\n") + 1
                masked = unescaped(turn[len(START) : head - 1]) == loss_role
                out.append((a, b, position, _merged(places[:i]), turn, head if masked else 0, len(turn) - len(END) - 1 if masked else 0))
                position += b - a
            if len(out) > 2000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, path, stack = begin.get(TaskContext.get().partitionId(), (0, b"", []))
        for batch in it:
            found = list(_walk([batch], path, stack, base))
            for conv in found:
                base = max([base, *(b for _, b in conv[4][conv[3] :])])
            path, stack = found[-1][1], found[-1][4]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in found], pa.int64()), pa.array([[a for a, _ in c[4]] for c in found], pa.list_(pa.int64()))], names=["conv_id", "nodes"])

    return ordered.mapInArrow(nodes, _NODES), ordered.mapInArrow(members, _MEMBERS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = pa.int64(), pa.int64(), pa.int64(), interval, pa.string(), pa.int32(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["start", "end", "position", "attends", "text", "loss_start", "loss_end"])


def read_conversations(nodes: DataFrame, members: DataFrame, hot: int = HOT_NODE) -> DataFrame:
    """conv_id, formatted text and its masked parts (still escaped), from the stream.

    Nodes of `hot` conversations or more (or, if there were over MOST_HOT of them, of so many more) are broadcast by number and copied as often as they fill `hot`, so
    that a turn which a third of all conversations begin with is joined by many tasks.
    """
    steps = members.select("conv_id", F.posexplode("nodes").alias("i", "start"))
    total = members.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()[0]
    share = max(hot, -(-total // MOST_HOT))
    copies = F.broadcast(steps.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= share).select("start", F.ceil(F.col("n") / share).alias("copies")))
    dealt = steps.join(copies, "start", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("conv_id", "i"), "copies"), F.lit(0))).drop("copies")
    copied = nodes.select("start", "text", "loss_start", "loss_end").join(copies, "start", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    found = dealt.join(copied, ["start", "copy"])
    own = F.struct("i", "text", F.expr("substring(text, loss_start + 1, loss_end - loss_start)").alias("loss"))
    parts = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("parts"))
    return parts.select("conv_id", F.array_join("parts.text", "").alias("formatted"), F.col("parts.loss").alias("masked"))


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all from the formatted texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in it:
            rows = []
            for formatted, masked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(formatted)
                loss = "".join(re.sub(r"\\(.)", r"\1", m, flags=re.S) for m in masked)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read.mapInArrow(batches, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
