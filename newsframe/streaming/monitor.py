"""Streams over article and log files: keyword monitoring, watermarked ingest, running counters, retries.

Offsets and states are in the stream's checkpoint folder; results are written a folder for each micro-batch, so that a batch that is done again after a
failure replaces what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.text import log_flags, status_detail, status_state
from ..operators.joins import keyword_matches
from ..sources.checkpoints import shared_folder


#: Articles that one folder of matches is about, and folders that a micro-batch names to read no others.
SPAN = 100_000
MOST_SPANS = 10_000
#: Lines of a job that are kept.
TAIL = 100
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int = 4) -> DataFrame:
    """A stream over the Parquet files of a folder, or over one file: as a pattern, a path may be either."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, each_batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append", folder: str | None = None, state_store: str | None = None) -> str:
    """Run a stream over what there is and return the folder of its results: batch=<n> below it for append, the last state for complete and update. state_store: a provider class for this stream."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    if state_store:
        spark.conf.set(setting, state_store)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each_batch or write).start()
    finally:
        if state_store and before is None:
            spark.conf.unset(setting)
        elif state_store:
            spark.conf.set(setting, before)
    query.awaitTermination()
    return f"{folder}/out"


def insert_ignore(rows: DataFrame, target: str, number: int, keys: Sequence[str], span: Column) -> None:
    """Add the rows of a micro-batch to a folder, of equal keys one, without those that an earlier batch added.

    The folder is laid out by batch and span (whole numbers that rows of one key share), and of what is there only the spans of the new rows are read. Nothing is kept between batches; a batch
    that is done again replaces what it wrote and looks at earlier ones alone.
    """
    spark = rows.sparkSession
    new = rows.dropDuplicates(list(keys)).withColumn("span", span.cast("long"))
    if number:
        known = spark.read.schema(new.schema.add("batch", "integer")).option("basePath", target).parquet(target).filter(F.col("batch") < number)
        met = known.join(F.broadcast(new.select("span").distinct()), "span", "left_semi") if new.select("span").distinct().limit(MOST_SPANS + 1).count() <= MOST_SPANS else known
        new = new.join(met, list(keys), "left_anti")
    new.write.mode("overwrite").partitionBy("span").parquet(f"{target}/batch={number}")


def monitor_keywords(articles: DataFrame, keywords: DataFrame, after: int = -1) -> DataFrame:
    """(keyword_id, article_id) of a stream of articles, each pair once, of ids past an offset. The streaming checkpoint is the offset from then on;
    after=max(0, last - n) on a new checkpoint replays the last n. The stream keeps no state: a pair that was found before is not inserted again, as the table has it."""
    spark = articles.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    target = f"{folder}/out"

    def insert_new(batch: DataFrame, number: int) -> None:
        insert_ignore(keyword_matches(batch, keywords), target, number, ("keyword_id", "article_id"), F.floor(F.col("article_id") / SPAN))

    run_to_end(articles.filter(F.col("id") > after), insert_new, folder=folder)
    return spark.read.schema("keyword_id long, article_id long").option("basePath", target).parquet(target).select("keyword_id", "article_id")


def backfill(articles: DataFrame, keywords: DataFrame, stored: DataFrame, n: int = 200) -> DataFrame:
    """Matches of the newest n articles: how many were found (attempts) and how many of them are not stored yet."""
    found = keyword_matches(articles.orderBy(F.desc("id")).limit(n), keywords)
    flagged = found.join(stored.select("keyword_id", "article_id", F.lit(True).alias("known")), ["keyword_id", "article_id"], "left")
    return flagged.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("known").isNull()).alias("inserted"))


def past_marks(rows: DataFrame, marks: DataFrame, key: str, default: datetime) -> DataFrame:
    """Rows later than their key's mark (the default where there is none)."""
    mark = F.coalesce("mark", F.lit(default.isoformat(" ")).cast("timestamp_ntz"))
    return rows.join(marks.select(key, "mark"), key, "left").filter(F.col("ts") > mark).drop("mark")


def new_marks(marks: DataFrame, keys: DataFrame, key: str, started: datetime) -> DataFrame:
    """Marks set to the start of a cycle for the keys that took part, before anything was read."""
    own = keys.select(key).distinct().withColumn("mark", F.lit(started.isoformat(" ")).cast("timestamp_ntz"))
    return marks.join(own.select(key), key, "left_anti").select(key, "mark").unionByName(own)


def in_window(column: Column, mark: datetime, end: datetime, old_on_mark: bool = True) -> Column:
    """(mark, end]: a row on the mark is old, or new for sites that have it so."""
    at = lambda t: F.lit(t.isoformat(" ")).cast("timestamp_ntz")
    return ((column > at(mark)) if old_on_mark else (column >= at(mark))) & (column <= at(end))


def first_of_key(stream: DataFrame, key: str, time: str, lookback: str = "7 days") -> DataFrame:
    """The stream without rows of a key that came within the lookback and without rows older than it."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, lookback).dropDuplicatesWithinWatermark([key])


def late_updates(stream: DataFrame, key: str, published: str, modified: str, mark: datetime, end: datetime, lookback: str = "7 days") -> DataFrame:
    """Rows whose publication or, failing that, modification is in (mark, end], with that time as `effective`: a later update of a known key is taken like a new row.

    Only the same update again (key and effective time, within the lookback) is left out. effective is a timestamp, as a watermark needs one.
    """
    at = [F.when(in_window(F.col(c), mark, end), F.col(c)) for c in (published, modified)]
    stamped = stream.withColumn("effective", F.coalesce(*at).cast("timestamp")).filter("effective IS NOT NULL")
    return stamped.withWatermark("effective", lookback).dropDuplicatesWithinWatermark([key, "effective"])


def job_counters(rows: DataFrame) -> DataFrame:
    """By job: lines, errors, processed articles and the latest line; the same over a stream and over a table."""
    told = rows.withColumn("told", log_flags(F.col("line")))
    return told.groupBy("job").agg(F.count(F.lit(1)).alias("lines"), F.count_if("told.error").alias("errors"), F.sum("told.processed").alias("processed"), F.max(F.struct("ts", "event_id", "line"))["line"].alias("latest"))


_TOLD = "lines long, errors long, processed long, state string, detail string, at timestamp, event_id long"
_LINE = "ts timestamp, event_id long, line string"
_TAILS = "job string, lines long, errors long, processed long, state string, detail string, tail array<string>"


class _JobTail(StatefulProcessor):
    """Of each job its counters, its latest state and its last lines: a value and a list of TAIL lines at most, both forgotten when the job is silent for the time to live."""

    def __init__(self, tail: int, ttl_ms: int | None):
        self.tail, self.ttl_ms = tail, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", _TOLD, self.ttl_ms)
        self.kept = handle.getListState("kept", _LINE, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        lines, errors, processed, state, detail, at, last = self.told.get() or (0, 0, 0, None, None, None, None)
        kept = list(self.kept.get())
        for frame in rows:
            lines, errors, processed = lines + len(frame), errors + int(frame["errors"].sum()), processed + int(frame["processed"].sum())
            stated = frame[frame["state"].notna()]
            if len(stated):
                row = stated.sort_values(["ts", "event_id"]).iloc[-1]
                if at is None or (row["ts"].to_pydatetime(), int(row["event_id"])) > (at, last):
                    state, detail, at, last = row["state"], row["detail"], row["ts"].to_pydatetime(), int(row["event_id"])
            newest = frame.sort_values(["ts", "event_id"]).tail(self.tail)
            kept += [(t.to_pydatetime(), int(i), line) for t, i, line in zip(newest["ts"], newest["event_id"], newest["line"], strict=True)]
            kept = sorted(kept, key=lambda x: x[:2])[-self.tail :]
        self.told.update((lines, errors, processed, state, detail, at, last))
        self.kept.put(kept)
        yield pd.DataFrame({"job": [key[0]], "lines": [lines], "errors": [errors], "processed": [processed], "state": [state], "detail": [detail], "tail": [[x[2] for x in kept]]})

    def close(self) -> None:
        pass


def job_tails(stream: DataFrame, tail: int = TAIL, ttl_ms: int | None = None) -> DataFrame:
    """By job, over a stream of (job, ts, event_id, line): lines, errors, processed articles, the latest state with its detail, and the last lines, oldest first; a row for each job of a micro-batch.

    Latest and last are by (ts, event_id), whatever the order of arrival. Run it with state_store=ROCKS and mode="update".
    """
    told = log_flags(F.col("line"))
    rows = stream.select("job", F.col("ts").cast("timestamp").alias("ts"), "event_id", "line", told["error"].cast("int").alias("errors"), told["processed"].alias("processed"), status_state(F.col("line")).alias("state"), status_detail(F.col("line")).alias("detail"))
    return rows.groupBy("job").transformWithStateInPandas(_JobTail(tail, ttl_ms), _TAILS, "update", "processingTime" if ttl_ms else "none")


_RETRY = "key string, attempts int, state string"


def retry_states(stream: DataFrame, most: int = 10) -> DataFrame:
    """By key, over a stream of (key, position, ok): attempts up to the first success or to `most`, and success, retry or exhausted.

    Attempts count by position, whatever the order in which files, micro-batches and parts of a key arrive: the state is the first `most` attempts by position, of which the rest follows.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            early = frame.sort_values("position").head(most)
            first += zip(early["position"].tolist(), early["ok"].tolist(), strict=True)
            first = sorted(first, key=lambda x: x[0])[:most]
        state.update(([p for p, _ in first], [ok is True for _, ok in first]))
        good = next((i for i, (_, ok) in enumerate(first, 1) if ok is True), None)
        name = "success" if good else "exhausted" if len(first) >= most else "retry"
        yield pd.DataFrame({"key": [key[0]], "attempts": [good or len(first)], "state": [name]})

    return stream.groupBy("key").applyInPandasWithState(step, _RETRY, "positions array<long>, oks array<boolean>", "update", GroupStateTimeout.NoTimeout)


def retry_table(rows: DataFrame, most: int = 10) -> DataFrame:
    """The same over a table: attempts up to the first success are counted by aggregates that combine before they are shuffled, so no key is sorted in one task."""
    totals = rows.groupBy("key").agg(F.min(F.when(F.col("ok"), F.col("position"))).alias("success"), F.count(F.lit(1)).alias("n"))
    upto = rows.join(totals.select("key", "success"), "key").groupBy("key").agg(F.count_if(F.col("position") <= F.col("success")).alias("nth"))
    both = totals.join(upto, "key")
    good = F.col("success").isNotNull() & (F.col("nth") <= most)
    attempts = F.when(good, F.col("nth")).otherwise(F.least("n", F.lit(most)))
    return both.select("key", attempts.cast("int").alias("attempts"), F.when(good, "success").when(F.col("n") >= most, "exhausted").otherwise("retry").alias("state"))


def gate(rows: DataFrame, least: int) -> DataFrame:
    """rows if there are that many, else none: what starts a build."""
    return rows if rows.limit(least).count() >= least else rows.limit(0)


def due_jobs(schedules: DataFrame, running: DataFrame, at: str) -> DataFrame:
    """(schedule, job): of active schedules of a time HH:MM, each job that doesn't run. jobs is a JSON array of ids."""
    due = schedules.filter((F.col("is_active") == 1) & (F.substring("schedule_time", 1, 5) == at))
    jobs = due.select("label", F.explode(F.from_json("jobs", "array<string>")).alias("job"))
    return jobs.join(running.select("job"), "job", "left_anti").select("label", "job")
