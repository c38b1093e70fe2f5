"""Structured Streaming twins of the batch jobs; each gives what its batch job gives on the same input."""

from __future__ import annotations

import heapq
import itertools
import pickle
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..durable import shared_dir
from ..operators.changes import first_rows
from ..operators.signals import COUNTERS, WINDOW_US, decide, progress
from ..sources.bucketed import BucketedStore


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that a task holds at a time; more are sorted in runs on the task's disk.
HELD = 20_000


def drain(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], at: str | None = None) -> None:
    """Runs a stream over what is there now, batch by batch, with state in RocksDB; its checkpoint is in the shared folder. A later run with the same
    checkpoint `at` goes on where this one ended."""
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", at).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def stream_store(stream: DataFrame, store: BucketedStore, at: str | None = None) -> None:
    """IO-11: policies of each batch are stored at once, of each url the first that was ever seen.

    A batch reads the urls of the folders that its own urls fall into, and adds files to these. A batch that is run again after a failure finds
    what it has stored before.
    """
    drain(stream, "append", lambda batch, _: store.insert_new(first_rows(batch, ["url"], [F.col("seq")])), at)


def stream_progress(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """SG-07: counters per scan and domain in update mode; the watermark bounds how late an event may come."""
    return progress(stream.withWatermark("ts", delay))


def stream_progress_late(stream: DataFrame, path: str, delay: str = "1 day", at: str | None = None) -> None:
    """SG-07: counters of events in time, and apart from them how many came late: before the latest time of all earlier batches less `delay`.

    Each batch writes its own counters, its late rows' number by scan and domain, and its latest time to folders of its number under `path`,
    so a batch that is run again replaces what it wrote.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        latest = None
        if number > 0:
            latest = spark.read.parquet(f"{path}/marks").filter(F.col("batch") < number).agg(F.max("latest") - F.expr(f"INTERVAL {delay}")).first()[0]
        late = F.lit(False) if latest is None else F.coalesce(F.col("ts") < F.lit(latest), F.lit(False))
        marked = batch.withColumn("_late", late)
        progress(marked.filter("not _late")).write.mode("overwrite").parquet(f"{path}/in_time/batch={number}")
        marked.filter("_late").groupBy("scan_id", "domain_id").agg(F.count("*").alias("late")).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    drain(stream, "append", write, at)


def progress_late(spark: SparkSession, path: str) -> DataFrame:
    """SG-07: what `stream_progress_late` has counted so far: the counters of events in time, and `late`."""
    counters = ["events", *COUNTERS]
    zero = F.lit(0).cast("long")
    in_time = spark.read.parquet(f"{path}/in_time").select("scan_id", "domain_id", *counters, zero.alias("late"))
    late = spark.read.parquet(f"{path}/late").select("scan_id", "domain_id", *(zero.alias(c) for c in counters), "late")
    return in_time.union(late).groupBy("scan_id", "domain_id").agg(*(F.sum(c).alias(c) for c in (*counters, "late")))


def in_order(frames: Iterator[pd.DataFrame], by: list[str], held: int = HELD) -> Iterator[tuple]:
    """Rows of all frames one at a time, in order of `by`; runs of `held` rows are sorted and, where there are several, read back from the task's disk."""

    def saved(run: pd.DataFrame):
        file = tempfile.TemporaryFile()
        for low in range(0, len(run), 1000):
            pickle.dump(list(run.iloc[low : low + 1000].itertuples(index=False, name=None)), file)
        file.seek(0)
        return file

    def stored(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    runs, part, size = [], [], 0
    columns: list[str] = []
    for f in frames:
        columns = list(f.columns)
        part.append(f)
        size += len(f)
        if size >= held:
            runs.append(saved(pd.concat(part).sort_values(by)))
            part, size = [], 0
    last = pd.concat(part).sort_values(by) if part else None
    now = last.itertuples(index=False, name=None) if last is not None else iter(())
    if not runs:
        yield from now
        return
    at = [columns.index(c) for c in by]
    yield from heapq.merge(*map(stored, runs), now, key=lambda r: tuple(r[i] for i in at))


def _frames(rows: Iterator[tuple], columns: list[str], held: int = HELD) -> Iterator[pd.DataFrame]:
    while part := list(itertools.islice(rows, held)):
        yield pd.DataFrame(part, columns=columns)


class _Idle(StatefulProcessor):
    """State of a key that goes `keep_ms` after the latest event time of its rows, once the watermark has passed that."""

    keep_ms: int | None = None
    schema = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def rest(self, latest_us: int | None) -> None:
        if self.keep_ms is not None and latest_us is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest_us // 1000 + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Changes(_Idle):
    schema = "change_hash string, latest_us long"

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        last, latest = self.state.get() if known else (None, None)

        def changes() -> Iterator[tuple]:
            nonlocal known, last, latest
            for record_id, seq, change_hash, us, *_ in in_order(rows, ["seq"]):
                if not known or change_hash != last:
                    yield record_id, seq, change_hash
                known, last = True, change_hash
                latest = latest if pd.isna(us) else int(us) if latest is None else max(latest, int(us))

        yield from _frames(changes(), ["record_id", "seq", "change_hash"])
        self.state.update((last, latest))
        self.rest(latest)


def stream_changed(stream: DataFrame, keep: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """CD-08: records (record_id, seq, change_hash) the first time and whenever their hash changes, within a batch in order of seq.

    The state of a record is its last hash. Without `keep` it stays. With it the stream has `ts`: a record whose latest row lies longer than `keep`
    behind the watermark (`delay` behind the latest row of all) is forgotten, and is new when it comes again. A record's rows of one batch are
    taken one at a time.
    """
    if keep is None:
        rows = stream.select("record_id", "seq", "change_hash", F.lit(None).cast("long").alias("us"))
    else:
        rows = stream.withWatermark("ts", delay).select("record_id", "seq", "change_hash", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")
    return rows.groupBy("record_id").transformWithStateInPandas(_Changes(None if keep is None else _millis(stream.sparkSession, keep)), "record_id string, seq long, change_hash string", "Append", "None" if keep is None else "EventTime")


def _millis(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).alias("ms")).first()[0]


class _Limits(_Idle):
    schema = "recent array<long>"

    def __init__(self, per_minute: int) -> None:
        self.per_minute, self.keep_ms = per_minute, WINDOW_US // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = deque(self.state.get()[0] if self.state.exists() else ())

        def waits() -> Iterator[tuple]:
            for own, request_id, us, *_ in in_order(rows, ["us", "request_id"]):
                wait = decide([us], recent, self.per_minute)[0]
                yield own, request_id, None if wait is None else wait / 1e6

        for f in _frames(waits(), ["key", "request_id", "wait_s"]):
            yield f.astype({"wait_s": "float64"})
        self.state.update((list(recent),))
        self.rest(recent[-1] if recent else None)


def stream_rate_limit(stream: DataFrame, per_minute: int, delay: str = "1 minute") -> DataFrame:
    """SG-09: like the batch limiter, within a batch in order of time; batches are taken to come in order of time, but for `delay`.

    The state of a key is the times at which it was allowed in the last minute. It goes when the watermark has passed the last of them by a minute. A key's rows
    of one batch are taken one at a time.
    """
    rows = stream.withWatermark("ts", delay).select("key", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(_Limits(per_minute), "key long, request_id long, wait_s double", "Append", "EventTime")
