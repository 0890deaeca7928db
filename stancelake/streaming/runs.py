"""Runs as streams of heartbeats: windowed counts, and states that stall without one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from stancelake.tables import scratch_path


def hourly(events: DataFrame) -> DataFrame:
    """Events and cents by hour and type; the same plan serves a table and a stream."""
    g = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select((F.unix_micros(F.col("w.start").cast("timestamp")) / 3_600_000_000).cast("long").alias("hour"), "event_type", "n", "cents")


#: How long a run may be silent before its state is dropped.
FORGET_MS = 90 * 86_400_000


def _track(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Last heartbeat and count of a run; a gap of over a day is a stall."""
    if state.hasTimedOut:  # silent for so long that nothing more is expected: its state goes
        state.remove()
        return
    last, beats, stalls = state.get if state.exists else (None, 0, 0)
    for pdf in batches:
        us = np.sort(pdf["us"].to_numpy())
        high = np.maximum.accumulate(us if last is None else np.append(last, us))
        before = high[:-1] if last is None else high[: len(us)]
        stalls += int((us[len(us) - len(before) :] - before > 86_400_000_000).sum())
        last, beats = int(high[-1]), beats + len(us)
    state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + FORGET_MS)
    state.update((int(last), int(beats), int(stalls)))
    yield pd.DataFrame({"user_id": [key[0]], "beats": [int(beats)], "stalls": [int(stalls)], "last_us": [int(last)]})


def track(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """A stream of run states from a stream of (user_id, ts); a run silent for FORGET_MS of event time is forgotten."""
    rows = events.withWatermark("ts", delay).select("user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(_track, "user_id long, beats long, stalls long, last_us long", "last_us long, beats long, stalls long", "update", "EventTimeTimeout")


#: A run's last event and what it is taken for: running, stalled or dead (silent for long, and longer), or how it ended.
_RUN = "us long, tie long, status string, beats long"
LIVENESS = "run string, status string, at_us long, last_us long, beats long"


class Watch(StatefulProcessor):
    """One state a run, and a timer in event time that fires while no event comes."""

    def __init__(self, stalled_ms: int, dead_ms: int):
        self.stalled_ms, self.dead_ms = stalled_ms, dead_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.run.get() if self.run.exists() else None
        us, tie, status, beats = held if held else (None, None, None, 0)
        for pdf in rows:
            last = pdf.sort_values(["us", "tie"]).iloc[-1]
            if us is None or (int(last["us"]), int(last["tie"])) > (us, tie):
                us, tie, status = int(last["us"]), int(last["tie"]), str(last["status"])
            beats += len(pdf)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.run.update((us, tie, status, beats))
        if status == "running":
            self.handle.registerTimer(us // 1000 + self.stalled_ms + 1)
        yield self._row(key[0], status, us, us, beats)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        us, tie, status, beats = self.run.get()
        now = timerValues.getCurrentWatermarkInMs()
        if status == "running":
            yield self._row(key[0], "stalled", us + self.stalled_ms * 1000, us, beats)
        if now > us // 1000 + self.dead_ms:  # it may be both at once, after a long gap
            yield self._row(key[0], "dead", us + self.dead_ms * 1000, us, beats)
            self.run.clear()
            return
        self.run.update((us, tie, "stalled", beats))
        self.handle.registerTimer(us // 1000 + self.dead_ms + 1)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(run, status: str, at_us: int, last_us: int, beats: int) -> pd.DataFrame:
        return pd.DataFrame({"run": [str(run)], "status": [status], "at_us": [at_us], "last_us": [last_us], "beats": [beats]})


def liveness(events: DataFrame, stalled_s: int = 30, dead_s: int = 300, delay: str = "10 seconds") -> DataFrame:
    """A stream of (run, status, at_us, last_us, beats) from a stream of events (run, ts, tie, status), status being running or how the run ended.

    A row for every batch of events of a run, and one when it has been silent
    for stalled_s, and for dead_s, of event time by the watermark, though no
    event of it comes. What comes after an end or a stall makes it anew what
    it says; a dead run's state is dropped.
    """
    rows = events.select(F.col("run").cast("string").alias("run"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("tie").cast("long").alias("tie"), "status").where("us is not null")
    return rows.withWatermark("ts", delay).groupBy("run").transformWithStateInPandas(Watch(stalled_s * 1000, dead_s * 1000), LIVENESS, "Update", "EventTime")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(path if _is_dir(spark, path) else f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_through(stream: DataFrame, mode: str, state: str | None = None) -> DataFrame:
    """The rows that a stream writes until it has read all that there is.

    Batches go to a table in the shared folder, with their number, and so does
    the stream's state, so a lost executor or a restart loses neither. In
    complete mode the last batch is the result, otherwise all are. With
    `state`, a folder, the stream goes on where it stopped there the last time.
    """
    spark = stream.sparkSession
    base = state or scratch_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure writes the same folder again
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # on disk, and what timers need
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    spark.conf.set(key, was)
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/rows")
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    return rows.drop("batch")


# --- the life of a run ---------------------------------------------------------------------------


def lifecycle(events: DataFrame, run: str = "run_id", order: list[str] | None = None) -> DataFrame:
    """A run's row from its events (run, kind, at, done, total): start, advance, heartbeat, finish.

    A second start begins it anew, what came before no longer counts; the
    last finish gives the status; a heartbeat moves nothing but itself.
    """
    begun = F.max(F.when(F.col("kind") == "start", F.col("at"))).over(Window.partitionBy(run))
    e = events.withColumn("__from", begun).where(F.col("__from").isNull() | (F.col("at") >= F.col("__from")))
    by = F.struct(*(order or ["at"]))
    ended = F.max_by("status", F.when(F.col("kind") == "finish", by)).alias("ended")
    moved = F.max(F.when(F.col("kind") == "advance", F.col("done"))).alias("done")
    g = e.groupBy(run).agg(F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started_at"), F.max("at").alias("heartbeat_at"), moved, F.max("total").alias("total"), ended)
    return g.select(run, "started_at", "heartbeat_at", F.coalesce("done", F.lit(0)).alias("done"), "total", F.coalesce("ended", F.lit("running")).alias("status"))


def progress_line(done: int, total: int) -> str:
    return f"progress turn={done} total={total}"


def progress(lines: Column) -> Column:
    """(done, total) of a progress line; null for any other line."""
    at = r"^progress turn=(\d+) total=(\d+)\s*$"
    part = lambda i: F.regexp_extract(lines, at, i).try_cast("long")
    return F.when(lines.rlike(at), F.struct(part(1).alias("done"), part(2).alias("total")))


def timings(spans: DataFrame) -> DataFrame:
    """(kind, n, total_us, mean_us, longest_us) of spans(kind, us)."""
    return spans.groupBy("kind").agg(F.count("*").alias("n"), F.sum("us").alias("total_us"), F.floor(F.sum("us") / F.count("*")).cast("long").alias("mean_us"), F.max("us").alias("longest_us"))


class StopFlag:
    """A file in the shared folder that asks work to stop between two batches; what is done stays in the cache."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def ask(self) -> None:
        self._fs.create(self._path, True).close()

    def clear(self) -> None:
        self._fs.delete(self._path, False)

    def asked(self) -> bool:
        return self._fs.exists(self._path)


def in_batches(parts: list[DataFrame], work: Callable[[DataFrame], DataFrame], path: str, stop: StopFlag | None = None) -> tuple[int, bool]:
    """(parts done in all, whether all are): each part's result is a folder of its own, and parts that have one are passed over.

    So a call after a stop, or after a failure, takes up what is left.
    """
    for i, part in enumerate(parts):
        spark = part.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={i}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            continue
        if stop is not None and stop.asked():
            return i, False
        work(part).write.mode("overwrite").parquet(f"{path}/part={i}")
    return len(parts), True


def poll(read: Callable[[], DataFrame], show: Callable[[list], None], every_s: float = 2.0, limit: int = 50, times: int | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """Show the newest `limit` runs again and again, `times` times or until show raises StopIteration."""
    n = 0
    while times is None or n < times:
        try:
            show(read().orderBy(F.desc("started_at"), "run_id").limit(limit).collect())
        except StopIteration:
            return
        n += 1
        if times is None or n < times:
            sleep(every_s)


def stalled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of every run, tracked over the stream."""
    rows = run_through(track(events_stream(spark, sf_dir)), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("beats", "stalls", "last_us"), "beats").alias("s")).select("user_id", "s.*")


def hourly_stream(spark: SparkSession, sf_dir: str, delay: str = "2 hours") -> DataFrame:
    """hourly over the stream: a window's last update counts, and its state goes once the watermark (`delay` late) has passed it."""
    rows = run_through(hourly(events_stream(spark, sf_dir).withWatermark("ts", delay)), "update")
    last = rows.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "cents"), "n").alias("s"))
    return last.select("hour", "event_type", "s.n", "s.cents")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
