"""Streams of call events: dedup within a time to live, reservations, windowed rates, per-call state, waits that time out.

Each function maps a streaming DataFrame to one; `drain` runs a stream over everything that is there and returns the
table it has written. State and checkpoints lie in the shared folder.

A live stream drops what comes later than its watermark and keeps its last windows open. Of a table that is drained to its
end nothing may be missing, in whatever order its files come: there the rows are drained first, without state, and then
settled in event-time order (`rates` over the drained rows, `first_within`, `states.call_moves`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import vocab as V
from ..scratch import fresh_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    """The events table as a stream; `at` is the event time with the session's zone."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events*.parquet")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], ttl: str = "5 minutes") -> DataFrame:
    """The first event of each key within the time to live, of a live stream."""
    return stream.withWatermark("at", ttl).dropDuplicatesWithinWatermark(keys)


def first_within(rows: DataFrame, keys: list[str], minutes: int, ties: list[str] = ()) -> DataFrame:
    """The same of drained rows: those with no kept row of their key less than so many minutes before them.

    Rows without a time stay. Sorted rows are folded batch by batch, in constant memory for a key of any length.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, since = None, 0
        for batch in batches:
            keep = []
            for key, us in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("_us").to_pylist()):
                keep.append(us is None or key != last or us - since >= minutes * 60_000_000)
                if keep[-1] and us is not None:
                    last, since = key, us
            yield batch.filter(pa.array(keep, pa.bool_()))

    timed = rows.withColumn("_us", F.unix_micros("at"))
    return timed.repartition(*keys).sortWithinPartitions(*keys, "_us", *ties).mapInArrow(fold, timed.schema).drop("_us")


def rates(stream: DataFrame, key: str, limits: dict[str, int], late: str = "10 minutes") -> dict[str, DataFrame]:
    """Per window length: counts per key and window, and whether they pass the limit. Of drained rows no window is late or open."""
    def one(length: str, limit: int) -> DataFrame:
        counted = stream.withWatermark("at", late).groupBy(F.window("at", length), key).agg(F.count("*").alias("n"))
        return counted.select(key, F.col("window.start").cast("timestamp_ntz").alias("start"), "n", (F.col("n") > limit).alias("limited"))

    return {length: one(length, limit) for length, limit in limits.items()}


def call_states(results: DataFrame) -> DataFrame:
    """(call_id, status, stage, seq): a row for each stage result that moves its call.

    results: call_id, seq, stage, action. Results of one call in one micro-batch are taken in order of seq; a result
    of another stage than the call's own is stale and does nothing. State: status and stage number.
    """
    last = len(V.STAGES) - 1

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, rank = state.get if state.exists else ("processing", 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if status != "processing" or row.stage != V.STAGES[rank]:
                continue
            if row.action == "hold":
                status = "held"
            elif row.action == "drop" and row.stage in V.SKIP_STAGES:
                status = "skipped"
            elif row.action == "continue" and rank == last:
                status = "completed"
            elif row.action == "continue":
                rank += 1
            else:
                continue
            out.append((key[0], status, V.STAGES[rank], row.seq))
        state.update((status, rank))
        yield pd.DataFrame(out, columns=["call_id", "status", "stage", "seq"])

    return results.groupBy("call_id").applyInPandasWithState(fold, "call_id long, status string, stage string, seq long", "status string, rank int", "append", GroupStateTimeout.NoTimeout)


def waits(stream: DataFrame, timeout_minutes: int) -> DataFrame:
    """(call_id, state): `ready` at a call's first ready event, `held` if none comes within the timeout of its first wait.

    stream: call_id, at, ready. Event time drives the timeout.
    """
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"call_id": [key[0]], "state": ["held"]})
            return
        rows = pd.concat(list(frames)).sort_values("at")
        start = state.get[0] if state.exists else int(rows["at"].iloc[0].timestamp() * 1000)
        due = start + timeout_minutes * 60_000
        first = rows[rows["ready"]]["at"].min()
        if not pd.isna(first) and first.timestamp() * 1000 < due:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"call_id": [key[0]], "state": ["ready"]})
            return
        state.update((start,))
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"call_id": [], "state": []}).astype({"call_id": "int64", "state": "str"})

    return stream.withWatermark("at", "1 minute").groupBy("call_id").applyInPandasWithState(fold, "call_id long, state string", "started long", "append", GroupStateTimeout.EventTimeTimeout)


class _Replay(StatefulProcessor):
    """Who holds a key, whether committed, and until when; a timer forgets a hold that has run out."""

    def __init__(self, key: list[str], minutes: int):
        self.key, self.ttl = key, minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "holder long, committed boolean, until long")

    def _hold(self, until: int, held: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update((*held, until))
        self.handle.registerTimer(until)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch["step"] = batch["kind"].map({"reserve": 0, "commit": 1, "release": 2})
        out = []
        for row in batch.sort_values(["at", "id", "step"]).itertuples():
            now = int(row.at.timestamp() * 1000)
            holder, committed, until = self.held.get() if self.held.exists() else (None, False, 0)
            acquired = row.kind == "reserve" and (holder is None or until <= now)
            if acquired:
                self._hold(now + self.ttl, (row.id, False))
            elif row.kind == "commit" and holder == row.id:
                self._hold(now + self.ttl, (row.id, True))
            elif row.kind == "release" and holder == row.id and not committed:
                self.held.clear()
            out.append((*key, row.id, row.kind, acquired))
        yield pd.DataFrame(out, columns=[*self.key, "id", "kind", "acquired"], dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        yield pd.DataFrame(columns=[*self.key, "id", "kind", "acquired"], dtype=object)

    def close(self) -> None:
        pass


def replay_guard(stream: DataFrame, keys: list[str], minutes: int, late: str = "1 minute") -> DataFrame:
    """`states.replay_guard` of a live stream of keys, id, kind, at: reserve, commit, release, with a time to live.

    Rows of a micro-batch are taken in order of time; state is one hold a key, forgotten when it runs out.
    """
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    rows = stream.select(*keys, "id", "kind", "at").withWatermark("at", late)
    return rows.groupBy(*keys).transformWithStateInPandas(_Replay(keys, minutes), f"{kinds}, id long, kind string, acquired boolean", "Append", "EventTime")


class _Settled(StatefulProcessor):
    """The first poll that finds nothing and the first that finds the transcript, whatever order they come in.

    A timer at the end of the longest wait, or at the transcript's time, tells the outcome once the watermark has passed it:
    no earlier poll can come any more.
    """

    def __init__(self, most_minutes: int):
        self.most = most_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "waited long, ready long, told boolean")

    def _due(self, waited: int | None, ready: int | None) -> tuple[int, str]:
        """Microseconds and outcome."""
        end = None if waited is None else waited + self.most
        return (ready, "ready") if ready is not None and (end is None or ready < end) else (end, "held")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waited, ready, told = self.seen.get() if self.seen.exists() else (None, None, False)
        for frame in rows:
            us = frame["at"].astype("datetime64[us, UTC]" if frame["at"].dt.tz is not None else "datetime64[us]").astype("int64")
            for found, first in ((False, us[~frame["ready"]].min()), (True, us[frame["ready"]].min())):
                if not pd.isna(first):
                    waited, ready = (waited, min(int(first), ready if ready is not None else int(first))) if found else (min(int(first), waited if waited is not None else int(first)), ready)
        self.seen.update((waited, ready, told))
        if not told:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-self._due(waited, ready)[0] // 1000))
        yield pd.DataFrame(columns=["call_id", "state", "at_us"], dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waited, ready, told = self.seen.get()
        at, state = self._due(waited, ready)
        self.seen.update((waited, ready, True))
        yield pd.DataFrame([] if told else [(key[0], state, at)], columns=["call_id", "state", "at_us"], dtype=object)

    def close(self) -> None:
        pass


def settled_waits(stream: DataFrame, most_minutes: int, late: str = "0 seconds") -> DataFrame:
    """(call_id, state, at_us): how each wait ends, `ready` or `held`, and when (microseconds); stream: call_id, at, ready.

    Polls may come in any order within the watermark. A wait that has not ended by the last watermark gives no row.
    """
    rows = stream.select("call_id", "at", "ready").withWatermark("at", late)
    return rows.groupBy("call_id").transformWithStateInPandas(_Settled(most_minutes), "call_id long, state string, at_us long", "Append", "EventTime")


#: Arbitrary state with timers needs this store.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, label: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Run a stream over all there is (trigger availableNow) into a table of the shared folder and read that.

    timers: the stream has state of its own with timers, which lies in another store.
    """
    spark = stream.sparkSession
    out, marks = fresh_path(spark, label), fresh_path(spark, f"{label}-marks")
    before = spark.conf.get(PROVIDER)
    if timers:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(out)
