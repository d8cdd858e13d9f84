"""Structured Streaming: deduplication, keyed status folds with timers, and a state table kept by foreachBatch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators.state import merged

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a query over all there is and returns what it wrote; its checkpoint makes a rerun go on where it stopped."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{path}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_latest(stream: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Runs a query that gives the rows that changed, and returns the last row of each key; a batch that is run again replaces itself."""
    spark = stream.sparkSession
    keep = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}")
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").option("basePath", f"{path}/out").parquet(f"{path}/out")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*key, "last.*")


def first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first arrival of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def health_streaks(stream: DataFrame, source: str) -> DataFrame:
    """(source, streak, n_attempts): a row each time a source's failure streak changes; rows have `at` (bigint) and `ok`.

    Attempts are folded in the order of `at` inside a micro-batch; sources come in order across batches.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("at")
        for ok in rows["ok"]:
            streak, n = (0 if ok else streak + 1), n + 1
        state.update((streak, n))
        yield pd.DataFrame({"source": [key[0]], "streak": [streak], "n_attempts": [n]})

    kind = stream.schema[source].dataType.simpleString()
    rows = stream.select(F.col(source).alias("source"), "at", "ok")
    return rows.groupBy("source").applyInPandasWithState(fold, f"source {kind}, streak long, n_attempts long", "streak long, n long", "update", GroupStateTimeout.NoTimeout)


def held_until(stream: DataFrame, key: str, minutes: int) -> DataFrame:
    """(key, outcome): rows with verdict `allow` or `reject` leave at once, deferred ones drop when their deadline passes.

    The deadline, by the clock, is fixed by the first time a key is held; later retries do not move it.
    """

    def resolve(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [group[0]], "outcome": ["expired"]})
            return
        for rows in batches:
            final = rows[rows["verdict"] != "defer"]
            if len(final):
                if state.exists:
                    state.remove()
                yield pd.DataFrame({"key": [group[0]], "outcome": ["sent" if final["verdict"].iloc[0] == "allow" else "dropped"]})
                return
        if not state.exists:
            state.update((1,))
            state.setTimeoutDuration(minutes * 60_000)

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), "verdict")
    return rows.groupBy("key").applyInPandasWithState(resolve, f"key {kind}, outcome string", "held int", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Folding(StatefulProcessor):
    """Folds each key's rows, in the order of (at, tie) within a micro-batch, into a state of named values; subclasses say how."""

    STATE = ""
    OUT: Row  # the names of the columns that go out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)

    def begin(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """The next state and the rows that go out."""
        raise NotImplementedError

    def result(self, key: tuple, state: tuple, out: list[tuple]) -> list[tuple]:
        """The rows that go out after a micro-batch, without the key."""
        return out

    def deadline(self, state: tuple) -> int:
        """When a timer is to go off for a key in this state; -1: none."""
        return -1

    def settle(self, before: int, state: tuple) -> None:
        """The key's one timer, moved only if its time has changed: every call goes to the JVM and back."""
        after = self.deadline(state)
        if before != after:
            if before >= 0:
                self.handle.deleteTimer(before)
            if after >= 0:
                self.handle.registerTimer(after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.state.get()
        state = self.begin() if kept is None else tuple(kept)
        before, out = self.deadline(state), []
        for row in sorted(rows, key=in_order):
            state, more = self.step(state, row)
            out += more
        self.state.update(state)
        self.settle(before, state)
        for values in self.result(key, state, out):
            yield self.OUT(key[0], *values)

    def close(self) -> None:
        pass


def in_order(row: Row) -> tuple:
    """The order of (at, tie), nulls last."""
    return row.at is None, row.at, row.tie is None, row.tie


class SourceHealth(Folding):
    """Streaks, attempts, incidents opened at `threshold` failures in a row, and recoveries that end them; rows have `ok`."""

    STATE = "streak bigint, attempts bigint, opened bigint, recovered bigint"
    OUT = Row("key", "consecutive_failures", "n_attempts", "opened", "recovered")
    threshold = 3

    def begin(self) -> tuple:
        return 0, 0, 0, 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        streak, attempts, opened, recovered = state
        if row.ok:
            return (0, attempts + 1, opened, recovered + (streak >= self.threshold)), []
        return (streak + 1, attempts + 1, opened + (streak + 1 == self.threshold), recovered), []

    def result(self, key: tuple, state: tuple, out: list[tuple]) -> list[tuple]:
        return [state]


#: What each event makes of each status of an outbox row; all else changes nothing.
TRANSITIONS = {("pending", "claim"): "sending", ("failed", "claim"): "sending", ("sending", "done"): "sent", ("sending", "fail"): "failed"}


class Outbox(Folding):
    """Compare-and-set transitions of an outbox row; rows have `event`."""

    STATE = "status string, n bigint"
    OUT = Row("key", "status", "n_events")

    def begin(self) -> tuple:
        return "pending", 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        return (TRANSITIONS.get((state[0], row.event), state[0]), state[1] + 1), []

    def result(self, key: tuple, state: tuple, out: list[tuple]) -> list[tuple]:
        return [state]


class Holds(Folding):
    """Deferred rows wait for a verdict up to a deadline in event time, which the first deferral fixes; rows have `verdict`.

    `at` is in milliseconds. A verdict at or after the deadline comes too late: the hold has expired, and the verdict counts for itself. A
    timer expires holds of which nothing more is heard once the watermark has passed their deadline.
    """

    STATE = "deadline bigint"
    OUT = Row("key", "at", "outcome")
    span_ms = 0

    def begin(self) -> tuple:
        return (-1,)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        deadline, out = state[0], []
        if 0 <= deadline <= row.at:
            out.append((deadline, "expired"))
            deadline = -1
        if row.verdict == "defer":
            return (row.at + self.span_ms if deadline < 0 else deadline,), out
        return (-1,), [*out, (row.at, "sent" if row.verdict == "allow" else "dropped")]

    def deadline(self, state: tuple) -> int:
        return state[0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.state.get()
        if kept is not None and kept[0] >= 0:
            self.state.clear()
            yield self.OUT(key[0], kept[0], "expired")


def _folded(rows: DataFrame, processor: StatefulProcessor, output: str, mode: str, time: str) -> DataFrame:
    """Keyed state in RocksDB, which is snapshotted to the checkpoint: it outlives executors and restarts."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=f"key {kind}, {output}", outputMode=mode, timeMode=time)


def source_health(stream: DataFrame) -> DataFrame:
    """`stream`: key, at, tie, ok. (key, consecutive_failures, n_attempts, opened, recovered) each time a source is heard of."""
    return _folded(stream, SourceHealth(), "consecutive_failures bigint, n_attempts bigint, opened bigint, recovered bigint", "Update", "None")


def outbox(stream: DataFrame) -> DataFrame:
    """`stream`: key, at, tie, event (claim, done, fail or another). (key, status, n_events) each time a row is heard of."""
    return _folded(stream, Outbox(), "status string, n_events bigint", "Update", "None")


def holds(stream: DataFrame, span_ms: int, event_time: str, delay: str) -> DataFrame:
    """`stream`: key, at (milliseconds), tie, verdict and the timestamp `event_time`. (key, at, outcome) of every hold and verdict once."""
    processor = Holds()
    processor.span_ms = span_ms
    return _folded(stream.withWatermark(event_time, delay), processor, "at bigint, outcome string", "Append", "EventTime")


def canary(spark: SparkSession, path: str, dry: bool) -> str:
    """sent, dry_run or already_sent: the mark, a file that only one caller can create, is made before the message counts as sent."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/canary-sent")
    fs = mark.getFileSystem(conf)
    if fs.exists(mark):
        return "already_sent"
    if dry:
        return "dry_run"
    return "sent" if fs.createNewFile(mark) else "already_sent"


class StateTable:
    """A keyed table kept as versions of Parquet; a stream's batch folded in twice, under the same id, changes nothing.

    A version is `path`/v<n>/data and, written after it, `path`/v<n>/done, which says what batches it holds. A version without a whole
    `done` does not count, so a crash leaves the one before, and a table opened again on the same path goes on from the last.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], latest: list[str], least: list[str], most: list[str], order: list[str]):
        self.spark, self.path, self.schema = spark, path, schema
        self.how = {"key": key, "latest": latest, "least": least, "most": most, "order": order}
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(path).getFileSystem(conf)
        self.version = max((n for n in self._numbers() if self._fs.exists(self._at(f"{path}/v{n}/done/_SUCCESS"))), default=0)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]

    def read(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}/data")

    def done(self) -> dict[str, int]:
        """The last batch of each stream that the table holds."""
        if not self.version:
            return {}
        return {r["stream"]: r["batch"] for r in self.spark.read.schema("stream string, batch bigint").json(f"{self.path}/v{self.version}/done").collect()}

    def fold(self, batch: DataFrame, batch_id: int, stream: str = "") -> None:
        done = self.done()
        if batch_id <= done.get(stream, -1):
            return
        target, old = f"{self.path}/v{self.version + 1}", self.read()
        merged(old, batch, **self.how).select(*old.columns).write.mode("overwrite").parquet(f"{target}/data")
        rows = list((done | {stream: batch_id}).items())
        self.spark.createDataFrame(rows, "stream string, batch bigint").coalesce(1).write.mode("overwrite").json(f"{target}/done")
        self.version += 1
        for n in self._numbers():
            if n < self.version - 1:
                self._fs.delete(self._at(f"{self.path}/v{n}"), True)

    def follow(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        query = stream.writeStream.foreachBatch(lambda df, i: self.fold(df, i, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.start().awaitTermination()
        return self.read()
