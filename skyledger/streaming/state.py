"""Stateful processing per upload: polling time-outs and a running funnel."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyledger.operators.status import STEPS, TERMINAL, TIMEOUT_MESSAGE, step_index, time_limit
from skyledger.sources.catalog import missing_path

# Ship these classes by value: workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMEOUT_SCHEMA = "upload_id string, started bigint, status string, error string"
FUNNEL_SCHEMA = "position int, version bigint, done bigint, active bigint, pending bigint"
#: Microseconds since the epoch; stands for no time.
NEVER = 2**62


def use_state_store(spark: SparkSession) -> None:
    """State variables and timers need the RocksDB store; it counts for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per Arrow batch and upload: first write, first final write, last write."""
    for batch in batches:
        at = batch["at"]
        ended = at.where(batch["status"].isin(TERMINAL), NEVER)
        marked = pd.DataFrame({"upload_id": batch["upload_id"].astype(str), "at": at, "ended": ended})
        yield marked.groupby("upload_id", as_index=False).agg(
            started=("at", "min"), ended=("ended", "min"), seen=("at", "max")
        )


class PollWatch(StatefulProcessor):
    """One upload: ``watch`` (first write, first final write) until its limit, then ``settled`` for good or for a while.

    Only the timer decides. It goes off when the watermark passes the limit, so no write that belongs before it is missing.
    """

    def __init__(self, limit_seconds: int, retention_seconds: int | None):
        self.limit = limit_seconds * 1_000_000
        self.retention = retention_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watch = handle.getValueState("watch", "started long, ended long")
        self.settled = handle.getValueState("settled", "due long")

    def _due(self, started: int) -> int:
        """The first millisecond beyond the limit."""
        return (started + self.limit) // 1000 + 1

    def _remembered(self, timers: object) -> bool:
        """Is there an outcome? One whose retention the watermark has passed goes."""
        if not self.settled.exists():
            return False
        if self.retention is None or self.settled.get()[0] + self.retention * 1000 > timers.getCurrentWatermarkInMs():
            return True
        self.settled.clear()
        return False

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if not self._remembered(timerValues):
            started, ended = self.watch.get() if self.watch.exists() else (NEVER, NEVER)
            before = started
            for row in rows:
                started, ended = min(started, row.started), min(ended, row.ended)
            if started < before:
                if before < NEVER:
                    self.handle.deleteTimer(self._due(before))
                self.handle.registerTimer(self._due(started))
            self.watch.update((started, ended))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if not self.watch.exists():
            self._remembered(timerValues)
            return
        started, ended = self.watch.get()
        due = self._due(started)
        if due > expiredTimerInfo.getExpiryTimeInMs():
            return  # the timer of an outcome before this one
        self.watch.clear()
        self.settled.update((due,))
        if self._remembered(timerValues) and self.retention is not None:
            self.handle.registerTimer(due + self.retention * 1000)
        if ended > started + self.limit:
            yield Row(upload_id=key[0], started=started, status="error", error=TIMEOUT_MESSAGE)

    def close(self) -> None:
        pass


def poll_timeout_stream(
    events: DataFrame, limit_seconds: int = time_limit(), delay: str = "0 seconds", retention_seconds: int | None = None
) -> DataFrame:
    """Emit one error row per upload that got no final status within the limit of its first.

    An event-time timer decides when the watermark passes the limit. The id then stays in the state, one number in the
    store on disk, so that a write that comes later, however late, raises no second error. With ``retention_seconds`` a second timer
    forgets it, and a still later write counts as a new upload's first. (The store's own time to live counts the
    clock's time and can't be had together with event-time timers.) Writes are combined before the
    shuffle, so a very chatty upload sends a few rows per task. Python sees times as microseconds only, so the session
    time zone has no influence. ``events`` has ``upload_id, ts, status``; ``ts`` is a timestamp.
    """
    use_state_store(events.sparkSession)
    spans = events.select("upload_id", F.unix_micros("ts").alias("at"), "status").mapInPandas(
        _spans, "upload_id string, started bigint, ended bigint, seen bigint"
    )
    late = (
        spans.withColumn("seen", F.timestamp_micros("seen"))
        .withWatermark("seen", delay)
        .groupBy("upload_id")
        .transformWithState(PollWatch(limit_seconds, retention_seconds), TIMEOUT_SCHEMA, "append", "EventTime")
    )
    return late.withColumn("started", F.timestamp_micros("started"))


class LatestStep(StatefulProcessor):
    """One upload's latest status; tells which step it leaves (−2: none yet) and which it reaches (−1: an unknown one)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "at long, final boolean, reached int, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        old = tuple(self.latest.get()) if self.latest.exists() else None
        new = max(((r.at, r.final, r.reached, r.status) for r in rows), key=_order)
        if old is None or _order(new) > _order(old):
            self.latest.update(new)
            before = -2 if old is None else old[2]
            if before != new[2]:
                yield Row(before=before, after=new[2])

    def close(self) -> None:
        pass


def _order(latest: tuple) -> tuple:
    """As the columns' order has it: a missing value comes first."""
    return tuple((v is not None, v if v is not None else 0) for v in latest)


class StepCount(StatefulProcessor):
    """Running numbers of one step; ``version`` counts its changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "version long, done long, active long, pending long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        version, *counts = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        for row in rows:
            counts = [a + b for a, b in zip(counts, (row.done, row.active, row.pending))]
        self.counts.update((version + 1, *counts))
        yield Row(position=key[0], version=version + 1, done=counts[0], active=counts[1], pending=counts[2])

    def close(self) -> None:
        pass


def _moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per Arrow batch: what uploads that change steps add to and take from the numbers of each step; seven rows at most."""
    for batch in batches:
        pairs = batch.groupby(["before", "after"]).size()
        rows = []
        for position in range(len(STEPS)):
            done = active = pending = 0
            for (before, after), n in pairs.items():
                gone = before > -2
                done += int(n) * (int(after > position) - (gone and before > position))
                active += int(n) * (int(after == position) - (gone and before == position))
                pending += int(n) * (int(after < position) - (gone and before < position))
            if done or active or pending:
                rows.append((position, done, active, pending))
        yield pd.DataFrame(rows, columns=["position", "done", "active", "pending"])


def step_funnel_stream(events: DataFrame) -> DataFrame:
    """Changes of the funnel while statuses arrive: the numbers of a step each time they change.

    The latest status of each upload is state; when it moves on, the old step's numbers are taken back and the new
    one's added. Moves are summed in each task before they meet the seven states of the steps. ``read_funnel`` gives the
    present numbers. ``events`` has ``upload_id, ts, step, status``.
    """
    use_state_store(events.sparkSession)
    written = events.select(
        F.col("upload_id").cast("string").alias("upload_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("status").isin(*TERMINAL).alias("final"),
        step_index(F.col("step")).alias("reached"), F.col("status").cast("string").alias("status"),
    )
    moved = written.groupBy("upload_id").transformWithState(LatestStep(), "before int, after int", "append", "None")
    summed = moved.mapInPandas(_moves, "position int, done bigint, active bigint, pending bigint")
    return summed.groupBy("position").transformWithState(StepCount(), FUNNEL_SCHEMA, "append", "None")


def read_funnel(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of every step from the log of changes; zeros before the first."""
    try:
        log = spark.read.schema(FUNNEL_SCHEMA).parquet(path)
    except AnalysisException as error:
        if not missing_path(error):
            raise
        log = spark.createDataFrame([], FUNNEL_SCHEMA)
    last = log.groupBy("position").agg(F.max(F.struct("version", "done", "active", "pending")).alias("last"))
    steps = spark.createDataFrame(list(enumerate(STEPS)), "position int, step string")
    zero = F.lit(0).cast("bigint")
    return steps.join(last, "position", "left").select(
        "position", "step", *[F.coalesce(f"last.{c}", zero).alias(c) for c in ("done", "active", "pending")]
    )
