"""The work queue as streams: events in, queue rows out, equal to the batch fold at every point; and retries, put back when their delay is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.queue import DRAWS, KEY, last_write, state

EVENTS = "ordinal long, ts double, event string, subject string, hop int, parent_subject string, parent_hop int"
RETRIES = "subject string, hop int, retry int, failed_at double, due_at double, outcome string"


def events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """files: of a micro-batch, at most."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def queue_rows(stream: DataFrame, **retry) -> DataFrame:
    """The batch fold is one aggregation by key, so the engine keeps its partial results as state; output in update mode.
    Rows of a key come in any order: every part of the fold goes by ordinal."""
    return state(stream, **retry)


def start(rows: DataFrame, checkpoint: str, path: str, mode: str = "update"):
    """Each micro-batch writes the rows that it changed into a folder of its own, which a repeat writes over; nothing goes to the driver."""

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The queue rows that a stream has written, each as its last micro-batch left it."""
    return last_write(spark.read.parquet(path).withColumnRenamed("batch", "ordinal"), *KEY).drop("ordinal")


class Retries(StatefulProcessor):
    """One row's errors: their number, and a timer for the retry that waits. The next event of the row supersedes a retry that was not due before it."""

    def __init__(self, max_retries: int, base: float, backoff: float, cap: float, jitter: float):
        self.most, self.base, self.backoff, self.cap, self.jitter = max_retries, base, backoff, cap, jitter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.errors = handle.getValueState("errors", "n int")
        self.waiting = handle.getValueState("waiting", "retry int, failed_at double, due_at double")

    def delay(self, key: tuple, retry: int) -> float:
        raw = max(0.0, self.base) * max(1.0, self.backoff) ** max(retry - 1, 0)
        raw = min(raw, self.cap) if self.cap > 0 else raw
        if self.jitter > 0:
            h = xxhash.xxh64(f"{key[0]}:{key[1]}:{retry}".encode(), seed=42).intdigest()
            h -= (h >> 63) << 64  # as the engine's signed hash
            raw = max(raw * (1 + self.jitter * (h % DRAWS / (DRAWS / 2) - 1)), 0.0)
            raw = min(raw, self.cap) if self.cap > 0 else raw
        return raw

    def _out(self, key: tuple, told: list[tuple]) -> Iterator[pd.DataFrame]:
        if told:
            yield pd.DataFrame([(*key, *t) for t in told], columns=["subject", "hop", "retry", "failed_at", "due_at", "outcome"]).astype({"hop": "int32", "retry": "int32"})

    def _cancelled(self) -> None:
        self.waiting.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = []
        for row in pd.concat(list(rows)).sort_values("ordinal").itertuples():
            if self.waiting.exists():
                retry, failed, due = self.waiting.get()
                told.append((retry, failed, due, "superseded" if row.ts <= due else "retry"))
                self._cancelled()
            if row.event == "error":
                n = (self.errors.get()[0] if self.errors.exists() else 0) + 1
                self.errors.update((n,))
                if n < self.most:
                    due = row.ts + self.delay(key, n)
                    self.waiting.update((n, float(row.ts), float(due)))
                    self.handle.registerTimer(int(due * 1000) + 1)
                elif n == self.most:
                    told.append((n, row.ts, None, "failed"))
        yield from self._out(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            retry, failed, due = self.waiting.get()
            self.waiting.clear()
            yield from self._out(key, [(retry, failed, due, "retry")])

    def close(self) -> None:
        pass


def retry_rows(stream: DataFrame, max_retries: int = 3, base: float = 5.0, backoff: float = 2.0, cap: float = 120.0, jitter: float = 0.0, wall_clock: bool = True) -> DataFrame:
    """The rows of `queue.retries`, each when it is decided: a retry when its timer expires. wall_clock: timers follow the clock; else the events' own time, by their
    watermark. Events of a row come in order, or in one micro-batch. A row is one key of state; rows of all subjects are spread by hash."""
    timed = stream.select("ordinal", "ts", "event", *KEY, F.timestamp_seconds("ts").alias("at"))
    if not wall_clock:
        timed = timed.withWatermark("at", "0 seconds")
    return timed.groupBy(*KEY).transformWithStateInPandas(Retries(max_retries, base, backoff, cap, jitter), RETRIES, "Append", "ProcessingTime" if wall_clock else "EventTime")


def start_retries(rows: DataFrame, checkpoint: str, path: str):
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
