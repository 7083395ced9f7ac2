"""Streams of records and calls: first-wins by fingerprint, and rate limits, with bounded state. Extensions of the batch forms."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tesserae import vocab


def records(spark: SparkSession, folder: str, schema: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def first_wins(rows: DataFrame, at: str, delay: str = "1 hour", content: str = "code") -> DataFrame:
    """Rows whose content is new within the delay."""
    return rows.withColumn("fingerprint", F.sha2(content, 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def windowed_counts(rows: DataFrame, at: str, by: str, width: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(at, delay).groupBy(F.window(at, width, slide or width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")


class Limiter(StatefulProcessor):
    """Holds a key's calls until the watermark is past them, then admits or refuses them in order of time.

    State of a key: calls that wait (n, at), and the admitted times of the last window.
    A timer stands at the earliest call that waits, or where the last admitted time leaves
    the window; then nothing of the key is left.
    """

    def __init__(self, order: str, most: int, micros: int):
        self.order, self.most, self.micros = order, most, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"n {self.order}, at bigint")
        self.times = handle.getListState("times", "at bigint")

    def _timer(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                self.waiting.appendList(list(zip(batch["n"].tolist(), (int(t) for t in batch["micros"]), strict=True)))
                first = min(int(batch["micros"].min()), first) if first is not None else int(batch["micros"].min())
        if first is not None:
            self._timer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(at, n) for n, at in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(w for w in held if w[0] <= upto)  # later rows than these are after the watermark
        later = [(n, at) for at, n in held if at > upto]
        times = deque(t for (t,) in self.times.get()) if self.times.exists() else deque()
        ok = []
        for at, _ in ready:
            while times and at - times[0] >= self.micros:
                times.popleft()
            ok.append(len(times) < self.most)
            if ok[-1]:
                times.append(at)
        while times and upto - times[0] >= self.micros and not later:
            times.popleft()
        self.waiting.clear()
        self.times.clear()
        if later:
            self.waiting.put(later)
            self._timer(min(at for _, at in later))
        if times:
            self.times.put([(t,) for t in times])
            self._timer(times[-1] + self.micros)
        if ready:
            yield pd.DataFrame({"key": [key[0]] * len(ready), "n": [n for _, n in ready], "at": pd.to_datetime([at for at, _ in ready], unit="us", utc=True), "admitted": ok})

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, key: str, at: str, order: str, most: int = vocab.RATE_CALLS, seconds: int = vocab.RATE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """key, n (the ``order`` column), at, admitted of each call, as the batch form has them, whatever the order of arrival.

    A call is answered when the watermark, ``delay`` behind the latest call, is past it.
    Calls that come later than that are dropped and counted by Spark (numRowsDroppedByWatermark); a call
    without a time is refused at once. A key's state is what waits and its admitted times of one window.
    State with timers needs the RocksDB provider (spark.sql.streaming.stateStore.providerClass).
    """
    rows = calls.select(F.col(key).cast("string").alias("key"), F.col(order).alias("n"), F.col(at).cast("timestamp").alias("at"))
    kind = rows.schema["n"].dataType.simpleString()
    timed = rows.where("at is not null").withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    out = timed.groupBy("key").transformWithStateInPandas(Limiter(kind, most, seconds * 1_000_000), f"key string, n {kind}, at timestamp, admitted boolean", "Append", "EventTime")
    return out.unionByName(rows.where("at is null").select("key", "n", "at", F.lit(False).alias("admitted")))
