"""Live confirmation: streaks, confirmations and exits from a stream of daily states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "security_id long, event string, trading_date string, start_date string, streak int"
#: Timers and typed state need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Confirmation(StatefulProcessor):
    """Steps an entity's rows in order of time, each once the watermark has passed it.

    Rows that wait stand in a list; one timer stands at the earliest of them. When it expires, all rows up to the
    watermark step, repeated times among them (true before false before unknown), and the timer moves on.
    """

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time long, state boolean")
        self.run = handle.getValueState("run", "streak int, start long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(_millis(t), None if pd.isna(s) else bool(s)) for b in rows for t, s in zip(b["event_time"], b["raw_state"])]
        if new:
            self.waiting.appendList(new)
            self._wait_for(min(t for t, _ in new))
        yield pd.DataFrame(columns=["security_id", "event", "trading_date", "start_date", "streak"])

    def _wait_for(self, first: int) -> None:
        """One timer, at the earliest row that waits."""
        standing = list(self.handle.listTimers())
        if standing and min(standing) <= first:
            return
        for other in standing:
            self.handle.deleteTimer(other)
        self.handle.registerTimer(first)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is None, not r[1]))
        streak, start = self.run.get() if self.run.exists() else (0, 0)
        out, wait = [], [(t, s) for t, s in rows if t > mark]
        for time, on in rows[: len(rows) - len(wait)]:
            if on:
                streak, start = streak + 1, start if streak else time
                if streak == self.k:
                    out.append((key[0], "confirmed", _day(time), _day(start), streak))
            else:
                if streak >= self.k:
                    out.append((key[0], "exit", _day(time), _day(start), streak))
                streak = 0
        self.run.update((streak, start))
        if wait:
            self.waiting.put(wait)
            self._wait_for(wait[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["security_id", "event", "trading_date", "start_date", "streak"])

    def close(self) -> None:
        pass


def _millis(time: pd.Timestamp) -> int:
    return int(time.value // 1_000_000)


def _day(millis: int) -> str:
    return str(pd.Timestamp(millis, unit="ms").date())


def stream_confirm(stream: DataFrame, k: int, delay: str = "3 days") -> DataFrame:
    """(security_id, event_time, raw_state) -> an event when a run reaches k rows and when a confirmed run ends.

    Rows wait until the watermark has passed them and then step in order of time, so rows that come
    out of order within the delay change nothing; later ones are dropped. On complete data the events
    equal the batch result. Every row counts, also one that repeats a time. The session needs the state store that
    ``STORE`` names.
    """
    keyed = stream.select("security_id", "event_time", "raw_state").withWatermark("event_time", delay)
    return keyed.groupBy("security_id").transformWithStateInPandas(Confirmation(k), OUTPUT, "Append", "EventTime")


def replay(states: DataFrame, folder: str, k: int, files: int = 6) -> DataFrame:
    """Write daily states as files in order of time, run them through the stream, and read what it wrote.

    A last file far ahead in time moves the watermark past all rows.
    """
    spark = states.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    rows = states.select("security_id", F.col("trading_date").cast("timestamp").alias("event_time"), "raw_state")
    rows.repartitionByRange(files, "event_time").sortWithinPartitions("event_time").write.parquet(f"{folder}/in/a")
    ahead = spark.range(1).select(F.lit(-1).cast("long").alias("security_id"), F.lit("2100-01-01").cast("timestamp").alias("event_time"), F.lit(None).cast("boolean").alias("raw_state"))
    ahead.write.parquet(f"{folder}/in/b")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    events = stream_confirm(stream, k, "60 days").where("security_id >= 0")
    run = events.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out")
