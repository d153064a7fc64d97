"""The daily flow run continuously: first sightings, freshness, verdicts and counts over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postsieve.operators.dedup import is_fresh


def first_seen(stream: DataFrame, key: str, ts: str = "ts", days: int = 5) -> DataFrame:
    """The first row of each key within ``days``; state of older keys is dropped by the watermark."""
    return stream.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([key])


def split_fresh_to(as_of: datetime, hours: int, trusted: Sequence[str], fresh_path: str, stale_path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: fresh and stale rows to their own tables.  A batch has its own folder, so a repeated batch writes the same files again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("__f", is_fresh(as_of, hours, trusted)).persist()
        try:
            marked.where("__f").drop("__f").write.mode("overwrite").parquet(f"{fresh_path}/batch={batch_id}")
            marked.where("not __f").drop("__f").write.mode("overwrite").parquet(f"{stale_path}/batch={batch_id}")
        finally:
            marked.unpersist()

    return write


def stage_counts(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), "stage", "verdict").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("date").alias("day"), "stage", "verdict", "n")


def usage_windows(stream: DataFrame, ts: str = "ts", window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    sums = stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide), F.coalesce("purpose", F.lit("other")).alias("purpose")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))
    return sums.select(F.col("window.start").alias("start"), "purpose", "calls", "input_tokens")


class VerdictProcessor(StatefulProcessor):
    """What is known of a key: a yes or a no with its time, each with a lifetime of its own.

    On the event clock a timer takes the verdict away when the watermark passes its end; on the processing clock the state store does, by its native time to live.
    """

    def __init__(self, positive_days: float, negative_days: float, on_event_clock: bool):
        self.lifetimes = {True: int(positive_days * 86_400_000_000), False: int(negative_days * 86_400_000_000)}  # microseconds
        self.on_event_clock = on_event_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = {verified: handle.getValueState("yes" if verified else "no", "since long", None if self.on_event_clock else us // 1000) for verified, us in self.lifetimes.items()}

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        given = pd.concat([frame[["verified", "ts"]] for frame in rows])
        times = given["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        order = np.lexsort((given["verified"].to_numpy(bool), times))
        verified, times = given["verified"].to_numpy(bool)[order], times[order]
        turns = np.append(np.flatnonzero(np.diff(verified)) + 1, len(times))  # where a verdict other than the one before begins
        held = next((v for v, state in self.known.items() if state.exists()), None)
        before = None if held is None else (held, self.known[held].get()[0])
        changes, at = [], 0
        if before is not None:
            at = self._next(before, verified, times, turns, 0)
        while at < len(times):  # once a change, not once a row
            changes.append(at)
            at = self._next((bool(verified[at]), int(times[at])), verified, times, turns, at + 1)
        if changes:
            last, since = bool(verified[changes[-1]]), int(times[changes[-1]])
            self._keep(last, since, timerValues)
            picked = given.iloc[order[changes]]
            yield pd.DataFrame({"key": key[0], "verified": picked["verified"].to_numpy(bool), "ts": picked["ts"].to_numpy()})

    def _next(self, known: tuple[bool, int], verified, times, turns, start: int) -> int:
        """The first row from ``start`` on that differs from the verdict, or comes when its time is over."""
        if start >= len(times):
            return len(times)
        differs = start if bool(verified[start]) != known[0] else int(turns[turns.searchsorted(start, "right")])
        return min(differs, max(start, int(times.searchsorted(known[1] + self.lifetimes[known[0]]))))

    def _keep(self, verified: bool, since: int, timer_values) -> None:
        self.known[not verified].clear()
        self.known[verified].update((since,))
        if self.on_event_clock:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((since + self.lifetimes[verified]) // 1000, timer_values.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        for state in self.known.values():
            state.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "verified": pd.Series([], dtype=bool), "ts": pd.Series([], dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


@contextmanager
def state_with_lifetimes(spark: SparkSession) -> Iterator[None]:
    """Streams started within use the RocksDB state store, which ``verdict_ttl`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def verdict_ttl(stream: DataFrame, key: str = "company_key", positive_days: float = 30, negative_days: float = 7, late: str = "1 day", clock: str = "event") -> DataFrame:
    """The verdicts that change what is known of a key: (key, verified, ts) for a first verdict, a changed one, or one when the last is ``positive_days`` or ``negative_days`` old.

    Verdicts of one batch are taken in the order of time, a no before a yes; a repeated one renews nothing.  With ``clock="processing"`` lifetimes between batches are those of
    the state store's own clock, and the query runs until it is stopped, by a trigger of intervals or once.  Start it within ``state_with_lifetimes``.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock is event or processing")
    rows = stream.select(F.col(key).cast("string").alias("key"), "verified", "ts").where("verified is not null and ts is not null").withWatermark("ts", late)
    mode = "EventTime" if clock == "event" else "ProcessingTime"
    changes = rows.groupBy("key").transformWithStateInPandas(VerdictProcessor(positive_days, negative_days, clock == "event"), "key string, verified boolean, ts timestamp", "append", mode)
    return changes.withColumnRenamed("key", key)
