"""Progress that is saved at most once an interval, by a timer that starts with the first save and is not put off by later ones."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where state with timers is kept.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Coalescer(StatefulProcessor):
    """Per key: the rows that wait (list state), each as its microsecond and the row in JSON, and one timer, at the first of
    them plus the interval. When the watermark has passed it no row before it can still come: the latest of those is given out,
    what lies behind starts a timer of its own. Rows may come in any order within the watermark's delay."""

    def __init__(self, interval_us: int):
        self.interval = interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row string")

    def _due(self, rows: list[tuple[int, str]]) -> int:
        """The millisecond at which the first interval is over."""
        return -(-(min(at for at, _ in rows) + self.interval) // 1000)

    def _time(self, rows: list[tuple[int, str]]) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if rows:
            self.handle.registerTimer(self._due(rows))

    def _held(self) -> list[tuple[int, str]]:
        return [(x[0], x[1]) for x in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["_at"], r["_row"]) for r in rows]
        first = not self.waiting.exists()
        self.waiting.appendList(new)
        timers, due = [] if first else list(self.handle.listTimers()), self._due(new)
        if not first and not timers:
            due = self._due(self._held())
        if not timers or due < min(timers):  # what waited before is due later: it need not be read
            for x in timers:
                self.handle.deleteTimer(x)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows, now = sorted(self._held()), timerValues.getCurrentWatermarkInMs()
        while rows and self._due(rows) <= now:
            end = rows[0][0] + self.interval
            saved = [x for x in rows if x[0] < end]
            rows = rows[len(saved) :]
            yield Row(_key=key[0], since=datetime.fromtimestamp(saved[0][0] / 1e6, timezone.utc), _row=saved[-1][1])
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()
        self._time(rows)

    def close(self) -> None:
        pass


def with_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def coalesced_by_timer(rows: DataFrame, keys: list[str], time: str = "ts", seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """keys, since (the first save of an interval) and the latest row of each interval of each key. Call with_timers first."""
    rest = [c for c in rows.columns if c not in keys]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    marked = rows.withWatermark(time, delay).withColumn("_key", F.to_json(F.struct(*keys))).withColumn("_at", F.unix_micros(time)).withColumn("_row", F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))
    out = marked.select("_key", "_at", "_row", time).groupBy("_key").transformWithState(Coalescer(seconds * 1_000_000), "_key string, since timestamp, _row string", "Append", "EventTime")
    read = out.select("since", F.from_json("_row", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r"))
    return read.select(*(F.col(f"r.{k}").alias(k) for k in keys), "since", *(F.col(f"r.{c}").alias(c) for c in rest))
