"""Runs of keyed events with a deadline in processing time, by several state variables and timers per key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def column_state(spark: SparkSession) -> Iterator[None]:
    """Has queries that start within keep their state in the store that several variables per key need; the
    session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Runs(StatefulProcessor):
    """One run per key at a time.

    State: the running ``run``, how many ``events`` of each kind it had, and how the last one ``ended``, which is
    forgotten after ``keep`` seconds.  A timer stands for the deadline and goes with the run's end.
    """

    def __init__(self, key: str, ends: str, seconds: int, resumes: str | None, keep: int) -> None:
        self.key, self.ends, self.seconds, self.resumes, self.keep = key, ends, seconds, resumes, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started long, number int")
        self.events = handle.getMapState("events", "kind string", "n long")
        self.ended = handle.getValueState("ended", "number int", self.keep * 1000)

    def _over(self, key: tuple, outcome: str) -> Row:
        number = self.run.get()[1]
        total = sum(n[0] for _, n in self.events.iterator())
        self.run.clear()
        self.events.clear()
        self.ended.update((number,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return Row(**{self.key: key[0], "outcome": outcome, "run": number, "events": total})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts: dict[str, int] = {}
        for row in rows:
            counts[row.event_type] = counts.get(row.event_type, 0) + 1
        if not self.run.exists():
            number = self.ended.get()[0] if self.ended.exists() else 0
            if number and self.resumes not in counts:  # the run is over: these came late
                yield Row(**{self.key: key[0], "outcome": "late", "run": number, "events": sum(counts.values())})
                return
            now = timerValues.getCurrentProcessingTimeInMs()
            self.run.update((now, number + 1))
            self.handle.registerTimer(now + 1000 * self.seconds)
        for kind, n in counts.items():
            name = (kind or "",)
            self.events.updateValue(name, ((self.events.getValue(name)[0] if self.events.containsKey(name) else 0) + n,))
        if self.ends in counts:
            yield self._over(key, "ended")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.run.exists():
            yield self._over(key, "timeout")

    def close(self) -> None:
        pass


def tracked_runs(events: DataFrame, key: str, ends: str, seconds: int, resumes: str | None = None, keep: int = 86_400) -> DataFrame:
    """How each run of a key ended: ``key``, ``outcome`` (ended, timeout or late), ``run`` (its number), ``events``.

    ``events`` has the key and ``event_type``.  A run begins with a key's first event and ends with one of type
    ``ends``, or ``seconds`` after its beginning in processing time, with or without new events.  Later events are
    ``late`` (a row per batch that has some) until one of type ``resumes`` begins the next run, or the key has been
    forgotten, ``keep`` seconds after the end.  Start the query within ``column_state``.
    """
    kind = dict(events.dtypes)[key]
    return events.select(key, "event_type").groupBy(key).transformWithState(
        Runs(key, ends, seconds, resumes, keep), f"{key} {kind}, outcome string, run int, events long", "Append", "ProcessingTime"
    )
