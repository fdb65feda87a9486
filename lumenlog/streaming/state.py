"""Keyed state with timers and expiry: hubs at any instant, runs that go on between passes.

Both need spark.sql.streaming.stateStore.providerClass set to RocksDB's (`use_rocksdb`). Rows of a key are held until the
watermark has passed them and are then taken in the order of their times, so late rows within the watermark change
nothing that was given out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HUB_SCHEMA = "id long, micros long, session long, last long, counted boolean"
RUN_SCHEMA = "session_id long, at long, submission boolean"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    """Holds rows (micros, a, b) of a key until a timer at their time has passed, then calls step on them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, a long, b string")

    def take(self, row) -> tuple[int, int, str | None]:
        raise NotImplementedError

    def due(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        """What is given out when the watermark has come to `now`, in microseconds."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for batch in rows:
            for r in batch.itertuples(index=False):
                got = self.take(r)
                self.waiting.appendValue(got)
                timers.add(-(-got[0] // 1000))
        for t in timers:
            self.handle.registerTimer(t)
        yield from ()

    def ready(self, now: int) -> list[tuple[int, int, str | None]]:
        """Rows up to now, in order; the others go on waiting."""
        held = [tuple(x) for x in self.waiting.get()]
        now_rows = sorted((x for x in held if x[0] <= now), key=lambda x: (x[0], x[1]))
        rest = [x for x in held if x[0] > now]
        if now_rows:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        return now_rows

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.due(key, expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def close(self) -> None:
        pass


class _Hubs(_InOrder):
    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", "session long", "micros long")

    def take(self, row) -> tuple[int, int, None]:
        return int(row.micros), int(row.session), None

    def due(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        out = []
        ready = self.ready(now)
        gone = [(s[0], m[0]) for s, m in self.last.iterator() if m[0] + self.window <= now]
        events = sorted([(m, 1, s) for m, s, _ in ready] + [(m + self.window, 0, s) for s, m in gone])
        for at, told, session in events:
            held = self.last.getValue((session,)) if self.last.containsKey((session,)) else None
            if told:
                out.append((key[0], at, session, at, True))
                self.last.updateValue((session,), (at,))
                self.handle.registerTimer(-(-(at + self.window) // 1000))
            elif held and held[0] + self.window <= at:
                out.append((key[0], at, session, held[0], False))
                self.last.removeKey((session,))
        if out:
            yield pd.DataFrame(out, columns=["id", "micros", "session", "last", "counted"])


def hub_changes(told: DataFrame, days: float = 14, late: str = "10 minutes") -> DataFrame:
    """The stream of changes (id, micros, session, last, counted) of who was told what within the window: told (ts, id, session).

    A row says that from micros on, that instant not included, the session counts for the id, or from micros on it doesn't
    any more. The state of an id is its sessions within the window; each goes by its own timer.
    """
    window = int(days * 86_400_000_000)
    rows = told.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return rows.groupBy("id").transformWithStateInPandas(_Hubs(window), HUB_SCHEMA, "Append", "EventTime")


def hubs_at(changes: DataFrame, now: Column | int, most: int, session: object = None) -> DataFrame:
    """(id, sessions) from the table of changes: ids that at least `most` (other) sessions count for at the instant `now`."""
    now = F.lit(now) if isinstance(now, int) else now
    known = changes.where((F.col("micros") < now) | ((F.col("micros") == now) & ~F.col("counted")))
    newest = known.withColumn("nth", F.row_number().over(Window.partitionBy("id", "session").orderBy(F.desc("micros"), F.desc("counted")))).where("nth = 1 and counted")
    if session is not None:
        newest = newest.where(F.col("session") != session)
    n = newest.groupBy("id").agg(F.count("*").alias("sessions"))
    return n.where(F.col("sessions") >= most) if most else n.where(F.lit(False))


class _Runs(_InOrder):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "micros long")

    def take(self, row) -> tuple[int, int, str]:
        return int(row.micros), int(row.at), f"{int(bool(row.image))}{row.command or ''}"

    def due(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        out = []
        last = self.last.get()[0] if self.last.exists() else None
        for micros, at, kind in self.ready(now):
            image, command, submission = kind[0] == "1", kind[1:], False
            idle = last is not None and micros - last >= self.idle
            if command == "/auto":
                last = micros
            elif idle and not command:
                last = None
            elif last is not None:
                last, submission = micros, not idle and not image
            out.append((key[0], at, submission))
        if out:
            if last is None:
                self.last.clear()
            else:
                self.last.update((last,))
            yield pd.DataFrame(out, columns=["session_id", "at", "submission"])


def run_stream(rows: DataFrame, idle: int, late: str = "10 minutes") -> DataFrame:
    """auto_runs over a stream (ts, session_id, at, command, image): whether each row was submitted by a run, which goes on between passes."""
    rows = rows.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return rows.groupBy("session_id").transformWithStateInPandas(_Runs(idle), RUN_SCHEMA, "Append", "EventTime")
