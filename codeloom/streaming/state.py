"""Keyed state for the streaming operators, on transformWithState (it needs the RocksDB state store; see `use_rocksdb`).

Rows of a key may come in any order. `InOrder` holds them in a list state until the watermark has
passed them, then hands them on by time and id, so that a stream decides as its batch twin does, whatever
the micro-batches were. A row that comes after the watermark has passed its time is dropped by Spark.
State ends by event-time timers: a key that has nothing pending and whose decisions no longer
depend on what is kept is cleared.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Subclasses say what they keep (`kept`), how rows in order change it (`advance`) and until when it matters (`needed_until`).

    Rows: key columns, ms, event_id, amount. Output: the key columns, then `columns`.
    """

    kept = "x long"
    columns: list[str] = []

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms long, event_id long, amount double")
        self.due = handle.getValueState("due", "ms long")
        self.open()

    def open(self) -> None:
        self.value = self.handle.getValueState("value", self.kept)

    def clear(self) -> None:
        self.value.clear()

    def advance(self, rows: list[tuple]) -> Iterator[tuple]:
        raise NotImplementedError

    def needed_until(self) -> int | None:
        """Event time (ms) after which what is kept no longer matters; None if nothing is kept."""
        raise NotImplementedError

    def closing(self) -> Iterator[tuple]:
        """Rows to put out when a key's state ends."""
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.pending.appendList([(int(a), int(b), float(c)) for a, b, c in zip(pdf["ms"], pdf["event_id"], pdf["amount"])])
        yield from self._passed(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield from self._passed(key, timerValues)

    def close(self) -> None:
        pass

    def _passed(self, key, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        ready, rest = sorted(r for r in waiting if r[0] < now), [r for r in waiting if r[0] >= now]
        out = []
        if ready:
            self.pending.put(rest) if rest else self.pending.clear()
            out = list(self.advance(ready))
        until = self.needed_until()
        if not rest and until is not None and until < now:
            out += self.closing()
            self.clear()
            until = None
        wake = max([r[0] for r in rest] + [until] * (until is not None), default=None)
        if wake is not None and (not self.due.exists() or self.due.get()[0] < wake):
            self.handle.registerTimer(wake + 1)
            self.due.update((wake,))
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=[*self.keys, *self.columns])


class RateLimit(InOrder):
    """T1. A list state of the window's times: new ones are appended; it is written anew only once most of it has left the window."""

    columns = ["event_id", "in_window", "ok", "remaining", "retry_after_ms"]

    def __init__(self, keys: list[str], limit: int, window_ms: int):
        super().__init__(keys)
        self.limit, self.window = limit, window_ms

    def open(self) -> None:
        self.seen = self.handle.getListState("seen", "ms long")

    def clear(self) -> None:
        self.seen.clear()

    def advance(self, rows: list[tuple]) -> Iterator[tuple]:
        seen = [r[0] for r in self.seen.get()] if self.seen.exists() else []
        held, first = len(seen), 0
        for ms, event_id, _ in rows:
            seen.append(ms)
            first = bisect_right(seen, ms - self.window, lo=first)
            n = len(seen) - first
            yield event_id, n, n <= self.limit, max(0, self.limit - n), seen[first] + self.window - ms if n > self.limit else 0
        if 2 * first > len(seen):
            self.seen.put([(x,) for x in seen[first:]])
        else:
            self.seen.appendList([(x,) for x in seen[held:]])
        self.last = seen[-1]

    def needed_until(self) -> int | None:
        if not self.seen.exists():
            return None
        return max(r[0] for r in self.seen.get()) + self.window


class Cooldown(InOrder):
    """T4. The time of the last alert sent."""

    kept, columns = "last long", ["event_id", "sent"]

    def __init__(self, keys: list[str], cooldown_ms: int):
        super().__init__(keys)
        self.cooldown = cooldown_ms

    def advance(self, rows: list[tuple]) -> Iterator[tuple]:
        last = self.value.get()[0] if self.value.exists() else None
        for ms, event_id, _ in rows:
            fire = last is None or ms - last >= self.cooldown
            last = ms if fire else last
            yield event_id, fire
        self.value.update((last,))

    def needed_until(self) -> int | None:
        return self.value.get()[0] + self.cooldown if self.value.exists() else None


class DayTotal(InOrder):
    """T3, T5. What a day has used so far; the day closes once the watermark is past it."""

    kept = "day long, used double"

    def used(self) -> float:
        return self.value.get()[1] if self.value.exists() else 0.0

    def needed_until(self) -> int | None:
        return (self.value.get()[0] + 1) * DAY_MS if self.value.exists() else None


class DayQuota(DayTotal):
    columns = ["event_id", "used_before", "allowed"]

    def __init__(self, keys: list[str], limit: float):
        super().__init__(keys)
        self.limit = limit

    def advance(self, rows: list[tuple]) -> Iterator[tuple]:
        used = self.used()
        for _, event_id, amount in rows:
            yield event_id, used, used < self.limit
            used += amount
        self.value.update((rows[0][0] // DAY_MS, used))


class DayAlerts(DayTotal):
    columns = ["event_id", "running", "level"]

    def __init__(self, keys: list[str], cap: float):
        super().__init__(keys)
        self.cap = cap

    def level(self, spent: float) -> str:
        return "critical" if spent >= self.cap else "warn" if spent >= 0.8 * self.cap else "ok"

    def advance(self, rows: list[tuple]) -> Iterator[tuple]:
        used = self.used()
        for _, event_id, amount in rows:
            before, used = self.level(used), used + amount
            if self.level(used) not in ("ok", before):
                yield event_id, used, self.level(used)
        self.value.update((rows[0][0] // DAY_MS, used))

    def closing(self) -> Iterator[tuple]:
        yield None, self.used(), "closed"


class Feed(StatefulProcessor):
    """T6. The last snapshot of a key; with a time to live, idle keys are forgotten. A snapshot that isn't after the last one is dropped."""

    def __init__(self, terminal: tuple[str, ...], idle_ms: int | None):
        self.terminal, self.idle_ms = terminal, idle_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long, snapshot string, ended boolean", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, shown, ended = self.last.get() if self.last.exists() else (None, None, False)
        out = []
        for seq, status, snapshot in sorted((r for pdf in rows for r in zip(pdf["seq"], pdf["status"], pdf["snapshot"])), key=lambda r: r[0]):
            if ended or at is not None and seq <= at:
                continue
            if at is None or snapshot != shown:
                out.append((*key, int(seq), status, snapshot))
            at, shown, ended = int(seq), snapshot, status in self.terminal
        if at is not None:
            self.last.update((at, shown, ended))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "status", "snapshot"])

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: InOrder, out: str, watermark: str) -> DataFrame:
    """rows: the processor's keys, ts, event_id, amount; `out` is the schema of its own columns."""
    held = rows.withWatermark("ts", watermark).selectExpr(*processor.keys, "ts", "unix_millis(ts) AS ms", "event_id", "CAST(amount AS double) AS amount")
    keys = ", ".join(f"{k} {held.schema[k].dataType.simpleString()}" for k in processor.keys)
    return held.groupBy(*processor.keys).transformWithStateInPandas(processor, f"{keys}, {out}", "append", "eventTime")
