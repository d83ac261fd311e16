"""Streaming operators (T1-T9), each with a batch twin over the same rows.

Rate limit, alerts, cooldown, quota and change feed keep state by key (state.py); spend, rates and quantiles are
windowed aggregates under a watermark. State is bounded: the rate limit keeps a window's timestamps, the
others one value a key, and rows wait in it until the watermark has passed them. Event-time timers close days and
clear idle keys; the change feed's keys can have a time to live.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.sinks import VersionedTable, upsert
from codeloom.streaming import state

TERMINAL = ("ready", "failed")
GROUP_ROWS = 10_000
BUCKETS_MS = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 20000)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def rate_limit(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """T1, batch: adds in_window, ok, remaining, retry_after_ms to (key, event_id, ts). Blocked events count too.

    A range frame takes in all events of the same millisecond; those with a later id are taken off.
    """
    w_ms = window_s * 1000
    rows = events.withColumn("_ms", millis(F.col("ts")))
    span = Window.partitionBy("key").orderBy("_ms").rangeBetween(-(w_ms - 1), 0)
    peers = Window.partitionBy("key", "_ms").orderBy(F.desc("event_id"))
    rows = rows.withColumn("in_window", F.count(F.lit(1)).over(span) - (F.row_number().over(peers) - 1)).withColumn("_first", F.min("_ms").over(span))
    return rows.select(*events.columns, F.col("in_window").cast("long").alias("in_window"), (F.col("in_window") <= limit).alias("ok"), F.greatest(F.lit(limit) - F.col("in_window"), F.lit(0)).cast("long").alias("remaining"), F.when(F.col("in_window") > limit, F.col("_first") + w_ms - F.col("_ms")).otherwise(0).cast("long").alias("retry_after_ms"))


def rate_limit_stream(events: DataFrame, limit: int, window_s: int, watermark: str = "0 seconds") -> DataFrame:
    """T1, stream: (key, event_id, in_window, ok, remaining, retry_after_ms), once the watermark has passed an event."""
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.lit(0.0).alias("amount"))
    return state.in_order(rows, state.RateLimit(["key"], limit, window_s * 1000), "event_id long, in_window long, ok boolean, remaining long, retry_after_ms long", watermark)


def daily_spend(costs: DataFrame, watermark: str | None = None) -> DataFrame:
    """(day, spend) of calls without an own key; with a watermark ("48 hours") for streams."""
    rows = costs.filter(~F.coalesce("own_key", F.lit(False))).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    return rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("amount").alias("spend")).select(F.to_date("w.start").alias("day"), "spend")


def spend_alerts(costs: DataFrame, cap: float) -> DataFrame:
    """Adds running, level (ok, warn from 80 %, critical from 100 %) and is_first_crossing within the day.

    A day's sum runs within its minutes; a minute starts from the sums of the minutes before it, so
    that a busy day isn't one task.
    """
    rows = costs.filter(~F.coalesce("own_key", F.lit(False))).withColumn("day", F.to_date("ts")).withColumn("_minute", F.date_trunc("minute", "ts"))
    sums = rows.groupBy(F.col("_minute").alias("_m")).agg(F.sum("amount").alias("_sum"))
    past = Window.partitionBy(F.to_date("_m")).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_m", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_start"))
    w = Window.partitionBy("_minute").orderBy("ts", "event_id")
    before = F.col("_start") + F.coalesce(F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = lambda spent: F.when(spent >= cap, "critical").when(spent >= 0.8 * cap, "warn").otherwise("ok")
    placed = rows.join(starts, F.col("_minute").eqNullSafe(F.col("_m"))).withColumn("_before", before).withColumn("running", F.col("_before") + F.coalesce("amount", F.lit(0)))
    placed = placed.withColumn("level", level(F.col("running")))
    crossing = (F.col("level") != "ok") & (F.col("level") != level(F.col("_before")))
    return placed.withColumn("is_first_crossing", crossing).drop("_minute", "_m", "_start", "_before")


def spend_alerts_stream(costs: DataFrame, cap: float, watermark: str = "48 hours") -> DataFrame:
    """T3, stream: (day, event_id, running, level) of each first crossing, and a row of level closed with the day's sum once the day is over.

    A day is one key: its sum decides on every cost, in order.
    """
    rows = costs.filter(~F.coalesce("own_key", F.lit(False))).select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.coalesce("amount", F.lit(0.0)).alias("amount")).withColumn("day", F.to_date("ts"))
    return state.in_order(rows, state.DayAlerts(["day"], cap), "event_id long, running double, level string", watermark)


def _cooldown(cooldown_ms: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ms", "event_id"])
        sent, last = [], None
        for ms in pdf["ms"]:
            fire = last is None or ms - last >= cooldown_ms
            last = ms if fire else last
            sent.append(fire)
        return pdf.assign(sent=sent)[["key", "event_id", "sent"]]

    return run


def alert_cooldown(events: DataFrame, cooldown_s: int) -> DataFrame:
    """T4, batch: (key, event_id, sent); the cooldown restarts at the last alert sent.

    After a pause of a cooldown the next alert is sent whatever came before, so a key's alerts can be cut
    there: groups hold the bursts that start within GROUP_ROWS alerts. Pauses are looked for between
    cells one cooldown wide, which hold none: the window sees a row a cell, not an alert.
    """
    cooldown_ms = max(1, cooldown_s * 1000)
    rows = events.select("key", "event_id", millis(F.col("ts")).alias("ms")).withColumn("cell", F.floor(F.col("ms") / cooldown_ms))
    cells = rows.groupBy(F.col("key").alias("k"), F.col("cell").alias("c")).agg(F.min("ms").alias("low"), F.max("ms").alias("high"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("k").orderBy("c")
    pause = F.col("low") - F.lag("high").over(along) >= cooldown_ms
    starts = cells.withColumn("at", F.when(pause, F.sum("n").over(along) - F.col("n")))
    groups = starts.select("k", "c", F.floor(F.coalesce(F.last("at", ignorenulls=True).over(along), F.lit(0)) / GROUP_ROWS).alias("group"))
    placed = rows.join(groups, F.col("key").eqNullSafe(F.col("k")) & F.col("cell").eqNullSafe(F.col("c"))).select("key", "event_id", "ms", "group")
    return placed.groupBy("key", "group").applyInPandas(_cooldown(cooldown_s * 1000), f"key {_kind(events, 'key')}, event_id long, sent boolean")


def alert_cooldown_stream(events: DataFrame, cooldown_s: int, watermark: str = "0 seconds") -> DataFrame:
    """T4, stream."""
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.lit(0.0).alias("amount"))
    return state.in_order(rows, state.Cooldown(["key"], cooldown_s * 1000), "event_id long, sent boolean", watermark)


def daily_quota(events: DataFrame, limit: float) -> DataFrame:
    """T5: adds day, used_before and allowed to (key, event_id, ts, amount): allowed while less than the limit was used before."""
    rows = events.withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("key", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("used_before", F.coalesce(F.sum("amount").over(w), F.lit(0.0))).withColumn("allowed", F.col("used_before") < limit)


def daily_quota_stream(events: DataFrame, limit: float, watermark: str = "1 hour") -> DataFrame:
    """T5, stream: (key, day, event_id, used_before, allowed); a key's day is forgotten once it is over."""
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id", "amount").withColumn("day", F.to_date("ts"))
    return state.in_order(rows, state.DayQuota(["key", "day"], limit), "event_id long, used_before double, allowed boolean", watermark)


def change_feed(snapshots: DataFrame) -> DataFrame:
    """T6, batch: snapshots (key, seq, status, snapshot) that differ from the one before; a key ends at its first terminal status."""
    w = Window.partitionBy("key").orderBy("seq")
    before = F.lag("snapshot").over(w)
    ended = F.max(F.col("status").isin(list(TERMINAL)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = snapshots.withColumn("_changed", F.row_number().over(w) == 1).withColumn("_changed", F.col("_changed") | ~F.col("snapshot").eqNullSafe(before)).withColumn("_ended", F.coalesce(ended, F.lit(0)))
    return rows.filter("_changed and _ended = 0").drop("_changed", "_ended")


def change_feed_stream(snapshots: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """T6, stream; with idle_ms a key that has been idle so long is forgotten."""
    rows = snapshots.select("key", "seq", "status", "snapshot")
    out = f"key {_kind(snapshots, 'key')}, seq long, status string, snapshot string"
    return rows.groupBy("key").transformWithStateInPandas(state.Feed(TERMINAL, idle_ms), out, "append", "processingTime" if idle_ms else "none")


def counter_rate(events: DataFrame, label: str, duration: str, slide: str, seconds: int, watermark: str | None = None) -> DataFrame:
    """(label, window_start, increase, rate) over sliding windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    grouped = rows.groupBy(label, F.window("ts", duration, slide).alias("w")).agg(F.sum("amount").alias("increase"))
    return grouped.select(label, F.col("w.start").alias("window_start"), "increase", (F.col("increase") / seconds).alias("rate"))


def bucket_quantiles(events: DataFrame, by: list[Column], value: str, quantiles: tuple = (0.5, 0.95, 0.99), bounds: tuple = BUCKETS_MS) -> DataFrame:
    """Quantiles from histogram buckets, linear inside a bucket; values past the last bound count as it."""
    names = [f"b{i}" for i in range(len(bounds))]
    counts = [F.count_if(F.col(value) <= b).alias(n) for n, b in zip(names, bounds)]
    hist = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
    out = hist
    for q in quantiles:
        rank = F.col("n") * q
        found = F.lit(float(bounds[-1]))
        for i in range(len(bounds) - 1, -1, -1):
            low, below = (float(bounds[i - 1]), F.col(names[i - 1])) if i else (0.0, F.lit(0))
            inside = F.col(names[i]) - below
            found = F.when(F.col(names[i]) >= rank, low + (bounds[i] - low) * F.when(inside > 0, (rank - below) / inside).otherwise(0.0)).otherwise(found)
        out = out.withColumn(f"p{round(q * 100)}", found)
    return out.drop(*names)


def upsert_stream(stream: DataFrame, key: list[str], seq: str, table: VersionedTable, checkpoint: str, event_time: str | None = None, delay: str | None = None):
    """A writer whose micro-batches are upserted (S11), each exactly once.

    A batch writes the version of its own number, from the version before it; a batch that is replayed after a crash
    finds its version there and changes nothing, or finds it unfinished and writes it again from the same base. With event_time and
    delay, rows sent again within the delay are dropped before they get here.
    """
    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([*key, seq])

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read once: what lies upstream may keep state
        try:
            if table.has(number):
                batch.count()  # the state upstream is still to be brought up to this batch
            else:
                base = table.load(before=number)
                table.save(upsert(batch.limit(0) if base is None else base, batch, key, seq), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
