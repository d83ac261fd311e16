import datetime as dt

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.sources import sinks
from codeloom.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def events(spark, seconds, key="k"):
    return spark.createDataFrame([(key, i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "key string, event_id long, ts timestamp")


def streamed(spark, df, tmp_path, make, name):
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    return run_stream(spark, make(stream), tmp_path, name)


def run_stream(spark, out, tmp_path, name):
    path = str(tmp_path / "out" / name)
    q = out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp" / name)).option("path", path).start()
    q.awaitTermination(300)
    return spark.read.schema(out.schema).parquet(path)


def in_batches(spark, df, tmp_path, make, name, batches=4, restart_after=2):
    """Rows dealt at random to micro-batches of neighbouring times that overlap, with a restart between; a last row far off moves the watermark on."""
    rows = df.withColumn("_b", F.floor((F.row_number().over(Window.orderBy("ts")) + F.rand(3) * 20) / (df.count() / batches))).cache()
    fields = df.schema
    folder = str(tmp_path / f"in_{name}")
    numbers = sorted(r[0] for r in rows.select("_b").distinct().collect())
    for i, b in enumerate([*numbers, None]):
        part = df.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 9 days")).withColumn("event_id", F.lit(-1).cast("long")) if b is None else rows.filter(F.col("_b") == b).drop("_b").orderBy(F.rand(5))
        part.coalesce(1).write.mode("append").parquet(folder)
        if i + 1 == restart_after or b is None:
            stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(folder)
            out = run_stream(spark, make(stream), tmp_path, name)
    return out.filter("event_id <> -1 or event_id is null")


def test_rate_limit(spark, tmp_path):
    df = events(spark, [0, 1, 2, 3, 10.5, 11.5])
    batch = streams.rate_limit(df, 3, 10).orderBy("event_id").collect()
    assert [r.ok for r in batch] == [True, True, True, False, False, False]
    assert [r.in_window for r in batch] == [1, 2, 3, 4, 4, 4] and batch[3].retry_after_ms == 7000
    key = lambda rows: sorted((r.event_id, r.in_window, r.ok, r.remaining, r.retry_after_ms) for r in rows)
    assert key(in_batches(spark, df, tmp_path, lambda s: streams.rate_limit_stream(s, 3, 10, "1 minute"), "rate", 2, 1).collect()) == key(batch)


def test_same_millisecond(spark):
    assert [r.in_window for r in streams.rate_limit(events(spark, [0, 0, 0]), 2, 10).orderBy("event_id").collect()] == [1, 2, 3]


def test_cooldown_over_bursts_matches_plain_loop(spark, monkeypatch):
    import random

    monkeypatch.setattr(streams, "GROUP_ROWS", 20)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, T0 + dt.timedelta(seconds=rng.choice((1, 5)) * rng.randint(0, 900))) for i in range(500)]
    last, want = {}, {}
    for key, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = key not in last or ts - last[key] >= dt.timedelta(seconds=40)
        if want[i]:
            last[key] = ts
    found = streams.alert_cooldown(spark.createDataFrame(rows, "key string, event_id long, ts timestamp"), 40).collect()
    assert {r.event_id: r.sent for r in found} == want and len(found) == 500 and 50 < sum(want.values()) < 300


def test_cooldown(spark, tmp_path):
    df = events(spark, [m * 60 for m in (0, 30, 61, 90, 122)])
    batch = {r.event_id: r.sent for r in streams.alert_cooldown(df, 3600).collect()}
    assert [i for i, sent in batch.items() if sent] == [0, 2, 4]
    assert {r.event_id: r.sent for r in in_batches(spark, df, tmp_path, lambda s: streams.alert_cooldown_stream(s, 3600, "1 day"), "cool", 2, 1).collect()} == batch


def test_change_feed(spark, tmp_path):
    shots = [("A", "x"), ("A", "x"), ("B", "x"), ("B", "x"), ("A", "x"), ("R", "ready"), ("C", "x")]
    df = spark.createDataFrame([("w", i, s, v) for i, (v, s) in enumerate(shots)], "key string, seq long, status string, snapshot string")
    batch = [r.snapshot for r in streams.change_feed(df).orderBy("seq").collect()]
    assert batch == ["A", "B", "A", "R"]
    assert [r.snapshot for r in streamed(spark, df, tmp_path, streams.change_feed_stream, "feed").orderBy("seq").collect()] == batch


def test_spend(spark, tmp_path):
    rows = [(1, T0, 2.3, False), (2, T0 + dt.timedelta(hours=1), 0.2, None), (3, T0 + dt.timedelta(hours=2), 0.6, False), (4, T0 + dt.timedelta(hours=3), 5.0, True), (5, T0 + dt.timedelta(hours=25), 1.0, False), (6, T0 + dt.timedelta(days=9), 0.0, False)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, amount double, own_key boolean")
    assert [(r.level, r.is_first_crossing) for r in streams.spend_alerts(df, 3.0).orderBy("event_id").collect()][:3] == [("ok", False), ("warn", True), ("critical", True)]
    batch = {r.day: round(r.spend, 6) for r in streams.daily_spend(df).collect()}
    assert batch[T0.date()] == 3.1
    got = streamed(spark, df, tmp_path, lambda s: streams.daily_spend(s, "48 hours"), "spend").collect()
    assert {r.day: round(r.spend, 6) for r in got} == {d: v for d, v in batch.items() if d < dt.date(2024, 1, 9)}


def test_quota_rate_and_quantiles(spark):
    df = events(spark, [0, 10, 20]).withColumn("amount", F.lit(2.0))
    assert [r.allowed for r in streams.daily_quota(df, 4).orderBy("event_id").collect()] == [True, True, False]
    assert {r.increase for r in streams.counter_rate(df, "key", "1 minute", "1 minute", 60).collect()} == {6.0}
    r = streams.bucket_quantiles(spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double"), [F.lit(1).alias("g")], "v").first()
    assert (r.p50, r.p95) == (50.0, 95.0)


def random_events(spark, n=300):
    import random

    rng = random.Random(8)
    rows = [(rng.choice("abc"), i, T0 + dt.timedelta(seconds=rng.randrange(3 * 86400), milliseconds=rng.randrange(3)), float(rng.randrange(1, 9)), rng.random() < 0.1) for i in range(n)]
    return spark.createDataFrame(rows, "key string, event_id long, ts timestamp, amount double, own_key boolean")


def test_streams_equal_batch_on_shuffled_micro_batches(spark, tmp_path):
    df = random_events(spark)
    rate = lambda rows: sorted((r.event_id, r.in_window, r.ok, r.remaining, r.retry_after_ms) for r in rows)
    assert rate(in_batches(spark, df, tmp_path, lambda s: streams.rate_limit_stream(s, 5, 7200, "1 day"), "rate").collect()) == rate(streams.rate_limit(df, 5, 7200).collect())
    cool = lambda rows: sorted((r.event_id, r.sent) for r in rows)
    assert cool(in_batches(spark, df, tmp_path, lambda s: streams.alert_cooldown_stream(s, 3600, "1 day"), "cool").collect()) == cool(streams.alert_cooldown(df, 3600).collect())
    quota = lambda rows: sorted((r.key, r.day, r.event_id, r.used_before, r.allowed) for r in rows)
    assert quota(in_batches(spark, df, tmp_path, lambda s: streams.daily_quota_stream(s, 60.0, "1 day"), "quota").collect()) == quota(streams.daily_quota(df, 60.0).collect())
    alerts = streams.spend_alerts(df, 300.0)
    found = in_batches(spark, df, tmp_path, lambda s: streams.spend_alerts_stream(s, 300.0, "1 day"), "alerts").collect()
    assert sorted((r.day, r.event_id, r.running, r.level) for r in found if r.level != "closed") == sorted((r.day, r.event_id, r.running, r.level) for r in alerts.filter("is_first_crossing").collect())
    assert {r.day: r.running for r in found if r.level == "closed"} == {r.day: r.spend for r in streams.daily_spend(df).collect()}


def test_late_rows_are_dropped_and_idle_keys_cleared(spark, tmp_path):
    folder = str(tmp_path / "in_late")
    steps = [[("k", 0, 0), ("k", 1, 5)], [("other", 2, 7200)], [("k", 3, 10)], [("other", 4, 14400)], [("k", 5, 14500)], [("other", 6, 90000)]]
    for rows in steps:
        spark.createDataFrame([(k, i, T0 + dt.timedelta(seconds=s)) for k, i, s in rows], "key string, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("key string, event_id long, ts timestamp").parquet(folder)
        out = run_stream(spark, streams.rate_limit_stream(stream, 9, 60, "10 minutes"), tmp_path, "late")
    got = {r.event_id: r.in_window for r in out.collect()}
    assert got == {0: 1, 1: 2, 2: 1, 4: 1, 5: 1}  # 3 came an hour late; 6 still waits
    kept = spark.read.format("statestore").option("path", str(tmp_path / "cp" / "late")).option("stateVarName", "seen").load()
    assert kept.select("key.key").distinct().count() <= 1


def test_upsert_stream_survives_a_crash(spark, tmp_path):
    """A crash after the table is saved and before the batch is committed, and one while it is saved: each batch counts once."""
    folder, path = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "key string, v long, seq long, ts timestamp"
    write = lambda *rows: spark.createDataFrame([(*r, T0) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    table = sinks.VersionedTable(spark, path)

    class Crashing(sinks.VersionedTable):
        early = False

        def save(self, rows, number):
            if self.early:
                rows.limit(1).write.mode("overwrite").parquet(f"{path}/v={number}")
                self._fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number}/_SUCCESS"), False)
            else:
                super().save(rows, number)
            raise RuntimeError("crash")

    def go(t):
        stream = spark.readStream.schema(schema).parquet(folder)
        try:
            streams.upsert_stream(stream, ["key"], "seq", t, str(tmp_path / "cp"), "ts", "1 day").trigger(availableNow=True).start().awaitTermination(300)
        except StreamingQueryException:
            assert isinstance(t, Crashing)
        else:
            assert not isinstance(t, Crashing)

    rows = lambda: sorted((r.key or "", r.v) for r in table.load().collect())
    write(("a", 1, 1), ("a", 2, 2), ("b", 3, 3), (None, 9, 4))
    go(Crashing(spark, path))
    go(table)
    assert rows() == [("", 9), ("a", 2), ("b", 3)]
    write(("a", 5, 5), (None, 8, 6), ("b", 3, 3))
    broken = Crashing(spark, path)
    broken.early = True
    go(broken)
    assert rows() == [("", 9), ("a", 2), ("b", 3)]
    go(table)
    go(table)
    assert rows() == [("", 8), ("", 9), ("a", 5), ("b", 3)] and len(table.versions()) <= 2


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in (1, 2):
        sinks.overwrite_workspaces(spark.createDataFrame([("w1", v)], "workspace_id string, v int"), path)
    sinks.overwrite_workspaces(spark.createDataFrame([("w2", 9)], "workspace_id string, v int"), path)
    assert sorted((r.workspace_id, r.v) for r in spark.read.parquet(path).collect()) == [("w1", 2), ("w2", 9)]
    merged = spark.createDataFrame([({"a": 1, "b": 1}, {"b": 2})], "l map<string,int>, r map<string,int>").select(sinks.merge_stats(F.col("l"), F.col("r"))).first()[0]
    assert merged == {"a": 1, "b": 2}
    ws = spark.createDataFrame([("i1", "u", "n<1>", "ready", True, T0)], "id string, owner_user_id string, name string, status string, is_public boolean, last_indexed_at timestamp")
    r = sinks.site_entries(ws, spark.createDataFrame([("u", "me")], "id string, login string"), "https://x/").first()
    assert "n&lt;1&gt;" in r.rss and r.sitemap == "<url><loc>https://x/i1</loc><lastmod>2024-01-01</lastmod></url>"
