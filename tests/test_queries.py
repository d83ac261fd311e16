"""Registered queries against their SQL on small tables that the test tables don't cover."""

import datetime
import os

import duckdb

import __spark_entry__ as entry

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def both(spark, d, name):
    """Sorted rows of a query and of its SQL, numbers rounded."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(d):
        path = os.path.join(d, file, "*.parquet") if os.path.isdir(os.path.join(d, file)) else os.path.join(d, file)
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    tidy = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    return tidy(map(tuple, entry.queries()[name](spark, str(d)).collect())), tidy(con.execute(entry.oracle_sql()[name]).fetchall())


def test_latest_commits_takes_every_order(spark):
    found, expected = both(spark, SMALL, "latest_commits")
    assert found == expected
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert len(found) == sum(min(r["count"], 2) for r in orders.groupBy("o_custkey").count().collect())


def test_setup_guide_without_a_package_file_near(spark):
    found, expected = both(spark, LARGE, "setup_guide")
    assert found == expected and found


def test_rate_limit_with_repeated_events(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, at(0), 7, 1.0), (1, at(0), 7, 1.0), (2, at(0), 7, 1.0), (3, at(5), 7, 1.0), (3, at(9), 7, 1.0), (4, at(9), None, 1.0), (5, None, 7, 1.0), (6, at(1), 8, 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    found, expected = both(spark, tmp_path, "rate_limit")
    assert found == expected


def test_times_round_to_milliseconds(spark, tmp_path):
    at = lambda hour, us: datetime.datetime(2024, 1, 1, hour, 0, 0, us)
    rows = [(2, at(0, 600), 7), (1, at(0, 1400), 7), (3, at(0, 600), 8), (4, at(1, 400), 8), (5, at(2, 500), 8), (6, at(10, 400), 8), (7, at(12, 499), 8)]
    spark.createDataFrame([(*r, "error", 1.0) for r in rows], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("rate_limit", "alert_cooldown"):
        found, expected = both(spark, tmp_path, name)
        assert found == expected and len(found) == len(rows), name


def test_rate_limit_with_events_without_id(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(None, at(0), 7, 1.0), (1, at(0), 7, 1.0), (None, at(3), 7, 1.0), (None, at(3), 7, 1.0), (2, at(3), 7, 1.0), (3, at(4), 7, 1.0), (None, at(0), 8, 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    found, expected = both(spark, tmp_path, "rate_limit")
    assert found == expected and len(found) == 4


def test_setup_guide_takes_every_manifest(spark):
    found, expected = both(spark, LARGE, "setup_guide")
    assert found == expected and [r[0] for r in found] == [0, 1, 10, 11, 2]


def test_setup_guide_without_any_package_file(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1, 600) if k % 5], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    found, expected = both(spark, tmp_path, "setup_guide")
    assert found == expected and {r[1] for r in found} >= {"go mod download", "go run ./..."}
