"""Views of the star tables as the library's inputs: the star graph G, the event graph E, commits, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.runtime import table, union


def ident(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, type, name) of regions, nations, customers, suppliers, parts and orders."""
    rows = (("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name"), ("orders", "o", "o_orderkey", "o_orderpriority"))
    return union([table(spark, d, t).select(ident(p, k).alias("id"), F.lit(t).alias("type"), F.col(n).alias("name")) for t, p, k, n in rows])


def edges(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """(src, dst, type), each once; traversals, which don't count edges, take them as they lie."""
    e = lambda t, sp, sk, dp, dk, kind: table(spark, d, t).select(ident(sp, sk).alias("src"), ident(dp, dk).alias("dst"), F.lit(kind).alias("type"))
    each = lambda df: df.distinct() if once else df
    return union([
        e("nation", "n", "n_nationkey", "r", "n_regionkey", "contained_in"), e("customer", "c", "c_custkey", "n", "c_nationkey", "contained_in"),
        e("supplier", "s", "s_suppkey", "n", "s_nationkey", "contained_in"), e("orders", "o", "o_orderkey", "c", "o_custkey", "calls"),
        each(e("lineitem", "o", "l_orderkey", "p", "l_partkey", "imports")), each(e("lineitem", "p", "l_partkey", "s", "l_suppkey", "imports")),
    ])


NODES_SQL = """nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'p:' || p_partkey, 'part', p_name FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'orders', o_orderpriority FROM orders)"""

EDGES_SQL = """edges AS (
  SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'contained_in' AS type FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'contained_in' FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'contained_in' FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'calls' FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'imports' FROM lineitem UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'imports' FROM lineitem)"""


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, type): consecutive event types of a user with the user's number modulo 50; cyclic."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = lambda c: F.concat_ws(":", c, F.pmod("user_id", F.lit(50)).cast("string"))
    rows = table(spark, d, "events").withColumn("next", F.lead("event_type").over(w)).filter("next is not null")
    return rows.select(node("event_type").alias("src"), node("next").alias("dst"), F.lit("calls").alias("type")).distinct()


EVENT_EDGES_SQL = """event_edges AS (
  SELECT DISTINCT event_type || ':' || (user_id % 50) AS src, nxt || ':' || (user_id % 50) AS dst
  FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"""


def commits(spark: SparkSession, d: str) -> DataFrame:
    """(sha, author, ts, message): events as commits; errors are fixes, signups features, purchases breaking changes."""
    kind = F.when(F.col("event_type") == "error", "fix(core): ").when(F.col("event_type") == "signup", "feat: ").when(F.col("event_type") == "purchase", "chore!: ").otherwise("docs: ")
    return table(spark, d, "events").select(
        F.col("event_id").alias("sha"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), F.col("ts").cast("timestamp").alias("ts"), F.concat(kind, "event_type").alias("message")
    )


COMMITS_SQL = """commits AS (
  SELECT event_id AS sha, 'u' || user_id AS author, ts,
         CASE event_type WHEN 'error' THEN 'fix' WHEN 'signup' THEN 'feat' WHEN 'purchase' THEN 'chore' ELSE 'docs' END AS kind, event_type = 'purchase' AS breaking,
         (SELECT max(ts) FROM events) AS as_of FROM events)"""


def as_of(df: DataFrame, column: str = "ts"):
    """The clock of a query: the newest time in its input (one row to the driver)."""
    return F.lit(df.agg(F.max(column)).first()[0])


def order_files(spark: SparkSession, d: str) -> DataFrame:
    """(sha, ts, files_changed): orders as commits, their parts as files."""
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(ident("p", "l_partkey")).alias("files_changed"))
    return table(spark, d, "orders").join(files, "o_orderkey").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").cast("timestamp").alias("ts"), "files_changed")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as messages (session_id, id, role, content, created_at)."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"))
