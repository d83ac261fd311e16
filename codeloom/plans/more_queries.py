"""Further queries: tenant listings, history, issue links, code and diff corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import activity, corpus, graph, issues, overview
from codeloom.plans import star
from codeloom.plans.registry import query
from codeloom.runtime import table
from codeloom.sources import files, sinks


def _text(c: str):
    return F.col(c).cast("string")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND contains(lower(c_name), '00000') ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def public_listing(spark, d):
    """Customers of a segment as public workspaces."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("is_public"), F.when(F.col("c_acctbal") > 0, "ready").otherwise("failed").alias("status"), F.col("c_acctbal").alias("last_indexed_at"))
    return activity.public_listing(rows, "00000").select("id", "name")


@query("SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 500")
def audit_listing(spark, d):
    """A7."""
    return activity.audit_listing(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), "ts"), "error").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def owner_workspaces(spark, d):
    """A13."""
    return activity.owner_workspaces(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_user_id"), F.col("o_orderdate").alias("created_at")), 7).select("id")


@query("""WITH u AS (SELECT user_id AS identity, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'signup') AS w, count(*) FILTER (event_type NOT IN ('signup', 'click')) AS m, 1000 * count(*) FILTER (event_type = 'click') AS t FROM events GROUP BY ALL)
SELECT identity, day, CASE WHEN identity % 10 = 0 THEN 0 ELSE w END AS workspaces_used, CASE WHEN identity % 10 = 0 THEN 0 ELSE w END >= CASE identity % 2 WHEN 0 THEN 0 ELSE 3 END AS workspaces_exceeded,
 CASE WHEN identity % 10 = 0 THEN 0 ELSE m END AS messages_used, CASE WHEN identity % 10 = 0 THEN 0 ELSE m END >= CASE identity % 2 WHEN 0 THEN 10 ELSE 50 END AS messages_exceeded,
 CASE WHEN identity % 10 = 0 THEN 0 ELSE t END AS tokens_used, CASE WHEN identity % 10 = 0 THEN 0 ELSE t END >= CASE identity % 2 WHEN 0 THEN 40000 ELSE 200000 END AS tokens_exceeded FROM u""")
def quota_status(spark, d):
    """Guests have even ids, every tenth identity bypasses."""
    events = table(spark, d, "events")
    usage = events.select(F.col("user_id").alias("identity"), "ts", F.when(F.col("event_type") == "signup", "workspaces").when(F.col("event_type") == "click", "tokens").otherwise("messages").alias("counter"), F.when(F.col("event_type") == "click", 1000).otherwise(1).cast("long").alias("amount"))
    who = events.select(F.col("user_id").alias("identity")).distinct().select("identity", F.when(F.pmod("identity", F.lit(2)) == 0, "guest").otherwise("user").alias("kind"), (F.pmod("identity", F.lit(10)) == 0).alias("bypass"))
    found = activity.quota_status(usage, who).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return found.select("identity", "day", F.col("workspaces_used").cast("long").alias("workspaces_used"), "workspaces_exceeded", F.col("messages_used").cast("long").alias("messages_used"), "messages_exceeded", F.col("tokens_used").cast("long").alias("tokens_used"), "tokens_exceeded")


@query(f"WITH {star.COMMITS_SQL} SELECT author, count(*) AS commits FROM commits GROUP BY 1 ORDER BY commits DESC, author LIMIT 5")
def top_authors(spark, d):
    """A1."""
    return activity.top_authors(star.commits(spark, d))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS commits FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
SELECT month, commits, greatest(4, round(commits * 100.0 / max(commits) OVER ())::INT) AS pct FROM m""")
def sparkline(spark, d):
    """A3: orders of the last twelve months."""
    return activity.sparkline(table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("commits")))


@query("SELECT page_id, 'r/d' || (page_id % 5) || '/m' || page_id AS target FROM pages")
def resolve_imports(spark, d):
    """Relative imports folded against the importing file."""
    here = F.concat(F.lit("r/a/b"), _text("page_id"), F.lit("/f.ts"))
    target = F.concat(F.lit("../../d"), F.pmod("page_id", F.lit(5)).cast("string"), F.lit("/./x/../m"), _text("page_id"))
    return table(spark, d, "pages").select("page_id", corpus.resolve_import(here, target).alias("target"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_quantity >= 8 AND l_returnflag <> 'N' ORDER BY l_orderkey, l_linenumber, 1 LIMIT 500")
def annotation_candidates(spark, d):
    """Spans as long as the quantity."""
    kind = F.when(F.col("l_returnflag") == "N", "file").otherwise("class")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), kind.alias("type"), F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity") - 1).alias("end_line"))
    return corpus.annotation_candidates(rows).select("id")


@query("""SELECT 'concept::' || lower(p_name) AS id, 'concept' AS type, count(*) AS evidence FROM part GROUP BY 1 UNION ALL SELECT 'pattern::' || lower(p_brand), 'pattern', count(*) FROM part GROUP BY 1""")
def semantic_graph(spark, d):
    """Parts as annotated entities; nodes with the number of their edges."""
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_id"), F.array(F.struct(F.concat(F.lit(" "), F.initcap("p_name")).alias("name"), _text("p_partkey").alias("evidence_quote"))).alias("concepts"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.lit("high").alias("confidence"), _text("p_partkey").alias("evidence_quote"))).alias("patterns"),
    )
    counts = corpus.semantic_edges(rows).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("evidence"))
    return corpus.semantic_nodes(rows).join(counts, "id").select("id", "type", "evidence")


@query("SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey)[1:4] AS code FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def entity_code(spark, d):
    """C14."""
    ents = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), star.ident("q", "c_custkey").alias("qualified_name"))
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), star.ident("q", "o_custkey").alias("qualified_name"), F.col("o_orderpriority").alias("text"))
    return corpus.entity_code(ents, chunks, 4)


@query("SELECT event_id AS sha, k::INT AS pos, 'f' || user_id || '_' || k || '.py' AS file_path FROM events, range(0, 2) t(k)")
def split_diffs(spark, d):
    """Two files in each event's diff."""
    part = lambda k: F.concat(F.lit("diff --git a/old b/f"), _text("user_id"), F.lit(f"_{k}.py\n--- a/old\n+++ b/f"), _text("user_id"), F.lit(f"_{k}.py\n+x\n"))
    return files.split_diffs(table(spark, d, "events").select(F.col("event_id").alias("sha"), F.concat(part(0), part(1)).alias("raw"))).select("sha", "pos", "file_path")


@query("""WITH r AS (SELECT l_orderkey AS sha, l_linenumber AS pos, l_partkey, sum(least(l_quantity::INT, 20) + CASE WHEN l_quantity > 20 THEN 15 ELSE 0 END + 11) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity))
SELECT sha, pos, (SELECT count(*) FROM r x WHERE x.sha = r.sha AND x.s + 69 > 250)::BIGINT AS elided FROM r WHERE s + 69 <= 250""")
def cap_diffs(spark, d):
    """Line items as diffs as long as their quantity."""
    first = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("m"))
    rows = first.select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("pos"), F.lit("f").alias("file_path"), F.repeat(F.lit("x"), F.col("m.l_quantity").cast("int")).alias("diff"))
    return files.cap_diffs(rows, 20, 250, 80).select("sha", "pos", F.col("elided").cast("long").alias("elided"))


@query("""SELECT c_custkey AS id, '{"a":' || CASE WHEN c_acctbal > 0 THEN '"2"' ELSE '1' END || ',"b":{"c":[1,' || c_custkey || ']},"d":true' || CASE WHEN c_acctbal > 0 THEN ',"e":{"c":null}' ELSE '' END || '}' AS merged FROM customer""")
def merge_stats_json(spark, d):
    """S15 on JSON texts: a number by a string, nested values whole."""
    left = F.concat(F.lit('{"d": true, "a": 1, "b": {"c": [1, '), _text("c_custkey"), F.lit("]}}"))
    right = F.when(F.col("c_acctbal") > 0, '{"a": "2", "e": {"c": null}}').otherwise("not json")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.from_json(sinks.merge_stats_json(left, right), "map<string,string>").alias("m"))
    # JSON objects have no order; by key they are equal texts.
    entries = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.when(k == "a", F.when(F.col("c_acctbal") > 0, F.concat(F.lit('"'), F.col("m")[k], F.lit('"'))).otherwise(F.col("m")[k])).otherwise(F.col("m")[k])))
    rows = rows.join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id")
    return rows.select("id", F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("merged"))


@query("SELECT o_orderkey AS number, 'closes #' || o_custkey AS excerpt, 1::BIGINT AS issues FROM (SELECT * FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) WHERE o_orderstatus = 'F'")
def merged_pulls(spark, d):
    """Orders as pull requests."""
    status = F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("number"), F.lit("fixes #1").alias("title"), F.concat(F.lit("**closes** "), F.lit("#"), _text("o_custkey")).alias("b"), F.concat(F.lit("closes #"), _text("o_custkey")).alias("body"), F.when(status == "O", "open").otherwise("closed").alias("state"),
        F.when(status == "F", F.col("o_orderdate")).alias("merged_at"), F.col("o_orderdate").alias("updated_at"), F.array(F.lit("x")).alias("labels"), F.lit("me").alias("author"),
    )
    found = files.merged_pulls(rows)
    return found.select("number", F.concat(F.lit("closes #"), F.regexp_extract("excerpt", r"(\d+)", 1)).alias("excerpt"), F.size("issues").cast("long").alias("issues"))


@query("""WITH m AS (SELECT o_custkey, arg_min(o_orderdate, o_orderkey) AS at FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN m.at IS NOT NULL THEN count(*) FILTER (o_orderdate > m.at) END AS behind FROM customer LEFT JOIN m ON m.o_custkey = c_custkey LEFT JOIN orders o ON o.o_custkey = c_custkey GROUP BY c_custkey, m.at""")
def freshness(spark, d):
    """Orders newer than a customer's first by key."""
    orders = table(spark, d, "orders")
    commits = orders.select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"))
    at = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("indexed_commit_sha"))
    return activity.freshness(commits, table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(at, "id", "left"))


@query("""WITH p AS (SELECT p_partkey, 'src/' || p_brand || '/' || p_type || '/f' || p_partkey || '.ts' AS path FROM part), t AS (SELECT p_type || '/f' || p_partkey || '.ts' AS token FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'f' || p_partkey || '.ts' FROM part WHERE p_partkey % 3 = 1),
r AS (SELECT token, p_partkey AS id, row_number() OVER (PARTITION BY token ORDER BY length(path), p_partkey) AS n FROM p JOIN t ON path LIKE '%/' || token) SELECT token, id FROM r WHERE n <= 3""")
def lookup_paths(spark, d):
    """L2: path endings as tokens."""
    parts = table(spark, d, "part")
    f = F.concat(F.lit("f"), _text("p_partkey"), F.lit(".ts"))
    tokens = parts.filter("p_partkey % 3 = 0").select(F.concat_ws("/", "p_type", f).alias("token")).union(parts.filter("p_partkey % 3 = 1").select(f))
    return issues.lookup_paths(tokens, parts.select(F.col("p_partkey").alias("id"), F.concat_ws("/", F.lit("src"), "p_brand", "p_type", f).alias("file_path")))


@query("""WITH l AS (SELECT l_orderkey AS number, l_partkey AS id, max(l_quantity)::BIGINT AS degree FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY degree DESC, id) AS n FROM l),
s AS (SELECT number, (sum(degree) + count(*))::BIGINT AS score FROM r WHERE n <= 5 GROUP BY 1)
SELECT o_orderkey AS number, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) < 6 THEN 'easy' WHEN coalesce(score, 0) < 20 THEN 'medium' ELSE 'hard' END AS difficulty FROM orders LEFT JOIN s ON number = o_orderkey""")
def first_issues(spark, d):
    """L4: orders by the quantities of their parts."""
    links = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("number"), F.col("l_partkey").alias("id")).agg(F.max("l_quantity").cast("long").alias("degree"))
    return issues.first_issues(table(spark, d, "orders").select(F.col("o_orderkey").alias("number")), links, None).select("number", "score", "difficulty")


@query("SELECT o_orderkey AS chunk_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) ORDER BY 1 LIMIT 12")
def pinned_chunks(spark, d):
    """W16."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("entity_id"))
    return activity.pinned_chunks(orders, orders.select("chunk_id"), table(spark, d, "customer").filter("c_nationkey = 5").select(F.col("c_custkey").alias("id")))


@query("""SELECT 'c' || c_custkey AS file_path, o_orderkey AS start_line FROM customer JOIN orders ON o_custkey = c_custkey WHERE ('c' || c_custkey) LIKE '%c12' ORDER BY o_orderkey LIMIT 6""")
def read_file(spark, d):
    """Orders as the chunks of a customer's file."""
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), _text("o_custkey")).alias("file_path"), F.col("o_orderkey").alias("start_line"), F.col("o_orderkey").alias("chunk_id"))
    return graph.read_file(rows, "./c12").select("file_path", "start_line")


@query("""WITH m AS (SELECT p_partkey, ['contributing', 'security', 'pr_template', NULL][p_size % 4 + 1] AS kind, 'd' || p_partkey || '/' || ['CONTRIBUTING.md', 'SECURITY.md', '.github/pull_request_template.md', 'contributing-notes.md'][p_size % 4 + 1] AS file_path FROM part),
f AS (SELECT * FROM m ORDER BY length(file_path), file_path, p_partkey LIMIT 20), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY length(file_path), file_path) AS n FROM f WHERE kind IS NOT NULL) SELECT kind, file_path FROM r WHERE n <= 2""")
def contribution_documents(spark, d):
    """Notes whose path is looked at but has no kind take part in the first cut."""
    names = F.array(*[F.lit(x) for x in ("CONTRIBUTING.md", "SECURITY.md", ".github/pull_request_template.md", "contributing-notes.md")])
    path = F.concat(F.lit("d"), _text("p_partkey"), F.lit("/"), F.element_at(names, (F.pmod("p_size", F.lit(4)) + 1).cast("int")))
    rows = table(spark, d, "part").select(path.alias("file_path"), F.col("p_name").alias("text"), F.lit(1).alias("start_line"), F.col("p_partkey").alias("chunk_id"))
    return overview.contribution_documents(rows).select("kind", "file_path")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS merged, 3 AS kept FROM customer")
def merge_stats(spark, d):
    """The right side of two maps wins."""
    left = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(3))
    right = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("a"), F.lit(2)))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), sinks.merge_stats(left, right).alias("m"))
    return rows.select("id", F.col("m")["a"].alias("merged"), F.col("m")["b"].alias("kept"))
