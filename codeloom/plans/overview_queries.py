"""The whole overview, over the queries of its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import overview
from codeloom.plans import corpus_queries, graph_queries, more_queries, star  # noqa: F401  their SQL is used below
from codeloom.plans.graph_queries import _paths
from codeloom.plans.more_queries import _text
from codeloom.plans.registry import ORACLES, query
from codeloom.runtime import table, union


def _part(name: str, item: str, sql: str) -> str:
    return f"SELECT '{name}' AS part, {item} AS item FROM ({sql})"


@query(" UNION ALL ".join((
    _part("architecture", "chart", ORACLES["architecture_flowchart"]), _part("contributing", "kind || ':' || file_path", ORACLES["contribution_documents"]),
    _part("entry_points", "kind || ':' || file_path", ORACLES["entry_points"].replace("r AS (", "u AS (SELECT f, m, b FROM m WHERE length(f) - length(replace(f, '/', '')) = 1), r AS (")),
    _part("core", "id || ':' || degree", "SELECT 'c:' || (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS id, count(*) AS degree FROM orders JOIN customer ON c_custkey = (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) GROUP BY 1, c_name ORDER BY degree DESC, c_name, id LIMIT 10"),
    _part("safe_changes", "path || ':' || score", "SELECT * FROM (" + ORACLES["safe_change_score"].replace("SELECT path, score FROM s WHERE score >= 3", "SELECT path, score, (SELECT p_size % 27 FROM part WHERE 'p:' || p_partkey = path) AS n FROM s WHERE score >= 3") + ") ORDER BY score DESC, n, path LIMIT 5"),
    _part("hot", "path || ':' || hotness", "SELECT 'p:' || p_partkey AS path, p_size % 4 AS hotness FROM part WHERE p_size % 4 > 0 ORDER BY hotness DESC, path LIMIT 10"),
    _part("stats", "type || ':' || n", "SELECT 'class' AS type, count(*) AS n FROM customer"),
)))
def project_overview(spark, d):
    """All seven parts over customers as classes, parts as files and notes, suppliers as packages."""
    n = table(spark, d, "customer").count()
    target = F.concat(F.lit("c:"), F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(n)).cast("string"))
    edges = table(spark, d, "orders").select(star.ident("c", "o_custkey").alias("src"), target.alias("dst"), F.lit("imports").alias("type"))
    names = table(spark, d, "customer").select(star.ident("c", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    entities = _paths(spark, d).drop("type", "name").join(names, "id").withColumns({"type": F.lit("class"), "qualified_name": F.lit(None).cast("string")})
    notes = F.array(*[F.lit(x) for x in ("CONTRIBUTING.md", "SECURITY.md", ".github/pull_request_template.md", "contributing-notes.md")])
    path = F.concat(F.lit("d"), _text("p_partkey"), F.lit("/"), F.element_at(notes, (F.pmod("p_size", F.lit(4)) + 1).cast("int")))
    docs = table(spark, d, "part").select(path.alias("file_path"), F.col("p_name").alias("text"), F.lit(1).alias("start_line"), F.col("p_partkey").alias("chunk_id"))
    k = _text("s_suppkey")
    body = F.concat(F.lit('{"name": "tool", "main": "./m'), k, F.lit('.js", "bin": "./b'), k, F.lit('.js"}'))
    packages = table(spark, d, "supplier").select(F.concat(F.lit("pkg"), k, F.lit("/package.json")).alias("file_path"), body.alias("text"), F.lit(1).alias("start_line"), F.col("s_suppkey").alias("chunk_id"))
    scores = table(spark, d, "part").select(star.ident("p", "p_partkey").alias("path"), *[F.pmod("p_size", F.lit(m)).alias(c) for c, m in (("tests", 3), ("hotness", 4), ("entities", 27))])
    parts = overview.project_overview(entities, edges, docs.unionByName(packages), scores)
    pair = lambda a, b: F.concat_ws(":", a, F.col(b).cast("string"))
    items = {"architecture": F.col("chart"), "contributing": pair("kind", "file_path"), "entry_points": pair("kind", "file_path"), "core": pair("id", "degree"), "safe_changes": pair("path", "score"), "hot": pair("path", "hotness"), "stats": pair("type", "n")}
    return union([parts[name].select(F.lit(name).alias("part"), item.alias("item")) for name, item in items.items()])
