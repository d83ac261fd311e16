"""Graph, build and resolution queries over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import build, graph, overview, resolve
from codeloom.plans import star
from codeloom.plans.registry import query
from codeloom.runtime import table, union
from codeloom.sources import sinks

_WALK = """WITH RECURSIVE {edges}, walk AS (
  SELECT {seed} AS id, 0 AS depth UNION SELECT e.{to}, w.depth + 1 FROM walk w JOIN {table} e ON e.{at} = w.id WHERE w.depth < {most} {more})
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id HAVING min(depth) > 0"""


def _seed(spark, ident: str):
    return spark.createDataFrame([(ident,)], "id string")


@query(_WALK.format(edges=star.EDGES_SQL, seed="'r:0'", to="src", at="dst", table="edges", most=3, more=""))
def reach_region(spark, d):
    """K4: everything that leads to a region within three hops."""
    return graph.traverse(star.edges(spark, d, False), _seed(spark, "r:0"), None, "in", 3, None)


@query(_WALK.format(edges=star.EVENT_EDGES_SQL, seed="'purchase:8'", to="src", at="dst", table="event_edges", most=5, more=""))
def callers_transitive(spark, d):
    """K2 on the cyclic event graph."""
    return graph.callers(star.event_edges(spark, d), _seed(spark, "purchase:8"), True, 5, None)


@query(_WALK.format(edges=star.EVENT_EDGES_SQL, seed="'signup:8'", to="dst", at="src", table="event_edges", most=5, more=""))
def callees_transitive(spark, d):
    """K3."""
    return graph.callees(star.event_edges(spark, d), _seed(spark, "signup:8"), True, 5, None)


@query(f"""WITH RECURSIVE {star.EDGES_SQL}, both_ AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
walk AS (SELECT 'c:1' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN both_ ON a = id WHERE depth < 2)
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id""")
def neighbourhood_2hop(spark, d):
    """Nodes around a customer with their distance."""
    return graph.neighbourhood(star.edges(spark, d, False), _seed(spark, "c:1"), 2)[0]


@query(f"WITH {star.NODES_SQL} SELECT id, type, name FROM nodes WHERE lower(name) = 'red widget'")
def find_symbol_exact(spark, d):
    """K1 with an exact hit."""
    return graph.find_symbol(star.nodes(spark, d), "Red Widget", limit=None)


@query(f"WITH {star.NODES_SQL} SELECT id, type, name FROM nodes WHERE contains(lower(name), 'widge') ORDER BY name, id LIMIT 20")
def find_symbol_fallback(spark, d):
    """K1 without an exact hit: substring, first 20."""
    return graph.find_symbol(star.nodes(spark, d), "widge")


@query(f"WITH {star.NODES_SQL} SELECT id, type, name FROM nodes WHERE contains(lower(name), '#00000000') ORDER BY length(name), name, id LIMIT 50")
def entity_search(spark, d):
    """W1."""
    return graph.search_entities(star.nodes(spark, d), "#00000000")


@query("""SELECT o_orderkey AS id, o_orderdate AS ts FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 1)
ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def file_history(spark, d):
    """K5: orders as the commits of a part."""
    touched = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("modified_by").alias("type"))
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    return graph.file_history(touched, commits, spark.createDataFrame([(1,)], "id long"))


@query(f"WITH {star.NODES_SQL}, {star.EDGES_SQL} SELECT id, name, type, 'd' AS description FROM nodes WHERE id IN (SELECT dst FROM edges WHERE type = 'imports')")
def summary_lookup(spark, d):
    """K9: summaries of all imported nodes."""
    nodes = star.nodes(spark, d).withColumn("description", F.lit("d"))
    return graph.summaries(nodes, star.edges(spark, d).filter("type = 'imports'").select(F.col("dst").alias("id")).distinct())


@query("SELECT DISTINCT o_orderkey AS chunk_id, o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2'")
def linked_chunks(spark, d):
    """K8: orders linked to the parts of a brand."""
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_totalprice")
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"))
    return graph.linked_chunks(chunks, links, table(spark, d, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("id")), None)


@query("SELECT DISTINCT 'o:' || l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7")
def tests_for(spark, d):
    """Orders as the tests of parts."""
    edges = table(spark, d, "lineitem").select(star.ident("p", "l_partkey").alias("src"), star.ident("o", "l_orderkey").alias("dst"), F.lit("tested_by").alias("type"))
    return graph.tests_for(edges, table(spark, d, "part").filter("p_size = 7").select(star.ident("p", "p_partkey").alias("id")), limit=None)


@query(f"""WITH {star.EDGES_SQL}, t AS (SELECT 'c:' || c_custkey AS id FROM customer WHERE c_nationkey = 3), f AS (
 SELECT id, 0 AS ord, 'target' AS role FROM t UNION ALL SELECT DISTINCT dst, 1, 'callee' FROM edges JOIN t ON src = id WHERE type = 'calls'
 UNION ALL (SELECT DISTINCT dst, 3, 'parent' FROM edges JOIN t ON src = id WHERE type = 'contained_in' ORDER BY 1 LIMIT 3))
SELECT id, arg_min(role, ord) AS role, min(ord)::INT AS ord FROM f GROUP BY id""")
def walkthrough(spark, d):
    """K10 from the customers of a nation."""
    seeds = table(spark, d, "customer").filter("c_nationkey = 3").select(star.ident("c", "c_custkey").alias("id"))
    return graph.walkthrough(star.edges(spark, d, False), seeds, None)


@query(f"""WITH {star.EDGES_SQL}, e AS (SELECT dst AS id, 'incoming' AS direction, type, src AS other FROM edges UNION ALL SELECT src, 'outgoing', type, dst FROM edges),
r AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY type, other) AS n, count(*) OVER (PARTITION BY id, direction) AS total FROM e WHERE id LIKE 's:%')
SELECT id, direction, type, other, total FROM r WHERE n <= 20""")
def entity_details(spark, d):
    """W4 of all suppliers."""
    return graph.entity_details(star.edges(spark, d), table(spark, d, "supplier").select(star.ident("s", "s_suppkey").alias("id")), 20)


@query(f"""WITH {star.NODES_SQL}, {star.EDGES_SQL}, i AS (SELECT 'n:' || n_nationkey AS id FROM nation), e AS (SELECT dst AS id, 'incoming' AS direction, type, src AS other FROM edges UNION ALL SELECT src, 'outgoing', type, dst FROM edges),
r AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.id, direction ORDER BY type, other) AS n FROM e JOIN i USING (id)) WHERE n <= 200),
c AS (SELECT 'n:' || c_nationkey AS id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS n FROM customer)
SELECT 'entity' AS part, id, name AS item FROM nodes JOIN i USING (id) UNION ALL SELECT 'edge', r.id, direction || ' ' || nodes.type || ' ' || nodes.name FROM r JOIN nodes ON nodes.id = other
UNION ALL SELECT 'chunk', id, c_custkey::VARCHAR FROM c WHERE n <= 20 UNION ALL SELECT 'counts', id, count(*) FILTER (direction = 'incoming') || '/' || count(*) FILTER (direction = 'outgoing') FROM r GROUP BY id""")
def entity_page(spark, d):
    """W4 of all nations: the nation, its edges with their other ends, its customers as linked chunks, and counts."""
    links = table(spark, d, "customer").select(star.ident("n", "c_nationkey").alias("entity_id"), F.col("c_custkey").alias("chunk_id"))
    chunks = table(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_mktsegment").alias("file_path"), F.lit(1).alias("start_line"))
    ids = table(spark, d, "nation").select(star.ident("n", "n_nationkey").alias("id"))
    page = graph.entity_page(star.nodes(spark, d), star.edges(spark, d), links, chunks, ids)
    row = lambda part, item: page[part].select(F.lit({"edges": "edge", "chunks": "chunk"}.get(part, part)).alias("part"), "id", item.cast("string").alias("item"))
    return union([row("entity", F.col("name")), row("edges", F.concat_ws(" ", "direction", "other_type", "other_name")), row("chunks", F.col("chunk_id")), row("counts", F.concat_ws("/", F.col("incoming").cast("string"), F.col("outgoing").cast("string")))])


@query(f"""WITH {star.NODES_SQL}, p AS (SELECT id, type FROM nodes WHERE type IN ('customer', 'nation') ORDER BY id LIMIT 100)
SELECT type, count(*) AS total, count(*) FILTER (id IN (SELECT id FROM p)) AS shown, (SELECT count(*) FROM p) >= 100 AS truncated FROM nodes GROUP BY 1""")
def subgraph_stats(spark, d):
    """Types in all and in a view cut at 100 nodes."""
    nodes = star.nodes(spark, d)
    return graph.subgraph_summary(nodes, graph.subgraph(nodes, star.edges(spark, d), ["customer", "nation"], max_nodes=100)[0], 100)


@query(f"""WITH {star.NODES_SQL}, {star.EDGES_SQL}, v AS (SELECT id FROM nodes WHERE type IN ('customer', 'nation', 'region'))
SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)""")
def subgraph_view(spark, d):
    """The edges among three types of nodes."""
    return graph.subgraph(star.nodes(spark, d), star.edges(spark, d), ["customer", "nation", "region"], max_nodes=None)[1]


@query(f"WITH {star.EDGES_SQL} SELECT DISTINCT dst AS id, src AS child FROM edges WHERE type = 'calls' AND dst LIKE 'c:1%'")
def call_hierarchy(spark, d):
    """W11 in mode callers."""
    ids = table(spark, d, "customer").select(star.ident("c", "c_custkey").alias("id")).filter("id like 'c:1%'")
    return graph.hierarchy_children(star.edges(spark, d, False), ids, "callers")


@query(f"""WITH {star.NODES_SQL}, {star.EDGES_SQL} SELECT id, name, nodes.type AS type, count(*) AS degree FROM nodes JOIN edges e ON e.dst = id AND e.type IN ('imports', 'calls')
WHERE nodes.type IN ('part', 'supplier', 'customer') GROUP BY 1, 2, 3 ORDER BY degree DESC, name, id LIMIT 10""")
def core_abstractions(spark, d):
    """O6."""
    return overview.core_abstractions(star.nodes(spark, d), star.edges(spark, d), ("part", "supplier", "customer"), ("imports", "calls"))


@query(f"WITH {star.NODES_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY ROLLUP (type)")
def type_stats(spark, d):
    """O9 with its total."""
    return overview.type_stats(star.nodes(spark, d), total=True)


_PATHS = """paths AS (SELECT 'c:' || c_custkey AS id, r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS file_path, c_custkey
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _paths(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(star.ident("c", "c_custkey").alias("id"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name").alias("file_path"), "c_custkey")


@query(f"""WITH {_PATHS}, f AS (SELECT regexp_extract(file_path, '^([^/]+/[^/]+)', 1) AS folder, count(*) AS n FROM paths GROUP BY 1 HAVING count(*) >= 3)
SELECT folder, n FROM f WHERE (SELECT count(*) FROM f) >= 2 ORDER BY n DESC, folder LIMIT 12""")
def folder_profile(spark, d):
    """O1 over customers placed by region, nation and segment."""
    return overview.folder_profile(_paths(spark, d))


@query(f"""WITH {_PATHS}, p AS (SELECT c_custkey, regexp_extract(file_path, '^([^/]+/[^/]+)', 1) AS folder FROM paths),
e AS (SELECT o_custkey AS a, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS b FROM orders),
f AS (SELECT x.folder AS from_folder, y.folder AS to_folder, count(*) AS n FROM e JOIN p x ON x.c_custkey = a JOIN p y ON y.c_custkey = b GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, 1, 2 LIMIT 40)
SELECT * FROM f WHERE from_folder <> to_folder ORDER BY n DESC, 1, 2 LIMIT 25""")
def folder_dependencies(spark, d):
    """O2 over derived import edges between customers."""
    n = table(spark, d, "customer").count()
    e = table(spark, d, "orders").select(star.ident("c", "o_custkey").alias("src"), F.concat(F.lit("c:"), F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(n)).cast("string")).alias("dst"), F.lit("imports").alias("type"))
    return overview.folder_dependencies(_paths(spark, d), e)


@query(f"""WITH {_PATHS}, s AS (SELECT string_split(file_path, '/') AS x FROM paths), u AS (SELECT unnest(range(0, 4)) AS k, x FROM s)
SELECT array_to_string(x[1:k], '/') AS dir, count(*) AS files, k::INT AS depth FROM u GROUP BY ALL""")
def dir_rollup(spark, d):
    """Every directory with the number of files below."""
    return overview.directory_rollup(_paths(spark, d).withColumnRenamed("file_path", "path"), {"files": F.count(F.lit(1))})


_HEAT = """heat AS (SELECT p_partkey, count(l_partkey) AS hotness, count(DISTINCT l_orderkey) AS entities FROM part LEFT JOIN lineitem
 ON l_partkey = p_partkey AND l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY GROUP BY 1)"""


def _heat(spark, d):
    items = table(spark, d, "lineitem")
    recent = items.filter(F.col("l_shipdate") >= star.as_of(items, "l_shipdate") - F.make_dt_interval(F.lit(90)))
    counts = recent.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("hotness"), F.count_distinct("l_orderkey").alias("entities"))
    return table(spark, d, "part").select("p_partkey").join(counts, "p_partkey", "left").fillna(0).withColumn("path", star.ident("p", "p_partkey"))


@query(f"WITH {_HEAT} SELECT 'p:' || p_partkey AS path, hotness FROM heat WHERE hotness > 0 ORDER BY hotness DESC, path LIMIT 10")
def hot_items(spark, d):
    """Parts by line items in the last 90 days."""
    return overview.hot_files(_heat(spark, d).select("path", "hotness"))


@query("""WITH t AS (SELECT p_partkey, p_size % 3 AS tests, p_size % 4 AS hotness, p_size % 27 AS entities FROM part),
s AS (SELECT 'p:' || p_partkey AS path, (CASE WHEN tests > 0 THEN 3 ELSE 0 END + CASE WHEN hotness = 0 THEN 2 WHEN hotness <= 2 THEN 1 ELSE 0 END + CASE WHEN entities <= 8 THEN 1 ELSE 0 END)::INT AS score FROM t WHERE entities BETWEEN 2 AND 25)
SELECT path, score FROM s WHERE score >= 3""")
def safe_change_score(spark, d):
    """O7 over all parts."""
    rows = table(spark, d, "part").select(star.ident("p", "p_partkey").alias("path"), *[F.pmod("p_size", F.lit(m)).alias(n) for n, m in (("tests", 3), ("hotness", 4), ("entities", 27))])
    return overview.safe_change_score(rows, None).select("path", "score")


@query("SELECT lower(p_name) AS short, min(p_partkey) AS id FROM part GROUP BY 1")
def short_name_index(spark, d):
    """G3."""
    return build.short_names(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")))


@query("""WITH f AS (SELECT lower(p_name) AS s, min(p_partkey) AS p FROM part GROUP BY 1), i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
k AS (SELECT i.*, p.p_name, CASE WHEN l_linenumber % 3 = 2 THEN f.p ELSE l_partkey END AS hit FROM i JOIN part p ON p.p_partkey = l_partkey JOIN f ON f.s = lower(p.p_name))
SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS seq, 'o:' || l_orderkey AS src, 'p:' || hit AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'path' ELSE 'short' END AS how
FROM k JOIN orders ON o_orderkey = l_orderkey""")
def resolve_edges(spark, d):
    """A third of the line items by exact name, a third through an extension, a third by short name."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    third = F.pmod("l_linenumber", F.lit(3))
    target = F.when(third == 0, F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".ts"))).when(third == 1, F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))).otherwise(F.lit("nowhere"))
    edges = items.select((F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("seq"), star.ident("order", "l_orderkey").alias("from_qualified"), target.alias("to_qualified"), F.col("p_name").alias("to_name"), F.lit("imports").alias("type"))
    parts = table(spark, d, "part").select(star.ident("p", "p_partkey").alias("id"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("qualified_name"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    orders = table(spark, d, "orders").select(star.ident("o", "o_orderkey").alias("id"), star.ident("order", "o_orderkey").alias("qualified_name"), F.lit(None).cast("string").alias("name"), (F.col("o_orderkey") + (1 << 40)).alias("seq"))
    return build.resolve_edges(edges, parts.unionByName(orders)).select("seq", "src", "dst", "how")


@query("""SELECT DISTINCT 'p:' || p_partkey AS src, 'test/' || l_orderkey AS dst, 'tested_by' AS type FROM lineitem JOIN part ON p_partkey = l_partkey""")
def derive_tested_by(spark, d):
    """G1: orders as test files importing parts without their extension."""
    imports = table(spark, d, "lineitem").select(F.concat(F.lit("test/"), F.col("l_orderkey").cast("string")).alias("test_file"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("target"))
    path = F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    parts = table(spark, d, "part").select(star.ident("p", "p_partkey").alias("id"), F.lit("function").alias("type"), path.alias("file_path"), F.concat(path, F.lit("::main")).alias("qualified_name"))
    return build.tested_by_edges(imports, parts)


@query("SELECT DISTINCT p_partkey AS entity_id, l_orderkey AS chunk_id FROM part JOIN lineitem ON l_partkey = p_partkey")
def link_chunks(spark, d):
    """G4."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), star.ident("q", "p_partkey").alias("qualified_name"))
    return build.link_chunks(parts, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), star.ident("q", "l_partkey").alias("qualified_name")))


@query("""SELECT 'person:u' || user_id || '::' || 'u' || user_id || '@x' AS src, 'commit:' || event_id AS dst, 'authored' AS type FROM events
UNION SELECT 'commit:' || event_id, 'c:' || c_custkey, 'modified_by' FROM events JOIN customer ON c_custkey IN (user_id, user_id * 2)""")
def commit_edges(spark, d):
    """Events as commits that touch two customers' files, some unknown."""
    author = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    commits = table(spark, d, "events").select(F.col("event_id").cast("string").alias("sha"), author.alias("author_name"), F.concat(author, F.lit("@x")).alias("author_email"), F.array(star.ident("f", "user_id"), F.concat(F.lit("f:"), (F.col("user_id") * 2).cast("string"))).alias("files_changed"))
    files = table(spark, d, "customer").select(star.ident("f", "c_custkey").alias("path"), star.ident("c", "c_custkey").alias("id"))
    return build.history_edges(commits, files)


@query("SELECT 'u' || user_id || '::' || 'u' || user_id || '@x' AS author, count(*) AS commits FROM events GROUP BY 1")
def author_counts(spark, d):
    """G7."""
    author = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return build.author_counts(table(spark, d, "events").select(author.alias("author_name"), F.concat(author, F.lit("@x")).alias("author_email")))


@query("""SELECT 'p:' || l_partkey AS path, count(DISTINCT l_orderkey) AS hotness FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) - INTERVAL 90 DAY GROUP BY 1""")
def hotness(spark, d):
    """Parts by orders in the last 90 days."""
    commits = star.order_files(spark, d)
    return build.hotness(commits, star.as_of(commits))


@query("SELECT p_partkey AS id, coalesce(n, 0) AS hotness FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def attach_hotness(spark, d):
    """G9."""
    files = table(spark, d, "part").select(F.col("p_partkey").alias("id"), star.ident("p", "p_partkey").alias("file_path"), F.lit("file").alias("type"))
    heat = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(star.ident("p", "l_partkey").alias("path")).agg(F.count(F.lit(1)).alias("hotness"))
    return build.attach_hotness(files, heat).select("id", "hotness")


def _concepts(spark, d):
    return table(spark, d, "part").select(F.lit("w").alias("workspace_id"), F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.lower("p_name").alias("normalized_name"), F.col("p_partkey").alias("created_at"))


@query("SELECT p_partkey AS dup_id, lo AS canonical_id FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_type, lower(p_name)) AS lo FROM part) WHERE p_partkey <> lo")
def merge_by_name(spark, d):
    """Parts of one type and name."""
    return resolve.merge_by_name(_concepts(spark, d))


@query("""WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type, lower(p_name)) AS lo FROM part)
SELECT DISTINCT a.lo AS src, b.lo AS dst, 'x' AS type FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
JOIN m a ON a.p_partkey = x.l_partkey JOIN m b ON b.p_partkey = y.l_partkey WHERE a.lo <> b.lo""")
def merge_redirect(spark, d):
    """Edges between neighbouring line items' parts after the merge."""
    merges = resolve.merge_by_name(_concepts(spark, d))
    items = table(spark, d, "lineitem")
    pair = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src")).join(items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"])
    return resolve.apply_merges(_concepts(spark, d), pair.select("src", "dst", F.lit("x").alias("type")), merges)[1]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), star.ident("v", "vec_id").alias("name"), "embedding", "label")


_PAIRS = """p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s
 FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.35")
def near_duplicate_pairs(spark, d):
    """Pairs of one label from a threshold on that the tables' vectors reach."""
    return resolve.similar_pairs(_vectors(spark, d), ["label"], 0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {_PAIRS}, n AS (SELECT b AS id, list(a ORDER BY a) AS earlier, row_number() OVER (ORDER BY b) AS k FROM p WHERE s >= 0.3 GROUP BY b),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone, NULL::BIGINT AS dup_id, NULL::BIGINT AS canonical_id
 UNION ALL SELECT x.k, CASE WHEN x.into_id IS NULL THEN x.gone ELSE list_append(x.gone, x.id) END, CASE WHEN x.into_id IS NOT NULL THEN x.id END, x.into_id
 FROM (SELECT n.k, n.id, r.gone, list_filter(n.earlier, lambda z: NOT list_contains(r.gone, z))[1] AS into_id FROM r JOIN n ON n.k = r.k + 1) x)
SELECT dup_id, canonical_id FROM r WHERE dup_id IS NOT NULL""")
def greedy_merge(spark, d):
    """Who merges into whom, in order."""
    return resolve.greedy_merge(resolve.similar_pairs(_vectors(spark, d), ["label"], 0.3), 0.3)


@query(f"WITH {_PAIRS} SELECT b AS id, count(*) AS flags, min(a) AS first FROM p WHERE s >= 0.4 AND s < 0.9 GROUP BY 1")
def duplicate_flags(spark, d):
    """G13, counted."""
    flags = resolve.duplicate_flags(resolve.similar_pairs(_vectors(spark, d), ["label"], 0.4), 0.9, 0.4)
    return flags.select("id", F.size("possible_duplicates").cast("long").alias("flags"), F.array_min(F.transform("possible_duplicates", lambda x: x.id)).alias("first"))


@query("""WITH b AS (SELECT l_partkey AS k, arg_max(l_quantity, {'a': l_orderkey * 10 + l_linenumber, 'b': l_quantity}) AS v FROM lineitem GROUP BY 1)
SELECT p_partkey AS id, coalesce(v, p_retailprice) AS value FROM part LEFT JOIN b ON k = p_partkey""")
def upsert_last_wins(spark, d):
    """Line items update their part; the last wins."""
    target = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))
    batch = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("value"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_quantity").alias("b")).alias("seq"))
    return sinks.upsert(target, batch, ["id"], "seq")


@query("SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def insert_if_absent(spark, d):
    """Users that no supplier key has."""
    return sinks.insert_absent(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")), ["id"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, d):
    """Orders left when customers in debt are deleted."""
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return sinks.cascade_delete({"orders": table(spark, d, "orders")}, {"orders": "o_custkey"}, gone)["orders"].select("o_orderkey")
