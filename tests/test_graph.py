import random
from collections import Counter

from pyspark.sql import functions as F

from codeloom.operators import build, graph, resolve
from codeloom.sources import sinks

ENTITIES = [
    ("orderFile", "file", "orders.ts", "src/orders.ts", "src/orders.ts"), ("orderClass", "class", "OrderService", "src/orders.ts::OrderService", "src/orders.ts"),
    ("processPayment", "function", "processPayment", "src/orders.ts::OrderService::processPayment", "src/orders.ts"),
    ("telemetryFile", "file", "telemetry.ts", "src/telemetry.ts", "src/telemetry.ts"), ("logEvent", "function", "logEvent", "src/telemetry.ts::logEvent", "src/telemetry.ts"),
]
EDGES = [("processPayment", "logEvent", "calls"), ("orderFile", "telemetryFile", "imports"), *[(f"f{i}", f"f{i + 1}", "calls") for i in range(7)], ("f5", "f2", "calls"), ("logEvent", "t1", "tested_by")]


def tables(spark):
    e = spark.createDataFrame(ENTITIES, "id string, type string, name string, qualified_name string, file_path string")
    return e, spark.createDataFrame(EDGES, "src string, dst string, type string")


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_find_symbol(spark):
    e, _ = tables(spark)
    ids = lambda *a, **k: [r.id for r in graph.find_symbol(e, *a, **k).collect()]
    assert ids("OrderService") == ["orderClass"]
    assert len(ids("order", fuzzy=True)) >= 2
    assert "orderClass" in ids("Order") and len(ids("Order")) > 1
    assert ids("Order", kind="class") == ["orderClass"]
    assert ids(kind="file") == ["orderFile", "telemetryFile"] and ids() == []


def test_calls(spark):
    _, edges = tables(spark)
    assert [r.id for r in graph.callers(edges, seed(spark, "logEvent")).collect()] == ["processPayment"]
    assert [r.id for r in graph.callees(edges, seed(spark, "processPayment")).collect()] == ["logEvent"]
    found = {r.id: r.depth for r in graph.callees(edges, seed(spark, "f0"), True, 5).collect()}
    assert found == {f"f{i}": i for i in range(1, 6)}
    assert {r.id for r in graph.callees(edges, seed(spark, "f2"), True, 9).collect()} == {"f3", "f4", "f5", "f6", "f7"}
    assert [r.id for r in graph.tests_for(edges, seed(spark, "logEvent")).collect()] == ["t1"]
    assert [r.id for r in graph.tests_for(edges, seed(spark, "t1"), "covered_by").collect()] == ["logEvent"]


def test_traverse_equals_closure(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
    edges = spark.createDataFrame([(a, b, "x") for a, b in pairs], "src long, dst long, type string")
    depth, frontier = {0: 0}, {0}
    for d in range(1, 7):
        frontier = {b for a, b in pairs if a in frontier} - set(depth)
        depth |= dict.fromkeys(frontier, d)
    found = graph.traverse(edges, spark.createDataFrame([(0,)], "id long"), None, "out", 6, None)
    assert {r.id: r.depth for r in found.collect()} == {k: v for k, v in depth.items() if v}


def test_walkthrough_and_diagram(spark):
    e, edges = tables(spark)
    steps = graph.walkthrough(edges, seed(spark, "processPayment"))
    assert [(r.id, r.role) for r in steps.collect()] == [("processPayment", "target"), ("logEvent", "callee")]
    assert graph.sequence_text(steps, e).first().diagram.split("\n") == [
        "sequenceDiagram", "    participant Caller", "    participant processPayment", "    Caller->>+processPayment: invoke",
        "    processPayment->>+logEvent: call", "    logEvent-->>-processPayment: ok", "    processPayment-->>-Caller: return",
    ]


def test_neighbourhood(spark):
    _, edges = tables(spark)
    nodes, inside = graph.neighbourhood(edges, seed(spark, "f3"), 1)
    assert {r.id: r.depth for r in nodes.collect()} == {"f3": 0, "f2": 1, "f4": 1}
    assert inside.count() == 2


def test_resolve_edges(spark):
    e, _ = tables(spark)
    known = e.selectExpr("id", "name", "qualified_name", "1 as seq")
    edges = spark.createDataFrame([(1, "src/orders.ts", "src/telemetry", "x", "imports"), (2, "src/orders.ts", "src/telemetry.ts::logEvent", "logEvent", "calls"), (3, "src/orders.ts", "nope::gone", "LOGEVENT", "calls"), (4, "src/orders.ts", None, "gone", "calls"), (5, "unknown", "src/orders.ts", "y", "imports")], "seq long, from_qualified string, to_qualified string, to_name string, type string")
    assert {(r.seq, r.dst, r.how) for r in build.resolve_edges(edges, known).collect()} == {(1, "telemetryFile", "path"), (2, "logEvent", "exact"), (3, "logEvent", "short")}


def test_resolve_edges_deals_frequent_targets(spark):
    """Edges that share a target, found or not, or a name don't meet in one task, whatever adaptive execution does."""
    known = spark.createDataFrame([("f", "src/f.ts", "main", 1), ("g", "src/g.ts", "Log", 2)], "id string, qualified_name string, name string, seq long")
    share = F.pmod("id", F.lit(4))
    to = F.when(share == 0, "src/g").when(share == 1, "src/g.ts").when(share == 2, "react").otherwise(F.lit(None))
    edges = spark.range(4000).select(F.col("id").alias("seq"), F.lit("src/f.ts").alias("from_qualified"), to.alias("to_qualified"), F.lit("log").alias("to_name"), F.lit("imports").alias("type"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = build.resolve_edges(edges, known, piece_rows=50).select("seq", "dst", "how", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 4000
    assert all((r.dst, r.how) == ("g", ("path", "exact", "short", "short")[r.seq % 4]) for r in rows)
    assert max(Counter(r.part for r in rows).values()) < 1000


def test_name_merge_moves_edges(spark):
    nodes = spark.createDataFrame([("w", "c1", "concept", "order processing", 1), ("w", "c2", "concept", "order processing", 2), ("v", "c3", "concept", "order processing", 1)], "workspace_id string, id string, type string, normalized_name string, created_at long")
    edges = spark.createDataFrame([("k", "c1", "implements_concept"), ("k", "c2", "implements_concept"), ("c1", "c2", "related")], "src string, dst string, type string")
    merges = resolve.merge_by_name(nodes)
    assert [tuple(r) for r in merges.collect()] == [("c2", "c1")]
    left, moved = resolve.apply_merges(nodes, edges, merges)
    assert {r.id for r in left.collect()} == {"c1", "c3"} and [tuple(r) for r in moved.collect()] == [("k", "c1", "implements_concept")]
    again = resolve.apply_merges(left, moved, merges)
    assert again[0].count() == 2 and again[1].collect() == moved.collect()


def _vectors(spark, rows):
    return resolve.earliest_first(spark.createDataFrame([("w", "concept", i, n, v, t) for t, (i, n, v) in enumerate(rows)], "workspace_id string, type string, id string, name string, embedding array<float>, created_at long"))


def test_vector_merge_and_flag(spark):
    v = _vectors(spark, [("a", "a", [1.0, 0.0]), ("b", "b", [1.0, 1e-6]), ("c", "c", [0.8, 0.6]), ("d", "d", [1.0, 0.0, 0.0])])
    pairs = resolve.similar_pairs(v, ["workspace_id", "type"])
    assert [tuple(r) for r in resolve.greedy_merge(pairs).collect()] == [("b", "a")]
    flags = {r.id: [x.id for x in r.possible_duplicates] for r in resolve.duplicate_flags(pairs).collect()}
    assert flags == {"c": ["a", "b"]}


def test_pairs_over_tiles_match_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(i, i % 2 if i % 17 else None, f"n{i % 25}" if i % 9 else None, i, None if i % 13 == 0 else [0.0] * 3 if i % 11 == 0 else [rng.choice((-1.0, 0.5, 1.0)) for _ in range(3 + i % 2)]) for i in range(160)]
    v = spark.createDataFrame(rows, "id long, label int, name string, ord long, embedding array<float>")

    def cosine(x, y):
        n = sum(a * a for a in x) ** 0.5 * sum(a * a for a in y) ** 0.5
        return 0.0 if len(x) != len(y) or n == 0 else sum(a * b for a, b in zip(x, y)) / n

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] != b[2] and a[4] and b[4] and cosine(a[4], b[4]) >= 0.75}
    for tile_rows in (7, 1000):
        found = [(r.a, r.b) for r in resolve.similar_pairs(v, ["label"], 0.75, tile_rows).collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 50
    assert resolve.similar_pairs(v.limit(0), ["label"]).collect() == []


def test_pairs_send_a_row_to_few_tiles(spark, monkeypatch):
    """Small regions share a tile: 300 rows without clusters in 3 tiles, not once for each of the other regions."""
    rng = random.Random(5)
    rows = [(i, 0, f"n{i}", i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, label int, name string, ord long, embedding array<float>")
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    want = {(a[0], b[0]) for a in rows for b in rows[a[0] + 1:] if cosine(a[4], b[4]) >= 0.5}
    monkeypatch.setattr(resolve, "TILE_WIDTH", 1, raising=False)
    monkeypatch.setattr(resolve, "STRIP_ROWS", 7, raising=False)
    found = [(r.a, r.b) for r in resolve.similar_pairs(v, ["label"], 0.5, 100).collect()]
    assert len(found) == len(want) > 100 and set(found) == want
    monkeypatch.setattr(resolve, "_tile_pairs", lambda least: lambda pdf: pdf.assign(a=pdf["id"], b=pdf["id"], ord_a=0, ord_b=0, similarity=1.0)[["a", "b", "ord_a", "ord_b", "similarity"]])
    assert resolve.similar_pairs(v, ["label"], 0.5, 100).count() <= 300 * 4


def test_greedy_merge_matches_a_plain_loop(spark):
    rng = random.Random(6)
    pairs = [(a, b) for b in range(150) for a in range(b) if rng.random() < 0.08]
    into = {}
    for b in range(150):
        first = next((a for a, x in pairs if x == b and a not in into), None)
        if first is not None:
            into[b] = first
    df = spark.createDataFrame([(a, b, a, b, 0.95) for a, b in pairs], "a long, b long, ord_a long, ord_b long, similarity double")
    assert {tuple(r) for r in resolve.greedy_merge(df).collect()} == set(into.items())


def test_greedy_merge_is_not_transitive(spark):
    import math

    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    v = _vectors(spark, [("a", "a", at(0)), ("b", "b", at(20)), ("c", "c", at(40)), ("d", "d", at(60))])
    merged = {tuple(r) for r in resolve.greedy_merge(resolve.similar_pairs(v, ["workspace_id", "type"])).collect()}
    assert merged == {("b", "a"), ("d", "c")}


def test_upsert(spark):
    target = spark.createDataFrame([("k1", "old1", 1), ("k2", "old2", 2), (None, "n", 3)], "key string, id string, v int")
    batch = spark.createDataFrame([("k1", "x", 10, 1), ("k1", "y", 11, 2), ("k3", "z", 12, 3), (None, "m", 13, 4)], "key string, id string, v int, seq int")
    rows = {tuple(r) for r in sinks.upsert(target, batch, ["key"], "seq", "id").collect()}
    assert rows == {("k1", "old1", 11), ("k2", "old2", 2), ("k3", "z", 12), (None, "n", 3), (None, "m", 13)}
    assert {r.key for r in sinks.insert_absent(target, batch.select("key", "id", "v").filter("key is not null"), ["key"]).collect()} == {"k3"}


def test_tested_by_deals_rows_before_its_distinct(spark):
    """A test that imports a file twice counts once; no task builds a table of its input split for that."""
    known = spark.createDataFrame([("f", "function", "src/f.ts", "src/f.ts::main")], "id string, type string, file_path string, qualified_name string")
    found = build.tested_by_edges(spark.createDataFrame([("t", "src/f"), ("t", "src/f.ts"), ("t", "src/f")], "test_file string, target string"), known)
    assert [tuple(r) for r in found.collect()] == [("f", "t", "tested_by")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan.split("HashAggregate(keys=[src", 2)[2] and "Exchange" not in plan.split("HashAggregate(keys=[src", 2)[1]
