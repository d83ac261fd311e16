import random

import numpy as np
from pyspark.sql import functions as F

from codeloom.operators import activity, corpus, graph, issues
from codeloom.sources import files, sinks


def test_exact_percentiles(spark):
    rnd = random.Random(5)
    groups = {
        "ints": [float(rnd.randrange(50)) for _ in range(999)], "doubles": [rnd.gauss(0, 1) * 10 ** rnd.randrange(-9, 9) for _ in range(1500)], "one": [3.25], "equal": [7.0] * 400,
        "huge": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324], None: [1.0, 2.0, 4.0, 8.0], "skew": [0.0] * 1000 + [1e9, 2e9],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ints", None), ("none", None), ("doubles", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in activity.exact_percentiles(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        vs = sorted(vs)
        for name, q in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            at = q * (len(vs) - 1)
            a, b = vs[int(np.floor(at))], vs[int(np.ceil(at))]
            if g != "huge":
                assert got[g][name] == a + (b - a) * (at - np.floor(at)), (g, name)
    assert (got["huge"].p0, got["huge"].p50, got["huge"].p100) == (-1.7e308, 0.0, 1.7e308)
    assert activity.exact_percentiles(df.limit(0), ["g"], "v", {"p50": 0.5}).count() == 0


def test_trace_rollup_keeps_groups_without_durations(spark):
    rows = [("a", True, 1.0), ("a", False, 3.0), ("b", True, None), (None, True, 5.0)]
    got = {r.op: (r.runs, r.failures, r.failure_rate, r.p50_ms, r.p95_ms) for r in activity.trace_rollup(spark.createDataFrame(rows, "op string, ok boolean, duration_ms double")).collect()}
    assert got == {"a": (2, 1, 0.5, 2.0, 2.9), "b": (1, 0, 0.0, None, None), None: (1, 0, 0.0, 5.0, 5.0)}


def test_public_stats_tell_numbers_from_strings(spark):
    rows = [(1, '{"a": 1, "b": "2", "c": 1.5e3, "d": [1], "e": null, "f": true}'), (2, "[1]"), (3, "broken"), (4, None), (5, "{}")]
    got = {r.id: r.stats for r in activity.public_stats(spark.createDataFrame(rows, "id int, stats string")).collect()}
    assert got == {1: {"a": 1.0, "c": 1500.0}, 2: None, 3: None, 4: None, 5: {}}


def test_merge_stats_json(spark):
    import json

    rows = [('{"a": 1, "b": {"c": 1}}', '{"b": {"d": 2}, "e": "1"}'), (None, '{"a": 1}'), ('{"a": 1}', None), ("x", '{"a": []}')]
    got = [json.loads(r[0]) for r in spark.createDataFrame(rows, "l string, r string").select(sinks.merge_stats_json(F.col("l"), F.col("r"))).collect()]
    assert got == [{"a": 1, "b": {"d": 2}, "e": "1"}, {"a": 1}, {"a": 1}, {"a": []}]


def test_budget_of_one_large_group(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'b', if(id % 11 = 0, null, 'a')) AS g", "id % 7 AS c")
    got = {r.id: (r.spent, r.exhausted) for r in corpus.within_budget(df, F.col("c"), 900, ["id"], ["g"]).collect()}
    spent, want = {}, {}
    for r in df.orderBy("id").collect():
        before = spent.get(r.g, 0)
        spent[r.g] = before + r.c
        if before < 900:
            want[r.id] = (r.g, before)
        last = spent
    over = {g for g in spent if any(w[0] == g for w in want.values()) and max(i for i, w in want.items() if w[0] == g) != max(r.id for r in df.collect() if r.g == g)}
    assert got == {i: (before, g in over) for i, (g, before) in want.items()}


def test_scan_tree_cuts_the_whole_root(spark, tmp_path):
    root = tmp_path / "a" / "src" / "b" / "src"
    (root / "x" / "src").mkdir(parents=True)
    (root / "x" / "src" / "m.py").write_text("x = 1\n")
    (root / "top.py").write_text("y = 1\n")
    for at in (str(root), str(root) + "/", f"file://{root}"):
        assert sorted(r.rel_path for r in files.scan_tree(spark, at).collect()) == ["top.py", "x/src/m.py"]


def test_issues_without_pulls(spark):
    rows = [(i, "open", ["x"], i, "url" if i % 2 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "number int, state string, labels array<string>, updated_at int, pull_request string")
    assert [r.number for r in issues.list_issues(df, limit=99).collect()] == list(range(98, 38, -2))
    assert [r.number for r in issues.list_issues(df, limit=0).collect()] == [98]
    assert issues.list_issues(df, number=3).count() == 0


def test_subgraph_summary_says_when_cut(spark):
    entities = spark.createDataFrame([(i, "a" if i < 8 else "b", None) for i in range(10)], "id int, type string, language string")
    edges = spark.createDataFrame([(0, 9, "calls")], "src int, dst int, type string")
    for limit, cut in ((5, True), (50, False)):
        nodes, _ = graph.subgraph(entities, edges, ["a"], max_nodes=limit)
        got = {r.type: (r.total, r.shown, r.truncated) for r in graph.subgraph_summary(entities, nodes, limit).collect()}
        assert got == {"a": (8, min(8, limit), cut), "b": (2, 0, cut)}
