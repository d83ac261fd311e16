import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    assert entry.entry(spark).limit(3).count() == 3
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 80 and set(sql) <= set(queries)


def test_some_queries_run(spark):
    for name in ("find_symbol_exact", "merge_by_name", "git_insights", "resolution_status", "hybrid_search"):
        assert entry.queries()[name](spark, SMALL).columns
