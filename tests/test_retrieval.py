from pyspark.sql import functions as F

from codeloom.operators import retrieval

SET_A = ["process payment for order with amount and currency", "render dashboard widgets and charts", "handle user authentication via oauth providers", "compute discount applied to order total"]
SET_B = ["foo", "bar baz quux", "OrderService.processPayment validates and charges", "totally unrelated content about cats and dogs"]


def chunks(spark, texts):
    return spark.createDataFrame([(i, t, "doc" if i % 2 else "code", [float(i), 1.0]) for i, t in enumerate(texts)], "chunk_id long, text string, source_type string, embedding array<float>")


def test_hybrid_search(spark):
    a = chunks(spark, SET_A)
    first = retrieval.hybrid_search(a, "payment processing for orders", None, 3).join(a, "chunk_id").orderBy(F.desc("rrf")).first()
    assert "payment" in first.text
    found = retrieval.hybrid_search(chunks(spark, SET_B), "processPayment", [1.0, 0.0], 3)
    assert 2 in [r.chunk_id for r in found.collect()]


def test_empty_and_no_match(spark):
    assert retrieval.hybrid_search(chunks(spark, SET_A).limit(0), "x", [1.0, 0.0]).collect() == []
    assert len(retrieval.hybrid_search(chunks(spark, SET_A), "zzz", [1.0, 0.0], 2).collect()) == 2
    assert retrieval.hybrid_search(chunks(spark, SET_A), "the", None).collect() == []


def test_docs_only(spark):
    found = retrieval.search_docs(chunks(spark, SET_A), "order", [1.0, 0.0])
    assert {r.chunk_id for r in found.collect()} <= {1, 3}


def test_query_syntax(spark):
    df = spark.createDataFrame([(0, "red green blue"), (1, "green red"), (2, "red yellow"), (3, "blue")], "chunk_id long, text string")
    ids = lambda q: sorted(r.chunk_id for r in retrieval.search_text(df, q, 10).collect())
    assert ids("red green") == [0, 1] and ids('"red green"') == [0] and ids("red -green") == [2] and ids("yellow or blue") == [0, 2, 3]


def plain_rank(text, alternatives):
    """Match and rank from places of lexemes, by the public definition of text ranking."""
    import math
    import re

    from test_stem import plain

    found = {}
    for place, w in enumerate([w for w in re.split(r"[\W_]+", text.lower()) if w], 1):
        if w not in retrieval.STOP_WORDS:
            found.setdefault(plain(w), [])
            if len(found[plain(w)]) < 256 and min(place, 16383) not in found[plain(w)]:
                found[plain(w)].append(min(place, 16383))

    def holds(t):
        (first, _), *rest = t.words
        return any(all(p + at in found.get(w, []) for w, at in rest) for p in found.get(first, []))

    if not any(all(holds(t) != t.negated for t in a) for a in alternatives):
        return None
    names = sorted({w for a in alternatives for t in a for w, _ in t.words})
    if len(alternatives) == 1 and len(names) > 1:
        left, pairs = 1.0, 0
        for i, a in enumerate(names):
            for b in names[:i]:
                for p in found.get(a, []):
                    for q in found.get(b, []):
                        if p != q:
                            d, pairs = abs(p - q), pairs + 1
                            left *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
        return 1 - left if pairs else 1e-20
    return sum(0.1 / i**2 for n in names for i in range(1, len(found.get(n, [])) + 1)) / 1.64493406685 / len(names)


def test_rank_against_plain(spark):
    import random

    rnd = random.Random(3)
    vocabulary = "order orders ordering paid payment payments the of running runs connected connection red green".split()
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 40))) for _ in range(80)] + ["", None, "order " * 400 + "payment", "payment. " + "x " * 17000 + "order order run", "Zürich ORDER—run_2"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").cache()
    index = retrieval.text_index(df).cache()
    for q in ["orders", "ordered payment", '"orders the payment"', "order -payment", "run or connecting red", '"red the running" or paid', '-"red green" order', "the of", "run run", "connect OR", "-red"]:
        alternatives = retrieval.prepared(spark, q)
        want = {i: r for i, t in enumerate(texts) if (r := plain_rank(t or "", alternatives)) is not None} if alternatives else {}
        got = {r.chunk_id: r.score for r in retrieval.text_matches(df, q).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 1e-12 + 1e-9 * want[i] for i in got), q
        if q != "-red":
            got = {r.chunk_id: r.score for r in retrieval.search_index(index, q).collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 1e-12 + 1e-9 * want[i] for i in got), q


def test_query_precedence():
    P = lambda *w, no=False: retrieval.Term(tuple(w), no)
    assert retrieval.parse_query('signal or noise filter -"big the cat"') == [[P(("signal", 0))], [P(("noise", 0)), P(("filter", 0)), P(("big", 0), ("cat", 2), no=True)]]
    assert retrieval.parse_query('or the "of" -') == []


def test_rrf_is_order_insensitive(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "chunk_id long, rank int")
    one, two = ({r.chunk_id: round(r.rrf, 12) for r in x.collect()} for x in (retrieval.fuse(a, b), retrieval.fuse(b, a)))
    assert one == two and max(one, key=one.get) == 2


def test_embed_pending(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, "d", [9.0])], "chunk_id long, text string, embedding array<float>")
    done = retrieval.embed_pending(rows, lambda texts: [[float(len(t))] for t in texts])
    assert {r.chunk_id: r.embedding for r in done.collect()} == {1: [3.0], 2: [9.0]}


def test_context_and_citations(spark):
    item = lambda *rows: spark.createDataFrame(rows, "id string, kind string, text string")
    got = retrieval.assemble_context(item(("e1", "entity", "a")), [item(("e1", "entity", "b"), ("e2", "entity", "c"))], item(("c9", "chunk", "z")))
    assert sorted((r.id, r.text, r.source) for r in got.collect()) == [("c9", "z", 2), ("e1", "a", 0), ("e2", "c", 1)]
    u = "01234567-89ab-cdef-0123-456789abcdef"
    messages = spark.createDataFrame([("m", f"[chunk:{u}]"), ("n", "none")], "message_id string, content string")
    assert retrieval.unknown_citations(messages, spark.createDataFrame([], "chunk_id string")).collect()[0].chunk_id == u


def test_nearest_batch_of_more_queries_than_a_block(spark):
    rows = spark.range(60).select(F.col("id").alias("chunk_id"), F.array(F.cos("id").cast("float"), F.sin("id").cast("float")).alias("embedding"))
    asked = rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.distance, 9)) for r in df.collect())
    cut = key(retrieval.nearest_batch(rows, asked, 3, max_queries=20))
    assert len(cut) == 180 and cut == key(retrieval.nearest_batch(rows, asked, 3))


def test_nearest_batch_matches_brute_force_with_ties(spark, monkeypatch):
    import random

    monkeypatch.setattr(retrieval, "QUERY_ROWS", 5)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 9)
    rng = random.Random(6)
    vectors = [None if i % 19 == 0 else [0.0, 0.0] if i % 23 == 0 else [float(rng.randint(-2, 2)) for _ in range(2 + (i % 7 == 0))] for i in range(120)]
    rows = spark.createDataFrame([(f"c{i:03}", v) for i, v in enumerate(vectors)], "chunk_id string, embedding array<float>").repartition(3)

    def distance(x, y):
        n = sum(a * a for a in x) ** 0.5 * sum(a * a for a in y) ** 0.5
        return 1 - (0.0 if len(x) != len(y) or n == 0 else sum(a * b for a, b in zip(x, y)) / n)

    held = [(f"c{i:03}", v) for i, v in enumerate(vectors) if v is not None]
    found = retrieval.nearest_batch(rows, rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), 4).collect()
    want = {(q, c, n) for q, x in held for n, (_, c) in enumerate(sorted((distance(x, y), c) for c, y in held)[:4], 1)}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in found} == want and len(found) == len(want)
    none = rows.limit(0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert retrieval.nearest_batch(rows, none, 4).collect() == []


def test_nearest_batch_twentieth_grows_with_the_table(spark):
    from codeloom.plans import QUERIES

    for sf in ("sf0.001", "sf0.01"):
        n = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").filter("vec_id % 20 = 0").count()
        assert QUERIES["nearest_batch_twentieth"](spark, f"/root/testdata/{sf}").count() == 5 * n


def test_embed_pending_sends_texts_only(spark):
    rows = spark.createDataFrame([(i, "ab" * i if i else None, "other", None) for i in range(130)], "chunk_id long, text string, more string, embedding array<float>")
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts) > 64)
        return [[float(len(t))] for t in texts]

    done = retrieval.embed_pending(rows, model)
    assert "MapInPandas" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r.chunk_id: (r.more, r.embedding) for r in done.collect()} == {i: ("other", [2.0 * i]) for i in range(130)} and calls.value == 0


def test_index_of_some_lexemes(spark):
    df = spark.createDataFrame([(1, "orders paid ordering"), (2, "the payment, red order"), (3, None), (4, "green")], "chunk_id long, text string")
    rows = lambda x: sorted((r.lexeme, r.chunk_id, r.places) for r in x.collect())
    only = retrieval.query_lexemes(spark, "ordered red")
    some = retrieval.text_index(df, only)
    assert rows(some) == [r for r in rows(retrieval.text_index(df)) if r[0] in only] and len(rows(some)) == 3
    assert "SortMergeJoin" not in some._jdf.queryExecution().executedPlan().toString()
