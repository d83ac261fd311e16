import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import angles
from codeloom.operators import neighbours, resolve


def clustered(n, dim, clusters, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [[float(x) for x in centres[i % clusters] * rng.uniform(0.2, 3) + spread * rng.normal(size=dim)] for i in range(n)]


def cosine(x, y):
    n = (sum(a * a for a in x) * sum(a * a for a in y)) ** 0.5
    return 0.0 if len(x) != len(y) or n == 0 else sum(a * b for a, b in zip(x, y)) / n


def odd_rows():
    rows = clustered(260, 6, 9, 1)
    return rows + [[0.0] * 6, None, [], rows[3], rows[3], [-x for x in rows[3]], [1.0, 2.0], [2.0, 1.0], [0.5] * 6, [0.0, 0.0]]


@pytest.mark.parametrize("tile_rows,limit", [(7, 4), (40, 30), (1000, 3), (7, 400)])
def test_nearest_is_exact(spark, tile_rows, limit):
    rows = odd_rows()
    df = spark.createDataFrame(list(enumerate(rows)), "chunk_id long, embedding array<float>").repartition(5)
    vectors = {r.chunk_id: r.embedding for r in df.collect()}
    asked = df.filter("chunk_id % 6 = 0 or chunk_id >= 255").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = neighbours.nearest(df, asked, limit, tile_rows).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], round(r.distance, 9), r.chunk_id))
    for q in (r.query_id for r in asked.collect()):
        if vectors[q] is None:
            assert q not in got
            continue
        far = sorted((1 - cosine(vectors[q], v), c) for c, v in vectors.items() if v is not None)
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, min(limit, len(far)) + 1))
        assert np.allclose([x[1] for x in mine], [d for d, _ in far[:limit]], atol=1e-8)
        worst = far[min(limit, len(far)) - 1][0]
        assert {c for d, c in far if d < worst - 1e-8} <= {x[2] for x in mine}


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id string, embedding array<float>")
    asked = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert neighbours.nearest(df.limit(0), asked, 3).count() == 0 and neighbours.nearest(df, asked.limit(0), 3).count() == 0
    assert neighbours.nearest(df, asked, 3).count() == 1


def test_regions_that_cannot_meet_are_left_out(spark):
    rows = clustered(600, 8, 12, 2)
    df = spark.createDataFrame([(i, v, "g") for i, v in enumerate(rows)], "id long, vector array<double>, block string")
    pivots = angles.sampled(df, "id", "vector", neighbours.PIVOTS)
    placed = neighbours.in_regions(df, pivots, ["block"], 10)
    pairs = neighbours.region_pairs(placed, len(pivots), ["block"], 0.9)
    regions = placed.select("region").distinct().count()
    joined = {tuple(map(str, r)) for r in pairs.select("a_region", "b_region").collect()}
    assert len(joined) < 0.4 * regions * (regions + 1) / 2
    where = {r.id: r.region for r in placed.collect()}
    for i, x in enumerate(rows):
        for j in range(i):
            if cosine(x, rows[j]) >= 0.9:
                assert tuple(map(str, sorted([where[i], where[j]]))) in joined


@pytest.mark.parametrize("tile_rows", [5, 50, 5000])
def test_similar_pairs_are_exact(spark, tile_rows):
    rnd = random.Random(4)
    rows = [v if v else None for v in odd_rows()]
    held = [(i, i, f"n{rnd.randrange(200)}", v, rnd.choice(["p", "q", None])) for i, v in enumerate(rows)]
    df = spark.createDataFrame(held, "id long, ord long, name string, embedding array<double>, label string")
    got = sorted((r.a, r.b) for r in resolve.similar_pairs(df, ["label"], 0.9, tile_rows).collect())
    want = [(a[0], b[0]) for a in held for b in held if a[1] < b[1] and a[4] and a[4] == b[4] and a[3] and b[3] and a[2] != b[2] and cosine(a[3], b[3]) >= 0.9]
    assert got == sorted(want) and len(want) > 500
