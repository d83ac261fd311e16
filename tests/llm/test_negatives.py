import math
import random

import numpy as np

from codeloom.functions import angles
from codeloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, score int, n string"


def brute(rows):
    held = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, row), row)
    out = []
    for a in (i for i in held if i % 50 == 0):
        label, v = held[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, k) for i, (k, w) in held.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, r, i, -s, -y) for r, (y, i, _) in enumerate(inside, 1)]
    return sorted(out)


def table(n, dim, seed, clusters=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    picks = [rnd.randrange(clusters) for _ in range(n)]
    return [(i, [c * 0.2 + rnd.gauss(0, 0.1) for c in centres[k]], k % 4, 0, "x") for i, k in enumerate(picks)]


def test_negatives_against_brute_force(spark):
    rows = table(700, 8, 1)
    same = rows[20][1]
    rows += [(1000 + i, same, i % 3, 1, None) for i in range(60)]  # ties, and anchors among copies
    rows += [(1101, None, 1, 0, "x"), (1150, [0.1] * 8, None, 0, "x"), (1200, [float("nan")] + [0.1] * 7, 1, 0, "x"), (1250, [float("inf")] + [0.1] * 7, 1, 0, "x"),
             (1300, [None] + [0.1] * 7, 1, 0, "x"), (None, [0.1] * 8, 1, 0, "x"), (1350, [0.0] * 8, 1, 0, "x"), (1400, [0.3] * 5, 2, 0, "x"), (1401, [0.2] * 5, 2, 0, "x"),
             (1402, [0.15] * 5, 1, 0, "x"), (1450, [], 1, 0, "x"), rows[50], rows[50], (100, [0.5] * 8, 0, 0, "x")]
    got = N.negatives_digest(spark.createDataFrame(rows, SCHEMA), tile_rows=37, block_rows=3)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


def test_negatives_empty_and_single(spark):
    assert N.negatives_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.negatives_digest(spark.createDataFrame([(0, [0.1, 0.2], 1, 0, "x")], SCHEMA)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    x = np.repeat(base, 50, 0) * rng.uniform(0.1, 4, (300, 1)) + 0.05 * rng.normal(size=(300, 16))
    x[0] = 0
    x[1] = -x[2]
    norms, seen = angles.to_directions(x, base / np.linalg.norm(base, axis=1)[:, None])
    low, high = angles.cosine_bounds(seen, seen)
    with np.errstate(invalid="ignore"):
        true = (x @ x.T) / np.outer(norms, norms)
    ok = np.isfinite(true)
    assert (low[ok] <= true[ok] + 1e-12).all() and (high[ok] >= true[ok] - 1e-12).all()
    assert (high[ok] < 0.9).mean() > 0.5
    cap = angles.cap_bounds(seen, seen[51:99].min(0)[None, :], seen[51:99].max(0)[None, :])[:, 0]
    assert (cap[3:] >= true[3:, 51:99].max(1) - 1e-12).all() and (cap < 0.9).mean() > 0.5


def test_only_overlapping_rows_are_scored(spark, monkeypatch):
    """On clustered rows most pairs are told apart by their bounds alone."""
    scored = []
    real = N._products
    monkeypatch.setattr(N, "_products", lambda a, rows: (scored.append(len(rows)), real(a, rows))[1])
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12)) * 60
    vectors = (np.repeat(centres, 60, 0) + rng.normal(size=(480, 12)) * 2).astype(np.int32)
    norms, seen = angles.to_directions(vectors.astype(float), centres / np.linalg.norm(centres, axis=1)[:, None])
    import pandas as pd

    row = N._packed(12, np.arange(480), np.repeat(np.arange(8), 60), vectors, norms, seen, np.arange(480) % 10 == 0)
    tile = N.Pack(row)
    block = N._packed(12, *tile.rows(np.flatnonzero(tile.marks)))
    frame = pd.DataFrame([row | {f"b_{k}": v for k, v in block.items()}])
    out = pd.concat(N._find_positives(5)(iter([frame])))
    assert len(out) == 48 * 5 and sum(scored) < 48 * 480 / 8
