import random
from types import SimpleNamespace

import numpy as np
import pytest

from codeloom.llm import jaccard
from codeloom.llm.components import connected


def words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, pct):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, k))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for base_size, copies, edits in ((60, 40, 3), (120, 30, 6), (25, 20, 1), (12, 12, 1), (8, 10, 1), (200, 25, 12), (6, 8, 1)):
        base = [rng.choice(vocabulary) for _ in range(base_size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w))
                roll = rng.random()
                if roll < 0.4:
                    w[at] = rng.choice(vocabulary)
                elif roll < 0.7:
                    del w[at]
                else:
                    w.insert(at, rng.choice(vocabulary))
                if len(w) < 2:
                    break
            rows.append((n, " ".join(w) if rng.random() < 0.8 else "  ".join(w).upper()))
            n += 1
    for _ in range(30):
        rows.append((n, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "shingle", "pct", "frequent"), [(1, 4, 85, 256), (2, 4, 85, 3), (3, 5, 80, 4), (4, 2, 80, 2), (5, 1, 85, 5)])
def test_components_match_brute_force(spark, seed, shingle, pct, frequent):
    rows = corpus(seed)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle, pct, frequent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, shingle, pct)


def test_edge_cases(edges, edge_rows, empty):
    found = [tuple(r) for r in jaccard.near_duplicates(edges).collect()]
    assert len(found) == len(edge_rows)
    want = brute([(i if i is not None else 1 << 60, r[1]) for r in edge_rows for i in [r[0]]], 4, 85)
    for doc_id, n, component in found:
        assert (n, component) == want[doc_id if doc_id is not None else 1 << 60]
    assert jaccard.near_duplicates(empty).collect() == []


def test_long_chain_of_links(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 103), (7, 7)]
    random.Random(0).shuffle(links)
    found = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("pct", [80, 85])
def test_linkable_sizes_share_a_band_scheme(pct):
    sizes = np.arange(1, 3000)
    band = jaccard.size_bands(sizes, pct)
    for n in range(1, 2400):
        assert band[n * 100 // pct - 1] - band[n - 1] <= 1


def test_keys_grow_in_proportion_to_a_text_of_frequent_shingles():
    rng = np.random.default_rng(0)
    found = []
    for n in (2_000, 20_000):
        one = SimpleNamespace(hash=rng.integers(0, 1 << 63, n, dtype=np.uint64), doc=np.zeros(n, np.int64), size=np.array([n]), nodes=np.array([0]))
        found.append(len(jaccard._keys(one, np.full(n, 20, np.uint8), 85, 9)[0]))
    assert found[0] < 4_000 and found[1] < 12 * found[0]


def test_texts_of_one_id_stay_apart(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(12))
    rows = [(None, one), (None, two), (7, one + " x"), (3, two), (3, one), (3, one)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found.collect()) == [(0, 9, 3), (0, 27, 3), (3, 9, 3), (3, 27, 3), (3, 27, 3), (7, 28, 3)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(tuple(r) for r in kept) == [(3, one), (3, two)]


def families(n, size=250, passage=100):
    """Two families; n near copies of each have a passage in common, six times as many don't, so the passage's words are the rarer ones."""
    rng = random.Random(7)
    fresh = (f"v{i}" for i in range(10**9))
    shared = [next(fresh) for _ in range(passage)]
    rows = []
    for _ in range(2):
        base = [next(fresh) for _ in range(size)]
        for k in range(7 * n):
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(size)] = next(fresh)
            rows.append((len(rows), " ".join(w[:120] + (shared if k < n else []) + w[120:])))
    return rows


def test_families_that_share_a_passage_cost_their_own_size(spark, monkeypatch):
    """Pairs of one component are never made, however many documents of it lie outside a centre's."""
    seen = {}
    real = jaccard._met_by_deltas

    def met(deltas, label, pct):
        x, y = jaccard._entries(deltas, label, pct)
        seen["x"], seen["pairs"] = x.count(), jaccard._component_pairs(x, y, pct).count()
        out = real(deltas, label, pct)
        seen["met"] = out.count()
        return out

    monkeypatch.setattr(jaccard, "_met_by_deltas", met)
    figures = []
    for n in (24, 48):
        rows = families(n)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        if n == 24:
            assert got == brute(rows, 4, 85)
        assert len({c for _, c in got.values()}) == 4
        figures.append(dict(seen))
    assert figures[0]["x"] > 0 and figures[1]["x"] < 3 * figures[0]["x"]
    assert figures[1]["pairs"] <= 2 * figures[0]["pairs"] + 10 and figures[1]["met"] <= 2 * figures[0]["met"] + 10
