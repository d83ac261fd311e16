import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from codeloom.llm import quality, queries

SMALL = "/root/testdata/sf0.001"


def test_stages_return_documents(spark, edges):
    docs = edges
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert out.columns[:2] == ["doc_id", "start"]


def test_empty(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_decisions_take_effect(spark):
    prose = [f"w{i * 7919 % 1009} and then word{i % 37}x{i}" for i in range(40)]
    base = " ".join(prose)
    stems = ("stone", "river", "winter", "garden", "letter", "bridge", "market", "summer", "window", "silver")
    passage = " ".join(a + b for a in stems[:7] for b in stems)
    near = base.replace("w0 ", "changed ", 1)
    rows = [(1, base, "en", "a", 0), (2, near, "en", "a", 0), (3, "junk " * 50, "en", "a", 0), (4, passage + " first document ends in its own way here and now", "en", "a", 0), (5, "another one starts here, unlike the rest of them all " + passage + " " + " ".join(b + "s" + a for a in stems[:4] for b in stems), "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert {r.doc_id for r in good.collect()} == {1, 2, 4, 5}
    kept = corpus_pipeline.near_duplicates(spark, good, SMALL)
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5}
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, kept, SMALL).collect()}
    assert cut[1] == base and "stonebridge " not in cut[5] and "stonebridge " in cut[4]


def test_run_matches_stages(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.filter("offset + length > 2048").count() == 0 and packed.count() > 50


def _words(text):
    return [w.decode() for w in (text or "").encode().split()]


def _one_of_each(rows, k=5, pct=80):
    """Rows (id, text, source): of each component of near copies the one with the smallest id."""
    sets = {}
    for i, t, _ in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in _words(t)]
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= pct * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [r for r in rows if find(r[0]) == r[0]]


def _cut(rows, k=50):
    first, out = {}, []
    for i, t, _ in sorted(rows):
        w = _words(t)
        for a in range(len(w) - k + 1):
            first.setdefault(tuple(w[a : a + k]), i)
    for i, t, s in rows:
        w = _words(t)
        gone = {p for a in range(len(w) - k + 1) if first[tuple(w[a : a + k])] < i for p in range(a, a + k)}
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t, s))
    return out


def _repeats(rows):
    size = {i: len(_words(t)) for i, t, _ in rows}
    own = defaultdict(int)
    for i, _, s in rows:
        own[s] += size[i]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(own))}
    budget, capped = 1.5 * sum(own.values()), set()
    while True:
        left = budget - sum(2 * own[s] for s in capped)
        target = {s: 2.0 * own[s] if s in capped else left * weight[s] / sum(weight[x] for x in own if x not in capped) for s in own}
        more = {s for s in own if target[s] > 2 * own[s] + 1e-9}
        if not more:
            break
        capped |= more
    out = Counter()
    for s in own:
        whole, upto = int(target[s] // own[s]), 0
        for _, i in sorted((int(hashlib.md5(f"0:{i}:{size[i]}".encode()).hexdigest()[:13], 16), i) for i, _, x in rows if x == s):
            upto += size[i]
            out[i] = whole + (2 * upto - size[i] <= 2 * (target[s] - whole * own[s]))
    return out


def test_run_matches_brute_force(spark, tmp_path):
    """Every stage but the rules' verdict again in plain Python, over a table with planted copies and passages."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(9)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = [r for r in docs.filter("length(text) > 800 and lang = 'en'").orderBy("doc_id").limit(12).collect()]
    passage = " ".join(long[0].text.split()[:70])
    planted = []
    for n, r in enumerate(long[1:]):
        words = r.text.split(" ")
        at = rng.randrange(len(words) // 2)
        text = (r.text, " ".join([*words[:at], "changed", *words[at + 1 :]]), r.text + "\n" + passage)[n % 3]
        planted.append((10_000 + n, text, r.lang, r.source, len(text)))
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_digest(spark.read.parquet(f"{tmp_path}/documents.parquet")).filter("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in table.collect() if r.doc_id in kept]
    single = _one_of_each(rows)
    cut = _cut(single)
    assert len(single) < len(rows) and sum(a[1] != b[1] for a, b in zip(single, cut)) >= 3
    repeats = _repeats(cut)

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: t.encode(text or "", add_special_tokens=False).ids + [1] for i, text, _ in cut}
    starts, tokens, sequences = Counter(), Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        starts[r.doc_id] += r.start == 0
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert +starts == +repeats and all(tokens[i] == repeats[i] * len(x) for i, x in ids.items())
    for spans in map(sorted, sequences.values()):
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and queries.ORACLES.keys() <= queries.QUERIES.keys()
