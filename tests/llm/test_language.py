"""The language query against a version without Spark, numpy's recursion or any table of spans."""

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from codeloom.llm import common, langid, lattice

PATH = common.vocabulary_path("piece_bpe_32k.model")


def plain(rows):
    v = lattice.pieces(PATH)
    held = {i: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 1 for i, r in enumerate(rows)}
    words = [[w.decode() for w in (r[1] or "").lower().encode().split()] for r in rows]
    counts = defaultdict(Counter)
    for i, r in enumerate(rows):
        if not held[i] and r[1] is not None and r[2] is not None:
            counts[r[2]].update(words[i])
    languages = sorted(k for k, c in counts.items() if c)

    def spans(word, p):
        """(start, end, pieces, probability) of every edge of a word's lattice; characters outside the vocabulary are spelled in bytes."""
        word = lattice.MARK + word
        out = []
        for a in range(len(word)):
            for b in range(a + 1, len(word) + 1):
                x = word[a:b]
                if x in v.ids:
                    out.append((a, b, [v.ids[x]], p[v.ids[x]]))
                elif b == a + 1:
                    ids = [v.bytes[c] for c in x.encode()]
                    out.append((a, b, ids, math.prod(p[i] for i in ids)))
        return out, len(word)

    def forward(edges, n):
        @lru_cache(None)
        def upto(j):
            return 1.0 if j == 0 else sum(upto(a) * q for a, b, _, q in edges if b == j)

        @lru_cache(None)
        def after(i):
            return 1.0 if i == n else sum(after(b) * q for a, b, _, q in edges if a == i)

        return upto, after

    models = {}
    for k in languages:
        e = defaultdict(float)
        for w, c in counts[k].items():
            edges, n = spans(w, v.prior)
            upto, after = forward(edges, n)
            for a, b, ids, q in edges:
                for i in ids:
                    e[i] += c * upto(a) * q * after(b) / upto(n)
        total = sum(e.values())
        models[k] = {i: (e[i] + langid.SMOOTHING * v.prior[i]) / (total + langid.SMOOTHING) for i in range(v.size)}
    out = []
    for i, r in enumerate(rows):
        if not languages or not any(map(str.isalpha, r[1] or "")):
            out.append((r[0], held[i], "und", 0.0))
            continue
        logs = []
        for k in languages:
            total = 0.0
            for w in words[i]:
                edges, n = spans(w, models[k])
                total += math.log(forward(edges, n)[0](n))
            logs.append(total)
        best = max(logs)
        out.append((r[0], held[i], languages[logs.index(best)], 1 / sum(math.exp((x - best) / len(words[i])) for x in logs)))
    return out


ROWS = [
    (0, "the cat sat on the mat", "en"), (1, "The dog ran home", "en"), (2, "der Hund lief in das Haus", "de"), (3, "die Katze saß auf dem Dach", "de"), (4, "le chat est ici", "fr"),
    (5, None, "fr"), (6, "12 34 !?", None), (7, "", "en"), (8, "le chien et la maison", None), (9, "das Haus", None), (10, "house", "xx"), (11, "☃ snow ☃", "en"), (12, "le chat est ici", "fr"),
    (None, "the house", "en"), (14, "the house", "aa"), (14, "the house", "aa"), (15, "THE HOUSE", "en"), (16, "la maison est la", "fr"), (17, "der Hund", "de"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("block", [1, 2, langid.MAX_LANGUAGES])
def test_language_query_matches_plain(spark, block):
    """Blocks of languages give what all at once give; nulls, ties, repeated rows and odd characters included."""
    folded = spark.createDataFrame(ROWS, SCHEMA).withColumn("held_out", langid.fold(3) == 1)
    got = sorted([tuple(r) for r in langid.identify(folded, folded.filter("not held_out"), block=block).collect()], key=str)
    want = sorted(plain(ROWS), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-9)


def test_language_query_without_labels(spark):
    rows = [(i, "some words", None) for i in range(5)]
    assert {tuple(r)[2:] for r in langid.identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("languages", [60, 512])
def test_memory_does_not_grow_with_languages(languages):
    v = lattice.pieces(PATH)
    logp = np.broadcast_to(np.log(np.where(v.prior > 0, v.prior, 1e-300))[:, None], (v.size, languages))
    words = ["".join(chr(0x4E00 + (i * 37 + j * 11) % 3000) for j in range(200)) for i in range(40)]
    tracemalloc.start()
    found = lattice.word_logprobs(v, words, logp, scaled=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (40, languages) and np.isfinite(found).all() and peak < 600e6
