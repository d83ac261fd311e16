"""Each operator against a brute-force version, a round trip or held-out accuracy, and on edge cases."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import common, langid, lattice, license_scan, lm_score, mixing, mpeg, packing, quality, sharding, substring

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


OPERATORS = {
    "sharding": sharding.shard_documents, "packing": packing.pack_documents, "quality": quality.quality_digest, "license": license_scan.scan_documents, "mpeg": mpeg.media_digest,
    "mixing": mixing.mix_digest, "substring": substring.substring_digest, "lm": lm_score.score_documents, "langid": langid.identify_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases_and_empty_tables(name, edges, edge_rows, empty):
    found = OPERATORS[name](edges).collect()
    if name == "packing":
        assert sum(1 for r in found if r.start == 0) == len(edge_rows)
    else:
        assert len(found) == len(edge_rows) and sum(r.doc_id is None for r in found) == 1
    assert OPERATORS[name](empty).collect() == []


# 1


def test_difference_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(400)]
    slots = sharding.difference([(s, 0, 0, 0, 0) for s in sizes])
    sums = Counter()
    for s, slot in zip(sizes, slots):
        sums[int(slot[0])] += s
    assert len(sums) == 5 and max(sums.values()) - min(sums.values()) <= 3


def test_shards(docs, rows):
    found = sharding.shard_documents(docs).collect()
    sizes, groups, slots = Counter(), defaultdict(set), defaultdict(list)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes"
        sizes[r.shard] += r.size
        groups[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(g) == 1 for g in groups.values()) and set(sizes) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(Counter({t: sum(len(x[1].encode()) + 8 for x in rows if x[1] == t) for t in set(text.values())}).values())
    assert max(sizes.values()) <= max(largest, 1.02 * sum(sizes.values()) / 24)


def test_shards_match_plain_differencing(spark):
    """Shard sizes are those of repeatedly adding, in opposite order, the two partial partitions of largest spread."""
    rng = random.Random(8)
    texts = ["x" * rng.randint(200, 4000) + str(i) for i in range(60)]
    texts += texts[:9] * 2 + [None, None]
    found = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()
    groups = Counter()
    for t in texts:
        groups[t] += len(t or "") + 8
    parts = [[n, 0, 0, 0, 0] for n in sorted(groups.values(), reverse=True)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        x, y = parts[:2]
        parts = parts[2:] + [sorted((a + b for a, b in zip(x, reversed(y))), reverse=True)]
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    # The two empty rows are a light group, which is laid on after the heavy ones; so are ties of spread.
    assert len(found) == len(texts) and max(abs(a - b) for a, b in zip(sorted(sizes.values(), reverse=True), parts[0])) <= 16


def test_many_bins_stay_balanced(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN", 300)
    monkeypatch.setattr(sharding, "SLOT_CELL", 50)
    rng = random.Random(5)
    texts = [f"{i} " + "x" * int(rng.paretovariate(1.2) * 40) for i in range(3000)]
    found = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    top = max(len(t) + 8 for t in texts)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) <= max(top, mean) * 1.02
    for s in range(8):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


# 2


def test_packing_round_trip(docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r[0]: t.encode(r[1], add_special_tokens=False).ids + [1] for r in rows}
    found = packing.pack_documents(docs).collect()
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, n in ((sorted(covered[i]), len(x)) for i, x in ids.items()):
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(spans[-1]) == n
    for spans in map(sorted, sequences.values()):
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(sequences)) > 0.97


def test_added_tokens_and_odd_texts(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n<|endoftext", "", None, "long " * 30_000, "y" * 9000]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "one"), (None, "two words"), (3, "a second text of an id")]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=4).collect()
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in found)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want.append((i if i is not None else -1, len(ids), a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert have == sorted(want)
    full = [r.sequence_id for r in found if r.length == 2048]
    assert len(set(full)) == len(full) and not {r.sequence_id for r in found if r.length < 2048} & set(full)


def test_tokeniser_cache_agrees_on_odd_spaces():
    tokens = packing.token_bytes("byte_bpe_50k.tiktoken")
    for text in ("a  b", " a b", "a b ", "a \n b", "a\n\nb c", "don't  they've 12 34!? ", " x  y", "tab\tbed x", "é ü <|endoftext|> z", "a b's c"):
        assert tokens.plain(text) == np.array(tokens.encode(text), "<u4").tobytes()


def test_first_fit_decreasing_matches_plain_scan():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    bins, offsets = packing.first_fit_decreasing(np.array(lengths), 100)
    used: list[int] = []
    for n, b, o in zip(lengths, bins, offsets):
        at = next((i for i, u in enumerate(used) if u + n <= 100), len(used))
        used += [0] * (at == len(used))
        assert (at, used[at]) == (b, o)
        used[at] += n


# 3


def _quality(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    hit = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_matches_brute_force(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=common.vocabulary_path("piece_bpe_32k.model"))
    text = {r[0]: r[1] for r in rows}
    for r in quality.quality_digest(docs).collect():
        base = _quality(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0]) and not (r.base_failed and r.kept)
        ids = [i for w in text[r.doc_id].encode().split() for i in sp.encode(w.decode())]
        n = Counter(ids)
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values())
        assert r.n_tokens == len(ids) and abs(r.token_entropy - entropy) < 1e-5 and abs(r.byte_share - sum(map(sp.is_byte, ids)) / len(ids)) < 1e-5


def test_quality_bands(spark):
    good = "The committee read every report in full before it decided what to do about the old bridge near the station."
    junk = " ".join(chr(0x1F300 + i) + chr(0x1F400 + i) for i in range(30))
    df = spark.createDataFrame([(1, good, "en", 1), (2, junk, "en", 1), (3, good, None, 1)], "doc_id long, text string, lang string, n_tokens long")
    assert {r.doc_id: r.kept for r in quality.quality_digest(df).collect()} == {1: True, 2: False, 3: True}
    assert [tuple(r) for r in quality.keep_good(df).orderBy("doc_id").collect()] == [(1, good, "en", 1), (3, good, None, 1)]


def test_quality_fences_of_the_table(spark):
    """Random letters, base64 and a text of another language lie in the fixed bands, but not among the table's texts."""
    rng = random.Random(5)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    words = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(120))
    odd = [(10**9, words("abcdefghijklmnopqrstuvwxyz"), "en"), (10**9 + 1, words("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), "fr")]
    found = quality.quality_digest(table.unionByName(spark.createDataFrame(odd, table.schema))).toPandas().set_index("doc_id")
    assert not found.base_failed[[x[0] for x in odd]].any() and not found.kept[[x[0] for x in odd]].any()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    judged = found[~found.base_failed & (found.n_tokens >= 64)].join(labels, how="inner")
    assert judged.kept[judged.quality == 1].mean() > 0.97 and judged.kept[judged.quality == 0].mean() < 0.5


# 4


def test_license_scan(spark):
    filler = "some words about rivers and bridges that say nothing of terms"
    files = [("a/LICENSE", "Released under the MIT License.\n"), ("a/b/x.txt", filler), ("a/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/c/d/y.txt", filler),
             ("z.txt", filler), ("a/c/d/own.txt", filler + "\nThis work is licensed under the GNU General Public License, version 3."), ("n", None)] + [(f"q/{i}", filler + f" {i}") for i in range(20)]
    df = spark.createDataFrame(files, "path string, text string")
    found = license_scan.inherit(license_scan.detect(df), F.col("path").endswith("LICENSE"))
    got = {r.path: (r.license, r.inherited_from) for r in found.collect()}
    assert got["a/b/x.txt"] == ("MIT", "a") and got["a/c/d/y.txt"] == ("Apache-2.0", "a/c") and got["a/c/d/own.txt"] == ("GPL-3.0", None)
    assert got["z.txt"] == (None, None) and got["n"] == (None, None) and got["a/LICENSE"] == ("MIT", None)


def test_license_bound_loses_nothing():
    model = license_scan.Model(license_scan.TEMPLATES, {"the": 90, "license": 5}, 100)
    rng = random.Random(0)
    words = sorted(model.idf) + ["other", "words"]
    for _ in range(300):
        tf = Counter(rng.choices(words, k=rng.randint(1, 12)))
        norm = math.sqrt(sum((c * model.idf.get(t, model.rare)) ** 2 for t, c in tf.items()))
        best = max(sum(c * model.idf.get(t, 0) * v.get(t, 0) for t, c in tf.items()) / norm for v in model.vectors.values())
        hit = model.best(tf, 0.5)
        assert (hit is not None) == (best >= 0.5) and (hit is None or abs(hit[1] - best) < 1e-9)


def test_license_notices_with_words_around_them(spark):
    notices = {
        "Copyright 2024 Acme Corp. All rights reserved.": "Proprietary", "# Released under the MIT License. See LICENSE for details.": "MIT", "MIT License": "MIT",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "# Licensed under the Apache\n# License, Version 2.0 by Acme\n": "Apache-2.0", "SPDX-License-Identifier: Zlib": None, "one may read of the MIT License in old books": None,
    }
    with open(f"{license_scan.TEXTS}/MPL-2.0.txt") as f:
        notices["Acme widgets\n\n" + f.read() + "\nAcme again"] = "MPL-2.0"
    prose = "mit der and the river by bridges of old stone near a green field"
    texts = [(f"n{i}", f"{prose} {i}\n{x}\n{prose} x{i}") for i, x in enumerate(notices)] + [(f"f{i}", f"{prose} w{i}") for i in range(60)]
    got = {r.path: r for r in license_scan.detect(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert {x: got[f"n{i}"].own_license for i, x in enumerate(notices)} == notices and all(got[f"f{i}"].own_license is None for i in range(60))


def test_license_scores_match_brute_force(spark):
    """Every passage of every text, with the document frequencies of all terms."""
    rng = random.Random(3)
    words = sorted({t for x in license_scan.TEMPLATES.values() for t in license_scan.terms(x)}) + ["river", "stone", "field", "bridge"] * 9
    texts = []
    for i in range(80):
        near = [w for w in license_scan.terms(rng.choice(sorted(license_scan.TEMPLATES.values()))) if rng.random() < 0.9]
        texts.append("\n".join([" ".join(rng.choices(words, k=6)), " ".join([*rng.choices(words, k=2), *near, f"w{i % 7}"]), " ".join(rng.choices(words, k=6))]))
    df = Counter(t for x in texts for t in set(license_scan.terms(x)))
    idf = lambda t: license_scan.weight(len(texts), df[t])
    found = license_scan.detect(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "path string, text string"), license_scan.TEMPLATES)
    got = {int(r.path): (r.own_license, r.own_score) for r in found.collect()}
    matched = 0
    for i, text in enumerate(texts):
        every, best = license_scan.terms(text), (None, 0.0)
        for name, template in sorted(license_scan.TEMPLATES.items()):
            v = Counter(license_scan.terms(template))
            n = min(len(every), sum(v.values()))
            for passage in [every, *map(license_scan.terms, text.split("\n")), *(every[a : a + n] for a in range(len(every) - n + 1))]:
                tf = Counter(passage)
                norm = math.sqrt(sum((c * idf(t)) ** 2 for t, c in v.items()) * sum((c * idf(t)) ** 2 for t, c in tf.items()))
                score = sum(c * tf[t] * idf(t) ** 2 for t, c in v.items()) / norm
                if score >= license_scan.THRESHOLD and score > best[1] + 1e-9:
                    best = (name, score)
        assert got[i][0] == best[0] and abs((got[i][1] or 0.0) - best[1]) < 1e-6
        matched += best[0] is not None
    assert 40 < matched


# 6


def test_mpeg_round_trip(docs, rows):
    text = {r[0]: r[1] for r in rows}
    for r in mpeg.media_digest(docs).collect():
        body = text[r.doc_id].encode()
        padded = body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(body), len(padded), hashlib.sha256(padded).hexdigest()) and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert "crc_bad=0;junk=0" in r.feature and hashlib.sha256(mpeg.build(padded)).hexdigest() == r.media_sha256


def test_mpeg_resynchronises():
    payload = bytes(random.Random(1).choices(b"\xff\xfb\xfa\x00\x90\xe0", k=20_000))
    media = mpeg.build(payload)
    p = mpeg.parse(b"junk\xff\xfbjunk" + media[media.index(b"\xff\xfb") :] + b"tail")
    assert mpeg.payload_of(b"junk\xff\xfbjunk" + media[media.index(b"\xff\xfb") :] + b"tail", p) == payload and p["junk"] == 14
    whole = mpeg.parse(media)
    assert whole["vbr"] == "Xing" and whole["vbr_frames"] == whole["frames"] == whole["crc_ok"] and whole["samples"] == 1152 * whole["frames"] and whole["tags"] == {"TSSE": "payload"}
    broken = bytearray(media)
    broken[whole["offsets"][3] + 10] ^= 1
    assert mpeg.parse(bytes(broken))["crc_bad"] == 1
    assert mpeg.parse(b"")["frames"] == 0 and mpeg.parse(b"\xff" * 1000)["frames"] == 0


def test_mpeg_reads_other_layers(spark):
    layer2 = b"".join(b"\xff\xfd\x84\xc0" + bytes(413 - (i > 999)) for i in range(5))  # 128 kbit/s at 48 kHz would be 384; 44.1 kHz without padding is 417
    frames = [b"\xff\xfd" + bytes([8 << 4 | 0 << 2, 0xC0]) + bytes(417 - 4) for _ in range(5)]
    p = mpeg.parse(b"".join(frames))
    assert p["frames"] == 5 and p["rate"] == 44100 and p["samples"] == 5 * 1152 and layer2[:2] == b"\xff\xfd"
    media = spark.createDataFrame([(1, bytearray(b"".join(frames))), (2, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in mpeg.read_media(media).collect()}
    assert got[1].frames == 5 and got[1].duration_us == 1_000_000 * 5760 // 44100 and got[1].seek_offsets == [0, 417, 834, 1251, 1668] and got[2].frames is None


# 7


def test_mix(docs, rows):
    found = mixing.mix_digest(docs).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    sources = sorted({r[3] for r in rows})
    own = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    budget, capped = 1.5 * sum(own.values()), set()
    while True:
        left = budget - sum(2 * own[s] for s in capped)
        target = {s: 2.0 * own[s] if s in capped else left * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        more = {s for s in sources if target[s] > 2 * own[s] + 1e-9}
        if not more:
            break
        capped |= more
    where = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == own[where[r.doc_id]] and abs(r.target - target[where[r.doc_id]]) < 1e-3 and r.taken <= 2 * r.size
        taken[where[r.doc_id]] += r.taken
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in size if where[i] == s) / 2 + 1e-6
    assert sorted(map(tuple, mixing.mix_digest(docs).collect())) == sorted(map(tuple, found))


def test_mix_buckets_change_nothing(docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix_digest(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert sorted(map(tuple, mixing.mix_digest(docs).collect())) == want
    total = sum(r[4] for r in want)
    assert sum(len((r.text or "").encode().split()) for r in mixing.repeat_rows(docs).collect()) == total


# 8


def _substring(rows, k):
    first = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = {p for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("k", [3, 13])
def test_substrings_match_brute_force(docs, rows, k):
    want = _substring([(r[0], r[1]) for r in rows], k)
    found = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring.dedup_substrings(docs, k).collect()}
    assert found == want


def test_cut_repeats_keeps_rows(spark, edges, edge_rows):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a\n  b " + passage, "s", 2.5, 9), (2, "c  d\n" + passage + " e", None, None, 9), (3, "x\n\n y", "t", 1.0, 9)]
    out = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string, extra double, n_chars long"), 50)
    assert {tuple(r) for r in out.collect()} == {(1, rows[0][1], "s", 2.5, len(rows[0][1])), (2, "c d e", None, None, 5), (3, "x\n\n y", "t", 1.0, 5)}
    assert out.columns == ["doc_id", "text", "source", "extra", "n_chars"]
    assert substring.cut_repeats(edges, 50).count() == len(edge_rows)


def test_cut_repeats_carries_any_type(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, "x " + passage), (3, None)], "doc_id int, text string").selectExpr(
        "doc_id", "text", "timestamp'2024-05-06 07:08:09.123456' AS at", "timestamp_ntz'2024-05-06 07:08:09.654321' AS plain", "map(doc_id, 'v') AS m", "cast('ab' AS binary) AS body",
        "double('NaN') AS x", "float('inf') AS y", "cast(1.5 AS decimal(20, 3)) AS _row", "struct(doc_id AS a, array(date'2020-01-01') AS b) AS kept", "cast(NULL AS string) AS chunk", "interval '1' day AS n_words", "doc_id AS n_removed")
    out = substring.cut_repeats(df, 50)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    others = [c for c in df.columns if c != "text"]
    assert sorted(map(str, out.select(others).collect())) == sorted(map(str, df.select(others).collect()))
    assert {r.doc_id: r.text for r in out.collect()} == {1: passage, 2: "x", 3: None}


# 9 and 10


def _brute_word(vocabulary, word, logp):
    word = lattice.MARK + word
    total = [0.0] * (len(word) + 1)
    total[0] = 1.0
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - vocabulary.longest), j):
            piece = vocabulary.ids.get(word[i:j])
            if piece is not None:
                total[j] += total[i] * math.exp(logp[piece])
            elif j - i == 1:
                total[j] += total[i] * math.exp(sum(logp[vocabulary.bytes[b]] for b in word[i].encode()))
    return total[-1]


def test_lattice_sums_all_segmentations():
    v = lattice.pieces(common.vocabulary_path("piece_bpe_32k.model"))
    logp = np.log(np.where(v.prior > 0, v.prior, 1e-300))
    words = ["the", "unbelievable", "überaus", "x", "☃ok", "abcdefghijklmnopqrstuv", "\U0001f9ff!"]
    got = lattice.word_logprobs(v, words, np.stack([logp, logp - 0.1], 1))
    for w, (a, b) in zip(words, got):
        assert abs(a - math.log(_brute_word(v, w, logp))) < 1e-9 and b < a
    odd = [*words, "\U0001f9ff" * 60, "q" * 300]
    both = [lattice.word_logprobs(v, odd, np.stack([logp, logp - 0.1], 1), scaled=x) for x in (False, True)]
    assert np.allclose(*both, rtol=1e-10)
    counts = lattice.expected_counts(v, words, np.ones((len(words), 1)), logp)
    spelled = counts[v.bytes[v.bytes >= 0], 0].sum()
    covered = sum(counts[i, 0] * len(p.encode()) for p, i in v.ids.items()) + spelled
    assert abs(covered - sum(len((lattice.MARK + w).encode()) for w in words)) < 1e-6 and spelled > 0


def test_lattice_is_fast_on_long_words():
    v = lattice.pieces(common.vocabulary_path("piece_bpe_32k.model"))
    logp = np.log(np.where(v.prior > 0, v.prior, 1e-300))[:, None]
    assert np.isfinite(lattice.word_logprobs(v, ["ab" * 3000], logp)).all()


def test_lm_scores(docs, rows):
    found = {r.doc_id: r for r in lm_score.score_documents(docs).collect()}
    low = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w.decode()) for w in (t or "").encode().split()]
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows}
    c = Counter(w for r in rows if not held[r[0]] for w in low(r[1]))
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    for i, t, _, _ in rows:
        r, w = found[i], low(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert abs(r.base_score - sum(base(c[x]) for x in w) - base(ends)) < 1e-6 and r.score < 0
    # The trained model beats the public prior on held-out text.
    prior = {r.doc_id: r.score for r in lm_score.score_documents(docs, iterations=0).collect()}
    out = [i for i in held if held[i]]
    assert sum(found[i].score for i in out) > sum(prior[i] for i in out)
    assert sum(found[i].edged_score for i in out) > sum(found[i].score for i in out)


def test_lm_matches_brute_force(spark):
    """Without EM rounds: each token's sum over all segmentations under the prior, and with its edge (c + V * L) / (N + V)."""
    texts = [(0, "the bridge the stones"), (1, "the Bridge of ☃"), (2, None), (3, ""), (4, "unseen bridge"), (5, "the the"), (6, "of stones"), (None, "of")]
    v = lattice.pieces(common.vocabulary_path("piece_bpe_32k.model"))
    logp = np.log(np.where(v.prior > 0, v.prior, 1e-300)) + math.log(0.5)
    words = {i: [w.lower() for w in (t or "").split()] for i, t in texts}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in texts}
    c = Counter(w for i in words if not held[i] for w in words[i])
    ends = sum(not h for h in held.values())
    n, kinds = sum(c.values()) + ends, len(c) + 1
    token = lambda k, x: math.log10((k + kinds * x) / (n + kinds))
    found = lm_score.score_documents(spark.createDataFrame(texts, "doc_id long, text string"), iterations=0).collect()
    assert len(found) == len(texts)
    for r in found:
        pieces = [_brute_word(v, w, logp) for w in words[r.doc_id]]
        assert abs(r.score - sum(map(math.log10, pieces)) - math.log10(0.5)) < 1e-6, r
        assert abs(r.edged_score - sum(token(c[w], x) for w, x in zip(words[r.doc_id], pieces)) - token(ends, 0.5)) < 1e-6, r
    # An EM round: each segmentation's share of its word's probability, times the word's count.
    names = {i: w for w, i in v.ids.items()}
    word = lattice.MARK + "of"
    ways = [[word[a:b] for a, b in zip((0, *cut), (*cut, len(word)))] for cut in ((), (1,), (2,), (1, 2))]
    spelled = lambda x: math.exp(sum(logp[v.bytes[b]] for b in x.encode())) if len(x) == 1 else 0.0
    p = [math.prod(math.exp(logp[v.ids[x]]) if x in v.ids else spelled(x) for x in way) for way in ways]
    want = Counter()
    for way, x in zip(ways, p):
        want.update({piece: 3 * x / sum(p) for piece in way} if x else {})
    got = lattice.expected_counts(v, ["of"], np.full((1, 1), 3.0), logp)[:, 0]
    assert {names[i]: round(e, 9) for i, e in enumerate(got) if e and i in names} == {w: round(e, 9) for w, e in want.items() if w in v.ids}


def test_language_held_out_accuracy(docs, rows):
    lang = {r[0]: r[2] for r in rows}
    found = langid.identify_documents(docs).collect()
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.97


def test_language_score_is_no_posterior(docs):
    found = langid.identify_documents(docs).filter("lang_pred <> 'und'").collect()
    assert all(0 < r.score <= 1 for r in found) and sum(r.score < 0.9999 for r in found) > len(found) / 4


def test_language_matches_brute_force():
    """Sums over all segmentations in each language, piece by piece."""
    path = common.vocabulary_path("piece_bpe_32k.model")
    v = lattice.pieces(path)
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(v.size), 3).T)

    def total(text, column):
        if not text:
            return 1.0
        return sum(np.exp(logp[v.ids[text[:n]], column]) * total(text[n:], column) for n in range(1, len(text) + 1) if text[:n] in v.ids)

    for scaled in (False, True):
        got = lattice.word_logprobs(v, ["bridge", "a", "stones"], logp, scaled=scaled)
        want = [[np.log(total(lattice.MARK + w, c)) for c in range(3)] for w in ("bridge", "a", "stones")]
        assert np.allclose(got, want)


def test_mpeg_tags_tables_and_checksums():
    v1 = (b"TAG" + b"Old".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + b"\0" * 30 + b"1999").ljust(128, b"\0")
    frame = lambda name, text: name + struct.pack(">I", len(text)) + b"\0\0" + text
    body = frame(b"TIT2", b"\0caf\xe9") + frame(b"TPE1", b"\x01" + "日本".encode("utf-16")) + frame(b"TALB", b"\x02" + "x".encode("utf-16-be")) + frame(b"TCON", "\x03é".encode())
    tag = b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body
    stream = mpeg.build(b"q" * 4000)
    p = mpeg.parse(tag + stream + v1)
    assert p["tags"] == {"TIT2": "café", "TPE1": "日本", "TALB": "x", "TCON": "é", "TSSE": "payload", "ID3v1.title": "Old", "ID3v1.artist": "Band", "ID3v1.year": "1999"} and p["n_tags"] == 3
    assert p["samples"] == p["frames"] * 1152 and mpeg.payload_of(tag + stream + v1, p) == b"q" * 4000
    # A Layer I stream (32 kbit/s, 32 kHz, mono): the checksum covers the header and 16 bytes of allocation.
    head = b"\xff\xfe\x18\xc0"
    alloc = bytes(range(16))
    length = (12000 * 32 // 32000) * 4
    one = lambda crc: (head + crc.to_bytes(2, "big") + alloc).ljust(length, b"\0")
    good = mpeg.crc16(head[2:] + alloc)
    p = mpeg.parse(one(good) + one(good ^ 1) + one(good))
    assert (p["frames"], p["crc_ok"], p["crc_bad"], p["samples"]) == (3, 2, 1, 3 * 384)
    # An encoder's delay and padding, and a VBRI seek table.
    plain = (b"\xff\xfb" + bytes([5 << 4 | 1 << 2, 0xC0])).ljust(192, b"\0")
    lame = plain[:21] + b"Xing" + struct.pack(">I", 0) + b"LAME3.100" + b"\0" * 12 + bytes([0x24, 0x01, 0x00]) + b"\0" * 40
    p = mpeg.parse(lame.ljust(192, b"\0") + plain * 4)
    assert p["samples"] == 4 * 1152 - 0x240 - 0x100
    vbri = plain[:36] + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 960, 4, 2, 1, 2, 2) + b"\1\2\3\4"
    p = mpeg.parse(vbri.ljust(192, b"\0") + plain * 4)
    assert (p["vbr"], p["vbr_bytes"], p["vbr_frames"], p["toc"]) == ("VBRI", 960, 4, b"\1\2\3\4")


def test_language_und(spark):
    df = spark.createDataFrame([(0, "the cat sat on the mat", "en"), (2, "der Hund lief in das Haus", "de"), (3, "12 34 !?", None), (4, None, "en"), (5, "das Haus", None)], "doc_id long, text string, lang string")
    languages, logp = langid.train(df)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df.withColumn("held_out", F.lit(False)), languages, logp).collect()}
    assert languages == ["de", "en"] and got[3] == got[4] == "und" and got[5] == "de" and got[0] == "en"
