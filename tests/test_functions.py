from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions import vectors as V


def one(spark, make, *values, kind="string"):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {kind}" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_refs_and_excerpts(spark):
    assert one(spark, X.extract_refs, "see `OrderService` and src/a/b.ts, `x`, `a  b`, `OrderService`") == ["OrderService", "src/a/b.ts"]
    assert one(spark, X.excerpt, "# Title\n\n\n```\ncode\n```\n**bold** text") == "Title bold text"
    assert one(spark, lambda c: X.excerpt(c, 8), "abcdefghi") == "abcde…"
    assert one(spark, X.extract_refs, "x/y.ts a/b.zip /c/d.py e/f.md") == ["x/y.ts", "e/f.md"]


def test_fix_refs(spark):
    for word in ("fix", "fixes", "fixed", "close", "closes", "closed", "resolve", "resolves", "resolved", "FIXES"):
        assert one(spark, X.fix_refs, f"{word} #42") == [42]
    for other in ("fixes: #42", "fixes:#42", "#42", "related to #42", "see #42 for context"):
        assert one(spark, X.fix_refs, other) == []
    assert one(spark, lambda c: X.fix_refs(c, "commit"), "fixes #421") == [421]
    assert one(spark, lambda c: X.fix_refs(c, "pull"), "closes #7x, closes #8.") == [8]


def test_commit_types(spark):
    assert one(spark, X.conventional_type, "fix(parser)!: y") == "fix"
    assert one(spark, X.is_breaking, "fix(x)!: y") and one(spark, X.is_breaking, "feat: a\n\nBREAKING CHANGE: z") and not one(spark, X.is_breaking, "feat: a")
    assert one(spark, X.conventional_type, " Feat_2 : a") == "feat_2" and one(spark, X.conventional_type, "no type") == ""


def test_citations(spark):
    u = "01234567-89ab-cdef-0123-456789abcdef"
    assert one(spark, X.extract_citations, f"a [chunk:{u}] b [entity:{u.upper()}] [chunk:{u}] [chunk:bad]") == [f"[chunk:{u}]", f"[entity:{u}]"]
    assert one(spark, X.cited_entity_ids, f"[entity:{u}] [chunk:{u}]") == [u]


def test_diffs(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+++ /dev/null"
    assert one(spark, X.diff_paths, diff) == ["x.py"]
    assert one(spark, X.contains_diff, diff) and not one(spark, X.contains_diff, "plain")


def test_small_functions(spark):
    assert one(spark, X.truncate_marked.__get__(4) if False else (lambda c: X.truncate_marked(c, 4)), "abcdefg") == "abcd… [truncated 3 chars]"
    assert [one(spark, lambda c: X.clamp(c, 50, 20), v) for v in ("7", "99", "0", "x", None)] == [7, 50, 1, 20, 20]
    assert [one(spark, X.normalize_path, v) for v in ("./a/b", "/a/b", "a/b")] == ["a/b"] * 3
    assert [one(spark, X.folder2, v) for v in ("a/b/c.ts", "a", "")] == ["a/b", "a", "(root)"]
    assert one(spark, X.sanitize_label, 'a "b"\n[c]') == "a__b___c_" and one(spark, X.sanitize_label, "") == "unknown"
    assert one(spark, X.escape_like, r"50%_\x") == r"50\%\_\\x"
    assert one(spark, X.make_targets, "build: a\n\tx\ntest:\n.PHONY: x\n_v:= 1\nbuild: b") == ["build", "test", "_v"]
    assert one(spark, X.readme_quickstart, "# A\nx\n## Quick start\nrun it\n## Next\ny") == "run it"
    assert one(spark, X.readme_quickstart, "# A\n## Usage notes\n" + "u" * 900) == "u" * 799 and one(spark, X.readme_quickstart, "# About usage\nx") is None
    assert [one(spark, X.package_manager, v) for v in ("pnpm@9", "yarn@4", "bun@1", "npm@10", "")] == ["pnpm", "yarn", "bun", "npm", "npm"]
    assert all(one(spark, X.is_excluded_path, p) for p in ("Tests/a.ts", "a/x.test.tsx", "a_test.go", "b/test_a.py", "vite.config.ts", "a/Package.json", "x.min.css", "poetry.lock"))
    assert not any(one(spark, X.is_excluded_path, p) for p in ("docs/a.md", "examples/a.ts", "a/x.d.ts", "CHANGELOG.md"))
    assert one(spark, X.is_excluded_path, "node_modules/a.js") and not one(spark, X.is_excluded_path, "src/a.js")
    assert one(spark, X.json_field, None) if False else one(spark, lambda c: X.json_field(c, "$.k", "long", -1), '{"k": "x"}') == -1
    assert one(spark, X.first_line, " a\nb") == "a"


def test_sse_blocks(spark):
    r = one(spark, X.parse_sse, "event: done\ndata: a\ndata:b")
    assert (r.event, r.data, r.has_data) == ("done", "a\nb", True)
    r = one(spark, X.parse_sse, ": comment")
    assert (r.event, r.data, r.has_data) == ("message", "", False)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.8, 0.6]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r.c, 6) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.8, 0.0, 0.0]
    e = one(spark, V.hash_embedding, "x")
    assert len(e) == 64 and abs(sum(x * x for x in e) - 1) < 1e-9 and e == one(spark, V.hash_embedding, "x")


def test_costs(spark):
    price = lambda v: one(spark, lambda c: V.micro_cents(c, 15), v, kind="long")
    assert (price(1_000_000), price(None), price(-5), price(3)) == (150_000, 0, 0, 0)
    assert one(spark, V.token_estimate, "abcde") == 2 and one(spark, V.token_estimate, None) == 0


def test_trim_result(spark):
    import json

    rows = [(json.dumps({"a": list(range(40)), "b": {"s": "x" * 5000, "l": ["y" * 5000, {"t": "z" * 4001}]}, "c": None}),), ('"' + "s" * 5000 + '"',), ("no json",), (None,), ("[[1, 2], 3]",)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(X.trim_result(F.col("d"))).collect()]
    first = json.loads(got[0])
    assert first["a"] == list(range(30)) and first["b"]["s"] == "x" * 4000 + "… [truncated]" and first["b"]["l"] == ["y" * 5000, {"t": "z" * 4000 + "… [truncated]"}] and first["c"] is None
    assert got[1:] == ['"' + "s" * 5000 + '"', None, None, "[[1,2],3]"]


def test_hash_embedding_against_plain(spark):
    import hashlib
    import math

    for dims in (64, 40):
        got = one(spark, lambda c: V.hash_embedding(c, dims), "Some Name")
        digest = hashlib.sha256(b"some name").digest()
        raw = [digest[i % 32] / 255 * 2 - 1 + math.sin(i * 0.013) for i in range(dims)]
        norm = math.sqrt(sum(x * x for x in raw))
        assert len(got) == dims and all(abs(x - y / norm) < 1e-12 for x, y in zip(got, raw))


def test_hash_embedding_uses_every_core(spark):
    import __spark_entry__ as entry

    found = entry.queries()["hash_embedding"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
