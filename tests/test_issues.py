import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeloom.operators import activity, issues, overview
from codeloom.sources import files

NOW = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def none(spark):
    return {
        "commits": spark.createDataFrame([], "number long, sha string"), "pulls": spark.createDataFrame([], "number long, pr long, open boolean, draft boolean, merged boolean, stale boolean"),
        "similar": spark.createDataFrame([], "number long, other long, state string, similarity double"),
    }


PR = dict(pr=100, open=True, draft=False, merged=False, stale=False)
DUP = dict(other=41, state="closed", similarity=0.9)


@pytest.mark.parametrize(("commit", "pulls", "similar", "want"), [
    (False, [], [], ("none", "low")), (True, [PR], [DUP], ("merged", "high")), (False, [PR], [], ("open_pr", "medium")), (False, [PR, PR | {"pr": 101, "draft": True}], [], ("open_pr", "medium")),
    (False, [PR | {"draft": True}], [], ("draft_pr", "medium")), (False, [PR | {"stale": True}], [], ("stale_pr", "low")), (False, [], [DUP], ("duplicate_closed", "medium")),
    (False, [], [DUP | {"similarity": 0.8}], ("related", "low")), (False, [], [DUP | {"state": "open"}], ("related", "low")), (False, [PR | {"open": False, "merged": True}], [], ("none", "low")),
])
def test_status_ladder(spark, none, commit, pulls, similar, want):
    c = spark.createDataFrame([(1, "abc")], "number long, sha string") if commit else none["commits"]
    p = spark.createDataFrame([(1, x["pr"], x["open"], x["draft"], x["merged"], x["stale"]) for x in pulls], none["pulls"].schema) if pulls else none["pulls"]
    s = spark.createDataFrame([(1, x["other"], x["state"], x["similarity"]) for x in similar], none["similar"].schema) if similar else none["similar"]
    r = issues.find_resolution(spark.createDataFrame([(1,)], "number long"), c, p, s).first()
    assert (r.status, r.confidence) == want and (r.reason is None) == (want[0] != "none")


def test_list_issues_falls_back_without_labels(spark):
    rows = spark.createDataFrame([(1, "open", ["bug"], 1), (2, "open", ["bug", "ui"], 2), (3, "closed", ["ui"], 3)], "number long, state string, labels array<string>, updated_at long")
    ids = lambda **k: [r.number for r in issues.list_issues(rows, **k).collect()]
    assert ids(labels=["bug", "ui"]) == [2] and ids(labels=["bug", "ui"], match="any") == [2, 1] and ids(labels=["none"]) == [2, 1] and ids(number=3) == [3]


def test_links_by_name_and_path(spark):
    rows = spark.createDataFrame([(1, "crash in `OrderService`", "see src/orders.ts")], "number long, title string, body string")
    ents = spark.createDataFrame([("c", "OrderService", "q", "a/src/orders.ts"), ("x", "Other", "r", "b/xsrc/orders.ts")], "id string, name string, qualified_name string, file_path string")
    edges = spark.createDataFrame([("z", "c", "calls")], "src string, dst string, type string")
    assert [(r.number, r.id, r.degree) for r in issues.issue_links(rows, ents, edges).collect()] == [(1, "c", 1)]


def test_bus_factor(spark):
    factor = lambda *n: activity.bus_factor(spark.createDataFrame([(f"a{i}",) for i, k in enumerate(n) for _ in range(k)], "author string")).first()[0]
    assert factor(5, 3, 1, 1) == 1 and factor(3, 3, 2, 2) == 2 and factor() == 0


def test_insights_of_nothing(spark):
    r = activity.git_insights(spark.createDataFrame([], "author string, ts timestamp, message string"), F.lit(NOW)).first()
    assert (r.commits, r.fixes, r.fix_feat_ratio, r.bus_factor) == (0, 0, None, 0)


def test_insights(spark):
    rows = [("a", NOW, "fix(x)!: y"), ("a", NOW - dt.timedelta(40), "feat: a\n\nBREAKING CHANGE: z"), ("b", NOW - dt.timedelta(100), "fix: old")]
    r = activity.git_insights(spark.createDataFrame(rows, "author string, ts timestamp, message string"), F.lit(NOW)).first()
    assert (r.commits, r.commits_30d, r.commits_90d, r.active_authors, r.fixes, r.features, r.fix_feat_ratio, r.breaking, r.bus_factor) == (3, 1, 2, 1, 2, 1, 2.0, 2, 1)


def test_diffs(spark):
    raw = "diff --git a/x b/x\n--- a/x\n+++ b/x\n+1\ndiff --git a/y b/z\n+2\n"
    parts = files.split_diffs(spark.createDataFrame([("s", raw)], "sha string, raw string"))
    assert [(r.pos, r.file_path) for r in parts.orderBy("pos").collect()] == [(0, "x"), (1, "z")]
    capped = files.cap_diffs(parts, per_file=10, per_commit=130, header=80).collect()
    assert len(capped) == 1 and capped[0].elided == 1 and "truncated" in capped[0].diff


def test_scan_and_flags(spark, tmp_path):
    for name, text in (("src/a.ts", "x"), ("node_modules/b.ts", "x"), ("pic.dylib", "x"), ("README.md", "# hi")):
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    found = files.scan_tree(spark, str(tmp_path / "repo"))
    assert sorted(r.rel_path for r in found.collect()) == ["README.md", "src/a.ts"]
    listed = {".gitignore": "*.log\n/tmp/\n# note\n!keep.log\n", "a.log": "x", "src/b.log": "x", "src/keep.log": "x", "tmp/x.ts": "x", "src/tmp/x.ts": "x", "src/.gitignore": "gen/**\nsrc/own.ts", "src/own.ts": "x", "own.ts": "x", ".idea/x": "x", "A.MAP": "x"}
    rows = spark.createDataFrame([(p, len(t), bytearray(t.encode())) for p, t in listed.items()], "rel_path string, size_bytes long, content binary")
    assert sorted(r.rel_path for r in files.keep_files(rows).collect()) == [".gitignore", "own.ts", "src/.gitignore", "src/keep.log", "src/tmp/x.ts"]
    r = spark.createDataFrame([("a.tsx", "go.mod", "\x01\x02\x03ab")], "p string, m string, t string").select(files.language_of(F.col("p")), files.manifest_languages(F.col("m")), files.looks_binary(F.col("t"))).first()
    assert tuple(r) == ("typescript", ["go"], True)


def test_directory_rollup(spark):
    rows = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("z", 4)], "path string, n long")
    found = {r.dir: (r.n, r.depth) for r in overview.directory_rollup(rows, {"n": F.sum("n")}).collect()}
    assert found == {"": (7, 0), "a": (3, 1), "a/b": (1, 2)}


def test_entry_points_and_setup(spark):
    manifest = '{"main": "./dist/i.js", "bin": {"cli": "./bin/c.js"}, "scripts": {"dev": "x", "test": "y"}}'
    m = spark.createDataFrame([("package.json", manifest), ("sub/package.json", '{"main": "no.js"}')], "file_path string, text string")
    e = spark.createDataFrame(
        [("r", "route", "/x", "GET /x", "src/r.ts"), ("f", "file", "c.js", None, "bin/c.js"), ("g", "file", "main.go", None, "cmd/app/main.go"), ("p", "file", "m", None, "pkg/__main__.py")],
        "id string, type string, name string, qualified_name string, file_path string",
    )
    assert [(r.kind, r.name, r.file_path, r.id) for r in overview.entry_points(m, e).collect()] == [
        ("main", "./dist/i.js", "./dist/i.js", None), ("cli", "cli", "./bin/c.js", "f"), ("cli", "app", "cmd/app/main.go", "g"), ("python_main", "pkg", "pkg/__main__.py", "p"), ("http_route", "GET /x", "src/r.ts", "r"),
    ]
    more = [("package.json", manifest.replace("{", '{"packageManager": "pnpm@9", ', 1)), ("a/docker-compose.yml", ""), ("Makefile", "all:\n"), ("README.md", "# Setup\nread")]
    guide = overview.setup_guide(spark.createDataFrame(more, "file_path string, text string"))
    assert [(r.kind, r.command) for r in guide.orderBy("ord").collect()] == [("docker", "docker compose up"), ("install", "pnpm install"), ("run", "pnpm  dev"), ("test", "pnpm  test"), ("note", "make all"), ("readme", "read")]
    python = [("x/pyproject.toml", "[tool.uv]\n[project.scripts]\nrun-it = 'a:b'\n[x]\n"), ("go.mod", "module x")]
    guide = overview.setup_guide(spark.createDataFrame(python, "file_path string, text string"))
    assert [r.command for r in guide.orderBy("ord").collect()] == ["uv sync", "run-it", "go mod download", "go run ./..."]


def test_flowchart(spark):
    folders = spark.createDataFrame([("a/b", 5), ("c", 3)], "folder string, n long")
    arrows = spark.createDataFrame([("a/b", "c", 4)], "from_folder string, to_folder string, n long")
    assert overview.flowchart(folders, arrows).first().chart == 'flowchart LR\n    a_b["a/b<br/>5"]\n    c["c<br/>3"]\n    a_b -->|4| c'
    assert overview.flowchart(folders, arrows.limit(0)).first().chart is None


def test_whole_file_chunks(spark):
    rows = [("package.json", 9, "{}"), ("x/Makefile", 5, "a:\nb:"), ("tsconfig.json", 5, "{}"), ("a.ts", 5, "x"), ("empty.sql", 0, ""), ("b.sql", 5, "x\ny"), ("pic.svg", 5, "x"), ("seen.css", 5, "x"), ("c.dat", 5, "\x01\x02\x03ab"), ("latin.txt", 5, "\x80\x85\x9fab")]
    found = spark.createDataFrame(rows, "rel_path string, size_bytes long, text string")
    assert [(r.file_path, r.end_line, r.source_type) for r in files.config_chunks(found).orderBy("file_path").collect()] == [("package.json", 1, "config"), ("x/Makefile", 2, "config")]
    rest = files.fallback_chunks(found, spark.createDataFrame([("seen.css",)], "file_path string"))
    assert [(r.file_path, r.end_line, r.source_type, r.language) for r in rest.orderBy("file_path").collect()] == [("b.sql", 2, "code", "unknown"), ("latin.txt", 1, "code", "unknown"), ("tsconfig.json", 1, "code", "unknown")]


def test_bus_factor_matches_plain_count(spark):
    import random

    from codeloom.operators import activity

    rng = random.Random(1)
    for n in (1, 2, 7, 30):
        counts = [rng.randint(1, 6) for _ in range(n)]
        rows = [(f"a{i}",) for i, c in enumerate(counts) for _ in range(c)]
        want = next(k for k in range(1, n + 1) if 2 * sum(sorted(counts, reverse=True)[:k]) >= sum(counts))
        assert activity.bus_factor(spark.createDataFrame(rows, "author string")).first()[0] == want
    assert activity.bus_factor(spark.createDataFrame([], "author string")).first()[0] == 0


def test_setup_guide_without_caps(spark):
    makefile = "".join(f"t{i}:\n" for i in range(7))
    rows = [(f"{i}/README.md", "") for i in range(100)] + [("src/deep/package.json", '{"scripts": {"test": "x"}}'), ("src/deep/Makefile", makefile)]
    files = spark.createDataFrame(rows, "file_path string, text string")
    some, every = ({r.ord: r.command for r in guide.collect()} for guide in (overview.setup_guide(files), overview.setup_guide(files, targets=None)))
    assert some == {1: "npm install", 3: "npm run test", 10: "make t0   make t1   make t2   make t3   make t4"}
    assert every == some | {10: "   ".join(f"make t{i}" for i in range(7))}
