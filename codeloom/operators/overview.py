"""Project overview (O1-O9, K14) and directory views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.graph import degree
from codeloom.operators.issues import path_suffixes, ranked_in
from codeloom.runtime import top, union

# Fixed rules: paths that are looked at, and document kinds by path, first match wins.
CONTRIB_PATHS = r"(?i)CONTRIBUTING|PULL_REQUEST_TEMPLATE|ISSUE_TEMPLATE|CODE_OF_CONDUCT|(?:^|/)SECURITY\.MD$"
CONTRIB_KINDS = (
    ("contributing", r"(?i)(?:^|/)CONTRIBUTING(?:\.md|\.txt|\.rst)?$"), ("contributing", r"(?i)(?:^|/)\.github/CONTRIBUTING(?:\.md)?$"),
    ("pr_template", r"(?i)(?:^|/)\.github/PULL_REQUEST_TEMPLATE(?:\.md)?$"), ("pr_template", r"(?i)(?:^|/)\.github/PULL_REQUEST_TEMPLATE/"),
    ("issue_template", r"(?i)(?:^|/)\.github/ISSUE_TEMPLATE/"), ("code_of_conduct", r"(?i)(?:^|/)CODE_OF_CONDUCT(?:\.md)?$"), ("security", r"(?i)(?:^|/)SECURITY(?:\.md)?$"),
)
CORE_TYPES = ("class", "function", "type", "component", "module")
CORE_EDGES = ("calls", "imports", "depends_on", "extends", "implements", "uses")


def folder_profile(entities: DataFrame, least: int = 3, limit: int | None = 12) -> DataFrame:
    """O1: (folder, n) of the two-level folders with at least `least` entities; none unless there are two."""
    counted = entities.filter("file_path is not null").groupBy(X.folder2(F.col("file_path")).alias("folder")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    best = top(counted, limit, F.desc("n"), "folder")
    folders = best.agg(F.count(F.lit(1)).alias("folders"))  # one row
    return best.crossJoin(F.broadcast(folders)).filter("folders >= 2").drop("folders")


def folder_dependencies(entities: DataFrame, edges: DataFrame, folders: DataFrame | None = None, least: int = 2, first: int | None = 40, limit: int | None = 25) -> DataFrame:
    """O2: (from_folder, to_folder, n) over imports; own-folder edges and folders outside `folders` go after the first cut."""
    at = lambda side: entities.filter("file_path is not null").select(F.col("id").alias(side), X.folder2(F.col("file_path")).alias(f"{side}_folder"))
    rows = edges.filter(F.col("type") == "imports").join(at("src"), "src").join(at("dst"), "dst")
    counted = rows.groupBy(F.col("src_folder").alias("from_folder"), F.col("dst_folder").alias("to_folder")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    best = top(counted, first, F.desc("n"), "from_folder", "to_folder").filter("from_folder <> to_folder")
    if folders is not None:
        for side in ("from_folder", "to_folder"):
            best = best.join(folders.select(F.col("folder").alias(side)), side, "left_semi")
    return top(best, limit, F.desc("n"), "from_folder", "to_folder")


def flowchart(folders: DataFrame, dependencies: DataFrame) -> DataFrame:
    """O3: one row `chart` of O1's folders and O2's dependencies; null without an edge."""
    node = lambda c: X.sanitize_label(F.col(c), 32, "node")
    n = F.col("n").cast("string")
    line = lambda o, first, second, *parts: F.struct(F.lit(o).alias("o"), (-F.col("n")).alias("most"), first.alias("a"), second.alias("b"), F.concat(*parts).alias("line"))
    boxes = folders.select(line(0, F.col("folder"), F.lit(""), F.lit("    "), node("folder"), F.lit('["'), F.col("folder"), F.lit("<br/>"), n, F.lit('"]')).alias("x"))
    arrows = dependencies.select(line(1, F.col("from_folder"), F.col("to_folder"), F.lit("    "), node("from_folder"), F.lit(" -->|"), n, F.lit("| "), node("to_folder")).alias("x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.line), "\n")
    return boxes.unionByName(arrows).agg(F.when(F.max("x.o") == 1, F.concat(F.lit("flowchart LR\n"), text)).alias("chart"))


def contribution_documents(chunks: DataFrame, per_kind: int = 2, limit: int | None = 20, excerpt: int = 1500) -> DataFrame:
    """(kind, file_path, excerpt): of the shortest paths looked at, those of a kind."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(CONTRIB_KINDS):
        kind = F.when(F.col("file_path").rlike(pattern), name).otherwise(kind)
    rows = chunks.filter(F.col("file_path").rlike(CONTRIB_PATHS))
    first = top(rows, limit, F.length("file_path"), "file_path", "start_line", "chunk_id").withColumn("kind", kind).filter("kind is not null")
    return ranked_in(first, ["kind"], per_kind, F.length("file_path"), "file_path", "start_line", "chunk_id").select("kind", "file_path", F.substring("text", 1, excerpt).alias("excerpt"))


def entry_points(manifests: DataFrame, entities: DataFrame, limit: int | None = 8) -> DataFrame:
    """(kind, name, file_path, id, description); the first of a kind and path is kept.

    In this order: main and bin of the shallowest package manifests (of the ten with the shortest
    paths), Go commands, Python mains, routes. manifests: file_path, text. entities: id, type, name,
    qualified_name, file_path.
    """
    field = lambda name: F.get_json_object("text", f"$.{name}")
    depth = F.size(F.split("file_path", "/"))
    nearest = top(manifests.filter(F.col("file_path").endswith("package.json")), 10, F.length("file_path"), "file_path").withColumn("depth", depth)
    least = nearest.agg(F.min("depth").alias("least"))  # one row
    shallow = nearest.crossJoin(F.broadcast(least)).filter("depth = least").select("file_path", F.length("file_path").alias("seq"), "text")
    row = lambda o, kind, name, path, ident, description: [F.lit(o).alias("o"), "seq", F.lit(kind).alias("kind"), name.alias("name"), path.alias("file_path"), ident.alias("id"), description.alias("description")]
    none = F.lit(None).cast(entities.schema["id"].dataType)
    main = shallow.filter(field("main").isNotNull()).withColumn("seq", F.col("seq") * 2).select(*row(0, "main", field("main"), field("main"), none, F.concat(F.lit("Package main from "), "file_path")))
    bins = F.when(field("bin").startswith("{"), F.from_json(field("bin"), "map<string,string>")).otherwise(F.create_map(F.coalesce(field("name"), F.lit("cli")), field("bin")))
    commands = shallow.filter(field("bin").isNotNull()).select((F.col("seq") * 2 + 1).alias("seq"), F.explode(bins).alias("cmd", "target"))
    cli = lambda words, name: F.concat(F.lit(f"{words} `"), name, F.lit("`"))
    many = commands.select(*row(0, "cli", F.col("cmd"), F.col("target"), none, cli("CLI entrypoint", F.col("cmd"))))
    found = union([main, many])
    paths = entities.filter((F.col("type") == "file") & F.col("file_path").isNotNull()).select(F.col("id").alias("hit"), F.explode(path_suffixes(F.col("file_path"))).alias("tail")).groupBy("tail").agg(F.min("hit").alias("hit"))
    found = found.withColumn("tail", X.normalize_path(F.col("file_path"))).join(paths, "tail", "left").withColumn("id", F.col("hit")).drop("tail", "hit")
    files = entities.filter("type = 'file'").withColumn("seq", F.lit(0))
    command = F.regexp_extract("file_path", r"(?:^|/)cmd/([^/]+)/", 1)
    go = top(files.filter(F.col("file_path").rlike(r"(?:^|/)cmd/[^/]+/main\.go$")), 10, "file_path", "id").select(*row(1, "cli", command, F.col("file_path"), F.col("id"), cli("Go command", command)))
    package = F.regexp_extract("file_path", r"([^/]+)/__main__\.py$", 1)
    py = top(files.filter(F.col("file_path").endswith("/__main__.py")), 10, "file_path", "id").select(*row(2, "python_main", package, F.col("file_path"), F.col("id"), F.concat(F.lit("Python module `python -m "), package, F.lit("`"))))
    routes = entities.filter("type = 'route' and file_path is not null").withColumn("seq", F.lit(0))
    http = top(routes, 8, "name", "id").select(*row(3, "http_route", F.coalesce("qualified_name", "name"), F.col("file_path"), F.col("id"), F.lit("HTTP route handler")))
    order = F.struct("o", "seq", "name")
    once = union([found, go, py, http]).groupBy("kind", "file_path").agg(F.min(order).alias("first"), F.min_by(F.struct("id", "description"), order).alias("x"))
    return top(once, limit, "first", "file_path").select("kind", "first.name", "file_path", "x.id", "x.description")


def core_abstractions(entities: DataFrame, edges: DataFrame, types=CORE_TYPES, edge_types=CORE_EDGES, limit: int | None = 10) -> DataFrame:
    """(id, name, type, degree) by in-degree; the edges are counted before the join."""
    rows = entities.filter(F.col("type").isin(list(types))).join(degree(edges, "dst", list(edge_types)), "id")
    return top(rows.select("id", "name", "type", "degree"), limit, F.desc("degree"), "name", "id")


def safe_change_score(files: DataFrame, limit: int | None = 5) -> DataFrame:
    """Files (path, tests, hotness, entities) by how safe a first change is, with reasons."""
    tested, cold, warm, small = F.col("tests") > 0, F.col("hotness") == 0, F.col("hotness").between(1, 2), F.col("entities") <= 8
    score = F.when(tested, 3).otherwise(0) + F.when(cold, 2).when(warm, 1).otherwise(0) + F.when(small, 1).otherwise(0)
    reasons = F.filter(F.array(F.when(tested, "covered by tests"), F.when(cold, "stable (no recent commits)").when(warm, "few recent commits"), F.when(small, "small file")), lambda x: x.isNotNull())
    rows = files.filter(F.col("entities").between(2, 25) & ~X.is_excluded_path(F.col("path"))).withColumn("score", score.cast("int")).withColumn("reasons", reasons)
    return top(rows.filter("score >= 3"), limit, F.desc("score"), "entities", "path")


def hot_files(files: DataFrame, limit: int | None = 10) -> DataFrame:
    """Files (path, hotness) that changed, most first."""
    return top(files.filter("hotness > 0"), limit, F.desc("hotness"), "path")


def type_stats(entities: DataFrame, total: bool = False) -> DataFrame:
    """(type, n); with `total` a further row of type null."""
    grouped = entities.rollup("type") if total else entities.groupBy("type")
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def project_overview(entities: DataFrame, edges: DataFrame, chunks: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """The sub-results by name; they share scans of the same tables and run when used."""
    folders = folder_profile(entities)
    return {
        "architecture": flowchart(folders, folder_dependencies(entities, edges, folders)), "contributing": contribution_documents(chunks),
        "entry_points": entry_points(chunks, entities), "core": core_abstractions(entities, edges), "safe_changes": safe_change_score(scores),
        "hot": hot_files(scores), "stats": type_stats(entities),
    }


def directory_rollup(files: DataFrame, measures: dict[str, Column], path: str = "path") -> DataFrame:
    """(dir, depth, measures...): one row a directory at every depth ('' the root); sums over all files below.

    Files are summed by directory first, so what is exploded are directories.
    """
    parts = F.split(path, "/")
    own = files.withColumn("_d", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    by_dir = own.groupBy("_d").agg(*[c.alias(n) for n, c in measures.items()])
    up = F.split("_d", "/")
    steps = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(up)), lambda i: F.array_join(F.slice(up, 1, i), "/"))))
    exploded = by_dir.select(F.explode(steps).alias("dir"), *measures)
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return exploded.groupBy("dir").agg(*[F.sum(n).alias(n) for n in measures]).withColumn("depth", depth)


def setup_guide(files: DataFrame, targets: int | None = 5) -> DataFrame:
    """(ord, kind, label, command, source) from the shallowest manifest of each kind, and the first targets of a makefile (None: all). files: file_path, text."""
    path, text = F.col("file_path"), F.col("text")
    low = F.lower("file_path")
    # Fixed order of the tests on a path; the first that holds names the kind.
    tests = (
        ("node", path.endswith("package.json")), ("python", path.endswith("pyproject.toml")), ("make", path.endswith("Makefile")), ("docker", path.endswith("Dockerfile")),
        ("compose", low.contains("docker-compose")), ("go", (path == "go.mod") | path.endswith("/go.mod")), ("cargo", path == "Cargo.toml"), ("readme", low.contains("readme")),
    )
    kind = F.lit(None).cast("string")
    for name, test in reversed(tests):
        kind = F.when(test, name).otherwise(kind)
    known = files.withColumn("kind", kind).filter("kind is not null")
    order = F.struct(F.size(F.split("file_path", "/")), F.length("file_path"), "file_path")
    pick = lambda k: F.min_by(F.when(F.col("kind") == k, F.struct(path.alias("path"), text.alias("text"))), F.when(F.col("kind") == k, order)).alias(k)
    one = known.agg(*[pick(k) for k, _ in tests])
    has = lambda k: F.col(k).isNotNull()
    node, python = F.col("node.text"), F.col("python.text")
    valid = has("node") & F.try_parse_json(node).isNotNull()
    manager = X.package_manager(F.coalesce(F.get_json_object(node, "$.packageManager"), F.lit("")))
    scripts = F.from_json(F.get_json_object(node, "$.scripts"), "map<string,string>")
    prefix = F.when(manager == "pnpm", F.lit("")).otherwise(F.lit("run"))
    run = lambda names: F.when(valid, F.concat(manager, F.lit(" "), prefix, F.lit(" "), X.pick_script(scripts, names)))
    poetry, uv = python.contains("[tool.poetry]"), python.contains("[tool.uv]") | python.contains("uv.lock")
    install = F.when(poetry, "poetry install").when(uv, "uv sync").otherwise("pip install -e .")
    script = F.regexp_extract(F.regexp_extract(python, r"\[project\.scripts\]((?s:.*?))(?:\n\[|\n*\z)", 1), r"(?m)^\s*([a-zA-Z0-9_-]+)\s*=", 1)
    command = F.when(script != "", F.when(poetry, F.concat(F.lit("poetry run "), script)).otherwise(script))
    bare = lambda k: has(k) & ~has("node")
    made = F.transform(X.make_targets(F.col("make.text")), lambda t: F.concat(F.lit("make "), t))
    made = made if targets is None else F.slice(made, 1, targets)
    path_of = lambda k: F.col(f"{k}.path")
    steps = [
        ("docker", "Or use Docker Compose", F.when(has("compose"), "docker compose up"), F.lit("docker-compose.yml")),
        ("install", "Install dependencies", F.when(valid, F.concat(manager, F.lit(" install"))), path_of("node")),
        ("run", "Run the app", run(["dev", "start", "serve"]), path_of("node")), ("test", "Run tests", run(["test", "test:unit"]), path_of("node")),
        ("install", "Install dependencies", F.when(bare("python"), install), path_of("python")), ("run", "Run the CLI", F.when(bare("python"), command), path_of("python")),
        ("install", "Fetch dependencies", F.when(bare("go"), "go mod download"), F.lit("go.mod")), ("run", "Build & run", F.when(bare("go"), "go run ./..."), F.lit("go.mod")),
        ("install", "Build dependencies", F.when(bare("cargo"), "cargo build"), F.lit("Cargo.toml")), ("run", "Run", F.when(bare("cargo"), "cargo run"), F.lit("Cargo.toml")),
        ("note", "Makefile targets", F.when(F.size(made) > 0, F.array_join(made, "   ")), path_of("make")),
        ("readme", "Quick start", X.readme_quickstart(F.col("readme.text")), path_of("readme")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("kind"), F.lit(n).alias("label"), c.alias("command"), source.alias("source")) for i, (k, n, c, source) in enumerate(steps)])
    return one.select(F.explode(rows).alias("r")).select("r.*").filter("command is not null")
