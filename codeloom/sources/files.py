"""Sources and path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.runtime import top

# Fixed lists.
EXCLUDED_DIRS = (".git", "node_modules", ".pnpm-store", "dist", "build", ".next", ".nuxt", ".output", "__pycache__", ".venv", "venv", "vendor", ".cache", ".idea", ".vscode", "coverage", ".turbo")
EXCLUDED_SUFFIXES = r"(?i)\.(?:min\.js|min\.css|map|lock|bin|exe|dll|so|dylib)$"
FALLBACK_SKIP = r"(?i)\.(?:md|mdx|ts|tsx|js|jsx|mts|cts|mjs|cjs|vue|py|pyi|go|png|jpg|jpeg|gif|webp|svg|ico|woff2?|ttf|otf|pdf|zip|tar|gz|bin)$"
MAX_FILE, MAX_FILES, CONFIG_FILE, FALLBACK_FILE = 1 << 20, 2000, 256 << 10, 128 << 10
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".vue": "typescript", ".py": "python", ".pyi": "python", ".go": "go"}
MANIFESTS = {"package.json": ["typescript", "javascript"], "tsconfig.json": ["typescript"], "pyproject.toml": ["python"], "requirements.txt": ["python"], "setup.py": ["python"], "pipfile": ["python"], "go.mod": ["go"], "go.sum": ["go"]}
MANIFEST_PATH = r"(?i)(?:^|/)(?:package\.json|pyproject\.toml|Makefile|Dockerfile|go\.mod|Cargo\.toml|docker-compose(?:\..+)?\.ya?ml)$"
FILE_DIFF, COMMIT_DIFF, DIFF_HEADER = 30_000, 60_000, 80


def scan_tree(spark: SparkSession, root: str, limit: int | None = MAX_FILES) -> DataFrame:
    """(rel_path, size_bytes, content, truncated) of a source tree; excluded names are filtered before contents are used.

    Spark doesn't list files whose names begin with a dot: ignore files take effect where a table of files has them (keep_files).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # Paths come back as whole URIs; the root, whole as well, is what is cut.
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    rel = F.substring(F.col("path"), F.locate(whole, F.col("path")) + len(whole), F.length("path"))
    return keep_files(files.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), "content"), limit)


def keep_files(files: DataFrame, limit: int | None = MAX_FILES) -> DataFrame:
    """S1 on a table (rel_path, size_bytes, ...): the kept files by path, with `truncated` when the limit cut some."""
    segments = F.split("rel_path", "/")
    names = F.array(*[F.lit(x) for x in EXCLUDED_DIRS])
    kept = files.filter(~F.arrays_overlap(segments, names) & ~F.col("rel_path").rlike(EXCLUDED_SUFFIXES) & (F.col("size_bytes") <= MAX_FILE))
    if "content" in files.columns:
        kept = drop_ignored(kept, ignore_rules(files))
    if limit is None:
        return kept.withColumn("truncated", F.lit(False))
    total = kept.agg((F.count(F.lit(1)) > limit).alias("truncated"))  # one row
    return top(kept, limit, "rel_path").crossJoin(F.broadcast(total))


def ignore_rules(files: DataFrame) -> DataFrame:
    """(dir, at, pattern, negated): the lines of all .gitignore files as patterns on paths from the root.

    A pattern with a slash before its end is anchored to the root; one that ends with a slash names directories.
    """
    here = F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
    lines = files.filter(F.col("rel_path").rlike(r"(?:^|/)\.gitignore$")).select(here.alias("dir"), F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("at", "line"))
    line = F.regexp_replace("line", r"\s+$", "")
    rows = lines.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    bare = F.regexp_replace(F.regexp_replace("line", "^!", ""), "/$", "")
    anchored = bare.contains("/")
    # Runs of stars are set apart by marks, so that the one of a segment doesn't touch the one across segments.
    body = F.regexp_replace(F.regexp_replace(bare, "^/", ""), r"([.+^$(){}|\\])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(body, r"\*\*/", "\u0001"), r"/\*\*$", "\u0002")
    body = F.regexp_replace(F.regexp_replace(body, r"\*", "[^/]*"), r"\?", "[^/]")
    body = F.regexp_replace(F.regexp_replace(body, "\u0001", "(?:.*/)?"), "\u0002", "/.+")
    tail = F.when(F.col("line").endswith("/"), F.lit("/.*$")).otherwise(F.lit("(?:/.*)?$"))
    return rows.select("dir", "at", F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), body, tail).alias("pattern"), F.col("line").startswith("!").alias("negated"))


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files that no rule of their directories ignores; the last rule that matches decides, deeper directories after shallower."""
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    placed = files.select("rel_path", F.explode(above).alias("d")).select("rel_path", "d.depth", "d.dir")
    hits = placed.join(rules, "dir").filter(F.expr("rel_path rlike pattern"))
    ignored = hits.groupBy("rel_path").agg(F.max_by("negated", F.struct("depth", "at")).alias("negated")).filter("not negated")
    return files.join(ignored.select("rel_path"), "rel_path", "left_anti")


def language_of(path: Column) -> Column:
    """By extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(pairs, ext)


def manifest_languages(name: Column) -> Column:
    """S3: array of the languages that a manifest's file name implies."""
    out = F.array().cast("array<string>")
    for k, v in MANIFESTS.items():
        out = F.when(F.lower(name) == k, F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def summarise_languages(rows: DataFrame, column: str = "language") -> DataFrame:
    """(language, n), most frequent first; nulls left out."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def looks_binary(text: Column) -> Column:
    """Fewer than nine tenths printable in the first 4096 characters; empty counts."""
    head = F.substring(text, 1, 4096)
    printable = F.length(F.regexp_replace(head, r"[^\t\n\r\x20-\x7E\x{80}-\x{10FFFF}]", ""))
    return (F.length(head) == 0) | (printable / F.length(head) < 0.9)


def config_chunks(files: DataFrame) -> DataFrame:
    """Whole-file chunks of manifests. files: rel_path, size_bytes, text."""
    return _whole(files.filter(F.col("rel_path").rlike(MANIFEST_PATH) & F.col("size_bytes").between(1, CONFIG_FILE)), "config")


def _whole(files: DataFrame, source_type: str) -> DataFrame:
    lines = F.size(F.split("text", "\n", -1))
    return files.select(F.col("rel_path").alias("file_path"), F.lit(1).alias("start_line"), lines.alias("end_line"), F.lit(source_type).alias("source_type"), F.coalesce(language_of(F.col("rel_path")), F.lit("unknown")).alias("language"), "text")


def fallback_chunks(files: DataFrame, covered: DataFrame) -> DataFrame:
    """Whole-file chunks of the files no other pass has covered (file_path)."""
    path = F.col("rel_path")
    rest = files.filter(F.col("size_bytes").between(1, FALLBACK_FILE) & ~path.rlike(FALLBACK_SKIP) & ~path.rlike(MANIFEST_PATH) & ~looks_binary(F.col("text")))
    return _whole(rest.join(covered.select(F.col("file_path").alias("rel_path")).distinct(), "rel_path", "left_anti"), "code")


def latest_commits(commits: DataFrame, by: list[str], limit: int = 200, ts: str = "ts", key: str = "sha") -> DataFrame:
    """The newest commits of each repository, with their rank. Merges (more than one of `parents`, where commits have them) don't count."""
    commits = commits.filter(F.coalesce(F.size("parents") <= 1, F.lit(True))) if "parents" in commits.columns else commits
    w = Window.partitionBy(*by).orderBy(F.desc(ts), key)
    return commits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def split_diffs(diffs: DataFrame) -> DataFrame:
    """(sha, pos, file_path, diff) by file from (sha, raw); the path is the one after the change."""
    parts = F.filter(F.split("raw", r"(?m)(?=^diff --git )"), lambda x: x.startswith("diff --git "))
    rows = diffs.select("sha", F.posexplode(parts).alias("pos", "diff"))
    new = F.regexp_extract("diff", r"(?m)^\+\+\+ b/(\S+)", 1)
    header = F.regexp_extract("diff", r"^diff --git a/\S+ b/(\S+)", 1)
    return rows.select("sha", "pos", F.when(new != "", new).otherwise(header).alias("file_path"), F.rtrim("diff").alias("diff"))


def cap_diffs(diffs: DataFrame, per_file: int = FILE_DIFF, per_commit: int = COMMIT_DIFF, header: int = DIFF_HEADER) -> DataFrame:
    """Diffs of (sha, pos, file_path, diff) cut per file with a mark; a commit's diffs stop at its total, `elided` says how many went.

    A diff is joined under a line with its path; `header` characters are set aside for the next one's.
    """
    cut = F.when(F.length("diff") > per_file, F.concat(F.substring("diff", 1, per_file), F.lit("\n[...truncated]"))).otherwise(F.col("diff"))
    w = Window.partitionBy("sha").orderBy("pos")
    entry = F.length(F.concat(F.lit("\n---  ---\n"), "file_path", "diff"))
    before = F.coalesce(F.sum(entry).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = diffs.withColumn("diff", cut).withColumn("over", (before + F.length("diff") + header > per_commit).cast("int"))
    rows = rows.withColumn("over", F.max("over").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("elided", F.sum("over").over(Window.partitionBy("sha")))
    return rows.filter("over = 0").drop("over")


def merged_pulls(pulls: DataFrame, limit: int = 200) -> DataFrame:
    """Merged pull requests among the newest closed ones, with the issues they close and an excerpt."""
    newest = top(pulls.filter(F.col("state") == "closed"), limit, F.desc("updated_at"), "number")
    return newest.filter("merged_at is not null").select("number", "title", X.excerpt(F.col("body"), 400).alias("excerpt"), X.fix_refs(F.coalesce("body", F.lit("")), "index").alias("issues"), "labels", "author", "merged_at")
