"""Graph build (G1-G9): derived edges, target resolution, links, history nodes and hotness.

A resolution cascade indexes the known paths instead of the edges: a path is found under itself and
under what is left without its extension or index name, each with its priority. An edge then takes
part in one equi join, whatever the number of extensions. Targets and names that very many edges share,
such as a package outside the corpus, are counted and dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed lists of the file extensions that an import path may leave out.
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts")
TARGET_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs", ".vue", ".py", ".go")
#: Rows with one key that a join leaves to one task.
PIECE_ROWS = 500_000


def stems(path: Column, extensions: tuple[str, ...], interleaved: bool) -> Column:
    """array<struct(priority, stem)>: the targets that a path is found by.

    Priorities: the path itself, then extensions and index files in turn (interleaved) or all
    extensions before all index files.
    """
    n = len(extensions)
    found = [F.struct(F.lit(0).alias("priority"), path.alias("stem"))]
    for i, ext in enumerate(extensions):
        plain, index = (1 + 2 * i, 2 + 2 * i) if interleaved else (1 + i, 1 + n + i)
        for priority, end in ((plain, ext), (index, f"/index{ext}")):
            left = F.substring(path, F.lit(1), F.length(path) - len(end))
            found.append(F.when(path.endswith(end), F.struct(F.lit(priority).alias("priority"), left.alias("stem"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def tested_by_edges(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """G1: (src entity, dst test file, type) for the top-level entities of the file each import of a test reaches.

    imports: test_file, target. entities: id, type, file_path, qualified_name. Targets have a slash
    and no colon; only files with top-level entities (path::name) are reached.
    """
    top_level = entities.filter((F.size(F.split("qualified_name", "::")) == 2) & ~F.col("type").isin("file", "test", "document"))
    index = top_level.select("file_path").distinct().select("file_path", F.explode(stems(F.col("file_path"), IMPORT_EXTENSIONS, True)).alias("s"))
    best = index.groupBy(F.col("s.stem").alias("target")).agg(F.min_by("file_path", "s.priority").alias("file_path"))
    reached = imports.filter(F.col("target").contains("/") & ~F.col("target").contains(":")).join(best, "target").select("test_file", "file_path")
    # Rows are dealt before the one distinct: nearly all differ, so a table of a whole input split would only take memory.
    found = top_level.join(reached, "file_path").select(F.col("id").alias("src"), F.col("test_file").alias("dst")).repartition("src", "dst")
    return found.distinct().withColumn("type", F.lit("tested_by"))


def short_names(entities: DataFrame) -> DataFrame:
    """(short, id): the first entity in input order (seq) of each lower-cased name."""
    return entities.filter("name is not null").groupBy(F.lower("name").alias("short")).agg(F.min_by("id", F.struct("seq", "id")).alias("id"))


def left_join_dealt(rows: DataFrame, index: DataFrame, key: str, counts: DataFrame, by: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rows left join index on key, where a key of many rows is cut into pieces by a hash of the column `by`.

    counts: (key, n), how often a key occurs at most. Keys of more than piece_rows (n / piece_rows of all rows at most, so
    few) are broadcast, and what the index has for them is repeated for each piece; rows without a key are spread.
    """
    heavy = F.broadcast(counts.filter(F.col("n") > piece_rows).select(key, F.ceil(F.col("n") / piece_rows).alias("_pieces")))
    hashed = F.xxhash64(by)
    piece = F.when(F.col(key).isNull(), hashed).when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(hashed, "_pieces"))
    left = rows.join(heavy, key, "left").withColumn("_piece", piece).drop("_pieces")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_pieces"), F.lit(1).cast("long")) - 1))
    right = index.join(heavy, key, "left").withColumn("_piece", every).drop("_pieces")
    return left.join(right, [key, "_piece"], "left").drop("_piece")


def resolve_edges(edges: DataFrame, entities: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Edges (seq, from_qualified, to_qualified, to_name, type) to (seq, src, dst, type, how).

    A target is looked up by qualified name; without `::` also with each extension and as an
    index file; last by short name. Edges without a source or a target are dropped.
    """
    by_name = entities.filter("qualified_name is not null").groupBy(F.col("qualified_name").alias("path")).agg(F.min_by("id", F.struct("seq", "id")).alias("node"))
    rows = edges.join(by_name.select(F.col("path").alias("from_qualified"), F.col("node").alias("src")), "from_qualified")
    indexed = by_name.select("node", F.explode(stems(F.col("path"), TARGET_EXTENSIONS, False)).alias("s"))
    # A target with `::` is found by its exact name only.
    indexed = indexed.filter((F.col("s.priority") == 0) | ~F.col("s.stem").contains("::"))
    direct = indexed.groupBy(F.col("s.stem").alias("to_qualified")).agg(F.min_by(F.struct("node", "s.priority"), "s.priority").alias("d"))
    short = short_names(entities).select("short", F.col("id").alias("by_short"))
    counts = lambda key: edges.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = left_join_dealt(rows, direct, "to_qualified", counts("to_qualified"), "seq", piece_rows)
    # Only an edge that isn't found yet asks for a name.
    found = found.withColumn("short", F.when(F.col("d").isNull(), F.lower("to_name")))
    found = left_join_dealt(found, short, "short", counts(F.lower("to_name").alias("short")), "seq", piece_rows)
    how = F.when(F.col("d").isNull(), "short").when(F.col("d.priority") == 0, "exact").otherwise("path")
    return found.select("seq", "src", F.coalesce("d.node", "by_short").alias("dst"), "type", how.alias("how")).filter("dst is not null")


def link_chunks(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (entity_id, chunk_id) with the same qualified name."""
    return entities.select(F.col("id").alias("entity_id"), "qualified_name").join(chunks.select("chunk_id", "qualified_name"), "qualified_name").select("entity_id", "chunk_id").distinct()


def author_key(name: Column, email: Column) -> Column:
    return F.lower(F.concat_ws("::", name, email))


def history_nodes(commits: DataFrame) -> DataFrame:
    """Distinct (id, type, name) of the persons and commits of (sha, author_name, author_email, message)."""
    persons = commits.groupBy(author_key(F.col("author_name"), F.col("author_email")).alias("key")).agg(F.min("author_name").alias("name"))
    people = persons.select(F.concat(F.lit("person:"), "key").alias("id"), F.lit("person").alias("type"), "name")
    return people.unionByName(commits.select(F.concat(F.lit("commit:"), "sha").alias("id"), F.lit("commit").alias("type"), F.substring_index("message", "\n", 1).alias("name")).dropDuplicates(["id"]))


def history_edges(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Authored (person to commit) and modified_by (commit to a known file) edges."""
    commit = F.concat(F.lit("commit:"), "sha")
    authored = commits.select(F.concat(F.lit("person:"), author_key(F.col("author_name"), F.col("author_email"))).alias("src"), commit.alias("dst"), F.lit("authored").alias("type"))
    touched = commits.select(commit.alias("src"), F.explode("files_changed").alias("path")).join(files.select("path", "id"), "path")
    return authored.unionByName(touched.select("src", F.col("id").alias("dst"), F.lit("modified_by").alias("type"))).distinct()


def diff_chunks(diffs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diff chunks of (sha, file_path, diff) and their links to the commit and, where known, the file."""
    ident = F.sha2(F.concat_ws("|", F.lit("diff"), "sha", "file_path"), 256)
    chunks = diffs.select(ident.alias("chunk_id"), "file_path", F.col("diff").alias("text"), F.lit("diff").alias("kind"), "sha").dropDuplicates(["chunk_id"])
    to_commit = chunks.select(F.concat(F.lit("commit:"), "sha").alias("entity_id"), "chunk_id")
    to_file = chunks.join(files.select(F.col("path").alias("file_path"), F.col("id").alias("entity_id")), "file_path").select("entity_id", "chunk_id")
    return chunks, to_commit.unionByName(to_file).distinct()


def author_counts(commits: DataFrame) -> DataFrame:
    """Commits by author key."""
    return commits.groupBy(author_key(F.col("author_name"), F.col("author_email")).alias("author")).agg(F.count(F.lit(1)).alias("commits"))


def hotness(commits: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """(path, hotness): changes of each file in the days up to as_of."""
    recent = commits.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.select(F.explode("files_changed").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("hotness"))


def attach_hotness(entities: DataFrame, heat: DataFrame) -> DataFrame:
    """Entities with `hotness`, 0 where a file has none; null for rows that aren't files."""
    joined = entities.join(heat.withColumnRenamed("path", "file_path"), "file_path", "left")
    return joined.withColumn("hotness", F.when(F.col("type") == "file", F.coalesce("hotness", F.lit(0))))
