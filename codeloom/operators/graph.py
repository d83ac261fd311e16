"""Graph operators over entity and edge tables.

Edges have columns src, dst, type; entities have id, type, name. Traversals run level by level:
a join of the frontier with the edges, distinct, and an anti join with what was seen. The
frontier is made distinct before each join, so a hub is joined on once. The edges are neither
shuffled nor written: a frontier whose counted size allows is sent to where they are read, and
only the frontier and what was seen are cut from their lineage through the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.runtime import checkpoint, top, union

#: Most ids of a frontier that are broadcast.
SMALL_FRONTIER = 100_000
#: Mode of a call hierarchy to edge type and direction.
HIERARCHY = {"callees": ("calls", "out"), "callers": ("calls", "in"), "tests": ("tested_by", "out"), "parents": ("contained_in", "out")}


def hops(edges: DataFrame, types: list[str] | None, direction: str) -> DataFrame:
    """Edges of some types as (at, next) in the wanted direction: out, in or both."""
    kept = edges if types is None else edges.filter(F.col("type").isin(types))
    out = kept.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    back = kept.select(F.col("dst").alias("at"), F.col("src").alias("next"))
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()


def traverse(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, direction: str = "out", max_depth: int = 5, limit: int | None = 200) -> DataFrame:
    """K4: (id, depth) of the nodes within max_depth hops of the seeds (column id); the seeds are left out.

    Cycles end because a node is kept at its first depth only. The limit is one ordered cut at
    the end, by depth and id.
    """
    links = hops(edges, types, direction).filter("at is not null and next is not null")
    seen = frontier = checkpoint(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        size = frontier.count()
        if not size:
            break
        at = frontier.select(F.col("id").alias("at"))
        reached = links.join(F.broadcast(at) if size <= SMALL_FRONTIER else at, "at").select(F.col("next").alias("id")).distinct()
        frontier = checkpoint(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return top(seen.filter("depth > 0"), limit, "depth", "id")


def callers(edges: DataFrame, targets: DataFrame, transitive: bool = False, max_depth: int = 5, limit: int | None = 200) -> DataFrame:
    """K2: what calls the targets."""
    return traverse(edges, targets, ["calls"], "in", max_depth if transitive else 1, limit)


def callees(edges: DataFrame, sources: DataFrame, transitive: bool = False, max_depth: int = 5, limit: int | None = 200) -> DataFrame:
    """K3: what the sources call."""
    return traverse(edges, sources, ["calls"], "out", max_depth if transitive else 1, limit)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with their undirected distance (seeds at 0) and the edges among them, each once."""
    near = traverse(edges, seeds, None, "both", depth, limit)
    nodes = near.unionByName(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, inside.distinct()


def find_symbol(entities: DataFrame, name: str | None = None, kind: str | None = None, fuzzy: bool = False, limit: int | None = 20) -> DataFrame:
    """K1: exact lower-case match, else (or when fuzzy) substring; without a name the list of a type.

    Both matches are found in one scan: a row counts when no row is exact or it is exact itself.
    """
    rows = entities if kind is None else entities.filter(F.col("type") == kind)
    if name is None:
        return top(rows if kind else rows.filter(F.lit(False)), limit, "name", "id")
    low = name.lower()
    hits = rows.filter(F.lower("name").contains(low))
    if not fuzzy:
        exact = F.lower("name") == low
        some = hits.agg(F.coalesce(F.max(exact.cast("int")), F.lit(0)).alias("some"))
        hits = hits.crossJoin(F.broadcast(some)).filter(exact | (F.col("some") == 0)).drop("some")  # one row
    return top(hits, limit, "name", "id")


def search_entities(entities: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """Names that contain the query; exact names first, then shorter ones."""
    low = query.lower()
    return top(entities.filter(F.lower("name").contains(low)), limit, (F.lower("name") == low).desc(), F.length("name"), "name", "id")


def file_history(edges: DataFrame, commits: DataFrame, files: DataFrame, since=None, limit: int | None = 50) -> DataFrame:
    """K5: commits (id, ts, ...) that modified the files (id), newest first."""
    touching = edges.filter(F.col("type") == "modified_by").join(files.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    found = commits.join(touching, "id", "left_semi")
    return top(found if since is None else found.filter(F.col("ts") >= F.lit(since)), limit, F.desc("ts"), "id")


def linked_chunks(chunks: DataFrame, links: DataFrame, entities: DataFrame, limit: int | None = 50) -> DataFrame:
    """K8: the chunks (chunk_id, ...) linked to any of the entities (id), each once."""
    wanted = links.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("chunk_id")
    return top(chunks.join(wanted, "chunk_id", "left_semi"), limit, "chunk_id")


def summaries(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """K9: id, name, type and description of the ids."""
    return entities.join(ids.select("id"), "id", "left_semi").select("id", "name", "type", "description")


def walkthrough(edges: DataFrame, targets: DataFrame, limit: int | None = 20, parents: int = 3) -> DataFrame:
    """(id, role) of the targets, their direct callees, tests and parents; each id in its first role."""
    parts = [targets.select("id", F.lit("target").alias("role"), F.lit(0).alias("ord"))]
    for ord_, (role, kind, most) in enumerate((("callee", "calls", None), ("test", "tested_by", None), ("parent", "contained_in", parents)), 1):
        found = traverse(edges, targets, [kind], "out", 1, most)
        parts.append(found.select("id", F.lit(role).alias("role"), F.lit(ord_).alias("ord")))
    once = union(parts).groupBy("id").agg(F.min_by("role", "ord").alias("role"), F.min("ord").alias("ord"))
    return top(once, limit, "ord", "id").select("id", "role", "ord")


def sequence_text(steps: DataFrame, entities: DataFrame, callees: int = 8, tests: int = 4) -> DataFrame:
    """One row `diagram`, a sequence diagram of a walkthrough's first target, callees and tests. entities: id, name, type."""
    kept = {"target": 1, "callee": callees, "test": tests}
    rows = union([top(steps.filter(F.col("role") == role), n, "id") for role, n in kept.items()])
    label = X.sanitize_label(F.col("name"), 48)
    named = rows.join(entities.select("id", label.alias("label"), F.when(F.col("type") == "function", "call").otherwise("use").alias("verb")), "id")
    root = F.first(F.when(F.col("role") == "target", F.col("label")), ignorenulls=True)
    of = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("id", "label", "verb"))))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    root_, one = F.col("root"), named.agg(root.alias("root"), of("callee").alias("callees"), of("test").alias("tests")).filter("root is not null")
    lines = F.concat(
        F.array(F.lit("sequenceDiagram"), F.lit("    participant Caller"), text("    participant ", root_), text("    Caller->>+", root_, ": invoke")),
        F.flatten(F.transform("callees", lambda c: F.array(text("    ", root_, "->>+", c.label, ": ", c.verb), text("    ", c.label, "-->>-", root_, ": ok")))),
        F.array(text("    ", root_, "-->>-Caller: return")),
        F.transform("tests", lambda t: text("    Note over ", root_, ": covered by ", t.label)),
    )
    return one.select(F.array_join(lines, "\n").alias("diagram"))


def read_file(chunks: DataFrame, path: str, limit: int = 6, files: int = 5) -> DataFrame:
    """Chunks of the files whose path is, or ends with, the given one; shortest paths first."""
    wanted = path[2:] if path.startswith("./") else path.lstrip("/")
    hits = chunks.filter((F.col("file_path") == path) | (F.col("file_path") == wanted) | F.col("file_path").endswith(wanted))
    hits = top(hits, 4 * limit, "file_path", "start_line", "chunk_id")
    per_file = Window.partitionBy("file_path").orderBy("start_line", "chunk_id")
    by_path = Window.orderBy(F.length("file_path"), "file_path")  # over at most 4 * limit rows
    ranked = hits.withColumn("r", F.row_number().over(per_file)).filter(F.col("r") <= limit).withColumn("f", F.dense_rank().over(by_path)).filter(F.col("f") <= files)
    return ranked.orderBy("f", "r").drop("r", "f")


def tests_for(edges: DataFrame, targets: DataFrame, direction: str = "tests", limit: int | None = 20) -> DataFrame:
    """Ids of the tests that cover the targets; `covered_by` reads the edge the other way."""
    return traverse(edges, targets, ["tested_by"], "out" if direction == "tests" else "in", 1, limit).select("id")


def hierarchy_children(edges: DataFrame, ids: DataFrame, mode: str) -> DataFrame:
    """(id, child) one hop from the ids in a call hierarchy's mode."""
    kind, direction = HIERARCHY[mode]
    return hops(edges, [kind], direction).join(ids.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("at").alias("id"), F.col("next").alias("child")).distinct()


def entity_details(edges: DataFrame, ids: DataFrame, limit: int = 200) -> DataFrame:
    """(id, direction, type, other, total) with the first `limit` edges of each id and direction, and their full number."""
    keep = lambda side, other, name: edges.join(ids.select(F.col("id").alias(side)), side, "left_semi").select(F.col(side).alias("id"), F.lit(name).alias("direction"), "type", F.col(other).alias("other"))
    rows = keep("dst", "src", "incoming").unionByName(keep("src", "dst", "outgoing"))
    # Counted by an aggregate, so that the rank's limit holds below the exchange and a hub is never sorted whole.
    totals = rows.groupBy("id", "direction").agg(F.count(F.lit(1)).alias("total"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("id", "direction").orderBy("type", "other"))).filter(F.col("r") <= limit).drop("r")
    return first.join(totals, ["id", "direction"]).select("id", "direction", "type", "other", "total")


def entity_page(entities: DataFrame, edges: DataFrame, links: DataFrame, chunks: DataFrame, ids: DataFrame, chunk_limit: int = 20) -> dict[str, DataFrame]:
    """What the page of each id shows: the entity itself, its edges (with the entity at the other end), its linked chunks and the counts.

    links: entity_id, chunk_id. Chunks are the first chunk_limit by path, line and id.
    """
    own = entities.join(ids, "id", "left_semi")
    other = entities.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    rows = entity_details(edges, ids).join(other, "other")
    linked = links.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(chunks, "chunk_id")
    first = Window.partitionBy("entity_id").orderBy("file_path", "start_line", "chunk_id")
    shown = linked.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= chunk_limit).drop("r").withColumnRenamed("entity_id", "id")
    counts = rows.groupBy("id").agg(F.count_if(F.col("direction") == "incoming").alias("incoming"), F.count_if(F.col("direction") == "outgoing").alias("outgoing"))
    return {"entity": own, "edges": rows, "chunks": shown, "counts": counts}


def subgraph_summary(entities: DataFrame, nodes: DataFrame, max_nodes: int) -> DataFrame:
    """(type, total, shown, truncated): entities of each type in all, those among a view's nodes, and whether the view was cut at its limit."""
    primary = nodes.filter("not context").select("id")
    cut = primary.agg((F.count(F.lit(1)) >= max_nodes).alias("truncated"))  # one row
    shown = entities.join(primary, "id", "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("shown"))
    totals = entities.groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    return totals.join(shown, "type", "left").fillna(0, ["shown"]).crossJoin(F.broadcast(cut))


def subgraph(entities: DataFrame, edges: DataFrame, types: list[str], language: str | None = None, max_nodes: int | None = 5000, context: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Nodes of the types, and with `context` up to that many neighbours; edges with both ends visible.

    The two ends are joined on apart, never with an OR.
    """
    wanted = entities.filter(F.col("type").isin(types))
    wanted = wanted if language is None else wanted.filter(F.col("language") == language)
    nodes = top(wanted, max_nodes, "id").select("id").withColumn("context", F.lit(False))
    if context is not None:
        near = hops(edges, None, "both").join(nodes.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("next").alias("id")).distinct()
        more = near.join(nodes, "id", "left_anti").join(entities.select("id"), "id", "left_semi")
        nodes = nodes.unionByName(top(more, context, "id").withColumn("context", F.lit(True)))
    visible = nodes.select("id")
    inside = edges.join(visible.select(F.col("id").alias("src")), "src", "left_semi").join(visible.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, inside


def degree(edges: DataFrame, by: str, types: list[str] | None = None) -> DataFrame:
    """(id, degree): edges of some types counted before any join."""
    kept = edges if types is None else edges.filter(F.col("type").isin(types))
    return kept.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def line_overlap(start: Column, end: Column, first: int | None, last: int | None) -> Column:
    """Whether lines start..end meet first..last; missing bounds pass."""
    above = F.lit(True) if first is None else F.coalesce(end >= first, F.lit(True))
    below = F.lit(True) if last is None else F.coalesce(start <= last, F.lit(True))
    return above & below
