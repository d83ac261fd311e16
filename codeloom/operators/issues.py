"""Issue linking and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions.vectors import cosine
from codeloom.operators.graph import degree
from codeloom.runtime import top

STALE_DAYS = 90
SIMILAR, DUPLICATE = 0.7, 0.85


def ranked_in(df: DataFrame, by: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each group; the rank limit is applied before and after the exchange."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def lookup_names(tokens: DataFrame, entities: DataFrame, edges: DataFrame, limit: int | None = 200) -> DataFrame:
    """L1: (token, id, degree): entities whose name or qualified name is the token, by in-degree.

    An OR of two equalities becomes a union of two equi joins.
    """
    asked = tokens.select(F.lower("token").alias("low"), "token").distinct()
    hit = lambda c: entities.select("id", F.lower(c).alias("low")).join(asked, "low").select("token", "id")
    found = hit("name").unionByName(hit("qualified_name")).distinct()
    scored = found.join(degree(edges, "dst"), "id", "left").select("token", "id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return top(scored, limit, F.desc("degree"), "token", "id")


def path_suffixes(path: Column) -> Column:
    """Every suffix of a path that starts after a slash, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def lookup_paths(tokens: DataFrame, entities: DataFrame, per_token: int = 3) -> DataFrame:
    """L2: (token, id) of the files whose path ends with the token at a segment; shortest paths first.

    Suffixes are exploded for an equi join, only for paths whose last segment some token ends with.
    """
    asked = tokens.select("token", X.normalize_path(F.col("token")).alias("suffix")).distinct()
    last = asked.select(F.element_at(F.split("suffix", "/"), -1).alias("last")).distinct()
    files = entities.filter("file_path is not null").withColumn("last", F.element_at(F.split("file_path", "/"), -1)).join(last, "last", "left_semi")
    hits = files.select("id", "file_path", F.explode(path_suffixes(F.col("file_path"))).alias("suffix")).join(asked, "suffix")
    return ranked_in(hits, ["token"], per_token, F.length("file_path"), "id").select("token", "id")


def chunks_per_entity(links: DataFrame, chunks: DataFrame, entities: DataFrame, per_entity: int = 3, limit: int | None = 50) -> DataFrame:
    """L3: (entity_id, chunk_id): the shortest chunks of each entity."""
    wanted = links.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    sized = wanted.join(chunks.select("chunk_id", F.length("text").alias("n")), "chunk_id")
    return top(ranked_in(sized, ["entity_id"], per_entity, "n", "chunk_id"), limit, "entity_id", "n", "chunk_id").select("entity_id", "chunk_id")


def list_issues(issues: DataFrame, labels: list[str] | None = None, state: str = "open", limit: int | None = 15, number: int | None = None, match: str = "all") -> DataFrame:
    """Issues by state and labels, newest first; if no issue has the labels, all of the state.

    Pull requests (rows with `pull_request`, where issues have that column) are none; the limit is held to 1 to 30.
    """
    issues = issues.filter(F.col("pull_request").isNull()) if "pull_request" in issues.columns else issues
    limit = None if limit is None else min(max(limit, 1), 30)
    if number is not None:
        return issues.filter(F.col("number") == number)
    rows = issues if state == "all" else issues.filter(F.col("state") == state)
    if labels:
        wanted = F.array(*[F.lit(x) for x in labels])
        hit = F.arrays_overlap("labels", wanted) if match == "any" else F.size(F.array_except(wanted, "labels")) == 0
        some = rows.agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("some"))  # one row
        rows = rows.crossJoin(F.broadcast(some)).filter(hit | (F.col("some") == 0)).drop("some")
    return top(rows, limit, F.desc("updated_at"), "number")


def issue_links(issues: DataFrame, entities: DataFrame, edges: DataFrame, per_issue: int = 8) -> DataFrame:
    """(number, id) of the entities each issue's text names, by in-degree."""
    refs = issues.select("number", F.explode(X.extract_refs(F.concat_ws("\n", "title", "body"))).alias("token")).distinct()
    by_name = lookup_names(refs.select("token"), entities, edges, None)
    by_path = lookup_paths(refs.select("token"), entities).join(degree(edges, "dst"), "id", "left").select("token", "id", F.coalesce("degree", F.lit(0)).alias("degree"))
    hits = refs.join(by_name.unionByName(by_path), "token").groupBy("number", "id").agg(F.max("degree").alias("degree"))
    return ranked_in(hits, ["number"], per_issue, F.desc("degree"), "id")


def first_issues(issues: DataFrame, links: DataFrame, limit: int | None = 12, linked: int = 5) -> DataFrame:
    """L4: (number, score, difficulty): in-degrees of the first linked entities and their number."""
    kept = ranked_in(links, ["number"], linked, F.desc("degree"), "id").groupBy("number").agg((F.sum("degree") + F.count(F.lit(1))).alias("score"))
    scored = issues.select("number").join(kept, "number", "left").withColumn("linked", F.col("score").isNotNull()).withColumn("score", F.coalesce("score", F.lit(0)))
    graded = scored.withColumn("difficulty", F.when(F.col("score") < 6, "easy").when(F.col("score") < 20, "medium").otherwise("hard"))
    return top(graded, limit, F.desc("linked"), "score", "number")


def fix_commits(commits: DataFrame, per_issue: int = 10) -> DataFrame:
    """(number, sha, ts): the newest commits that say they fix an issue."""
    refs = commits.select("sha", "ts", F.explode(X.fix_refs(F.col("message"), "commit")).alias("number"))
    return ranked_in(refs, ["number"], per_issue, F.desc("ts"), "sha")


def pull_evidence(pulls: DataFrame, as_of: Column, recent: int = 30, per_issue: int = 5) -> DataFrame:
    """R2: (number, pr, open, draft, merged, stale) among the pulls last updated that mention the issue."""
    body = F.concat_ws("\n", "title", "body")
    mentions = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"#(\d+)\b"), F.lit(1)), lambda x: x.cast("long")))
    rows = pulls.select(F.col("number").alias("pr"), "state", "draft", "merged_at", "updated_at", mentions.alias("m"), X.fix_refs(body, "pull").alias("closes"))
    near = ranked_in(rows.select("*", F.explode("m").alias("issue")), ["issue"], recent, F.desc("updated_at"), "pr")
    hits = ranked_in(near.filter(F.array_contains("closes", F.col("issue"))), ["issue"], per_issue, F.desc("updated_at"), "pr")
    merged, is_open = F.col("merged_at").isNotNull(), F.col("state") == "open"
    stale = is_open & ~merged & (F.col("updated_at") < as_of - F.make_dt_interval(F.lit(STALE_DAYS)))
    return hits.select(F.col("issue").alias("number"), "pr", is_open.alias("open"), F.coalesce("draft", F.lit(False)).alias("draft"), merged.alias("merged"), stale.alias("stale"))


def similar_issues(issues: DataFrame, pool: int = 60, per_issue: int = 8, least: float = SIMILAR) -> DataFrame:
    """(number, other, state, similarity) against the issues last updated; the pool is a fixed small number."""
    recent = top(issues.filter("embedding is not null"), pool, F.desc("updated_at"), "number").select(F.col("number").alias("other"), F.col("state").alias("other_state"), F.col("embedding").alias("e"))
    pairs = issues.filter("embedding is not null").crossJoin(F.broadcast(recent)).filter("number <> other")
    scored = pairs.select("number", "other", F.col("other_state").alias("state"), F.round(cosine(F.col("embedding"), F.col("e")), 3).alias("similarity"))
    return ranked_in(scored, ["number"], per_issue, F.desc("similarity"), "other").filter(F.col("similarity") >= least)


def classify(has_commit: Column, ready: Column, draft: Column, stale: Column, duplicate: Column, related: Column) -> tuple[Column, Column]:
    """(status, confidence); the first that holds wins."""
    ladder = [(has_commit, "merged", "high"), (ready, "open_pr", "medium"), (draft, "draft_pr", "medium"), (stale, "stale_pr", "low"), (duplicate, "duplicate_closed", "medium"), (related, "related", "low")]
    status, confidence = F.lit("none"), F.lit("low")
    for held, name, level in reversed(ladder):
        status = F.when(held, name).otherwise(status)
        confidence = F.when(held, level).otherwise(confidence)
    return status, confidence


def find_resolution(issues: DataFrame, commits: DataFrame, pulls: DataFrame, similar: DataFrame) -> DataFrame:
    """(number, status, confidence, reason, commits, pulls, similar) for every issue at once.

    commits, pulls and similar are the results of R1 to R3.
    """
    c = commits.groupBy("number").agg(F.sort_array(F.collect_list("sha")).alias("commits"))
    live = F.col("open") & ~F.col("merged")
    p = pulls.groupBy("number").agg(
        F.bool_or(live & ~F.col("draft") & ~F.col("stale")).alias("ready"), F.bool_or(live & F.col("draft")).alias("drafted"),
        F.bool_or(live & F.col("stale")).alias("staled"), F.sort_array(F.collect_list("pr")).alias("pulls"),
    )
    s = similar.groupBy("number").agg(
        F.bool_or((F.col("state") == "closed") & (F.col("similarity") >= DUPLICATE)).alias("dup"), F.bool_or(F.col("similarity") >= SIMILAR).alias("rel"),
        F.sort_array(F.collect_list(F.struct("similarity", "other")), False).alias("similar"),
    )
    no = lambda name: F.coalesce(name, F.lit(False))
    rows = issues.select("number").join(c, "number", "left").join(p, "number", "left").join(s, "number", "left")
    status, confidence = classify(F.col("commits").isNotNull(), no("ready"), no("drafted"), no("staled"), no("dup"), no("rel"))
    return rows.select("number", status.alias("status"), confidence.alias("confidence"), F.when(status == "none", "no commit, pull request or similar issue").alias("reason"), "commits", "pulls", "similar")
