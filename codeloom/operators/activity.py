"""Activity, cost and tenant analytics (A1-A15) and query-service projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions.vectors import micro_cents, token_estimate
from codeloom.operators.issues import path_suffixes, ranked_in
from codeloom.runtime import checkpoint, top, union

# Daily limits by kind of identity.
COUNTERS = ("workspaces", "messages", "tokens")
LIMITS = {"guest": {"workspaces": 0, "messages": 10, "tokens": 40_000}, "user": {"workspaces": 3, "messages": 50, "tokens": 200_000}}


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def bus_factor(commits: DataFrame, author: str = "author") -> DataFrame:
    """A2: one row `bus_factor`: the fewest top authors with half of the commits; 0 without commits.

    The running sum is over the distinct numbers of commits an author has, not over authors: of those
    there are at most about the square root of twice the commits.
    """
    counts = commits.groupBy(author).agg(F.count(F.lit(1)).alias("c"))
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = [F.coalesce(F.sum(x).over(above), F.lit(0)).alias(name) for x, name in ((F.col("n"), "authors"), (F.col("n") * F.col("c"), "before"))]
    run = levels.select("c", "n", *sums, F.sum(F.col("n") * F.col("c")).over(whole).alias("t"))
    reached = run.filter("2 * (before + n * c) >= t").select((F.col("authors") + F.greatest(F.ceil((F.col("t") / 2 - F.col("before")) / F.col("c")), F.lit(0))).alias("r"))
    return reached.agg(F.coalesce(F.min("r"), F.lit(0)).cast("long").alias("bus_factor"))


def git_insights(commits: DataFrame, as_of: Column) -> DataFrame:
    """A1: one row of totals over commits (author, ts, message); zeros for an empty table."""
    kind = X.conventional_type(F.col("message"))
    fix, feat = F.count_if(kind == "fix"), F.count_if(kind == "feat")
    within = lambda d: F.col("ts") >= days_before(as_of, d)
    totals = commits.agg(
        F.max("ts").alias("last_commit"), F.count(F.lit(1)).alias("commits"), F.count_if(within(30)).alias("commits_30d"), F.count_if(within(90)).alias("commits_90d"),
        F.count_distinct(F.when(within(90), F.col("author"))).alias("active_authors"), fix.alias("fixes"), feat.alias("features"),
        F.when(feat > 0, F.round(fix / feat, 2)).alias("fix_feat_ratio"), F.count_if(within(90) & X.is_breaking(F.col("message"))).alias("breaking"),
    )
    return totals.crossJoin(bus_factor(commits))  # one row each


def top_authors(commits: DataFrame, limit: int = 5) -> DataFrame:
    """A1: (author, commits)."""
    return top(commits.groupBy("author").agg(F.count(F.lit(1)).alias("commits")), limit, F.desc("commits"), "author")


def monthly_commits(commits: DataFrame) -> DataFrame:
    """A1: (month, commits)."""
    return commits.groupBy(X.month_utc(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("commits"))


def sparkline(monthly: DataFrame, months: int = 12, least: int = 4) -> DataFrame:
    """A3: the last months scaled to their maximum in percent."""
    last = monthly.orderBy(F.desc("month")).limit(months)
    peak = last.agg(F.max("commits").alias("peak"))
    return last.crossJoin(F.broadcast(peak)).select("month", "commits", F.greatest(F.lit(least), F.round(F.col("commits") * 100 / F.col("peak")).cast("int")).alias("pct"))


def user_report(users: DataFrame, workspaces: DataFrame, sessions: DataFrame, messages: DataFrame, as_of: Column, limit: int | None = 200) -> DataFrame:
    """A4: users with workspaces owned, own messages in 30 days and whether they brought a key; measures are aggregated before the joins.

    The key itself (encrypted_byok_api_key, where users have it) doesn't come out.
    """
    owned = workspaces.groupBy(F.col("owner_user_id").alias("id")).agg(F.count(F.lit(1)).alias("workspaces"))
    recent = messages.filter((F.col("role") == "user") & (F.col("created_at") >= days_before(as_of, 30)))
    sent = recent.join(sessions.select(F.col("id").alias("session_id"), "user_id"), "session_id").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("messages_30d"))
    rows = users.join(owned, "id", "left").join(sent, "id", "left").fillna(0, ["workspaces", "messages_30d"])
    if "encrypted_byok_api_key" in users.columns:
        rows = rows.withColumn("has_byok", F.col("encrypted_byok_api_key").isNotNull()).drop("encrypted_byok_api_key")
    return top(rows, limit, F.desc("created_at"), "id")


def tenant_cost_report(workspaces: DataFrame, users: DataFrame, costs: DataFrame, limit: int | None = None) -> DataFrame:
    """A5: workspaces with owner login and cost in cents."""
    spent = costs.groupBy(F.col("workspace_id").alias("id")).agg(F.sum("usd_micro_cents").alias("m"))
    owner = users.select(F.col("id").alias("owner_user_id"), F.col("login").alias("owner"))
    rows = workspaces.join(owner, "owner_user_id", "left").join(spent, "id", "left").withColumn("cost_cents", F.coalesce("m", F.lit(0)) / 10000).drop("m")
    return top(rows, limit, F.desc("created_at"), "id")


def overview_row(users: DataFrame, workspaces: DataFrame, sessions: DataFrame, messages: DataFrame, costs: DataFrame, as_of: Column) -> DataFrame:
    """One row: counts, active users in 30 days, cost today and in seven days."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    active = sessions.filter(F.col("updated_at") >= days_before(as_of, 30)).agg(F.count_distinct("user_id").alias("active_users_30d"))
    today, week = F.col("ts") >= F.date_trunc("day", as_of), F.col("ts") >= days_before(as_of, 7)
    cost = costs.agg(F.coalesce(F.sum(F.when(today, F.col("usd_micro_cents"))), F.lit(0)).alias("cost_today"), F.coalesce(F.sum(F.when(week, F.col("usd_micro_cents"))), F.lit(0)).alias("cost_7d"))
    out = n(users, "users")
    for part in (n(workspaces, "workspaces"), workspaces.agg(F.count_if(F.col("status") == "ready").alias("ready")), n(sessions, "sessions"), n(messages, "messages"), active, cost):
        out = out.crossJoin(part)  # one row each
    return out


def audit_listing(events: DataFrame, action: str | None = None, limit: int = 500) -> DataFrame:
    """A7."""
    return top(events if action is None else events.filter(F.col("action") == action), limit, F.desc("ts"), "id")


def session_list(messages: DataFrame, limit: int | None = 50, preview: int = 200) -> DataFrame:
    """(session_id, messages, last_at, preview), newest first. messages: session_id, content, created_at."""
    rows = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.max("created_at").alias("last_at"), F.substring(F.max_by("content", "created_at"), 1, preview).alias("preview"))
    return top(rows, limit, F.desc("last_at"), "session_id")


def transcript(messages: DataFrame, session_id) -> DataFrame:
    """A9."""
    return messages.filter(F.col("session_id") == session_id).orderBy("created_at", "id")


def prior_turns(messages: DataFrame, n: int = 16, cut: int = 3000, take: str = "oldest") -> DataFrame:
    """A10: the oldest (as the source has it) or latest n turns of each session, each cut with a mark."""
    order = [F.col("created_at"), F.col("id")] if take == "oldest" else [F.desc("created_at"), F.desc("id")]
    short = F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("… [truncated]"))).otherwise(F.col("content"))
    return ranked_in(messages, ["session_id"], n, *order).withColumn("content", short)


def quota_status(usage: DataFrame, identities: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """(identity, day, used and exceeded by counter). usage: identity, ts, counter, amount. identities: identity, kind, bypass."""
    daily = usage.groupBy("identity", F.to_date("ts").alias("day")).pivot("counter", list(COUNTERS)).agg(F.sum("amount"))
    rows = daily.join(identities, "identity")
    for c in COUNTERS:
        most = F.lit(None).cast("int")
        for kind, m in limits.items():
            most = F.when(F.col("kind") == kind, m[c]).otherwise(most)
        used = F.when(F.col("bypass"), 0).otherwise(F.coalesce(c, F.lit(0)))
        rows = rows.withColumn(f"{c}_used", used).withColumn(f"{c}_exceeded", used >= most)
    return rows.select("identity", "day", *[f"{c}_{x}" for c in COUNTERS for x in ("used", "exceeded")])


def owner_workspaces(workspaces: DataFrame, owner, limit: int = 100) -> DataFrame:
    """A13."""
    return top(workspaces.filter(F.col("owner_user_id") == owner), limit, F.desc("created_at"), "id")


BUCKETS = 1024


def exact_percentiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """by and one column for each of the quantiles (name to share): exact, between ranks linear, of the finite values.

    A rank is looked for in buckets between the least and the largest value; the bucket that holds it becomes the next range, until all its
    values are one. A pass keeps BUCKETS counts a range, never the values, and narrows the range BUCKETS times.
    """
    held = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("abs(_v) < double('infinity')")
    whole = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    same = lambda a, b, keys: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    ranks = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_n") - 1)
        ranks += [whole.select(*by, "_low", "_high", F.lit(name).alias("_q"), (at - F.floor(at)).alias("_share"), F.lit(top_end).alias("_up"), end(at).cast("long").alias("_rank")) for top_end, end in ((False, F.floor), (True, F.ceil))]
    ranks = checkpoint(union(ranks))
    while not (wide := ranks.filter("_low < _high")).isEmpty():
        spans = wide.select(*by, "_low", "_high").distinct()
        inside = held.alias("r").join(spans.alias("s"), same("r", "s", by) & F.col("_v").between(F.col("_low"), F.col("_high"))).select(*[f"s.{k}" for k in by], "_low", "_high", "_v")
        half = lambda c: F.col(c) / 2 - F.col("_low") / 2  # noqa: E731  a whole difference may not fit a double
        bucket = F.when(half("_high") > 0, F.least(F.floor(half("_v") / half("_high") * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.when(F.col("_v") > F.col("_low"), BUCKETS - 1).otherwise(0))
        counts = inside.groupBy(*by, "_low", "_high", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = F.sum("_c").over(Window.partitionBy(*by, "_low", "_high").orderBy("_b"))
        found = counts.withColumn("_before", upto - F.col("_c"))
        keys = [*by, "_low", "_high"]
        next_ = wide.alias("w").join(found.alias("f"), same("w", "f", keys) & (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        next_ = next_.select(*[f"w.{k}" for k in by], F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_q", "_share", "_up", (F.col("_rank") - F.col("_before")).alias("_rank"))
        ranks = checkpoint(ranks.filter("_low >= _high").unionByName(next_))
    ends = ranks.groupBy(*by, "_q").agg(F.max(F.when(~F.col("_up"), F.col("_low"))).alias("a"), F.max(F.when(F.col("_up"), F.col("_low"))).alias("b"), F.max("_share").alias("s"))
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == name, F.col("a") + (F.col("b") - F.col("a")) * F.col("s"))).alias(name) for name in quantiles])


def trace_rollup(traces: DataFrame) -> DataFrame:
    """Runs, failures, failure rate and latency by operator. traces: op, ok, duration_ms."""
    sums = traces.groupBy("op").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.count_if(~F.col("ok")) / F.count(F.lit(1)), 4).alias("failure_rate"),
        F.round(F.avg("duration_ms"), 4).alias("avg_ms"),
    )
    ends = exact_percentiles(traces, ["op"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnRenamed("op", "_op")
    joined = sums.join(ends, F.col("op").eqNullSafe(F.col("_op")), "left").drop("_op")
    return joined.withColumns({c: F.round(c, 4) for c in ("p50_ms", "p95_ms")})


def slowest(traces: DataFrame, n: int = 10) -> DataFrame:
    """The slowest steps."""
    return top(traces, n, F.desc("duration_ms"), "message_id", "step_id")


def cost_backfill(workspaces: DataFrame, costs: DataFrame, entities: DataFrame, chunks: DataFrame, cents_in: float, cents_out: float, cents_embed: float) -> DataFrame:
    """Cost rows of finished workspaces without a backfill mark: 800 and 200 tokens an annotation, a token for four characters embedded."""
    marked = costs.filter(F.col("phase").startswith("backfill:")).select(F.col("workspace_id").alias("id"))
    todo = workspaces.filter(F.col("status") == "ready").join(marked, "id", "left_anti").select(F.col("id").alias("workspace_id"))
    noted = entities.filter("description is not null").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))
    notes = todo.join(noted, "workspace_id").select("workspace_id", F.lit("backfill:annotate").alias("phase"), (F.col("n") * 800).alias("input_tokens"), (F.col("n") * 200).alias("output_tokens"))
    embedded = chunks.filter("embedding is not null").groupBy("workspace_id").agg(F.sum(token_estimate(F.col("text"))).alias("input_tokens"))
    embeds = todo.join(embedded, "workspace_id").select("workspace_id", F.lit("backfill:embed").alias("phase"), "input_tokens", F.lit(0).cast("long").alias("output_tokens"))
    price = F.when(F.col("phase") == "backfill:embed", micro_cents(F.col("input_tokens"), cents_embed)).otherwise(micro_cents(F.col("input_tokens"), cents_in) + micro_cents(F.col("output_tokens"), cents_out))
    return notes.unionByName(embeds).withColumn("usd_micro_cents", price)


def chunk_by_id(chunks: DataFrame, chunk_id) -> DataFrame:
    """W2."""
    return chunks.filter(F.col("chunk_id") == chunk_id)


def latest_chunk(chunks: DataFrame, path: str, other_than=None) -> DataFrame:
    """The newest chunk of a path that is no diff."""
    rows = chunks.filter((F.col("file_path") == path) & (F.coalesce("kind", F.lit("")) != "diff"))
    return top(rows if other_than is None else rows.filter(F.col("chunk_id") != other_than), 1, F.desc("created_at"), "chunk_id")


def commit_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(sha, pos, path, id) in order; id is null for an unknown path."""
    rows = commits.select("sha", F.posexplode("files_changed").alias("pos", "path"))
    return rows.join(files.select("path", "id"), "path", "left").select("sha", "pos", "path", "id")


def freshness(commits: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(id, behind): commits newer than the indexed one; null where it is unknown."""
    at = commits.select("workspace_id", F.col("sha").alias("indexed_commit_sha"), F.col("ts").alias("indexed_ts"))
    known = workspaces.select(F.col("id").alias("workspace_id"), "indexed_commit_sha").join(at, ["workspace_id", "indexed_commit_sha"], "left")
    rows = known.join(commits.select("workspace_id", "ts"), "workspace_id", "left")
    return rows.groupBy(F.col("workspace_id").alias("id")).agg(F.when(F.max("indexed_ts").isNotNull(), F.count_if(F.col("ts") > F.col("indexed_ts"))).alias("behind"))


def public_listing(workspaces: DataFrame, query: str = "", limit: int | None = 50) -> DataFrame:
    """Public, ready workspaces whose name contains the text, latest indexed first, never indexed last."""
    rows = workspaces.filter("is_public and status = 'ready'").filter(F.lower("name").contains(query.lower()))
    return top(rows, limit, F.col("last_indexed_at").desc_nulls_last(), "id")


def public_stats(workspaces: DataFrame) -> DataFrame:
    """(id, stats): only the top-level finite numbers of the stats document, as doubles; a string that looks like one is none."""
    fields = F.try_variant_get(F.try_parse_json("stats"), "$", "map<string,variant>")
    numbers = F.map_filter(fields, lambda _, v: F.schema_of_variant(v).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return workspaces.select("id", F.transform_values(numbers, lambda _, v: v.cast("double")).alias("stats"))


def chunks_for_paths(chunks: DataFrame, paths: DataFrame, per_path: int = 3) -> DataFrame:
    """(path, chunk_id): chunks of exactly that path, by suffix only where there is none."""
    asked = paths.select("path", X.normalize_path(F.col("path")).alias("plain")).distinct()
    own = chunks.select("chunk_id", "file_path", "start_line")
    exact = own.join(asked.select("path", F.explode(F.array_distinct(F.array("path", "plain"))).alias("file_path")), "file_path").select("path", "chunk_id", "start_line", F.lit(0).alias("p"))
    suffix = own.select("chunk_id", "start_line", F.explode(path_suffixes(F.col("file_path"))).alias("plain")).join(asked, "plain").select("path", "chunk_id", "start_line", F.lit(1).alias("p"))
    both = exact.unionByName(suffix)
    best = both.groupBy("path").agg(F.min("p").alias("p"))
    return ranked_in(both.join(best, ["path", "p"]), ["path"], per_path, "start_line", "chunk_id").select("path", "chunk_id")


def pinned_chunks(links: DataFrame, chunks: DataFrame, entities: DataFrame, limit: int = 12) -> DataFrame:
    """Chunks of the pinned entities (id)."""
    wanted = links.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("chunk_id").distinct()
    return top(chunks.join(wanted, "chunk_id", "left_semi"), limit, "chunk_id")
