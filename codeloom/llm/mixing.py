"""Mixing sources to target weights by capped water-filling.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share a budget of
`budget_pct` percent of all words. A source stops at `max_epochs` times its own words; the
excess is shared again by weight until no source is above its cap. In closed form: with
sources ordered by cap / weight, the capped ones are the prefix whose ratio does not exceed
the water level left for the rest, so one window over the small source table finds the
fixed point.

A target of q whole epochs and a fraction repeats every document q times and one further time
those first in a seeded order, up to the fraction of the source's words (the document that
crosses it belongs to the nearer side). The order is cut into
hash buckets whose sums are cumulated per source; only the bucket in which the fraction ends
is ordered row by row, so no source, however large, is sorted in one task.

Edge cases: null and empty texts have size 0 and take nothing; a source without words has
target 0; repeated rows are separate rows; an empty table gives no rows. The number of
sources is taken to fit one task (their totals only, never their rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
BUDGET_PCT = 150
MAX_EPOCHS = 2
BUCKET_ROWS = 20_000


def water_fill(sources: DataFrame, weights: tuple = WEIGHTS, budget_pct: int = BUDGET_PCT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources: source, source_size. Adds `target` (double)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prior = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("budget", F.sum("source_size").over(everything) * budget_pct / F.lit(100))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(prior), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(prior), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    )
    # The first source that is not capped fixes the water level of it and all behind it.
    water = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)
    level = water["level"]
    return filled.select("source", "source_size", F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("w"))).alias("target"))


def seeded(seed: int, *columns: str) -> Column:
    """A number in [0, 2^52) that depends on the columns and the seed alone; md5, so SQL engines agree."""
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, budget_pct: int = BUDGET_PCT, max_epochs: int = MAX_EPOCHS, seed: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken; with `whole`, the input row as the struct `_row` as well."""
    keep = ["_row"] if whole else []
    sized = docs.select("doc_id", "source", C.word_count(F.col("text")).alias("size"), *([F.struct("*").alias("_row")] if whole else [])).withColumn("u", seeded(seed, "doc_id", "size"))
    rows, sized = sized, sized.drop("_row")
    n_rows = docs.count()
    buckets = max(64, n_rows // BUCKET_ROWS)
    width = (1 << 52) // buckets + 1
    per_bucket = C.checkpoint(sized.groupBy("source", F.floor(F.col("u") / width).alias("b")).agg(F.sum("size").alias("words")))
    sources = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = C.checkpoint(
        water_fill(sources, weights, budget_pct, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        per_bucket.withColumn("upto", F.sum("words").over(run))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .filter(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min_by(F.struct("b", (F.col("upto") - F.col("words")).alias("before")), "b").alias("cut"))
    )
    plan = targets.join(ends.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", F.coalesce("cut.b", F.lit(-1)).alias("cut_b"), F.coalesce("cut.before", F.lit(0)).alias("before"))
    plan = C.checkpoint(plan)
    limit = 1 << 20
    n_sources = plan.count()
    small = F.broadcast(plan) if n_sources <= limit else plan
    b = F.floor(F.col("u") / width)
    joined = rows.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    columns = ["doc_id", "source", *keep, "size", "source_size", "target"]
    clear = joined.filter(b != F.col("cut_b")).withColumn("extra", (b < F.col("cut_b")).cast("long"))
    order = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = joined.filter(b == F.col("cut_b")).withColumn("extra", ((F.col("before") + F.sum("size").over(order)) * 2 - F.col("size") <= F.col("rest") * 2).cast("long"))
    mixed = clear.unionByName(edge).withColumn("repeats", F.col("whole") + F.col("extra"))
    return mixed.select(*columns, "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it."""
    mixed = mix_documents(docs, whole=True).filter("repeats > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("_row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (to 6 digits), taken."""
    return mix_documents(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
