"""Entity resolution (G10-G13): merge by name, greedy merge by vector, redirects and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import angles
from codeloom.functions.blocks import SLACK, Block, exact, rough
from codeloom.operators import neighbours
from codeloom.runtime import checkpoint, union

MERGE, FLAG = 0.9, 0.75
TILE_ROWS = 2048
#: Vectors of fewer numbers than this fill a tile with more rows in proportion.
TILE_WIDTH = 512
#: Rows of a tile whose cosines with another one are held at once.
STRIP_ROWS = 1024


def merge_by_name(entities: DataFrame, types: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(dup_id, canonical_id): the earliest of each (workspace, type, normalized name) stands for the others.

    An aggregate and a join rather than a window, so a very common name is never sorted in one task.
    """
    by = by or ["workspace_id", "type", "normalized_name"]
    rows = entities if types is None else entities.filter(F.col("type").isin(types))
    first = rows.groupBy(*by).agg(F.min_by("id", F.struct("created_at", "id")).alias("canonical_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(first, by).filter("id <> canonical_id").select(F.col("id").alias("dup_id"), "canonical_id")


def similar_pairs(vectors: DataFrame, block: list[str], least: float = FLAG, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b, ord_a, ord_b, similarity) of entities of one block with a before b, cosine at least `least`, and different names.

    vectors: id, ord, name, embedding and the block columns; rows without an embedding, and those with
    a null in a block column, have no partner. Exact: a block lies in regions around pivots, and every two regions that can
    hold a pair (neighbours.py) meet, in tiles of about tile_rows, or more where vectors are short. A task holds two tiles, takes
    their matrix product by strips and returns only the pairs found, so a block of any size is spread over tasks.
    """
    numbers = vectors.schema["embedding"].dataType
    kept = "array<float>" if isinstance(getattr(numbers, "elementType", None), T.FloatType) else "array<double>"
    held = vectors.filter("embedding is not null").select(*block, "id", "ord", "name", F.col("embedding").cast(kept).alias("vector")).dropna(subset=block)
    pivots = angles.sampled(held.filter(F.size("vector") > 0), "id", "vector", neighbours.PIVOTS)
    placed = neighbours.in_regions(held, pivots, block, tile_rows)
    pairs = neighbours.region_pairs(placed, len(pivots), block, least)
    tiles = _tiles(placed, block, tile_rows)
    # A region's rows go to every tile that holds a region they can meet, once.
    meets = union([pairs.select(*block, F.col(f"{x}_region").alias("region"), F.col(f"{y}_region").alias("_other")) for x, y in (("a", "b"), ("b", "a"))])
    held_by = tiles.select(*block, F.col("region").alias("_other"), F.col("tile").alias("_met")).distinct()
    sends = meets.join(held_by, [*block, "_other"]).groupBy(*block, "region").agg(F.collect_set("_met").alias("_mets"))
    sends = checkpoint(tiles.join(sends, [*block, "region"]).select(*block, "region", "part", "tile", "_mets"))
    met = placed.join(sends, [*block, "region", "part"]).select(*block, "id", "ord", "name", "vector", "tile", F.explode("_mets").alias("_met"))
    met = met.select(*block, F.least("tile", "_met").alias("_i"), F.greatest("tile", "_met").alias("_j"), (F.col("tile") > F.col("_met")).alias("_right"), "id", "ord", "name", "vector")
    kinds = {c: held.schema[c].dataType.simpleString() for c in ("id", "ord")}
    schema = f"a {kinds['id']}, b {kinds['id']}, ord_a {kinds['ord']}, ord_b {kinds['ord']}, similarity double"
    return met.groupBy(*block, "_i", "_j").applyInPandas(_tile_pairs(least), schema)


def _tiles(placed: DataFrame, block: list[str], tile_rows: int) -> DataFrame:
    """(block, region, part, tile): small regions of a block and width share a tile; short vectors make larger ones."""
    sizes = placed.groupBy(*block, "region", "part").agg(F.count(F.lit(1)).alias("_n"))
    room = tile_rows * F.greatest(F.lit(1), F.floor(F.lit(TILE_WIDTH) / F.greatest(F.col("region.dim"), F.lit(1))))
    # Over the regions and parts of a block, not its rows.
    before = F.sum("_n").over(Window.partitionBy(*block, "region.dim").orderBy("region", "part")) - F.col("_n")
    return sizes.select(*block, "region", "part", F.struct(F.col("region.dim").alias("dim"), F.floor(before / room).alias("n")).alias("tile"))


def _tile_pairs(least: float):
    import numpy as np
    import pandas as pd

    def strip(x: pd.DataFrame, y: pd.DataFrame, b: Block, start: int, one_tile: bool) -> pd.DataFrame:
        a = Block(x["vector"])
        i, j = np.nonzero(rough(a, b) >= least - SLACK)
        if one_tile:  # each pair once
            i, j = i[i + start < j], j[i + start < j]
        similarity = exact(a, b, i, j)
        ids, ords, names = ([side[c].to_numpy()[at] for side, at in ((x, i), (y, j))] for c in ("id", "ord", "name"))
        keep = (similarity >= least) & (ords[0] != ords[1]) & (pd.Series(names[0]).fillna("\0") != pd.Series(names[1]).fillna("\0")).to_numpy()
        first = (ords[0] < ords[1])[keep]
        pick = lambda c: (np.where(first, c[0][keep], c[1][keep]), np.where(first, c[1][keep], c[0][keep]))
        (one, two), (ord_one, ord_two) = pick(ids), pick(ords)
        return pd.DataFrame({"a": one, "b": two, "ord_a": ord_one, "ord_b": ord_two, "similarity": similarity[keep]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        right = pdf["_right"].to_numpy()
        one_tile = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        x, y = (pdf, pdf) if one_tile else (pdf[~right], pdf[right])
        b = Block(y["vector"])
        return pd.concat([strip(x[at : at + STRIP_ROWS], y, b, at, one_tile) for at in range(0, max(len(x), 1), STRIP_ROWS)])

    return run


def greedy_merge(pairs: DataFrame, merge: float = MERGE) -> DataFrame:
    """(dup_id, canonical_id). In order, a node merges into its first earlier neighbour that survives.

    pairs: a, b, ord_a, ord_b, similarity with a before b. Each round decides every node whose
    earlier neighbours are all decided, so the rounds number the longest chain, not the nodes.
    After rounds 1, 2, 4 and so on the pairs that can't matter any more are dropped.
    A merged node takes nothing in: chains are not closed transitively.
    """
    close = checkpoint(pairs.filter(F.col("similarity") >= merge).select("a", "b", "ord_a"))
    nodes = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct()
    before = F.struct("ord_a", "a")
    kind = close.select(before.alias("first")).schema["first"].dataType
    state = checkpoint(nodes.withColumn("into", F.lit(None).cast(close.schema["a"].dataType)).withColumn("done", F.lit(False)).withColumn("first", F.lit(None).cast(kind)))
    rounds = 0
    while not state.filter("not done").isEmpty():
        earlier = close.join(state.select(F.col("id").alias("a"), F.col("done").alias("a_done"), F.col("into").alias("a_into")), "a")
        survivor = F.col("a_done") & F.col("a_into").isNull()
        seen = earlier.groupBy(F.col("b").alias("id")).agg(F.min(F.when(survivor, before)).alias("first"), F.min(F.when(~F.col("a_done"), before)).alias("open"))
        joined = state.drop("first").join(seen, "id", "left")
        takes = F.col("first").isNotNull() & (F.col("open").isNull() | (F.col("first") < F.col("open")))
        now = ~F.col("done") & (takes | F.col("open").isNull())
        state = checkpoint(joined.select("id", F.when(now & takes, F.col("first.a")).otherwise(F.col("into")).alias("into"), (F.col("done") | now).alias("done"), "first"))
        rounds += 1
        if rounds & (rounds - 1) == 0:
            close = checkpoint(_undecided(close, state))
    return state.filter("into is not null").select(F.col("id").alias("dup_id"), F.col("into").alias("canonical_id"))


def _undecided(close: DataFrame, state: DataFrame) -> DataFrame:
    """The pairs that may still decide a node: b isn't decided, a hasn't merged and doesn't lie behind b's first survivor so far."""
    left = close.join(state.filter("not done").select(F.col("id").alias("b"), "first"), "b").filter(F.col("first").isNull() | (F.struct("ord_a", "a") <= F.col("first")))
    merged = state.filter("into is not null").select(F.col("id").alias("a"))
    return left.select(*close.columns).join(merged, "a", "left_anti")


def apply_merges(entities: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without the merged ones; edges redirected, self-loops dropped, each once."""
    out = edges
    for end in ("src", "dst"):
        to = merges.select(F.col("dup_id").alias(end), F.col("canonical_id").alias("_to"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    left = entities.join(merges.select(F.col("dup_id").alias("id")), "id", "left_anti")
    return left, out.filter("src <> dst").select(*edges.columns).distinct()


def duplicate_flags(pairs: DataFrame, merge: float = MERGE, flag: float = FLAG) -> DataFrame:
    """(id, possible_duplicates) for the band between flag and merge."""
    band = pairs.filter((F.col("similarity") >= flag) & (F.col("similarity") < merge))
    return band.groupBy(F.col("b").alias("id")).agg(F.sort_array(F.collect_set(F.struct(F.col("a").alias("id"), "similarity"))).alias("possible_duplicates"))


def earliest_first(entities: DataFrame) -> DataFrame:
    """Adds `ord`, a total order of creation within a workspace and type."""
    return entities.withColumn("ord", F.row_number().over(Window.partitionBy("workspace_id", "type").orderBy("created_at", "id")))
