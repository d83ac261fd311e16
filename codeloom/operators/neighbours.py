"""Exact similarity search over tiles of vectors, with regions left out by the triangle inequality on the sphere.

A few rows are pivots. A row lies in the cell of its nearest pivot and there in the shell of its angle to it: a region, of
which there are PIVOTS times pi / SHELL at most, whatever the number of rows. A region knows the least and the largest angle of
its rows to every pivot. Two regions whose ranges lie g apart for some pivot hold no two vectors of a cosine above
cos(g). Regions meet by those figures alone; vectors move only for pairs that can matter, in tiles of about tile_rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import angles
from codeloom.functions.blocks import SLACK, Block, exact, rough
from codeloom.runtime import checkpoint

PIVOTS, SHELL, TILE_ROWS = 32, 0.1, 1024
GRID = 16


def _angled(pivots: np.ndarray):
    def run(frames):
        for pdf in frames:
            n, widths = len(pdf), np.fromiter(map(len, pdf["vector"]), np.int64, len(pdf))
            seen, cell, shell = [np.full(len(pivots), np.pi / 2)] * n, np.full(n, -1, np.int32), np.zeros(n, np.int32)
            at = np.flatnonzero(widths == pivots.shape[1])
            if len(at) and len(pivots):
                norms, found = angles.to_directions(np.stack(pdf["vector"].iloc[at]).astype(float), pivots)
                for i, a, c, norm in zip(at, found, found.argmin(1), norms):
                    if norm > 0:
                        seen[i], cell[i], shell[i] = a, c, a[c] / SHELL
            yield pdf.assign(angles=seen, dim=widths.astype(np.int32), cell=cell, shell=shell)

    return run


def in_regions(rows: DataFrame, pivots: np.ndarray, by: list[str] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """rows (with `id` and `vector`) with angles, region (dim, cell, shell), parts (tiles of the region) and part, written once.

    Regions lie within the groups of `by`; a group that fits a tile is one region, and so is a cell. A vector of another length than the pivots, or without a direction, counts as at right
    angles to all of them: its cosine with the pivots' kind is 0.
    """
    by = by or []
    place = [*by, "dim", "cell", "shell"]
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("angles array<double>, dim int, cell int, shell int").fields])
    found = checkpoint(rows.mapInPandas(_angled(pivots), schema))
    total = lambda *keys: F.sum("_n").over(Window.partitionBy(*keys))  # noqa: E731  over the regions of a group, not its rows
    region = F.when(total(*by, "dim") <= tile_rows, F.struct("dim", F.lit(-2).alias("cell"), F.lit(0).alias("shell")))
    region = region.when(total(*by, "dim", "cell") <= tile_rows, F.struct("dim", "cell", F.lit(0).alias("shell"))).otherwise(F.struct("dim", "cell", "shell"))
    regions = found.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).withColumn("region", region).withColumn("parts", F.ceil(total(*by, "region") / tile_rows).cast("int")).drop("_n")
    return checkpoint(found.join(regions, place).drop("dim", "cell", "shell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))


def figures(placed: DataFrame, n_pivots: int, name: str, by: list[str] | None = None) -> DataFrame:
    """The by columns and name_region, name_n, name_parts, name_l and name_h: least and largest angle to each pivot."""
    low, high = ([f(F.col("angles")[i]).alias(f"{x}{i}") for i in range(n_pivots)] for x, f in (("l", F.min), ("h", F.max)))
    found = placed.groupBy(*(by or []), "region").agg(F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts"), *low, *high)
    arrays = [F.array(*[F.col(f"{x}{i}") for i in range(n_pivots)]).cast("array<double>").alias(f"{name}_{x}") for x in ("l", "h")]
    return found.select(*(by or []), *[F.col(c).alias(f"{name}_{c}") for c in ("region", "n", "parts")], *arrays)


def cosine_limit(a: str = "a", b: str = "b") -> Column:
    """The largest cosine that rows of two regions can have."""
    gaps = F.zip_with(F.arrays_zip(f"{a}_l", f"{a}_h"), F.arrays_zip(f"{b}_l", f"{b}_h"), lambda x, y: F.greatest(x[f"{a}_l"] - y[f"{b}_h"], y[f"{b}_l"] - x[f"{a}_h"], F.lit(0.0)))
    limit = F.cos(F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)) - angles.SLACK, F.lit(0.0)))
    return F.when(F.col(f"{a}_region.dim") != F.col(f"{b}_region.dim"), 0.0).otherwise(limit)


def region_pairs(placed: DataFrame, n_pivots: int, by: list[str], least: float) -> DataFrame:
    """(by, a_region, b_region, a_parts, b_parts): pairs of regions of a group, each once, that can hold rows of a cosine of `least`."""
    pairs = figures(placed, n_pivots, "a", by).join(figures(placed, n_pivots, "b", by), by).filter(F.col("a_region") <= F.col("b_region"))
    return pairs.filter(cosine_limit() >= least).select(*by, "a_region", "b_region", "a_parts", "b_parts")


def _nearest_in(limit: int):
    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            a, b, ids = Block(asked["vector"]), Block(held["vector"]), held["id"].to_numpy()
            near, top = rough(a, b), min(limit, len(held))
            least = np.partition(near, len(held) - top, axis=1)[:, len(held) - top]
            i, j = np.nonzero(near >= least[:, None] - SLACK)
            rows = pd.DataFrame({"query_id": asked["id"].to_numpy()[i], "chunk_id": ids[j], "distance": 1 - exact(a, b, i, j)})
            out = rows.sort_values(["query_id", "distance", "chunk_id"]).groupby("query_id", sort=False, dropna=False).head(limit)
        return out if len(out) else pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []}, dtype=object)

    return run


def nearest(chunks: DataFrame, queries: DataFrame, limit: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """V2 for a table of queries of any size: (query_id, chunk_id, distance, rank), ties to the smaller chunk_id; equal query_ids ask once.

    Queries lie in regions like the rows. First each region of queries looks into the regions that can be nearest, as many as hold
    enough rows; its worst query's last hit then bounds which others are worth a visit.
    """
    held = chunks.filter(F.size("embedding") >= 0).select(F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = queries.filter(F.size("vector") >= 0).select(F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["id"])
    pivots = angles.sampled(held.filter(F.size("vector") > 0), "id", "vector", PIVOTS)
    rows, wanted = in_regions(held, pivots, tile_rows=tile_rows), in_regions(asked, pivots, tile_rows=tile_rows)
    # Figures of regions only, whose number is bounded: each of the queries' meets each of the rows' once.
    tiles = figures(rows, len(pivots), "b").withColumn("_g", F.pmod(F.xxhash64("b_region"), F.lit(GRID)))
    askers = figures(wanted, len(pivots), "a").withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID - 1).cast("long"))))
    able = checkpoint(askers.join(tiles, "_g").select("a_region", "b_region", "a_parts", "b_parts", "b_n", cosine_limit().alias("most")))
    schema = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("chunk_id", held.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    key = ["a_region", "a_part", "b_region", "b_part"]

    def visit(pairs: DataFrame) -> DataFrame:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = wanted.select("id", "vector", F.col("region").alias("a_region"), F.col("part").alias("a_part")).join(pairs, "a_region").withColumn("b_part", every("b_parts"))
        right = rows.select("id", "vector", F.col("region").alias("b_region"), F.col("part").alias("b_part")).join(pairs, "b_region").withColumn("a_part", every("a_parts"))
        return left.select(*key, "id", "vector").groupBy(*key).cogroup(right.select(*key, "id", "vector").groupBy(*key)).applyInPandas(_nearest_in(limit), schema)

    best = Window.partitionBy("a_region").orderBy(F.desc("most"), F.desc("b_n"), "b_region")
    first = able.withColumn("_before", F.sum("b_n").over(best) - F.col("b_n")).filter(F.col("_before") < limit).drop("_before")
    found = checkpoint(visit(first))
    ends = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))).filter(F.col("_r") == limit).select("query_id", "distance")
    last = wanted.select(F.col("id").alias("query_id"), F.col("region").alias("a_region")).join(ends, "query_id", "left")
    open_ = last.groupBy("a_region").agg(F.min(F.when(F.col("distance").isNotNull(), 1 - F.col("distance")).otherwise(float("-inf"))).alias("least"))
    more = able.join(open_, "a_region").filter(F.col("most") >= F.col("least") - SLACK).join(first, ["a_region", "b_region"], "left_anti")
    by = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.unionByName(visit(more)).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)
