"""Hard-negative mining with angular triangle filtering.

Every row stores its norm and its angles to a few reference directions (rows of the table with the
smallest hashes: a sample of at most DIRECTIONS). For an anchor and a row, the angles give an interval of
their cosine by the triangle inequality on the sphere; times both norms, and widened by more
than the rounding, it bounds their integer inner product. A whole tile is skipped if none of its
rows can reach an open window of the anchor's; in the rest only rows whose bounds overlap a window
get an integer product. Windows are, first, the scores that can still be among an anchor's best of the same
label, and then, for each positive, its band of negative scores from the best three found so far on.

In Spark: rows lie in tiles of at most TILE_ROWS, sorted by nearest direction so that a tile's angles lie
close together; anchors lie in blocks of at most BLOCK_ROWS. Anchors are a stated query set against all
rows, so tiles and blocks meet on a grid by one equi join: a tile is sent to each column of blocks, a
block to each group of tiles. A task keeps a block's best over all the tiles it sees and sends only
those on; a window with a limit merges them. Nothing of the rows or anchors passes through the driver.

Defined results: rows with a null id, a null label, a null or empty vector, or a null or non-finite
component take no part, nor do those with a component of LARGEST and more, whose products
would not fit a long. Rows of one id count once: the one with the smallest label, then
vector. Vectors of different lengths are not compared. A zero vector scores 0 with all. Ties go to the smaller id. An
anchor without rows of its label, or a positive without a row in its band, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import angles

from .common import checkpoint

DIRECTIONS = 8
TILE_ROWS, BLOCK_ROWS = 2048, 512
LARGEST = 1 << 26

_PACKED = "pack long, dim int, n int, anchors int, ids binary, labels binary, vectors binary, norms binary, angles binary, marks binary"
_ANGLED = "vec_id long, label long, vector array<long>, mark boolean, norm double, angles array<double>, cell int, near double"


class Pack:
    """The arrays of a packed row; every array is one of Spark's binaries."""

    def __init__(self, row, prefix: str = ""):
        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.key, self.dim, self.n = int(row[prefix + "pack"]), int(row["dim"]), int(row[prefix + "n"])
        self.ids, self.labels, self.norms, self.marks = get("ids", np.int64), get("labels", np.int64), get("norms", np.float64), get("marks", bool)
        self.vectors = get("vectors", np.int32).reshape(self.n, self.dim)
        self.angles = get("angles", np.float64).reshape(self.n, -1)

    def rows(self, at: np.ndarray) -> tuple:
        return self.ids[at], self.labels[at], self.vectors[at], self.norms[at], self.angles[at], self.marks[at]


def _packed(dim: int, ids, labels, vectors, norms, seen, marks) -> dict:
    out = {"ids": np.asarray(ids, np.int64), "labels": np.asarray(labels, np.int64), "vectors": np.asarray(vectors, np.int32), "norms": np.asarray(norms, np.float64), "angles": np.asarray(seen, np.float64), "marks": np.asarray(marks, bool)}
    return {"pack": int(out["ids"][0]), "dim": dim, "n": len(out["ids"]), "anchors": int(out["marks"].sum())} | {k: np.ascontiguousarray(v).tobytes() for k, v in out.items()}


def _with_angles(directions: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n, norm, seen, cell, near = len(pdf), np.zeros(len(pdf)), [None] * len(pdf), np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            widths = np.fromiter(map(len, pdf["vector"]), np.int64, n)
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                norm[at], angle = angles.to_directions(np.stack(pdf["vector"].iloc[at]).astype(float), directions)
                if angle.shape[1]:
                    cell[at], near[at] = angle.argmin(1), angle.min(1)
                for i, a in zip(at, angle):
                    seen[i] = a
            yield pdf.assign(norm=norm, angles=seen, cell=cell, near=near)

    return run


def _pack_rows(tile_rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, own in pdf.groupby(pdf["vector"].map(len), sort=False):
                for at in range(0, len(own), tile_rows):
                    x = own.iloc[at : at + tile_rows]
                    yield pd.DataFrame([_packed(int(dim), x["vec_id"], x["label"], np.stack(x["vector"]), x["norm"], np.stack(x["angles"]), x["mark"])])

    return run


def _pack_anchors(block_rows: int):
    """Anchors of neighbouring tiles of a column, in blocks of at most block_rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        column = None

        def block(dim: int) -> pd.DataFrame:
            return pd.DataFrame([_packed(dim, *(np.concatenate(c) for c in zip(*held.pop(dim)))) | {"column": column}])

        for pdf in frames:
            for row in pdf.to_dict("records"):
                if row["column"] != column:
                    yield from map(block, list(held))
                    column = row["column"]
                tile = Pack(row)
                at = np.flatnonzero(tile.marks)
                for a in range(0, len(at), block_rows):
                    part = at[a : a + block_rows]
                    if sum(len(x[0]) for x in held.get(tile.dim, [])) + len(part) > block_rows:
                        yield block(tile.dim)
                    held.setdefault(tile.dim, []).append(tile.rows(part))
        yield from map(block, list(held))

    return run


def _bounds(block: Pack, tile: Pack, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the integer products of the block's anchors with the tile's rows `at`; the slack grows with the norms."""
    low, high = angles.cosine_bounds(block.angles, tile.angles[at])
    size = block.norms[:, None] * tile.norms[at][None, :]
    return low * size - (1 + 1e-9 * size), high * size + (1 + 1e-9 * size)


def _ceiling(block: Pack, tile: Pack) -> np.ndarray:
    """An upper bound of each anchor's product with any row of the tile."""
    cap = angles.cap_bounds(block.angles, tile.angles.min(0)[None, :], tile.angles.max(0)[None, :])[:, 0]
    return np.where(cap > 0, cap * block.norms * tile.norms.max(), cap * block.norms * tile.norms.min()) + 1 + 1e-9 * block.norms * tile.norms.max()


def _products(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where those are exact."""
    if len(rows) and float(np.abs(anchor).max()) * float(np.abs(rows).max()) * rows.shape[1] < 2**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return rows.astype(np.int64) @ anchor.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:n]
    return scores[order], ids[order]


def _meetings(frames: Iterator[pd.DataFrame]):
    """(block, its row, tiles) for the joined rows of a task, sorted by block."""
    block = row = None
    for pdf in frames:
        for r in pdf.to_dict("records"):
            if block is None or block.key != r["b_pack"]:
                yield block, row, None
                block, row = Pack(r, "b_"), r
            yield block, row, Pack(r)
    yield block, row, None


def _find_positives(n: int):
    """(block, anchor, row, score): each anchor's best rows of its own label among a task's tiles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list = []
        for block, _, tile in _meetings(frames):
            if tile is None:
                if block is not None:
                    yield pd.DataFrame([(block.key, i, int(x), int(s)) for i, (score, ids) in enumerate(best) for s, x in zip(score.tolist(), ids.tolist())], columns=["block", "at", "vec_id", "score"])
                best = []
                continue
            best = best or [(np.empty(0, np.int64), np.empty(0, np.int64))] * block.n
            least = np.array([s[-1] if len(s) == n else -np.inf for s, _ in best])
            if not (open_ := np.flatnonzero(_ceiling(block, tile) >= least)).size:
                continue
            low, high = _bounds(block, tile, np.arange(tile.n))
            for i in open_:
                own = np.flatnonzero((tile.labels == block.labels[i]) & (tile.ids != block.ids[i]))
                if len(own) > n:
                    least[i] = max(least[i], np.partition(low[i, own], len(own) - n)[len(own) - n])
                own = own[high[i, own] >= least[i]]
                if len(own):
                    scores = _products(block.vectors[i], tile.vectors[own])
                    best[i] = _best(np.r_[best[i][0], scores], np.r_[best[i][1], tile.ids[own]], n)

    return run


def _find_negatives(n: int, low_pct: int, high_pct: int):
    """(anchor_id, positive_id, positive_score, vec_id, score): the best rows of other labels in each positive's band among a task's tiles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list = []
        for block, row, tile in _meetings(frames):
            if tile is None:
                out = [(int(block.ids[i]), p, s, int(x), int(y)) for i, p, s, found in best for y, x in zip(*map(np.ndarray.tolist, found))]
                if out:
                    yield pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])
                best = []
                continue
            best = best or [[int(x["at"]), int(x["vec_id"]), int(x["score"]), (np.empty(0, np.int64), np.empty(0, np.int64))] for x in row["positives"] if low_pct * x["score"] <= high_pct * x["score"]]
            ceiling = _ceiling(block, tile)
            wanted: dict[int, list] = {}
            for x in best:  # a band is open from its lower end, or the worst of the best, to its upper end
                least = max(low_pct * x[2] / 100, x[3][0][-1] if len(x[3][0]) == n else -np.inf)
                if ceiling[x[0]] >= least:
                    wanted.setdefault(x[0], []).append((least, x))
            if not wanted:
                continue
            low, high = _bounds(block, tile, np.arange(tile.n))
            for i, bands in wanted.items():
                near = np.zeros(tile.n, bool)
                for least, x in bands:
                    near |= (high[i] >= least) & (low[i] <= high_pct * x[2] / 100)
                near &= tile.labels != block.labels[i]
                at = np.flatnonzero(near)
                scores, ids = _products(block.vectors[i], tile.vectors[at]), tile.ids[at]
                for _, x in bands:
                    own = (low_pct * x[2] <= 100 * scores) & (100 * scores <= high_pct * x[2])
                    x[3] = _best(np.r_[x[3][0], scores[own]], np.r_[x[3][1], ids[own]], n)

    return run


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95,
         tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (vec_id long, label, vector array<long>).

    `anchors` says of a row whether it is an anchor. A positive is one of the anchor's best rows of its label; its negatives are the best
    rows of other labels with low_pct * positive_score <= 100 * score <= high_pct * positive_score.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | (F.abs(x) >= LARGEST))
    held = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector").filter(usable)
    directions = angles.sampled(held, "vec_id", "vector", DIRECTIONS)
    once = held.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    angled = once.withColumn("mark", F.coalesce(anchors, F.lit(False))).withColumns({"norm": F.lit(0.0), "angles": F.array().cast("array<double>"), "cell": F.lit(0), "near": F.lit(0.0)})
    angled = angled.mapInPandas(_with_angles(directions), _ANGLED)
    tiles = checkpoint(angled.repartitionByRange("cell", "near", "vec_id").sortWithinPartitions("cell", "near", "vec_id").mapInPandas(_pack_rows(tile_rows), _PACKED))
    n_tiles, n_anchors = tiles.agg(F.count(F.lit(1)), F.coalesce(F.sum("anchors"), F.lit(0))).first()
    columns = max(1, -(-n_anchors // block_rows))
    groups = max(1, min(n_tiles, -(-4 * rows.sparkSession.sparkContext.defaultParallelism // columns)))
    marked = tiles.filter("anchors > 0").withColumn("column", F.pmod(F.xxhash64("pack"), F.lit(columns)).cast("int"))
    blocks = checkpoint(marked.repartition("column").sortWithinPartitions("column", "pack").mapInPandas(_pack_anchors(block_rows), _PACKED + ", column int"))
    grid = tiles.withColumns({"group": F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int"), "column": F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))})

    def met(some: DataFrame, *more: str) -> DataFrame:
        """Tiles beside blocks, a block's tiles in a row."""
        side = some.select("dim", "column", *[F.col(c).alias(f"b_{c}") for c in ("pack", "n", "ids", "labels", "vectors", "norms", "angles", "marks")], *more)
        side = side.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return grid.join(side, ["dim", "column", "group"]).sortWithinPartitions("b_pack", "pack")

    by = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    found = met(blocks).mapInPandas(_find_positives(positives), "block long, at int, vec_id long, score long")
    found = found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= positives)
    found = found.groupBy("block").agg(F.collect_list(F.struct("at", "vec_id", "score")).alias("positives"))  # block_rows x positives at most
    asked = checkpoint(blocks.join(found.withColumnRenamed("block", "pack"), "pack"))
    taken = met(asked, "positives").mapInPandas(_find_negatives(negatives, low_pct, high_pct), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return taken.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def negatives_digest(embeddings: DataFrame, **sizes: int) -> DataFrame:
    """The query's rows: labels moved on where vec_id is divisible by 7, components floor(256 * x), anchors where vec_id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: 256 * x.cast("double"))
    small = F.col("vec_id").isNotNull() & angles.finite(F.col("embedding")) & ~F.exists("embedding", lambda x: F.abs(256 * x.cast("double")) >= LARGEST)
    rows = embeddings.filter(small).select("vec_id", label.alias("label"), F.transform(scaled, lambda x: F.floor(x)).alias("vector"))
    return mine(rows, F.col("vec_id") % 50 == 0, **sizes)
