"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

A partial partition is a tuple of shard sums with a label for each slot. Differencing takes
the two partial partitions of largest spread and adds them in opposite order (largest slot to
smallest), until one is left; unwinding the merges gives every group its slot.

To run on any number of groups the work is cut in two levels:

* Heavy groups, those of at least total / (shards * HEAVY) bytes, of which there can be no
  more than shards * HEAVY, are differenced together first.
* Light groups are dealt by hash to bins of about BIN groups. Each bin is differenced together
  with its share of the heavy result (the heavy slot sums divided by the number of bins) as
  one more partial partition, so every bin evens out its part of the heavy spread, and the
  slot that holds heavy slot i is shard i.

Texts never move: a group is known by a 128-bit hash of its text. A document's slot counts
within small hash cells of a shard whose offsets are prefix sums, so no shard is ever sorted
as a whole.

Edge cases: null and empty texts are groups of their own (null: 8 bytes a row); an empty table
gives no rows; repeated rows each get a slot; one group larger than a shard's share stays
whole, and the other shards are evened out among themselves.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

HEAVY = 256
BIN = 20_000
ROW_OVERHEAD = 8
SLOT_CELL = 50_000


def difference(parts: list[tuple[int, ...]]) -> list[np.ndarray]:
    """For each partial partition (a tuple of slot sums, any order), the final slot of each of its slots."""
    width = len(parts[0])
    sums, children = [], []
    heap = []
    for i, part in enumerate(parts):
        order = sorted(range(width), key=lambda j: (-part[j], j))
        ordered = [part[j] for j in order]
        sums.append(ordered)
        children.append(order)
        heap.append((ordered[-1] - ordered[0], i))
    heapq.heapify(heap)
    n = len(parts)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        mixed = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(width), key=mixed.__getitem__, reverse=True)
        merged = [mixed[j] for j in order]
        heapq.heappush(heap, (merged[-1] - merged[0], len(sums)))
        sums.append(merged)
        sums[a] = sums[b] = None
        children.append((a, b, order))
    place: list = [None] * len(sums)
    place[heap[0][1]] = np.arange(width)
    for m in range(len(sums) - 1, n - 1, -1):
        a, b, order = children[m]
        own = np.empty(width, np.int64)
        own[order] = place[m]
        place[a], place[b], place[m] = own, own[::-1], None
    out = []
    for i in range(n):
        slot = np.empty(width, np.int64)
        slot[children[i]] = place[i]
        out.append(slot)
    return out


def _heavy(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "h1", "h2"], ascending=[False, True, True])
        slots = difference([(int(b), *[0] * (shards - 1)) for b in pdf["bytes"]])
        return pd.DataFrame({"h1": pdf["h1"], "h2": pdf["h2"], "shard": [int(s[0]) for s in slots], "bytes": pdf["bytes"]})

    return run


def _light(shards: int, share: list[int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "h1", "h2"], ascending=[False, True, True])
        parts = [(int(b), *[0] * (shards - 1)) for b in pdf["bytes"]]
        slots = difference([tuple(share), *parts])
        to_shard = np.empty(shards, np.int64)
        to_shard[slots[0]] = np.arange(shards)
        return pd.DataFrame({"h1": pdf["h1"], "h2": pdf["h2"], "shard": [int(to_shard[s[0]]) for s in slots[1:]]})

    return run


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.octet_length(text)).alias("h2")]


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """groups: h1, h2, bytes. Returns h1, h2, shard."""
    total, count = (int(x or 0) for x in groups.agg(F.sum("bytes"), F.count(F.lit(1))).first())
    bound = max(1, total // (shards * HEAVY))
    heavy = groups.filter(F.col("bytes") >= bound)
    placed = C.checkpoint(heavy.groupBy(F.lit(0).alias("all")).applyInPandas(_heavy(shards), "h1 long, h2 long, shard int, bytes long"))
    bins = max(1, -(-count // BIN))
    sums = dict(placed.groupBy("shard").agg(F.sum("bytes")).collect())  # one row a shard
    share = [int(sums.get(i, 0)) // bins for i in range(shards)]
    light = groups.filter(F.col("bytes") < bound).groupBy(F.pmod(F.xxhash64("h1", "h2"), F.lit(bins)).alias("bin"))
    return placed.select("h1", "h2", "shard").unionByName(light.applyInPandas(_light(shards, share), "h1 long, h2 long, shard int"))


def with_slots(rows: DataFrame, by: str, order: list[str], n_rows: int) -> DataFrame:
    """Adds `slot`, gapless from 0 within `by`, without sorting a whole shard in one task."""
    cells = max(16, n_rows // SLOT_CELL)
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = rows.groupBy(by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(by, "_cell").orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(within) - 1).join(offsets, [by, "_cell"]).withColumn("slot", F.col("_offset") + F.col("_at")).drop("_cell", "_offset", "_at")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; see the module's text."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (C.text_bytes(text) + ROW_OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *text_key(text),
    )
    groups = C.checkpoint(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    n_rows = int(groups.agg(F.sum("n")).first()[0] or 0)
    placed = C.checkpoint(rows.join(assign_groups(groups, shards), ["h1", "h2"]).select("doc_id", "size", "text_crc32", "shard", "h1"))
    slotted = with_slots(placed, "shard", ["doc_id", "h1", "size"], n_rows)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
