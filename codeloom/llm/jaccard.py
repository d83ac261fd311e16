"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

Tokens are the distinct word shingles of a document; two documents link when
100 * intersection >= threshold_pct * union. Equal texts are collapsed first, so a class of copies
costs one node whatever its size.

* Token order: rarest first. Document frequencies are counted over all documents in one row
  of hashed cells as wide as the text, merged shard by shard (see common.py); a document
  learns the frequency class of each of its own tokens. A frequency is never underestimated,
  and both documents of a pair see the same one.
* Prefix: a document of n tokens can miss n - ceil(t * n) of them, so the first
  n - ceil(t * n) + 1 hold a shared token. Tokens of at most FREQUENT documents are indexed
  singly (a posting list has at most FREQUENT entries). Frequent tokens fall into classes by
  hash and are indexed as pairs within a class; each class can waste one token, so the prefix
  is extended until its single tokens and its second and later tokens of each class number
  n - ceil(t * n) + 1. The last tokens of the two prefixes being ordered, the shared
  combination lies in both. The number of classes grows with the length: sizes are cut into bands
  so that the two documents of a link lie in one band or in neighbours, and a document is indexed
  with the classes of its own band and of the next. A class then has two tokens of a prefix on
  average, and a document has keys in proportion to its length. A token that occurs nowhere else
  counts, but isn't indexed.
* Verification without all pairs of a posting list: every document is held against the centre of
  each of its lists, the document with the smallest share of tokens of its own. That gives links,
  and for those that lie outside the component of their centre c the exact way on: the *delta* of a
  document is its symmetric difference with c. With m tokens of c missing and e further ones, a
  document links with c iff cost = m + t * e <= (1 - t) * |c|; two documents x, y link iff their
  deltas share at least (cost x + cost y - (1 - t) * |c|) / (1 + t) tokens. That is more than half
  of what a close copy has, so prefixes of the deltas are indexed as those of the texts were, and
  pairs whose deltas have too few tokens to share are left out by the join. Near copies of one text that
  each have changes of their own drop out here, whatever the size of their group.

Edge cases: null, empty and blank texts have no shingles and link with nothing; a text with
fewer words than a shingle is one shingle; equal sets always link; rows with one doc_id, or with
none, and different texts are different documents, each with its own shingles and links; a component's
id is the smallest doc_id of its rows, null where none has one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected
from .sharding import text_key

FREQUENT = 256
SHINGLE = 4
THRESHOLD_PCT = 85


class _Sets:
    """Distinct shingle hashes of a chunk's texts: (text, hash) in order. A text is one row of `wanted`."""

    def __init__(self, pdf: pd.DataFrame, k: int, side: pd.DataFrame):
        wanted = side.loc[side["kind"] == 0, ["doc_id", "h1", "h2", "node"]]
        pdf = pdf.merge(wanted, on=["doc_id", "h1", "h2"]).drop_duplicates("node")
        words = [C.ascii_lower(b).split() for b in pdf["body"]]
        self.nodes = pdf["node"].to_numpy(np.int64)
        h, doc, lens = C.joined(words)
        n = len(h) - k + 1
        start = np.flatnonzero(doc[: max(n, 0)] == doc[k - 1 :]) if n > 0 else np.empty(0, np.int64)
        hashes, owners = C.window_hashes(h, k)[start] if n > 0 else np.empty(0, np.uint64), doc[start]
        short = np.flatnonzero((lens > 0) & (lens < k))
        ends = np.cumsum(lens)
        whole = np.array([C.window_hashes(C.mix(h[ends[i] - lens[i] : ends[i]], 50), int(lens[i]))[0] for i in short], np.uint64)
        hashes, owners = np.concatenate([hashes, whole]), np.concatenate([owners, short])
        order = np.lexsort((hashes, owners))
        hashes, owners = hashes[order], owners[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        self.hash, self.doc = hashes[new], owners[new].astype(np.int64)
        self.size = np.bincount(self.doc, minlength=len(self.nodes))


def _cells(s: _Sets, bits: int):
    return np.unique(C.mix(s.hash, 5) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)


def _frequencies(k: int, bits: int, shard_bits: int):
    def run(key, pdf: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        out = []
        s = _Sets(pdf, k, side)
        cells, _, counts = _cells(s, bits)
        for shard, a, b in C.shard_slices(cells, bits, shard_bits):
            out.append((shard, int(key[0]), b - a, C.pack_sorted(cells[a:b]), C.zlib.compress(C.planes(counts[a:b].astype(np.uint32)), 1)))
        return pd.DataFrame(out, columns=["shard", "chunk", "n", "body", "counts"])

    return run


def _merge_frequencies(key, pdf: pd.DataFrame) -> pd.DataFrame:
    cells = np.concatenate([C.unpack_sorted(b, n) for b, n in zip(pdf["body"], pdf["n"])])
    counts = np.concatenate([C.unplanes(C.zlib.decompress(b), np.uint32, n) for b, n in zip(pdf["counts"], pdf["n"])])
    _, inverse = np.unique(cells, return_inverse=True)
    total = np.bincount(inverse, weights=counts)
    # 1: one document; otherwise the number of binary digits of the count.
    klass = np.frexp(total)[1].astype(np.uint8)[inverse]
    ends = np.cumsum(pdf["n"].to_numpy())
    bodies = [C.zlib.compress(klass[e - n : e].tobytes(), 1) for e, n in zip(ends, pdf["n"])]
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": 1, "shard": pdf["shard"], "body": bodies, "doc_id": 0, "h1": 0, "h2": 0, "node": 0})


def _ranks(group: np.ndarray) -> np.ndarray:
    """Position of each entry within its run of equal values."""
    if not len(group):
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))


def size_bands(sizes: np.ndarray, pct: int) -> np.ndarray:
    """The band of each size; sizes within the threshold of each other lie in one band or in neighbours."""
    edges = band_edges(int(sizes.max()) if len(sizes) else 1, pct)
    return np.searchsorted(np.array(edges), sizes, side="right") - 1


def band_edges(most: int, pct: int) -> list[int]:
    """First sizes of the bands, up to the band after that of `most`."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * 100 // pct + 1)
    return [*edges, edges[-1] * 100 // pct + 1]


def class_counts(edges: list[int], pct: int) -> np.ndarray:
    """Classes of frequent tokens for documents of a band and the one before it: as many as the smallest
    of them has tokens to look at, and no more than it has shared tokens to waste."""
    least = np.array([edges[max(i - 1, 0)] for i in range(len(edges))])
    shared = -(-pct * least // 100)
    return np.maximum(1, np.minimum(least - shared + 1, shared - 1))


def _keys(s: _Sets, klass: np.ndarray, pct: int, frequent_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys and the text each belongs to."""
    smallest = -(-pct // (100 - pct))  # the smallest n with n / (n + 1) >= pct / 100
    order = np.lexsort((s.hash, klass, s.doc))
    h, c, d = s.hash[order], klass[order], s.doc[order]
    need = s.size - (pct * s.size + 99) // 100 + 1
    common = c > frequent_class
    begin = np.cumsum(s.size) - s.size
    band = size_bands(s.size, pct)
    counts = class_counts(band_edges(int(s.size.max()) if len(s.size) else 1, pct), pct)
    single = np.zeros(len(h), bool)
    keys, owners = [], []
    for scheme in (band, band + 1):
        classes = counts[scheme][d]
        group = np.where(common, (C.mix(h, 9) % classes.astype(np.uint64)).astype(np.int64), -1)
        by_class = np.lexsort((np.arange(len(h)), group, d))
        run = d[by_class] * (int(counts.max()) + 1) + group[by_class] + 1
        weight = np.ones(len(h), np.int64)
        weight[by_class[(_ranks(run) == 0) & (group[by_class] >= 0)]] = 0
        total = np.cumsum(weight)
        before = total - weight - np.where(begin[d] > 0, total[np.maximum(begin[d] - 1, 0)], 0)
        inside = (before < need[d]) & (s.size[d] >= smallest)
        single |= inside & ~common & (c > 1)
        pick = by_class[(inside & common)[by_class]]
        runs = d[pick] * (int(counts.max()) + 1) + group[pick] + 1
        rank = _ranks(runs)
        for step in range(1, int(rank.max()) + 1 if len(rank) else 1):
            second = np.flatnonzero(rank >= step)  # joined with the token `step` places before it in its class
            with np.errstate(over="ignore"):
                pair = C.mix(h[pick[second - step]] * np.uint64(0x9E3779B97F4A7C15) + h[pick[second]], 22)
            keys.append(C.mix(pair ^ C.mix(scheme[d[pick[second]]].astype(np.uint64), 23)))
            owners.append(d[pick[second]])
    keys.append(C.mix(h[single], 21))
    owners.append(d[single])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _signatures(k: int, bits: int, pct: int, frequent: int):
    frequent_class = int(np.frexp(frequent)[1])  # counts of more digits are frequent

    def run(key, pdf: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        s = _Sets(pdf, k, side)
        cells, inverse, _ = _cells(s, bits)
        own = side[side["kind"] == 1].sort_values("shard")
        klass = np.concatenate([np.frombuffer(C.zlib.decompress(b), np.uint8) for b in own["body"]]) if len(own) else np.empty(0, np.uint8)
        assert len(klass) == len(cells), "a shard's reply is missing"
        klass = klass[inverse]
        keys, owners = _keys(s, klass, pct, frequent_class)
        by_doc = np.argsort(owners, kind="stable")
        per_doc = np.bincount(owners, minlength=len(s.nodes))
        places = np.cumsum(s.size)[:-1]
        sets = np.split(s.hash, places) if len(s.nodes) else []
        key_lists = np.split(keys[by_doc], np.cumsum(per_doc)[:-1]) if len(s.nodes) else []
        marks = [C.xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
        return pd.DataFrame({
            "node": s.nodes,
            "n": s.size.astype(np.int64),
            "u": np.bincount(s.doc[klass == 1], minlength=len(s.nodes)),
            "s1": [int.from_bytes(m[:8], "little", signed=True) for m in marks],
            "s2": [int.from_bytes(m[8:], "little", signed=True) for m in marks],
            "keys": pd.Series(key_lists, dtype=object),
            "tokens": [x.tobytes() if len(y) else None for x, y in zip(sets, key_lists)],
            "classes": [x.tobytes() if len(y) else None for x, y in zip(np.split(klass, places) if len(s.nodes) else [], key_lists)],
        })

    return run


DELTAS = "node long, p long, linked boolean, n long, cost long, room long, able long, delta array<long>"


def _compare(pct: int):
    """Each document against a centre: whether they link, and the document's delta.

    cost, room: 100 m + pct e and (100 - pct) |c|; able: tokens of the delta that another delta can
    share; delta: those tokens in an order that all deltas with this centre follow, as far as any use needs them.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for node, p, x, classes, c in zip(pdf["node"], pdf["p"], pdf["x"], pdf["classes"], pdf["c"]):
                x, c, classes = np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint64), np.frombuffer(classes, np.uint8)
                extra = ~np.isin(x, c, assume_unique=True)
                missing = c[~np.isin(c, x, assume_unique=True)]
                e, m = int(extra.sum()), len(missing)
                both = len(x) - e
                cost, room = 100 * m + pct * e, (100 - pct) * len(c)
                shareable = extra & (classes > 1)
                tokens, klass = x[shareable], classes[shareable]
                tokens = np.concatenate([tokens[np.lexsort((tokens, klass))], missing])
                least = -(-(cost + 1 if cost <= room else cost - room + pct) // (100 + pct))
                delta = C.mix(tokens[: max(0, len(tokens) - least + 1)], 41) ^ C.mix(np.array([p]).view(np.uint64), 42)
                out.append((node, p, 100 * both >= pct * (len(x) + m), len(x), cost, room, len(tokens), delta.view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "p", "linked", "n", "cost", "room", "able", "delta"])

    return run


def _verify(pct: int):
    def run(frames):
        for pdf in frames:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(np.isin(x, y, assume_unique=True).sum())
                ok.append(100 * both >= pct * (len(x) + len(y) - both))
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    return run


def _entries(deltas: DataFrame, label: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """The prefixes of deltas, one row a token: x, documents outside their centre's component, and y, all documents of such centres.

    A token stands for itself and its centre. The smallest cost among the others of a centre bounds from
    below what two deltas must share, and so how long the prefixes are.
    """
    root = label.withColumnRenamed("node", "at")
    placed = deltas.join(root.select(F.col("at").alias("node"), "root"), "node", "left").join(root.select(F.col("at").alias("p"), F.col("root").alias("main")), "p", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node")).withColumn("main", F.coalesce("main", "p"))
    outside = F.col("root") != F.col("main")
    least = placed.groupBy("p").agg(F.min("cost").alias("least_y"), F.min(F.when(outside, F.col("cost"))).alias("least_x")).filter("least_x is not null")
    placed = placed.join(least, "p")

    def prefix(other: str) -> Column:
        shared = F.ceil((F.col("cost") + F.col(other) - F.col("room")) / (100 + pct))
        length = F.col("able") - F.greatest(shared, F.lit(1)) + 1
        return F.explode(F.when(length > 0, F.slice("delta", F.lit(1), length.cast("int"))))

    kept = lambda x, other: [prefix(other).alias("token"), F.col("node").alias(x), F.col("root").alias(f"r{x}"), F.col("cost").alias(f"c{x}"), F.col("able").alias(f"a{x}"), F.col("n").alias(f"n{x}")]
    return placed.filter(outside).select(*kept("x", "least_y"), "room"), placed.select(*kept("y", "least_x"))


def _component_pairs(x: DataFrame, y: DataFrame, pct: int) -> DataFrame:
    """(token, rx, ry): components that meet at a token and whose figures there don't rule out a link."""
    both = x.groupBy("token", F.col("rx").alias("r")).agg(F.lit(1).alias("one")).unionByName(y.groupBy("token", F.col("ry").alias("r")).agg(F.lit(1).alias("one")))
    shared = both.groupBy("token").agg(F.min("r").alias("low"), F.max("r").alias("high")).filter("low < high").select("token")
    sides = []
    for side, frame, more in (("x", x, [F.first("room").alias("room")]), ("y", y, [])):
        held = frame.groupBy("token", f"r{side}").agg(F.min(f"c{side}").alias(f"c{side}"), F.max(f"a{side}").alias(f"a{side}"), F.min(f"n{side}").alias(f"least_n{side}"), F.max(f"n{side}").alias(f"most_n{side}"), *more)
        sides.append(held.join(shared, "token", "left_semi"))
    enough = F.col("cx") + F.col("cy") - F.col("room") <= F.least("ax", "ay") * (100 + pct)
    sizes = (F.col("most_nx") * 100 >= F.col("least_ny") * pct) & (F.col("most_ny") * 100 >= F.col("least_nx") * pct)
    return sides[0].join(sides[1], "token").filter((F.col("rx") != F.col("ry")) & enough & sizes).select("token", "rx", "ry")


def _met_by_deltas(deltas: DataFrame, label: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list and whose deltas share a prefix token; none that links is missing.

    Components meet at a token first, by grouped figures, and only documents of components that can link
    there are joined: a family that shares a list with another family's centre costs its own number of tokens.
    """
    x, y = _entries(deltas, label, pct)
    pairs = C.checkpoint(_component_pairs(x, y, pct))
    enough = F.col("cx") + F.col("cy") - F.col("room") <= F.least("ax", "ay") * (100 + pct)
    sizes = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * pct
    met = pairs.join(x, ["token", "rx"]).join(y, ["token", "ry"]).filter(enough & sizes)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _classes(docs: DataFrame, shingle: int, threshold_pct: int, frequent: int) -> DataFrame:
    """h1, h2, rep, n, component, first for each text with a word: its smallest doc_id, number of shingles,
    smallest doc_id of its component, and whether it is the text that stands for the component."""
    _, total = C.volume(docs)
    n_chunks, bits = C.chunk_count(total), C.sketch_bits(total, 4.0)
    shard_bits = C.shard_bits_for(total, bits)
    rows = docs.filter(F.col("text").rlike(C.WORD_SQL)).select(C.id_or_last(docs), *text_key(F.col("text")))
    # Node numbers hold from the checkpoint on.
    copies = C.checkpoint(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    none = F.lit(None).cast("binary")
    wanted = copies.select(C.chunk_of(F.col("rep"), F.col("h1"), n_chunks), F.lit(0).alias("kind"), F.lit(0).alias("shard"), none.alias("body"), F.col("rep").alias("doc_id"), "h1", "h2", "node")
    texts = C.chunked(docs, n_chunks, *text_key(F.col("text")))
    packets = texts.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInPandas(_frequencies(shingle, bits, shard_bits), "shard int, chunk int, n long, body binary, counts binary")
    replies = packets.groupBy("shard").applyInPandas(_merge_frequencies, "chunk int, kind int, shard int, body binary, doc_id long, h1 long, h2 long, node long")
    signed = C.checkpoint(
        texts.groupBy("chunk").cogroup(wanted.unionByName(replies).groupBy("chunk")).applyInPandas(_signatures(shingle, bits, threshold_pct, frequent), "node long, n long, u long, s1 long, s2 long, keys array<long>, tokens binary, classes binary")
    )
    equal_sets = signed.groupBy("s1", "s2").agg(F.min("node").alias("least"))
    equal = signed.select("node", "s1", "s2").join(equal_sets, ["s1", "s2"]).filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    postings = signed.filter(F.size("keys") > 0).select("node", "n", "u", "keys").join(equal_sets.select(F.col("least").alias("node")), "node", "left_semi").select("node", F.struct((F.col("u") * 10000 / F.col("n")).cast("int").alias("alone"), "node").alias("rank"), F.explode("keys").alias("key"))
    centres = postings.groupBy("key").agg(F.min("rank")["node"].alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "p")
    near = postings.join(centres, "key").filter("node <> p").select("node", "p").distinct()
    sets = signed.filter(F.size("keys") > 0)
    with_x = near.join(sets.select("node", F.col("tokens").alias("x"), "classes"), "node")
    with_c = with_x.join(sets.select(F.col("node").alias("p"), F.col("tokens").alias("c")), "p")
    deltas = C.checkpoint(with_c.select("node", "p", "x", "classes", "c").mapInPandas(_compare(threshold_pct), DELTAS))
    ordered = deltas.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"), "linked")
    links = C.checkpoint(ordered.filter("linked").select("a", "b").unionByName(equal))
    label = connected(links)
    pairs = C.checkpoint(_met_by_deltas(deltas, label, threshold_pct).join(ordered.select("a", "b"), ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        token_sets = sets.select("node", "tokens")
        with_y = pairs.join(token_sets.withColumnsRenamed({"node": "a", "tokens": "x"}), "a").join(token_sets.withColumnsRenamed({"node": "b", "tokens": "y"}), "b")
        more = C.checkpoint(with_y.select("a", "b", "x", "y").mapInPandas(_verify(threshold_pct), "a long, b long"))
        if not more.isEmpty():
            label = connected(links.unionByName(more))
    found = copies.join(signed.select("node", "n"), "node").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A row a component, written, so that the join back deals the texts of a large component to several tasks.
    heads = C.checkpoint(found.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("head")))
    return found.join(heads, "root").select("h1", "h2", "rep", "n", F.col("head.rep").alias("component"), (F.col("head.node") == F.col("node")).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold_pct: int = THRESHOLD_PCT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    found = _classes(docs, shingle, threshold_pct, frequent).select("h1", "h2", "n", "component")
    rows = docs.select(C.id_or_last(docs), *text_key(F.col("text")))
    out = rows.join(found, ["h1", "h2"], "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.select(C.id_or_null(), "n_shingles", F.nullif(F.col("component_id"), F.lit(C.NULL_ID)).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int, threshold_pct: int) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last); texts without a word all stay.

    Of rows that repeat both doc_id and text, any one stays.
    """
    key = ["h1", "h2", "_id"]
    found = C.checkpoint(_classes(docs, shingle, threshold_pct, FREQUENT)).select("h1", "h2", "rep", "first")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), C.id_or_last(docs).alias("_id"), *text_key(F.col("text")))
    worded = keyed.filter(F.col("_row")["text"].rlike(C.WORD_SQL))
    standing = F.col("first") & (F.col("_id") == F.col("rep"))
    named = worded.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).join(found, ["h1", "h2"]).withColumn("stays", standing)
    # What goes is known by id and text, so that neither the texts nor a text of very many copies are dealt by a hot key.
    kept = keyed.join(named.filter("not stays").select(*key), key, "left_anti")
    again = C.checkpoint(named.filter("stays and times > 1").select(*key))
    if not again.isEmpty():
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select("_row.*")
