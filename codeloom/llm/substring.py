"""Substring dedup: count-min prefilter, then exact grouping of the windows estimated repeated.

A window is `window` consecutive words of one document. Each word covered by a window whose
word sequence also starts in a document with a smaller doc_id is removed.

1. Every chunk of documents builds a partial count-min sketch of its windows. The sketch is
   as wide as the text is long (cells grow with the input, so its error does not) and is
   never held in one place: partial sketches are cut into shards, merged shard by shard,
   and each chunk is told which of its own cells have a merged count of two or more. Counts
   are overestimates, so no repeated window is lost.
2. Only windows whose smallest count over the rows is two or more are grouped exactly, by a
   96-bit key of the word sequence, again shard by shard; each chunk is told which of its
   keys start in a smaller document elsewhere.
3. The chunk marks the words.

The three passes share one shuffle of the texts by chunk (the planner reuses the exchange).

Edge cases: null and empty texts have no words and stay as they are; a null doc_id counts as
the largest; rows with the same doc_id never remove each other's words; a document with fewer
words than the window loses nothing. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

DEPTH = 2
EXACT = 9


class _Windows:
    """The windows of a chunk: start word, document and first key, with the chunk's distinct keys."""

    def __init__(self, pdf: pd.DataFrame, k: int):
        self.ids = pdf["doc_id"].to_numpy(np.int64)
        self.words = [b.split() if b is not None else [] for b in pdf["body"]]
        self.h, self.doc, self.lens = C.joined(self.words)
        n = len(self.h) - k + 1
        self.start = np.flatnonzero(self.doc[: max(n, 0)] == self.doc[k - 1 :]) if n > 0 else np.empty(0, np.int64)
        self.k = k
        all_keys = C.window_hashes(self.h, k)
        self.keys, self.inverse = np.unique(all_keys[self.start], return_inverse=True)
        self.id_of = self.ids[self.doc[self.start]]
        self.low = np.full(len(self.keys), C.NULL_ID, np.int64)
        np.minimum.at(self.low, self.inverse, self.id_of)
        high = np.full(len(self.keys), np.iinfo(np.int64).min, np.int64)
        np.maximum.at(high, self.inverse, self.id_of)
        self.several = high > self.low

    def second_keys(self, pick: np.ndarray) -> np.ndarray:
        """32 further bits for the picked distinct keys."""
        first = np.empty(len(self.keys), np.int64)
        first[self.inverse[::-1]] = self.start[::-1]
        at = first[pick]
        if not len(at):
            return np.empty(0, np.uint32)
        rows = self.h[at[:, None] + np.arange(self.k)]
        acc = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.k):
                acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + C.mix(rows[:, i], 77)
        return (C.mix(acc, 3) >> np.uint64(32)).astype(np.uint32)


def _cells(w: _Windows, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells of a sketch row, whether this chunk alone fills one twice, and each key's cell."""
    cells, inverse = np.unique(C.mix(w.keys, 11 + row) >> np.uint64(64 - bits), return_inverse=True)
    n = np.bincount(inverse, weights=1.0 + w.several, minlength=len(cells))
    return cells, n >= 2, inverse


def _sketch(k: int, bits: int, shard_bits: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w = _Windows(pdf, k)
        out = []
        for row in range(DEPTH):
            cells, twice, _ = _cells(w, row, bits)
            for shard, a, b in C.shard_slices(cells, bits, shard_bits):
                out.append((row, shard, int(key[0]), b - a, C.pack_bits(twice[a:b]), C.pack_sorted(cells[a:b])))
        return pd.DataFrame(out, columns=["kind", "shard", "chunk", "n", "flags", "body"])

    return run


def _merge_sketch(key, pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [C.unpack_sorted(b, n) for b, n in zip(pdf["body"], pdf["n"])]
    twice = np.concatenate([C.unpack_bits(b, n) for b, n in zip(pdf["flags"], pdf["n"])])
    cells, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    repeated = (np.bincount(inverse, weights=1.0 + twice, minlength=len(cells)) >= 2)[inverse]
    ends = np.cumsum(pdf["n"].to_numpy())
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": pdf["kind"], "shard": pdf["shard"], "n": pdf["n"], "body": [C.pack_bits(repeated[e - n : e]) for e, n in zip(ends, pdf["n"])]})


def _estimated(w: _Windows, replies: pd.DataFrame, bits: int) -> np.ndarray:
    """Indices of the distinct keys whose count-min estimate is two or more."""
    keep = np.ones(len(w.keys), bool)
    for row in range(DEPTH):
        cells, _, inverse = _cells(w, row, bits)
        keep &= _in_order(replies, row, len(cells))[inverse]
    return np.flatnonzero(keep)


def _in_order(replies: pd.DataFrame, kind: int, n: int) -> np.ndarray:
    own = replies[replies["kind"] == kind].sort_values("shard")
    flags = [C.unpack_bits(b, k) for b, k in zip(own["body"], own["n"])]
    flags = np.concatenate(flags) if flags else np.empty(0, bool)
    assert len(flags) == n, "a shard's reply is missing"
    return flags


def _candidates(k: int, bits: int, shard_bits: int):
    def run(key, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            w = _Windows(pdf, k)
            pick = _estimated(w, replies, bits)
            keys, low, second = w.keys[pick], w.low[pick], w.second_keys(pick)
            for shard, a, b in C.shard_slices(keys, 64, shard_bits):
                out.append((shard, int(key[0]), b - a, keys[a:b].tobytes(), second[a:b].tobytes(), C.planes(low[a:b])))
        return pd.DataFrame(out, columns=["shard", "chunk", "n", "k1", "k2", "low"])

    return run


def _exact(key, pdf: pd.DataFrame) -> pd.DataFrame:
    k1 = np.frombuffer(b"".join(pdf["k1"]), np.uint64)
    k2 = np.frombuffer(b"".join(pdf["k2"]), np.uint32)
    low = np.concatenate([C.unplanes(b, np.int64, n) for b, n in zip(pdf["low"], pdf["n"])])
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), C.NULL_ID, np.int64)
    np.minimum.at(least, group, low)
    smaller = least[group] < low
    ends = np.cumsum(pdf["n"].to_numpy())
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": EXACT, "shard": pdf["shard"], "n": pdf["n"], "body": [C.pack_bits(smaller[e - n : e]) for e, n in zip(ends, pdf["n"])]})


def _mark(k: int, bits: int, layout: bool):
    """Word counts and kept texts of a chunk's documents, in their order."""

    def run(pdf: pd.DataFrame, replies: pd.DataFrame) -> tuple[np.ndarray, list[int], list[bytes]]:
        w = _Windows(pdf, k)
        pick = _estimated(w, replies, bits)
        elsewhere = np.zeros(len(w.keys), bool)
        elsewhere[pick] = _in_order(replies, EXACT, len(pick))
        gone = elsewhere[w.inverse] | (w.id_of > w.low[w.inverse])
        steps = np.zeros(len(w.h) + 1, np.int64)
        np.add.at(steps, w.start[gone], 1)
        np.add.at(steps, w.start[gone] + k, -1)
        kept = np.cumsum(steps)[:-1] == 0
        ends = np.cumsum(w.lens)
        texts, removed = [], []
        for body, words, end, n in zip(pdf["body"], w.words, ends, w.lens):
            keep = kept[end - n : end]
            removed.append(int(n - keep.sum()))
            if removed[-1]:
                words = [x for x, y in zip(words, keep.tolist()) if y]
            texts.append(body if layout and not removed[-1] else b" ".join(words))
        return w.lens, removed, texts

    return run


OWN = ["doc_id", "body"]


def _on_texts(f, ddl: str):
    """A function on a chunk's documents (and packets) as frames, with Arrow around it, so that columns carried along are never converted."""
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(f((key[0].as_py(),), docs.select(OWN).to_pandas()), schema, preserve_index=False)

    def run_both(key: tuple, docs: pa.Table, packets: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(f((key[0].as_py(),), docs.select(OWN).to_pandas(), packets.to_pandas()), schema, preserve_index=False)

    return run, run_both


def _marked(k: int, bits: int, layout: bool, more: list[str]):
    mark = _mark(k, bits, layout)

    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        lens, removed, texts = mark(docs.select(OWN).to_pandas(), replies.to_pandas()) if docs.num_rows else ([], [], [])
        made = [docs["doc_id"], pa.array(lens, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary())]
        return pa.table([*made, *(docs[c] for c in more)], names=["doc_id", "n_words", "n_removed", "kept", *more])

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, layout: bool = False, more: dict | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and `kept` (binary: the words that stay, joined by one space).

    With `layout`, texts that lose nothing stay as they are, null included. `more` names further
    columns to carry along, of any type that Arrow has.
    """
    more = more or {}
    _, total = C.volume(docs)
    bits = C.sketch_bits(total)
    shard_bits = C.shard_bits_for(total, bits)
    texts = C.chunked(docs, C.chunk_count(total), *[x.alias(c) for c, x in more.items()])
    sketched = "kind int, shard int, chunk int, n long, flags binary, body binary"
    packets = texts.groupBy("chunk").applyInArrow(_on_texts(_sketch(window, bits, shard_bits), sketched)[0], sketched)
    reply = "chunk int, kind int, shard int, n long, body binary"
    rows = packets.groupBy("kind", "shard").applyInPandas(_merge_sketch, reply)
    keyed = "shard int, chunk int, n long, k1 binary, k2 binary, low binary"
    asked = texts.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(_on_texts(_candidates(window, bits, shard_bits), keyed)[1], keyed)
    exact = asked.groupBy("shard").applyInPandas(_exact, reply)
    both = rows.unionByName(exact)
    fields = T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept binary").fields
    schema = T.StructType(fields + [texts.schema[c] for c in more])
    marked = texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_marked(window, bits, layout, list(more)), schema)
    return marked.select(C.id_or_null(), "n_words", "n_removed", "kept", *more)


def cut_repeats(docs: DataFrame, window: int) -> DataFrame:
    """docs with repeated passages cut from `text`, and `n_chars`, where there is one, brought up to date; other columns pass as they are."""
    others = {f"_c{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    cut = dedup_substrings(docs, window, layout=True, more={n: F.col(c) for n, c in others.items()})
    text = F.col("kept").cast("string")
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(n) for n, c in others.items()}
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def substring_digest(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    kept = dedup_substrings(docs, window)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
