"""LM scoring by subword lattice likelihood.

The pieces of a public unigram vocabulary, weighted by its existing scores, are re-estimated
by expectation-maximisation on the training documents' word counts; a text's probability is
the sum over all segmentations of its words, times the end token. The recursion is that of
lattice.py, in log space.

`score` is that marginal, over the pieces alone. Beside it stands `edged_score`, for which a word of
the training documents is an edge of its own across the whole lattice, and so is the end: with c
uses among N training tokens of V kinds, a token's probability is (c + V * L) / (N + V), where L is its
marginal (Witten and Bell's weight for what is new).

Word counts are exact and cover all training documents: chunks send each shard of the words
their distinct words with counts, the shard adds them up and answers with the corpus count of
each (see common.py). Expectation steps run over the shards' word tables; only the piece sums
(as many as the vocabulary has pieces) come to the driver.

The base score is the additive unigram model over the same tokens.

Edge cases: null and empty texts are the end token alone; with no training documents every
count is 0, no word has an edge and the model is the public prior; a null doc_id folds as empty text and comes back
null; repeated rows are separate documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .langid import fold
from .lattice import expected_counts, pieces, word_logprobs

ITERATIONS = 2
SMOOTHING = 1000.0
TYPES = -1


def _packed(words: list[bytes]) -> bytes:
    return zlib.compress(b" ".join(words), 1)


def _distinct(bodies: list, shards: int) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """Words of each text, and the distinct words by shard in order."""
    words = [C.ascii_lower(b).split() if b is not None else [] for b in bodies]
    by_shard: list[list[bytes]] = [[] for _ in range(shards)]
    for w in sorted({w for ws in words for w in ws}):
        by_shard[xxhash.xxh3_64_intdigest(w) % shards].append(w)
    return words, by_shard


def _count(shards: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        words, by_shard = _distinct(pdf["body"].tolist(), shards)
        counts: dict[bytes, int] = {}
        for ws, out in zip(words, pdf["held_out"].tolist()):
            if not out:
                for w in ws:
                    counts[w] = counts.get(w, 0) + 1
        rows = [(s, int(key[0]), len(own), _packed(own), zlib.compress(C.planes(np.array([counts.get(w, 0) for w in own], np.uint32)), 1)) for s, own in enumerate(by_shard) if own]
        return pd.DataFrame(rows, columns=["shard", "chunk", "n", "body", "counts"])

    return run


def _add(key, pdf: pd.DataFrame) -> pd.DataFrame:
    total: dict[bytes, int] = {}
    packets = [zlib.decompress(b).split() for b in pdf["body"]]
    for words, body in zip(packets, pdf["counts"]):
        for w, c in zip(words, C.unplanes(zlib.decompress(body), np.uint32, len(words)).tolist()):
            total[w] = total.get(w, 0) + c
    rows = [(int(c), int(key[0]), len(words), 0, None, zlib.compress(C.planes(np.array([total[w] for w in words], np.int64)), 1)) for c, words in zip(pdf["chunk"], packets)]
    seen = sorted(w for w, c in total.items() if c)
    values = np.array([total[w] for w in seen], np.int64)
    for a in range(0, len(seen), 100_000):
        part = values[a : a + 100_000]
        rows.append((TYPES, int(key[0]), len(part), int(part.sum()), _packed(seen[a : a + 100_000]), zlib.compress(C.planes(part), 1)))
    return pd.DataFrame(rows, columns=["chunk", "shard", "n", "total", "body", "counts"])


def _expect(path: str, logp: np.ndarray):
    def run(frames):
        vocabulary = pieces(path)
        total = np.zeros((vocabulary.size, 1))
        for pdf in frames:
            for body, counts, n in zip(pdf["body"], pdf["counts"], pdf["n"]):
                words = [w.decode("utf-8", "replace") for w in zlib.decompress(body).split()]
                total += expected_counts(vocabulary, words, C.unplanes(zlib.decompress(counts), np.int64, n).astype(float)[:, None], logp)
        piece = np.flatnonzero(total[:, 0])
        yield pd.DataFrame({"piece": piece, "e": total[piece, 0]})

    return run


def fit(types: DataFrame, n_docs: int, path: str, iterations: int = ITERATIONS, smoothing: float = SMOOTHING) -> tuple[np.ndarray, float]:
    """Natural log probability of each piece and of the end token."""
    prior = pieces(path).prior
    p, p_end = prior, 0.5
    for _ in range(iterations):
        e = np.zeros(len(prior))
        logp = np.log(np.where(p > 0, p, 1e-300))
        for piece, x in types.mapInPandas(_expect(path, logp), "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect():
            e[piece] = x
        p_end = (n_docs + 0.5) / (n_docs + e.sum() + 1.0)
        p = (e + smoothing * prior) / (e.sum() + smoothing)
    return np.log(np.where(p > 0, p, 1e-300)) + np.log1p(-p_end), float(np.log(p_end))


def with_edges(log_lattice: np.ndarray, counts: np.ndarray, n_all: int, n_types: int) -> np.ndarray:
    """log10 probability of tokens from that of their pieces (log10 as well) and their training counts."""
    if not n_all:
        return log_lattice
    with np.errstate(divide="ignore"):
        seen = np.log10(counts / (n_all + n_types))
    return np.logaddexp(seen * np.log(10), (log_lattice + np.log10(n_types / (n_all + n_types))) * np.log(10)) / np.log(10)


def _score(shards: int, path: str, logp: np.ndarray, log_end: float, end_count: int, n_all: int, n_types: int):
    denominator = n_all + 0.1 * (n_types + 1)
    lattice_end = np.array([log_end / np.log(10)])
    end = float(with_edges(lattice_end, np.array([end_count]), n_all, n_types)[0])

    def run(key, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "edged_score"]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        words, by_shard = _distinct(pdf["body"].tolist(), shards)
        distinct = [w for own in by_shard for w in own]
        own = replies.sort_values("shard")
        counts = np.concatenate([C.unplanes(zlib.decompress(b), np.int64, n) for b, n in zip(own["counts"], own["n"])] or [np.empty(0, np.int64)])
        assert len(counts) == len(distinct), "a shard's reply is missing"
        base = np.log10((counts + 0.1) / denominator)
        lattice = word_logprobs(pieces(path), [w.decode("utf-8", "replace") for w in distinct], logp[:, None])[:, 0] / np.log(10)
        edged = with_edges(lattice, counts, n_all, n_types)
        place = {w: i for i, w in enumerate(distinct)}
        base_end = float(np.log10((end_count + 0.1) / denominator))
        rows = []
        for ws in words:
            at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
            rows.append((len(ws) + 1, int((counts[at] > 0).sum()) + (end_count > 0), float(base[at].sum()) + base_end, float(lattice[at].sum()) + float(lattice_end[0]), float(edged[at].sum()) + end))
        out = pd.DataFrame(rows, columns=columns[2:])
        return pd.concat([pdf[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1)

    return run


def score_documents(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, edged_score."""
    path = C.vocabulary_path(vocabulary)
    _, total = C.volume(docs)
    n_chunks = C.chunk_count(total)
    shards = max(16, -(-total // (24 << 20)))
    folded = docs.withColumn("_held_out", fold(10) == 0)
    texts = C.chunked(folded, n_chunks, F.col("_held_out").alias("held_out"))
    packets = texts.groupBy("chunk").applyInPandas(_count(shards), "shard int, chunk int, n long, body binary, counts binary")
    tables = C.checkpoint(packets.groupBy("shard").applyInPandas(_add, "chunk int, shard int, n long, total long, body binary, counts binary"))
    types = tables.filter(F.col("chunk") == TYPES)
    n_types, n_words = (int(x or 0) for x in types.agg(F.sum("n"), F.sum("total")).first())
    n_docs = folded.filter(~F.col("_held_out")).count()
    logp, log_end = fit(types, n_docs, path, iterations)
    n_all, n_distinct = n_words + n_docs, n_types + (n_docs > 0)
    replies = tables.filter(F.col("chunk") != TYPES).select("chunk", "shard", "n", "counts")
    scored = texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(
        _score(shards, path, logp, log_end, n_docs, n_all, n_distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, edged_score double"
    )
    return scored.select(C.id_or_null(), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "edged_score")
