"""Language identification by segmentation-marginalised unigrams.

Every language has its own probability for each piece of a fixed public vocabulary. Training
counts words by language over all labelled training documents, and spreads each word's count
over its segmentations in proportion to their probability under the public scores (one
expectation step); counts are smoothed towards the prior of those scores. A text's
probability in a language is the product over its words of the sum over all segmentations,
by the forward recursion of lattice.py. Words are cut at ASCII white space and lower-cased.
The score is the share of the predicted language in the geometric mean of its words' likelihoods
over all languages: a text's length doesn't push it to one, as it does a posterior.

The expected counts come to the driver as one array a language and the model (pieces x languages)
goes to the tasks in the closure; both are bounded by the vocabulary and MAX_LANGUAGES and checked.
A worker remembers words of up to LONGEST_KNOWN bytes, KNOWN_VALUES log probabilities in all.

Edge cases: null text or text without a letter is `und` with score 0; rows without a lang are
not learned from; with no language learned at all every text is `und`; ties go to the first
language in code point order; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .lattice import expected_counts, pieces, word_logprobs

UNKNOWN = "und"
MAX_LANGUAGES = 128
SMOOTHING = 1000.0
KNOWN_VALUES, LONGEST_KNOWN = 800_000, 32


def _count_words(frames):
    for pdf in C.by_bytes(frames, "body", 4 << 20):
        out = []
        for lang, bodies in pdf.groupby("lang")["body"]:
            counts: Counter = Counter()
            for b in bodies:
                counts.update(b.decode("utf-8", "replace").lower().encode().split())
            out.append(pd.DataFrame({"lang": lang, "word": list(counts.keys()), "c": list(counts.values())}))
        if out:
            yield pd.concat(out)


def _expect(path: str, languages: list[str]):
    def run(frames):
        vocabulary = pieces(path)
        prior = np.log(np.where(vocabulary.prior > 0, vocabulary.prior, 1e-300))
        total = np.zeros((vocabulary.size, len(languages)))
        for pdf in frames:
            words = [w.decode("utf-8", "replace") for w in pdf["word"]]
            total += expected_counts(vocabulary, words, np.array(pdf["counts"].tolist(), float).reshape(len(pdf), len(languages)), prior)
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "lang": lang, "e": total[piece, lang]})

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, c) of the labelled rows of docs (text, lang), written once."""
    labelled = docs.filter("text is not null and lang is not null").select("lang", F.col("text").cast("binary").alias("body"))
    return C.checkpoint(labelled.mapInPandas(_count_words, "lang string, word binary, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")))


def fit(counts: DataFrame, languages: list[str], vocabulary: str = "piece_bpe_32k.model", smoothing: float = SMOOTHING) -> np.ndarray:
    """The log probability of each piece in each of some languages (pieces x languages)."""
    path = C.vocabulary_path(vocabulary)
    prior = pieces(path).prior
    expected = np.zeros((len(prior), len(languages)))
    if languages:
        columns = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("c"))), F.lit(0)).cast("double") for x in languages]
        by_word = counts.filter(F.col("lang").isin(languages)).groupBy("word").agg(F.array(*columns).alias("counts"))
        sums = by_word.mapInPandas(_expect(path, languages), "piece int, lang int, e double").groupBy("piece", "lang").agg(F.sum("e").alias("e"))
        packed = sums.groupBy("lang").agg(F.collect_list("piece").alias("pieces"), F.collect_list("e").alias("e"))
        for r in packed.toLocalIterator():  # a row a language, at most as long as the vocabulary
            expected[r.pieces, r.lang] = r.e
    p = (expected + smoothing * prior[:, None]) / (expected.sum(0) + smoothing)
    return np.log(np.where(p > 0, p, 1e-300))


def known_languages(counts: DataFrame) -> list[str]:
    """Languages in code point order."""
    return sorted(r[0] for r in counts.select("lang").distinct().toLocalIterator())


def train(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and the log probability of each piece in each (pieces x languages).

    docs: text, lang; rows without either are left out.
    """
    counts = word_counts(docs)
    languages = known_languages(counts)
    return languages, fit(counts, languages, vocabulary, smoothing)


class _Scores(dict):
    """Word to its log probability in each language; bounded."""


CARRIED = "doc_id long, held_out boolean, body binary, lang_pred string, best double, shares double"


def _predict(path: str, languages: list[str], logp: np.ndarray):
    """Adds a block of languages to what earlier blocks have found: the best language so far, its log probability, and the
    sum of all languages' shares relative to it. Ties stay with the earlier language."""

    def run(frames):
        vocabulary, known = pieces(path), _Scores()
        for pdf in C.by_bytes(frames, "body", 4 << 20):
            texts = [b.decode("utf-8", "replace").lower() if b is not None else "" for b in pdf["body"]]
            words = [t.encode().split() for t in texts]
            distinct = list({w for ws in words for w in ws})
            unseen = [w for w in distinct if w not in known]
            table = np.zeros((len(distinct), len(languages)))
            place = {w: i for i, w in enumerate(distinct)}
            if unseen:
                fresh = word_logprobs(vocabulary, [w.decode("utf-8", "replace") for w in unseen], logp, scaled=True)
                table[[place[w] for w in unseen]] = fresh
            seen = [w for w in distinct if w in known]
            if seen:
                table[[place[w] for w in seen]] = [known[w] for w in seen]
            room = KNOWN_VALUES // max(1, len(languages)) - len(known)
            for i in [i for i, w in enumerate(unseen) if len(w) <= LONGEST_KNOWN][: max(0, room)]:
                known[unseen[i]] = fresh[i].copy()
            out = []
            for text, ws, pred, best, shares in zip(texts, words, pdf["lang_pred"], pdf["best"], pdf["shares"]):
                if not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, -np.inf, 0.0))
                    continue
                total = table[[place[w] for w in ws]].sum(0)
                at = int(total.argmax())
                own = float(np.exp(np.clip((total - total[at]) / len(ws), -700, 0)).sum())
                if total[at] > best:
                    out.append((languages[at], float(total[at]), own + shares * float(np.exp(max((best - total[at]) / len(ws), -700)))))
                else:
                    out.append((pred, best, shares + own * float(np.exp(max((total[at] - best) / len(ws), -700)))))
            yield pdf.assign(**dict(zip(("lang_pred", "best", "shares"), map(list, zip(*out))))) if out else pdf

    return run


def predict(docs: DataFrame, languages: list[str], logp: np.ndarray, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, held_out, lang_pred, score; docs: doc_id, held_out, text."""
    return _scores(_with_block(_unscored(docs), languages, logp, vocabulary))


def _unscored(docs: DataFrame) -> DataFrame:
    return docs.select(C.id_or_last(docs), "held_out", F.col("text").cast("binary").alias("body"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("shares"))


def _with_block(rows: DataFrame, languages: list[str], logp: np.ndarray, vocabulary: str) -> DataFrame:
    return rows.mapInPandas(_predict(C.vocabulary_path(vocabulary), languages, logp), CARRIED) if languages else rows


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select(C.id_or_null(), "held_out", "lang_pred", F.when(F.col("shares") > 0, 1 / F.col("shares")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, labelled: DataFrame, vocabulary: str = "piece_bpe_32k.model", block: int = MAX_LANGUAGES) -> DataFrame:
    """Languages are taken `block` at a time, so that a model of any number of them fits a task; a block's rows are written before the next."""
    counts = word_counts(labelled)
    languages, rows = known_languages(counts), _unscored(docs)
    for a in range(0, len(languages), block):
        rows = _with_block(C.checkpoint(rows) if a else rows, languages[a : a + block], fit(counts, languages[a : a + block], vocabulary), vocabulary)
    return _scores(rows)


def fold(modulus: int):
    """crc32 of doc_id as text, modulo; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the documents outside fold 1 of 3 and predicts all."""
    folded = docs.select("doc_id", "text", "lang", (fold(3) == 1).alias("held_out"))
    return identify(folded, folded.filter("not held_out"))
