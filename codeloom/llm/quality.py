"""Quality rules with tokeniser fertility.

Base counts of every whole text (see `measure`) and, from a public vocabulary with byte
fallback, three figures of its words: characters per token, the share of byte-fallback tokens,
and the entropy of the text's token distribution in bits; and the tokens it takes relative to
those of a second public vocabulary. A text that fails the base rule is rejected; otherwise it
is rejected when a figure leaves

* the fixed band of its language, or of its script where the language has no band of its own.
  Bands are parameters and wide: they hold for tables too small to tell anything;
* the fences of its language over the whole table: FENCE_SPREADS times the quartiles' distance
  beyond them. Texts without a language have those of the texts of their script without one. A
  language of fewer than FENCE_TEXTS different texts has no fences, as other languages of its
  script must not decide on it: fences across languages rejected nearly all clean Spanish texts. Texts
  with the same figures count once, so copies don't narrow the fences; texts that fail the base
  rule or have fewer than FENCE_TOKENS tokens neither count nor are held against them; a figure
  whose quartiles coincide has no fence.

Words are tokenised once per worker and remembered up to a bound, so the cost is that of the
distinct words. The figures are measured once and kept; the quartiles are exact ones of figures
to three digits, whose distinct values are bounded.

Edge cases: null and empty texts have no words, fail the base rule and have no fertility
figures (null); a language without a band, or null, falls back to the script of most of the
text's letters, then to DEFAULT_BAND; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C


class Band(NamedTuple):
    """Figures outside are rejected. Entropy is only judged from `entropy_tokens` tokens on."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float
    entropy_tokens: int = 64


#: A vocabulary made mostly for Latin script spends more tokens on other scripts. The bands are wide:
#: running prose lies well inside, so that a doubtful text stays.
DEFAULT_BAND = Band((0.3, 12.0), 0.9, 2.0)
SCRIPT_BANDS = {
    "latin": Band((1.2, 12.0), 0.10, 3.0),
    "cyrillic": Band((1.0, 12.0), 0.30, 3.0),
    "greek": Band((0.6, 12.0), 0.60, 2.5),
    "cjk": Band((0.3, 6.0), 0.90, 2.5),
}
#: English is what the vocabulary knows best.
LANGUAGE_BANDS = {"en": Band((1.5, 12.0), 0.05, 3.5)}
#: Fences are those of far outliers, from the quartiles of at least FENCE_TEXTS texts.
FENCE_SPREADS, FENCE_TEXTS, FENCE_TOKENS = 3, 50, 64
FENCED = ("chars_per_token", "byte_share", "token_entropy", "token_ratio")
SECOND = "byte_bpe_multi_50k.tiktoken"
#: So many rows of fences may go to every task.
FEW_GROUPS = 10_000
MIN_WORDS = 10
REPEAT_PCT = 20
REPEAT_WINDOW = 5
#: Words that a worker remembers, and the longest of them in bytes.
KNOWN, LONGEST_KNOWN = 160_000, 32
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: Unicode ranges of the scripts that have a band.
SCRIPTS = {
    "latin": re.compile("[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]"),
    "cyrillic": re.compile("[Ѐ-ԯ]"),
    "greek": re.compile("[Ͱ-Ͽἀ-῿]"),
    "cjk": re.compile("[぀-ヿ㐀-鿿가-힯]"),
}


class WordTokens(dict):
    """Word to its token ids as 16-bit bytes, and to its number of tokens in a second vocabulary; bounded."""

    def __init__(self, path: str, second: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(second or C.vocabulary_path(SECOND), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.second = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.others: dict[bytes, int] = {}

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        if len(self.is_byte) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 pieces")

    def learn(self, words: list[bytes]) -> tuple[dict[bytes, bytes], dict[bytes, int]]:
        """Ids of words that aren't remembered, and their numbers of tokens in the second vocabulary."""
        decoded = [w.decode("utf-8", "replace") for w in words]
        ids = self.sp.encode(decoded, num_threads=1)
        others = {w: len(self.second(x)) for w, x in zip(words, decoded)}
        fresh = {w: np.array(i, np.uint16).tobytes() for w, i in zip(words, ids)}
        room = KNOWN - len(self)
        if room > 0:
            kept = dict([x for x in fresh.items() if len(x[0]) <= LONGEST_KNOWN][:room])
            self.update(kept)
            self.others.update({w: others[w] for w in kept})
        return fresh, others


_LOADED: dict[str, WordTokens] = {}


def script_of(text: str) -> str:
    """The script of most letters, by the ranges above; '' without any."""
    letters = len(text)
    found = {}
    for name, p in SCRIPTS.items():
        if letters <= max(found.values(), default=0):
            break  # the rest can't outnumber the script found
        found[name] = len(text) - len(p.sub("", text))
        letters -= found[name]
    best = max(found, key=found.get, default="")
    return best if found.get(best) else ""


def _repeat_words(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text in k-word windows found twice or more in it."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    start = np.flatnonzero(doc[:n] == doc[k - 1 :])
    keys = C.mix(C.window_hashes(h, k)[start] ^ C.mix(doc[start].astype(np.uint64), 40))
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(h) + 1, np.int64)
    np.add.at(steps, start[twice], 1)
    np.add.at(steps, start[twice] + k, -1)
    return np.bincount(doc[np.cumsum(steps)[:-1] > 0], minlength=n_docs)


def _fertility(tokens: WordTokens, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte tokens and entropy of each text, and its tokens in the second vocabulary."""
    distinct = {w for ws in words for w in ws}
    fresh, others = tokens.learn([w for w in distinct if w not in tokens])
    look = {w: tokens[w] for w in distinct if w in tokens} | fresh
    count = {w: tokens.others[w] for w in distinct if w in tokens.others} | others
    n_others = np.fromiter((sum([count[w] for w in ws]) for ws in words), np.int64, len(words))
    bodies = [b"".join([look[w] for w in ws]) for ws in words]
    n = np.fromiter((len(b) // 2 for b in bodies), np.int64, len(bodies))
    ids = np.frombuffer(b"".join(bodies), np.uint16)
    doc = np.repeat(np.arange(len(words)), n)
    n_bytes = np.bincount(doc[tokens.is_byte[ids]], minlength=len(words))
    keys, counts = np.unique((doc.astype(np.uint64) << np.uint64(16)) | ids, return_counts=True)
    owner = (keys >> np.uint64(16)).astype(np.int64)
    spread = np.bincount(owner, weights=counts * np.log2(counts), minlength=len(words))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(n > 0, np.log2(np.maximum(n, 1)) - spread / np.maximum(n, 1), 0.0)
    return n, n_bytes, entropy, n_others


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, n_byte_tokens long, token_entropy double, n_other_tokens long"


def _measured(tokens: WordTokens, bodies: list[bytes]) -> list[pa.Array]:
    words = [b.split() for b in bodies]
    h, doc, lens = C.joined(words)
    n_tokens, n_bytes, entropy, n_others = _fertility(tokens, words)
    word_chars = [len(b.translate(None, SPACES).decode("utf-8", "replace")) for b in bodies]
    n_symbols = [len(b) - len(b.translate(None, SYMBOLS)) for b in bodies]
    lines = [[x for x in b.split(b"\n") if x.strip(SPACES)] for b in bodies]
    n_dup_lines = [len(x) - len(set(x)) for x in lines]
    repeats = _repeat_words(h, doc, len(bodies))
    scripts = [script_of(b.decode("utf-8", "replace")) for b in bodies]
    longs = [pa.array(x, pa.int64()) for x in (lens, word_chars, n_symbols, n_dup_lines, repeats)]
    return [*longs, pa.array(scripts, pa.string()), pa.array(n_tokens, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(entropy, pa.float64()), pa.array(n_others, pa.int64())]


def _measure(path: str, keep_text: bool):
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = WordTokens(path)
        for batch in C.slices(batches, "_text", 2 << 20):
            bodies = [b or b"" for b in batch.column("_text").cast(pa.binary()).to_pylist()]
            kept = [n for n in batch.schema.names if keep_text or n != "_text"]
            columns = [batch.column(n) for n in kept] + _measured(_LOADED[path], bodies)
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return run


def measure(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", whole: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lang, script, n_tokens,
    chars_per_token, byte_share, token_entropy, token_ratio; with `whole`, the input row as the struct `_row` as well.
    """
    others = [c for c in docs.columns if c != "text"] if whole else ["doc_id", "lang"]
    named = {f"_c{i}": c for i, c in enumerate(others)}
    rows = docs.select(*[F.col(c).alias(n) for n, c in named.items()], F.col("text").cast("string").alias("_text"))
    schema = T.StructType([f for f in rows.schema if whole or f.name != "_text"] + list(T._parse_datatype_string(MEASURES)))
    found = rows.mapInArrow(_measure(C.vocabulary_path(vocabulary), whole), schema)
    place = {c: n for n, c in named.items()} | {"text": "_text"}
    some = F.col("n_tokens") > 0
    return found.select(
        F.col(place["doc_id"]).alias("doc_id"), F.col(place["lang"]).alias("lang"),
        *[x.split()[0] for x in MEASURES.split(", ")[:7]],
        F.when(some, F.col("word_chars") / F.col("n_tokens")).alias("chars_per_token"),
        F.when(some, F.col("n_byte_tokens") / F.col("n_tokens")).alias("byte_share"),
        F.when(some, F.col("token_entropy")).alias("token_entropy"),
        F.when(F.col("n_other_tokens") > 0, F.col("n_tokens") / F.col("n_other_tokens")).alias("token_ratio"),
        *([F.struct(*[F.col(place[c]).alias(c) for c in docs.columns]).alias("_row")] if whole else []),
    )


def _inside(band: Band):
    low, high = band.chars_per_token
    return F.col("chars_per_token").between(low, high) & (F.col("byte_share") <= band.byte_share) & ((F.col("token_entropy") >= band.entropy) | (F.col("n_tokens") < band.entropy_tokens))


def fences(judged: DataFrame) -> DataFrame:
    """(fence_group, fences): [low, high] of each figure, or null, for groups with enough texts."""
    once = judged.filter(~F.col("base_failed") & (F.col("n_tokens") >= FENCE_TOKENS)).select("fence_group", "n_words", "n_tokens", *FENCED).distinct()
    quartiles = [F.percentile(F.round(c, 3), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in FENCED]
    found = once.groupBy("fence_group").agg(F.count(F.lit(1)).alias("n"), *quartiles).filter(F.col("n") >= FENCE_TEXTS)

    def around(c):
        low, high = F.col(c)[0], F.col(c)[1]
        return F.when(low < high, F.array(low - FENCE_SPREADS * (high - low), high + FENCE_SPREADS * (high - low))).alias(c)

    return found.select("fence_group", F.struct(*map(around, FENCED)).alias("fences"))


def judge(measured: DataFrame, languages: dict[str, Band] | None = None, scripts: dict[str, Band] | None = None, default: Band = DEFAULT_BAND) -> DataFrame:
    """Adds base_failed and kept. The measured rows are kept, as the fences need them all before the first verdict."""
    verdict = _inside(default)
    for name, band in (SCRIPT_BANDS if scripts is None else scripts).items():
        verdict = F.when(F.col("script") == name, _inside(band)).otherwise(verdict)
    for name, band in (LANGUAGE_BANDS if languages is None else languages).items():
        verdict = F.when(F.col("lang") == name, _inside(band)).otherwise(verdict)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PCT)
    group = F.coalesce(F.concat(F.lit("lang "), F.col("lang").cast("string")), F.concat(F.lit("script "), "script"))
    judged = C.checkpoint(measured.withColumn("base_failed", failed).withColumn("fence_group", group))
    found = C.checkpoint(fences(judged))
    few = found.count() <= FEW_GROUPS  # `lang` may have any number of values
    fenced = judged.join(F.broadcast(found) if few else found, "fence_group", "left")
    within = F.lit(True)
    for c in FENCED:
        near = F.col("fences")[c]
        within = within & (near.isNull() | F.col(c).between(near[0], near[1]))
    kept = ~F.col("base_failed") & F.coalesce(verdict, F.lit(False)) & ((F.col("n_tokens") < FENCE_TOKENS) | within)
    return fenced.withColumn("kept", kept).drop("fence_group", "fences")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, unchanged."""
    return judge(measure(docs, whole=True)).filter("kept").select("_row.*")


def quality_digest(docs: DataFrame) -> DataFrame:
    found = judge(measure(docs))
    figures = [F.round(c, 6).alias(c) for c in FENCED]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *figures)
