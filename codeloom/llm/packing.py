"""Packing by first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are tokenised where they are read; only (document, start, length, checksum) rows
move. Pieces of a full sequence are sequences of their own. The remainders are dealt to
randomised groups by a seeded hash, and each group runs first-fit decreasing: pieces in
descending length, each into the first open sequence with room, found in O(log n) on a
tournament tree whose inner nodes hold the largest free space below them. Groups are
independent, so the job is one shuffle of small rows at any size, and the waste is at most a
few sequences a group. The number of groups follows the most pieces that the table can have, so
neither many nor long documents make a group large.

Token ids are those of the public byte-level BPE vocabulary, its added tokens included: where one
of their strings occurs in a text, the text is cut there and the token takes its own id. A word
between single spaces is tokenised alone and remembered: the vocabulary's split pattern never
crosses from a word into a following space, so its ids don't depend on its neighbours. Texts with
other white space next to a space go through the tokeniser whole.

Edge cases: null and empty texts have one token, the end id; repeated rows are packed each; a
null doc_id packs like any other; ties of length go by doc_id, then place; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEQUENCE = 2048
END_ID = 1
GROUP_ROWS = 4096
KNOWN = 100_000
#: Longer words are not remembered, so that the words kept stay small.
LONGEST_KNOWN = 32
_MIXED = re.compile(r" \s|\s ")


class TokenBytes(dict):
    """Word (with the space before it) to its ids as little-endian 32-bit bytes; bounded."""

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = {x: np.array([i], "<u4").tobytes() for x, i in added.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(self) < KNOWN and len(word) <= LONGEST_KNOWN:
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or _MIXED.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + w] for w in rest])

    def of(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


_LOADED: dict[tuple, TokenBytes] = {}


def token_bytes(vocabulary: str) -> TokenBytes:
    """A worker's tokeniser for a rank file of public_tokenizers; its added tokens are those of the JSON file of that name."""
    from public_tokenizers import PATTERN

    if vocabulary not in _LOADED:
        ranks = C.vocabulary_path(vocabulary)
        with open(C.vocabulary_path(vocabulary.removesuffix(".tiktoken") + ".json"), encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        _LOADED[vocabulary] = TokenBytes(ranks, PATTERN, added)
    return _LOADED[vocabulary]


def _pieces(vocabulary: str, sequence: int, end_id: int):
    def run(frames):
        tokens = token_bytes(vocabulary)
        tail = np.array([end_id], "<u4").tobytes()
        step = 4 * sequence
        for pdf in frames:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = (tokens.of(text) if text else b"") + tail
                n = len(ids) // 4
                for at in range(0, len(ids), step):
                    body = ids[at : at + step]
                    out.append((doc, at // 4, len(body) // 4, zlib.crc32(body), n))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; lengths must descend."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < n:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= n
        node //= 2
        while node:
            top = max(free[2 * node], free[2 * node + 1])
            if free[node] == top:
                break
            free[node] = top
            node //= 2
    return bins, offsets


def _pack(sequence: int, stride: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        lengths = pdf["length"].to_numpy()
        full = int((lengths == sequence).sum())  # these are sequences of their own
        bins, offsets = first_fit_decreasing(lengths[full:], sequence)
        bins, offsets = np.r_[np.arange(full), full + bins], np.r_[np.zeros(full, np.int64), offsets]
        return pdf.drop(columns="grp").assign(sequence_id=int(key[0]) * stride + bins, offset=offsets)

    return run


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", sequence: int = SEQUENCE, end_id: int = END_ID, group_rows: int = GROUP_ROWS, seed: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    n_docs, n_bytes = C.volume(docs)
    rows = docs.select(C.id_or_last(docs), F.col("text"))
    pieces = rows.mapInPandas(_pieces(vocabulary, sequence, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    most = n_docs + n_bytes // sequence  # a token has a byte at least
    groups = max(1, most // group_rows)
    stride = 1 << 32
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(_pack(sequence, stride), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.select(C.id_or_null(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
