"""Segmentation lattices of words over a fixed public piece vocabulary.

A word is written with the vocabulary's word mark in front; its probability is the sum over
all ways to cut it into pieces, found by a forward recursion in log space. A character that
the vocabulary lacks is spelled by its byte pieces. Words of one length are worked on
together, so each step of the recursion is a few array operations for thousands of words.
"""

from __future__ import annotations

import numpy as np

MARK = "▁"
TOGETHER = 2048
#: Columns of probabilities that one recursion takes.
COLUMNS = 16


class Pieces:
    """Pieces of a sentencepiece model file: text to id, byte pieces, and a prior from the public scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.ids: dict[str, int] = {}
        self.bytes = np.full(256, -1, np.int64)
        rank = np.full(n, float(n))
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > -1e8:
                self.ids[piece] = i
                rank[i] = -sp.get_score(i)
        self.longest = max(map(len, self.ids))
        usable = np.zeros(n, bool)
        usable[[*self.ids.values(), *self.bytes[self.bytes >= 0]]] = True
        # Merge scores are negated ranks; a rank-frequency law makes them probabilities.
        prior = np.where(usable, 1.0 / (rank + 3.0), 0.0)
        self.prior = prior / prior.sum()
        self._index()

    def _index(self) -> None:
        """Piece hashes in two direct-address tables, so that whole arrays of spans are looked up at once."""
        names = list(self.ids)
        keys = np.array([int(_extend(np.zeros(1, np.uint64), [np.array([ord(c)], np.uint64) for c in w])[0]) for w in names], np.uint64)
        values = np.array([self.ids[w] for w in names], np.int32)
        self.tables = []
        left = np.arange(len(names))
        for seed in range(1, 20):
            slot = _slot(keys[left], seed)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << SLOT_BITS, -1, np.int32)
            table[slot[first]] = left[first]
            self.tables.append((seed, table))
            left = np.delete(left, first)
            if not len(left):
                break
        self.keys, self.values = np.append(keys, np.uint64(0)), np.append(values, np.int32(-1))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of span hashes; -1 for spans that are no piece."""
        out = np.full(h.shape, -1, np.int32)
        for seed, table in self.tables:
            at = table[_slot(h, seed)]
            hit = self.keys[at] == h
            out = np.where(hit & (at >= 0), self.values[at], out)
        return out


SLOT_BITS = 19


def _extend(h: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        for c in codes:
            h = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
    return h


def _slot(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F + 2 * seed)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _edges(vocabulary: Pieces, words: list[str], length: int) -> tuple[np.ndarray, str]:
    """ids[word, end - 1, span length - 1] and the characters that are spelled by bytes.

    An id is that of the span's piece, -1 where there is none, and vocabulary.size + i for the
    i-th spelled character.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).reshape(len(words), length).astype(np.uint64)
    most = min(length, vocabulary.longest)
    ids = np.full((len(words), length, most), -1, np.int32)
    h = np.zeros(codes.shape, np.uint64)
    for n in range(1, most + 1):
        h = _extend(h[:, : length - n + 1], [codes[:, n - 1 :]])
        ids[:, n - 1 :, n - 1] = vocabulary.lookup(h)
    missing = ids[:, :, 0] < 0
    spelled, which = np.unique(codes[missing], return_inverse=True)
    ids[:, :, 0][missing] = vocabulary.size + which
    return ids, "".join(map(chr, spelled.tolist()))


def _table(vocabulary: Pieces, logp: np.ndarray, spelled: str) -> np.ndarray:
    """logp by piece, then the spelled characters, then -inf for no piece (reached as -1)."""
    extra = [logp[vocabulary.bytes[list(c.encode("utf-8", "replace"))]].sum(0, keepdims=True) for c in spelled]
    return np.concatenate([logp, *extra, np.full((1, logp.shape[1]), -np.inf)])


def _lse(terms: np.ndarray) -> np.ndarray:
    top = terms.max(1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(terms - safe[:, None]).sum(1))


def _by_length(words: list[str], columns: int = 1):
    """Rows of words of one length, as many together as keep length x words x columns bounded."""
    order: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        order.setdefault(len(w), []).append(i)
    for length, rows in order.items():
        step = max(1, min(TOGETHER, 4 * 400_000 // max(4, length * max(4, columns))))
        for a in range(0, len(rows), step):
            yield length, rows[a : a + step]


def _forward(edge: np.ndarray) -> np.ndarray:
    """alpha[word, position, column] of edge[word, end - 1, span length - 1, column]."""
    n, length, most, columns = edge.shape
    alpha = np.full((n, length + 1, columns), -np.inf)
    alpha[:, 0] = 0.0
    for j in range(1, length + 1):
        m = min(j, most)
        alpha[:, j] = _lse(alpha[:, j - m : j][:, ::-1] + edge[:, j - 1, :m])
    return alpha


def _scaled(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The last column of _forward by products: every few positions the values are divided by
    their largest one and the divisor's logarithm is kept, so that long words don't underflow."""
    n, length, most = ids.shape
    alpha = np.zeros((n, length + 1, p.shape[1]))
    alpha[:, 0] = 1.0
    log_scale = np.zeros((n, p.shape[1]))
    for j in range(1, length + 1):
        m = min(j, most)
        alpha[:, j] = np.einsum("nmk,nmk->nk", alpha[:, j - m : j][:, ::-1], p[ids[:, j - 1, :m]])
        if j % 8 == 0:
            recent = alpha[:, max(0, j + 1 - most) : j + 1]
            top = recent.max(1)
            recent /= top[:, None]
            log_scale += np.log(top)
    return np.log(alpha[:, length]) + log_scale


def word_logprobs(vocabulary: Pieces, words: list[str], logp: np.ndarray, scaled: bool = False) -> np.ndarray:
    """Natural log probability of each word, summed over its segmentations, for each column of logp.

    The recursion runs in log space or, with `scaled`, on scaled probabilities, which is faster
    for several columns. More than COLUMNS columns are taken in blocks, so that memory doesn't grow with them.
    """
    if logp.shape[1] > COLUMNS:
        return np.concatenate([word_logprobs(vocabulary, words, logp[:, a : a + COLUMNS], scaled) for a in range(0, logp.shape[1], COLUMNS)], axis=1)
    out = np.zeros((len(words), logp.shape[1]))
    marked = [MARK + w for w in words]
    for length, rows in _by_length(marked, logp.shape[1]):
        ids, spelled = _edges(vocabulary, [marked[r] for r in rows], length)
        table = _table(vocabulary, logp, spelled)
        # Spelled characters are too unlikely for a common scale; their words take the log-space way.
        plain = ~(ids[:, 1:, 0] >= vocabulary.size).any(1) & scaled
        rows = np.array(rows)
        if plain.any():
            out[rows[plain]] = _scaled(ids[plain], np.exp(table))
        if not plain.all():
            out[rows[~plain]] = _forward(table[ids[~plain]])[:, length]
    return out


def expected_counts(vocabulary: Pieces, words: list[str], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations under logp (one column), for each column of weights."""
    total = np.zeros((vocabulary.size, weights.shape[1]))
    marked = [MARK + w for w in words]
    for length, rows in _by_length(marked):
        ids, spelled = _edges(vocabulary, [marked[r] for r in rows], length)
        edge = _table(vocabulary, logp[:, None], spelled)[ids]
        alpha = _forward(edge)[:, :, 0]
        edge = edge[:, :, :, 0]
        most = edge.shape[2]
        beta = np.full_like(alpha, -np.inf)
        beta[:, length] = 0.0
        for i in range(length - 1, -1, -1):
            m = min(length - i, most)
            ends = np.arange(i, i + m)
            beta[:, i] = _lse((beta[:, ends + 1] + edge[:, ends, ends - i])[:, :, None])[:, 0]
        post = edge
        post += beta[:, 1:, None]
        for n in range(most):
            post[:, n:, n] += alpha[:, : length - n]
        post -= alpha[:, length, None, None]
        np.exp(post, out=post)
        post[~np.isfinite(post)] = 0.0
        flat = ids.ravel() + 1
        for c in range(weights.shape[1]):
            found = np.bincount(flat, weights=(post * weights[rows, c][:, None, None]).ravel(), minlength=vocabulary.size + 1 + len(spelled))
            total[:, c] += found[1 : vocabulary.size + 1]
            for char, e in zip(spelled, found[vocabulary.size + 1 :]):
                for b in char.encode("utf-8", "replace"):
                    total[vocabulary.bytes[b], c] += e
    return total
