"""Shared pieces of the training-data operators.

Words are maximal runs of bytes other than space and 0x09-0x0D. `bytes.split()` with no
argument splits on exactly those six bytes, so texts are cast to binary in Spark and split
in tasks without decoding.

The *chunk exchange* used by the window and shingle operators: documents are dealt to
chunks of a bounded number of bytes by a hash of their id. A chunk sends each shard of a
key space one packed packet with its own distinct keys; the shard merges the packets and
answers each chunk with an array aligned to the keys it sent. Nothing passes through the
driver and a key that every document has costs one entry per chunk.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import checkpoint  # noqa: F401

WORD_SQL = r"[^\x20\x09-\x0D]+"
NULL_ID = np.iinfo(np.int64).max
CHUNK_BYTES = 4 << 20
MIN_CHUNKS = 48

_B1 = np.uint64(0x9E3779B97F4A7C15)
_B2 = np.uint64(0xC2B2AE3D27D4EB4F)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def volume(docs: DataFrame) -> tuple[int, int]:
    """Rows and text bytes of the whole table: one row to the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(text_bytes(F.col("text"))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def chunk_count(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(MIN_CHUNKS, -(-total_bytes // chunk_bytes))


def chunk_of(doc_id: Column, text_hash: Column, n_chunks: int) -> Column:
    """The chunk of a document: a hash of its id and text, so that null or repeated ids spread by their texts."""
    return F.pmod(F.xxhash64(doc_id, text_hash), F.lit(n_chunks)).cast("int").alias("chunk")


def chunked(docs: DataFrame, n_chunks: int, *more: Column) -> DataFrame:
    """(chunk int, doc_id long, body binary, and more)."""
    return docs.select(
        chunk_of(id_or_last(docs), F.xxhash64("text"), n_chunks),
        id_or_last(docs),
        F.col("text").cast("binary").alias("body"),
        *more,
    )


def id_or_last(docs: DataFrame) -> Column:
    """doc_id with null as the largest long, so that tasks see plain integers."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")


def id_or_null() -> Column:
    """The inverse of id_or_last."""
    return F.nullif(F.col("doc_id"), F.lit(NULL_ID)).alias("doc_id")


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; every seed gives an independent function."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A hash for each run of k word hashes; `second` gives an independent one."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    src, base = (mix(h, 77), _B2) if second else (h, _B1)
    with np.errstate(over="ignore"):
        acc = src[:n].copy()
        for i in range(1, k):
            acc *= base
            acc += src[i : i + n]
    return mix(acc, 3 if second else 1)


def ascii_lower(body: bytes) -> bytes:
    """Lower-cases A-Z only."""
    return body.lower()


def joined(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lists in a row, the list each belongs to, and the lengths."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.empty(int(lens.sum()), np.uint64)
    at = 0
    for words in lists:
        h[at : at + len(words)] = word_hashes(words)
        at += len(words)
    return h, np.repeat(np.arange(len(lists)), lens), lens


def planes(a: np.ndarray) -> bytes:
    """Byte planes: high bytes that are mostly equal lie together and compress."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(body: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(body, np.uint8, n * size).reshape(size, n).T.copy().view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned values as compressed differences."""
    d = np.diff(a, prepend=a[:0].dtype.type(0)) if len(a) else a
    top = int(d.max()) if len(d) else 0
    dtype = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(dtype).itemsize]) + zlib.compress(planes(d.astype(dtype)), 1)


def unpack_sorted(body: bytes, n: int) -> np.ndarray:
    dtype = {2: np.uint16, 4: np.uint32, 8: np.uint64}[body[0]]
    return np.cumsum(unplanes(zlib.decompress(body[1:]), dtype, n).astype(np.uint64), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def shard_slices(sorted_keys: np.ndarray, bits: int, shard_bits: int) -> list[tuple[int, int, int]]:
    """(shard, start, end) of the non-empty shards; a shard is the top shard_bits of a key of `bits` bits."""
    shards = (sorted_keys >> np.uint64(bits - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(sorted_keys), np.int64)
    ids, starts = np.unique(shards, return_index=True)
    return list(zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_keys)]))


def sketch_bits(total_bytes: int, per_byte: float = 1.0) -> int:
    """log2 of a sketch width in proportion to the text."""
    return max(16, int(np.ceil(np.log2(max(1, total_bytes) * per_byte))))


def shard_bits_for(total_bytes: int, bits: int, bytes_per_shard: int = 24 << 20) -> int:
    return min(bits, max(4, int(np.ceil(np.log2(max(1, total_bytes / bytes_per_shard))))))


def by_bytes(frames, column: str, limit: int):
    """Cuts incoming frames so that a column's values in one add up to about `limit` bytes at most."""
    for pdf in frames:
        sizes = np.fromiter((len(b) if b is not None else 0 for b in pdf[column]), np.int64, len(pdf))
        part = np.cumsum(sizes) // limit
        for a, b in zip(*(lambda e: (e, [*e[1:], len(pdf)]))(np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist())) if len(pdf) else ():
            yield pdf.iloc[a:b].reset_index(drop=True)


def vocabulary_path(name: str) -> str:
    """A path is taken as it is; a name is looked up among the public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches, column: str, limit: int):
    """by_bytes for Arrow record batches; nothing is copied."""
    for batch in batches:
        values = batch.column(column)
        sizes = np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in values), np.int64, len(values)) if batch.num_rows else np.empty(0, np.int64)
        part = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(part) else []
        for a, b in zip(edges, [*edges[1:], len(part)]):
            yield batch.slice(a, b - a)
