"""Vector and token functions (V1, V6, V7, A14) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.stem import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """V1: zero norms and unequal lengths give 0. Norms may be passed in where they are computed once a row."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """V6: digest bytes of the lower-cased text in turn, disturbed by a sine and scaled to unit length."""
    digest = F.sha2(F.lower(text), 256)
    number = lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)
    turns = F.slice(F.flatten(F.array_repeat(let(digest, number), -(-dims // 32))), 1, dims)
    raw = F.zip_with(turns, F.array(*[F.sin(F.lit(i * 0.013)) for i in range(dims)]), lambda x, y: x + y)
    return let(raw, lambda r: let(F.greatest(norm(r), F.lit(1e-12)), lambda n: F.transform(r, lambda x: x / n)))


def token_estimate(text: Column) -> Column:
    """V7: a token for every four characters, rounded up."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def micro_cents(tokens: Column, cents_per_million: Column | float) -> Column:
    """A cent is 10,000 micro-cents; half up; negative or missing tokens cost nothing."""
    price = F.lit(cents_per_million) if isinstance(cents_per_million, (int, float)) else cents_per_million
    return F.floor(F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)) * price / 100 + 0.5).cast("long")
