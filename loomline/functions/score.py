"""Vector and ranking scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import normalize_tag

# Weights of the hybrid score and the half-life of recency.
WEIGHTS = {"vector": 0.60, "keyword": 0.25, "tag": 0.05, "recency": 0.10}
HALF_LIFE_DAYS = 90
EMBEDDING_DIM = 8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    n = F.sqrt(dot(doubles(v), doubles(v)))
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty, zero or differently long vectors."""
    a, b = doubles(a), doubles(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.coalesce(F.when(fit & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def instant(text: Column) -> Column:
    """An RFC 3339 text as a timestamp; null if it isn't one."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def recency(created_at: Column, now: str) -> Column:
    """Halves every 90 whole days; 0 without a date."""
    days = F.floor((F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(instant(created_at))) / F.lit(86_400_000_000))
    return F.when(days.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / HALF_LIFE_DAYS))


def matched_terms(terms: Column, query_terms: list[str]) -> Column:
    """J07."""
    wanted = F.array(*[F.lit(t) for t in query_terms]) if query_terms else F.array().cast("array<string>")
    return F.array_sort(F.array_intersect(F.coalesce(terms, F.array().cast("array<string>")), wanted))


def tag_hit(tags: Column, query_terms: list[str]) -> Column:
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.coalesce(F.exists(tags, lambda t: normalize_tag(t).isin(query_terms)), F.lit(False)) if query_terms else F.lit(False)


def hashed_embedding(terms: Column, dim: int = EMBEDDING_DIM) -> Column:
    """F01's stand-in: a hashed bag of terms of length one. Real models plug in as any string -> array<float> column."""
    slots = F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    return l2_normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double")))
