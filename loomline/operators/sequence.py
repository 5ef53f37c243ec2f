"""Looking back along an ordered sequence without one task per entity.

``lag`` and "last value seen so far" over a whole entity put all its rows into one task. Here rows are split by
(entity, time bucket); the look-back runs inside buckets, and what the first rows of a bucket need from earlier
ones comes from a summary of one row a bucket. All rows are shuffled once, on (entity, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 3_600_000


def bucketed(df: DataFrame, keys: list[str], time: str, bucket_ms: int = BUCKET_MS, name: str = "__b") -> DataFrame:
    """``df`` with a time bucket, shuffled on keys and bucket; every later step on these columns reuses the exchange."""
    out = df.withColumn(name, F.floor(F.col(time) / F.lit(bucket_ms)))
    return out.repartition(*[F.col(k) for k in keys], F.col(name))


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], into: str = "prev", bucket: str = "__b") -> DataFrame:
    """Adds ``into``, a struct of ``values`` of the row before in the entity's ``order``; null for its first row.

    ``df`` comes from ``bucketed`` with a bucket that grows with the first column of ``order``.
    """
    slot = [*keys, bucket]
    state = F.struct(*[F.col(c) for c in values])
    rank = F.struct(*[F.col(c) for c in order])
    within = Window.partitionBy(*slot).orderBy(*order)
    local = df.withColumn("__local", F.lag(state).over(within))
    last = df.groupBy(*slot).agg(F.max(F.struct(rank.alias("r"), state.alias("v"))).alias("m"))
    carried = last.select(*slot, F.lag("m").over(Window.partitionBy(*keys).orderBy(bucket)).getField("v").alias("__carried"))
    return local.join(carried, slot).withColumn(into, F.coalesce("__local", "__carried")).drop("__local", "__carried")


def with_latest(df: DataFrame, keys: list[str], order: list[str], value: Column, into: str, bucket: str = "__b") -> DataFrame:
    """Adds ``into``, the latest non-null ``value`` up to and with the row in the entity's ``order``."""
    slot = [*keys, bucket]
    marked = df.withColumn("__v", value)
    within = Window.partitionBy(*slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("__local", F.last("__v", ignorenulls=True).over(within))
    rank = F.struct(*[F.col(c) for c in order])
    last = marked.groupBy(*slot).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), rank)).alias("__last"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*slot, F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    return local.join(carried, slot).withColumn(into, F.coalesce("__local", "__carried")).drop("__local", "__carried", "__v")


def gathered(at: Column, text: Column, between: str) -> Column:
    """Aggregate: the texts of a group in order of ``at``, with ``between`` between them; null if there are none."""
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(at.alias("at"), text.alias("t")))))
    return F.when(F.count(text) > 0, F.array_join(F.transform(rows, lambda x: x["t"]), between))


def joined_text(df: DataFrame, group: list[str], order: list[str], text: str, into: str, between: str, time: str | None = None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``group`` and ``into``, the group's texts in ``order``, with ``between`` between them; null texts are left out.

    A time bucket's texts are joined first, so no task sorts a large group's rows; only its few long parts meet.
    """
    place = F.struct(*[F.col(c) for c in order])
    parts = df.groupBy(*group, F.floor(F.col(time or order[0]) / F.lit(bucket_ms)).alias("__part")).agg(gathered(place, F.col(text), between).alias("__text"))
    return parts.groupBy(*group).agg(F.coalesce(gathered(F.col("__part"), F.col("__text"), between), F.lit("")).alias(into))
