"""Overlapping and gapped intervals: continuous periods and the gaps between (problem 4).

Method: sort by start per entity, compare each start with the running maximum of the ends before it,
label islands cumulatively, aggregate periods, derive gaps.

Scale: one entity may hold a third of all rows, so no window spans an entity's rows. Rows are split by
(entity, time bucket); local islands come from a window inside the bucket. What a bucket needs from
those before it, the maximum end and the number of islands, comes from a summary of one row a bucket.
Rows are shuffled once, on (entity, bucket); the two summaries derive the local islands from that exchange again, which is
cheaper than shuffling or storing them. What is shuffled later are islands and summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket. Only the split of work depends on it, not the result.
BUCKET_MS = 3_600_000


def periods_and_gaps(spans: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", bucket_ms: int = BUCKET_MS, max_gap_ms: int | None = None) -> DataFrame:
    """Columns ``keys..., kind, start_ms, end_ms``: kind ``period`` or ``gap``.

    A period is a longest stretch covered by spans that overlap or touch; a gap lies between two
    neighbouring periods of an entity, given if shorter than ``max_gap_ms`` (None: always).
    Defined cases: spans with a null time or an end not after the start don't count; rows with a null
    key belong to no entity and are left out; repeats change nothing; an entity with one period has no
    gap; an empty input gives an empty result. Other columns of the input are ignored, whatever their names.
    """
    named = [f"__k{i}" for i in range(len(keys))]
    rows = spans.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named)], F.col(f"`{start}`").cast("bigint").alias("s"), F.col(f"`{end}`").cast("bigint").alias("e"))
    rows = rows.filter("s IS NOT NULL AND e IS NOT NULL AND e > s").dropna(subset=named)
    slot = [*named, "b"]
    rows = rows.withColumn("b", F.floor(F.col("s") / F.lit(bucket_ms)))

    ordered = Window.partitionBy(*slot).orderBy("s", "e")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        rows.withColumn("seen", F.max("e").over(before))
        .withColumn("new", (F.col("seen").isNull() | (F.col("s") > F.col("seen"))).cast("int"))
        .withColumn("isle", F.sum("new").over(running))
        .groupBy(*slot, "isle")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("new") == 1, F.col("seen"))).alias("seen"))
    )

    by_bucket = Window.partitionBy(*named).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.groupBy(*slot).agg(F.max("e").alias("reach")).select(*slot, F.max("reach").over(by_bucket).alias("carry"))
    flagged = (
        local.join(carry, slot)
        .withColumn("prev_end", F.greatest("seen", "carry"))
        .withColumn("opens", (F.col("prev_end").isNull() | (F.col("s") > F.col("prev_end"))).cast("int"))
    )
    opened = flagged.groupBy(*slot).agg(F.sum("opens").alias("n")).select(*slot, F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("base"))
    labelled = flagged.join(opened, slot).withColumn("period", F.col("base") + F.sum("opens").over(Window.partitionBy(*slot).orderBy("isle").rowsBetween(Window.unboundedPreceding, 0)))
    merged = labelled.groupBy(*named, "period").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("opens") == 1, F.col("prev_end"))).alias("gap_from"))

    gap = F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("start_ms"), F.col("s").alias("end_ms"))
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    wanted = F.col("gap_from").isNotNull()
    if max_gap_ms is not None:
        wanted &= F.col("s") - F.col("gap_from") < max_gap_ms
    exploded = merged.select(*named, F.explode(F.when(wanted, F.array(period, gap)).otherwise(F.array(period))).alias("x"))
    return exploded.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], "x.kind", "x.start_ms", "x.end_ms")
