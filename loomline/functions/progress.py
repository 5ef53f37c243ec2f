"""Progress of long runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def after_decoding(p: Column) -> Column:
    """Decoding takes the first twentieth."""
    return 0.05 + clamp(p) * 0.95


def beside_diarization(p: Column, diarizing: Column) -> Column:
    """Recognition is 85 % of the work where speakers are told apart, too."""
    return F.when(diarizing, clamp(p) * 0.85).otherwise(clamp(p))


def half(p: Column, second: Column) -> Column:
    """Each of two channels is half of the work."""
    return clamp(p) / 2 + F.when(second, 0.5).otherwise(0.0)


def bands(stages: DataFrame, run: str, order: str, weight: str) -> DataFrame:
    """Each stage's share of a run, ``band_start`` to ``band_end``, by cumulated weights; the last ends at 1."""
    upto = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(run))
    last = F.lead(order).over(Window.partitionBy(run).orderBy(order)).isNull()
    end = F.when(last, 1.0).otherwise(F.sum(weight).over(upto) / total)
    return stages.withColumn("band_start", (F.sum(weight).over(upto) - F.col(weight)) / total).withColumn("band_end", end)


def monotone(events: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """Progress that never goes back."""
    return events.withColumn(value, F.max(value).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def speed_factor(ratios: Column, alpha: float = 0.35) -> Column:
    """Moving average of actual to expected times, each held between 0.2 and 5; the first is taken whole."""
    held = F.transform(ratios.cast("array<double>"), lambda r: clamp(r, 0.2, 5.0))
    return F.aggregate(held, F.lit(None).cast("double"), lambda a, r: F.when(a.isNull(), r).otherwise(a + (r - a) * alpha))


def worth_telling(events: DataFrame, run: str, order: str, percent: str, ms: str) -> DataFrame:
    """Events that are first, at the end, a whole percent on, or 100 ms after the one before."""
    w = Window.partitionBy(run).orderBy(order)
    moved = F.abs(F.col(percent) - F.lag(percent).over(w)) >= 1
    waited = F.col(ms) - F.lag(ms).over(w) >= 100
    keep = (F.col(percent) >= 100) | F.lag(percent).over(w).isNull() | moved | waited
    return events.withColumn("__keep", keep).filter("__keep").drop("__keep")


def meter_height(level: Column, gate: float = 0.01, gain: float = 2.4) -> Column:
    """How high a level is drawn."""
    return F.when(level < gate, 0.0).otherwise(F.pow(clamp(level * gain), F.lit(0.52)))
