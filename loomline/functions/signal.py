"""Audio-signal scalars over arrays of samples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16_000
#: From this level on a channel carries a signal.
SILENCE = 1e-3


def finite(v: Column) -> Column:
    return F.filter(v.cast("array<double>"), lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def rms(v: Column) -> Column:
    """0 for no samples."""
    v = v.cast("array<double>")
    return F.when(F.size(v) > 0, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v))).otherwise(F.lit(0.0))


def peak(v: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(finite(v), F.abs)), F.lit(0.0))


def level(v: Column) -> Column:
    """A08."""
    return F.least(F.greatest(rms(v) * 4, F.lit(0.0)), F.lit(1.0))


def has_signal(v: Column) -> Column:
    """P11."""
    return rms(v) >= SILENCE


def diagnostics(v: Column) -> Column:
    """Counts, length, level and peak of the finite samples."""
    v = v.cast("array<double>")
    good = finite(v)
    return F.struct(
        F.size(v).alias("n"), (F.size(v) / RATE).alias("secs"), rms(good).alias("rms"), peak(v).alias("peak"),
        F.size(F.filter(v, F.isnan)).alias("nan"), F.size(F.filter(v, lambda x: F.abs(x) == float("inf"))).alias("inf"),
    )


def mix_down(v: Column, channels: int) -> Column:
    """The mean of each frame of interleaved channels; samples of an unfinished frame are dropped."""
    frames = F.floor(F.size(v) / channels).cast("int")
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.aggregate(F.slice(v.cast("array<double>"), i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x) / channels)).otherwise(F.array().cast("array<double>"))


def resample(v: Column, rate: int | Column, to: int) -> Column:
    """Linear interpolation between neighbours, the last sample held; samples at the wanted rate stay as they are."""
    v = v.cast("array<double>")
    if isinstance(rate, int):
        if rate == to:
            return v
        rate = F.lit(rate)
    n = F.floor(F.size(v) * F.lit(to) / rate).cast("int")

    def at(i: Column) -> Column:
        place = i * (rate / F.lit(float(to)))
        low = F.floor(place).cast("int")
        a, b = F.get(v, F.least(low, F.size(v) - 1)), F.get(v, F.least(low + 1, F.size(v) - 1))
        return a + (b - a) * (place - low)

    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))
    return F.when(rate == to, v).otherwise(made)


def assembled(pieces: Column, total: Column) -> Column:
    """Samples of pieces (``start``, ``pcm``, both in samples) on a line of ``total`` zeros; later pieces cover earlier ones, what lies outside is cut."""

    def lay(line: Column, piece: Column) -> Column:
        start = F.greatest(F.least(piece["start"], total), F.lit(0)).cast("int")
        own = F.slice(piece["pcm"].cast("array<double>"), F.lit(1), F.greatest(total - start, F.lit(0)).cast("int"))
        stop = start + F.size(own)
        return F.concat(F.slice(line, F.lit(1), start), own, F.slice(line, stop + 1, F.greatest(total - stop, F.lit(0)).cast("int")))

    return F.aggregate(pieces, F.array_repeat(F.lit(0.0), total.cast("int")), lay)


def quantise(v: Column) -> Column:
    """16-bit samples."""
    return F.transform(v.cast("array<double>"), lambda x: F.least(F.greatest(x * 32767, F.lit(-32768.0)), F.lit(32767.0)).cast("smallint"))


def dequantise(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 32768)


def samples_to_ms(n: Column) -> Column:
    """E29."""
    return F.floor(n * 1000 / RATE).cast("bigint")


def usable_pcm(v: Column, least: int = 1_600) -> Column:
    """P20: long enough, and every sample finite."""
    return (F.size(v) >= least) & (F.size(finite(v)) == F.size(v))
