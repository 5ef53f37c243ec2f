from pyspark.sql import functions as F

from loomline.functions import progress, signal
from loomline.operators import read_models as rm
from loomline.streaming.phrases import at_rate


def one(spark, expr):
    return spark.range(1).select(expr.alias("y")).first().y


def test_remaps(spark):
    assert one(spark, progress.after_decoding(F.lit(1.0))) == 1 and one(spark, progress.half(F.lit(2.0), F.lit(True))) == 1
    assert one(spark, progress.beside_diarization(F.lit(1.0), F.lit(True))) == 0.85
    assert round(one(spark, progress.speed_factor(F.array(F.lit(1.0), F.lit(9.0)))), 4) == 2.4 and one(spark, progress.speed_factor(F.array().cast("array<double>"))) is None
    assert one(spark, progress.meter_height(F.lit(0.001))) == 0


def test_bands_and_events(spark):
    stages = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 3.0)], "run string, n int, w double")
    assert [(r.band_start, r.band_end) for r in progress.bands(stages, "run", "n", "w").orderBy("n").collect()] == [(0, 0.25), (0.25, 1)]
    ev = spark.createDataFrame([("r", 1, 0.0, 0), ("r", 2, 0.5, 50), ("r", 3, 1.6, 60), ("r", 4, 1.7, 200), ("r", 5, 1.2, 210)], "run string, n int, p double, ms bigint")
    assert [r.n for r in progress.worth_telling(ev, "run", "n", "p", "ms").orderBy("n").collect()] == [1, 3, 4]
    assert [r.p for r in progress.monotone(ev, "run", "n", "p").orderBy("n").collect()] == [0, 0.5, 1.6, 1.7, 1.7]


def test_assembly_and_rates(spark):
    pieces = F.array(F.struct(F.lit(1).alias("start"), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("pcm")), F.struct(F.lit(2).alias("start"), F.array(F.lit(2.0)).alias("pcm")), F.struct(F.lit(5).alias("start"), F.array(F.lit(3.0), F.lit(3.0)).alias("pcm")))
    assert one(spark, signal.assembled(pieces, F.lit(6))) == [0, 1, 2, 1, 0, 3]
    packets = spark.createDataFrame([(8_000, [0.0, 1.0]), (16_000, [0.0, 1.0])], "native_rate int, samples array<float>")
    assert [r.samples for r in at_rate(packets).collect()] == [[0, 0.5, 1, 1], [0, 1]]


def test_neighbours(spark):
    items = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "1"), ("d", "3")], "id string, created_at string")
    assert [rm.neighbours(items, k) for k in ("d", "a", "b", "c", "x")] == [(None, "a"), ("d", "b"), ("a", "c"), ("b", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("md::x",), ("x",)], "i string").select(rm.legacy_id(F.col("i"))).collect()] == [True, False]
