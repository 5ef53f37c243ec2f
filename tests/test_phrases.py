import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.session import scratch
from loomline.streaming.phrases import Cutter, Limits, debounced, phrases_batch, phrases_stream, retimed

STEP = 8192


def audio(*parts):
    return np.concatenate([np.full(n, v, np.float32) for n, v in parts])


TALK = audio((64 * STEP, 0.5), (2 * STEP, 0.0), (5 * STEP, 0.5), (123, 0.5))


@pytest.mark.parametrize("size", [1280, 511, 16_000, 70_001])
def test_cuts_whatever_the_packets(size):
    c = Cutter()
    cuts = [x for i in range(0, len(TALK), size) for x in c.push(TALK[i : i + size])]
    assert cuts + c.finish() == [(0, 65 * STEP), (65 * STEP, len(TALK))]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6000), st.sampled_from([0.0, 0.5])), min_size=1, max_size=30), st.integers(1, 5000))
def test_every_sample_once(parts, size):
    pcm, limits = audio(*parts), Limits(step=512, least=2048, quiet=2)
    results = []
    for n in (size, len(pcm)):
        c = Cutter(limits=limits)
        results.append([x for i in range(0, len(pcm), n) for x in c.push(pcm[i : i + n])] + c.finish())
    assert results[0] == results[1] and results[0][0][0] == 0 and results[0][-1][1] == len(pcm)
    assert all(a[1] == b[0] for a, b in zip(results[0], results[0][1:]))


def test_short_quiet_and_limits():
    c = Cutter()
    assert c.push(audio((60 * STEP, 0.5), (8 * 512, 0.0), (8 * 512, 0.5), (STEP, 0.5))) == []
    with pytest.raises(OverflowError):
        c.push(audio((60 * 16_000, 0.5)))
    c = Cutter()
    c.push(np.zeros(17, np.float32))
    assert c.finish() == [(0, 17)] and Cutter().finish() == []


def test_stream_and_batch_agree(spark):
    limits = Limits(step=512, least=2048, quiet=2)
    pcm = audio((4096, 0.5), (2048, 0.0), (3000, 0.5))
    rows = [(s, i // 700, pcm[i : i + 700].tolist(), i + 700 >= len(pcm)) for s in ("a", "b") for i in range(0, len(pcm), 700)]
    packets = spark.createDataFrame(rows, "session_id string, packet_no bigint, samples array<float>, is_end boolean")
    batch = sorted(map(tuple, phrases_batch(packets, limits=limits).collect()))
    path, out, state = (scratch(spark, x) for x in ("packets", "phrases", "state"))
    half = len(rows) // 4
    early, late = packets.filter(f"packet_no < {half}"), packets.filter(f"packet_no >= {half} OR session_id = 'lost'")
    for part in (early, late):
        part.write.mode("append").parquet(path)
        stream = phrases_stream(spark.readStream.schema(packets.schema).parquet(path), limits=limits)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == batch and len(batch) == 4


def test_lost_packet_poisons(spark):
    path, out, state = (scratch(spark, x) for x in ("packets", "phrases", "state"))
    rows = [("a", 0, [0.1] * 5, False), ("a", 2, [0.1] * 5, True)]
    spark.createDataFrame(rows, "session_id string, packet_no bigint, samples array<float>, is_end boolean").write.parquet(path)
    stream = phrases_stream(spark.readStream.schema("session_id string, packet_no bigint, samples array<float>, is_end boolean").parquet(path))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).collect()
    assert len(got) == 1 and got[0].error and got[0].start_sample is None


def test_cancelled_sessions_give_nothing_else(spark):
    limits = Limits(step=512, least=2048, quiet=2)
    path, out, state = (scratch(spark, x) for x in ("packets", "phrases", "state"))
    schema = "session_id string, packet_no bigint, samples array<float>, is_end boolean, is_cancel boolean"
    loud, quiet = [0.5] * 2048, [0.0] * 2048
    rows = [("a", 0, loud, False, None), ("a", 1, quiet, False, None), ("a", 2, loud, False, True), ("a", 3, loud, True, None), ("b", 0, loud, True, None)]
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream = phrases_stream(spark.readStream.schema(schema).parquet(path), limits=limits)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", None, None, "cancelled"), ("b", 0, 2048, None)]


def test_retiming_and_debounce(spark):
    df = spark.createDataFrame([(1000, 500, -5, 900), (1000, 500, 400, 300)], "offset_ms bigint, phrase_ms bigint, start_ms bigint, end_ms bigint")
    assert [(r.start_ms, r.end_ms) for r in retimed(df).collect()] == [(1000, 1500), (1400, 1400)]
    ev = spark.sql("SELECT 'k' AS k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS t, s AS v FROM VALUES (0), (1), (9), (10) AS x(s)")
    assert sorted(r.v for r in debounced(ev, "k", "t", "v", "3 seconds").collect()) == [1, 10]
