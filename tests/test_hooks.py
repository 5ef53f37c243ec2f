import numpy as np
import pytest

from loomline.session import scratch
from loomline.streaming.gestures import commands
from loomline.streaming.hooks import diarize, diarize_stream, labelled_ranges, transcribe_both, with_taps


def splitter():
    """Made here, so that it is shipped by value: workers don't know this module."""

    def halves(pcm):
        if len(pcm) == 3:
            raise RuntimeError("too short")
        return [(0, 0, len(pcm) // 2), (1, len(pcm) // 2, len(pcm))]

    return halves


def test_a_failing_diarizer_leaves_a_plain_transcript(spark):
    df = spark.createDataFrame([("a", [0.0] * 10), ("b", [0.0] * 3), ("c", None)], "recording_id string, pcm array<float>")
    got = labelled_ranges(diarize(df, splitter())).collect()
    assert [tuple(r) for r in sorted(got)] == [("a", "Speaker 1", 0, 5), ("a", "Speaker 2", 5, 10)]


def test_both_channels_are_recognised_and_merged(spark):
    df = spark.createDataFrame([("a", "mic", [1.0] * 5), ("a", "speaker", [2.0] * 3)], "recording_id string, channel string, pcm array<float>")
    lines = transcribe_both(df, lambda pcm: [(int(10 - pcm[0]), 20, f"said {len(pcm)}")]).orderBy("start_ms").collect()
    assert [(r.source, r.start_ms, r.text) for r in lines] == [("speaker", 8, "said 3"), ("mic", 9, "said 5")]


def test_live_diarization(spark):
    class Counting:
        """Reports a range for each packet, and at the end one for the whole."""

        def __init__(self):
            self.seen = 0

        def feed(self, pcm):
            if len(pcm) and pcm[0] < 0:
                raise RuntimeError("broken")
            self.seen += len(pcm)
            return [(0, self.seen - len(pcm), self.seen)]

        def flush(self):
            return [(9, 0, self.seen)]

    path, out, state = (scratch(spark, x) for x in ("packets", "ranges", "state"))
    schema = "session_id string, packet_no long, samples array<float>, is_end boolean"
    for rows in ([("a", 0, [1.0] * 4, False), ("b", 0, [-1.0], False)], [("a", 1, [1.0] * 2, True), ("b", 1, [1.0], True), ("c", 0, [1.0], False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        q = diarize_stream(spark.readStream.schema(schema).parquet(path), Counting).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [("a", 0, 0, 4), ("a", 0, 4, 6), ("a", 9, 0, 6)]


def test_taps_see_every_batch(spark):
    path, state = scratch(spark, "in"), scratch(spark, "state")
    spark.range(5).write.parquet(path)
    seen = []

    def broken(batch):
        raise RuntimeError("tap")

    q = with_taps(spark.readStream.schema("id long").parquet(path), broken, lambda b: seen.append(b.count())).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 5


@pytest.mark.parametrize(
    "events,want",
    [
        ("d0 u100 d200 u300 d1400", [(300, "start", "double_tap"), (1400, "stop", "double_tap")]),
        ("d0 u100 d200 u300 d900 d1300", [(300, "start", "double_tap"), (1300, "stop", "double_tap")]),
        ("d0 u100 d200 u900", [(700, "start", "hold"), (900, "stop", "hold")]),
        ("d0 u400 d500 u550 d600 u650", [(650, "start", "double_tap")]),
        ("d0 u100 d600 u700 d800", [(1300, "start", "hold")]),
        ("d0 d50 u100 d200 d250 u699", [(699, "start", "double_tap")]),
        ("d0 u100", []),
        ("u5", []),
    ],
)
def test_gestures(spark, events, want):
    rows = [("s", int(e[1:]), {"d": "down", "u": "up"}[e[0]]) for e in events.split()]
    got = commands(spark.createDataFrame(rows + [(None, 1, "down")], "session_id string, at_ms long, event string")).collect()
    assert [(r.at_ms, r.command, r.gesture) for r in got] == want


def test_nothing_to_hear(spark):
    assert diarize(spark.createDataFrame([], "recording_id string, pcm array<float>"), splitter()).count() == 0 and np.isfinite(1)
