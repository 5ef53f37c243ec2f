import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm.nearest import match_stream, match_tables, nearest
from loomline.session import scratch


def brute(lefts, rights, tol):
    out = set()
    for who, ref, t, *_ in lefts:
        own = [(abs(rt - t), rt, rr) for w, rr, rt, *_ in rights if w == who and rt is not None and rr is not None] if None not in (who, ref, t) else []
        if own and min(own)[0] <= tol:
            best = min(own)
            out.add((who, str(ref), t, best[2], best[1]))
    return out


def run(spark, lefts, rights, tol=100, progress=None):
    left, right = scratch(spark, "l"), scratch(spark, "r")
    spark.createDataFrame(lefts, "who string, pos int, t bigint, side int, event_time string").repartition(3).write.parquet(left)
    spark.createDataFrame(rights, "who string, id string, t bigint, bucket string").repartition(2).write.parquet(right)
    return match_tables(spark, left, right, "who", "t", "pos", "t", "id", tol, progress)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    who = lambda: "hot" if rnd.random() < 0.4 else f"w{rnd.randrange(4)}"
    when = lambda: rnd.choice([rnd.randrange(-900, 3_000_000), 600_000 + rnd.randrange(-120, 120), 0])
    lefts = [(who(), i, when(), 0, "x") for i in range(300)]
    rights = [(who(), f"c{i}", when(), "y") for i in range(250)]
    lefts += [(None, 1, 5, 0, ""), ("hot", 999, None, 0, ""), *lefts[:40]]
    rights += [("hot", "z", None, ""), (None, "n", 5, ""), *rights[:40]]
    got = run(spark, lefts, rights).collect()
    assert {tuple(r) for r in got} == brute(lefts, rights, 100) and len(got) == len({tuple(r) for r in got})


def test_ties_limits_and_far_times(spark):
    lefts = [("a", 1, 1000, 0, ""), ("a", 2, 5000, 0, ""), ("a", 3, 9000, 0, ""), ("a", 4, 10**14, 0, ""), ("a", 5, -(10**14), 0, "")]
    rights = [("a", "late", 1100, ""), ("a", "early", 900, ""), ("a", "y", 5100, ""), ("a", "x", 5100, ""), ("a", "far", 9101, ""), ("a", "huge", 10**14 + 5, "")]
    got = {r.left_ref: r.right_ref for r in run(spark, lefts, rights).collect()}
    assert got == {"1": "early", "2": "x", "4": "huge"}


def test_replay_emits_and_evicts_slice_by_slice(spark):
    lefts = [(f"w{i % 5}", i, i * 10_000, 0, "") for i in range(300)]
    rights = [(f"w{i % 5}", f"c{i}", i * 10_000 + 7, "") for i in range(300)]
    progress = []
    assert run(spark, lefts, rights, progress=progress).count() == 300
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(s["numRowsRemoved"] > 0 for s in state) >= 3 and state[-1]["numRowsTotal"] == 0
    assert max(p["numInputRows"] for p in progress) < 400  # of 600, in three slices
    assert "rocksdb" in str(state[0]).lower()


def test_nearest_at_the_ends_of_the_range():
    big = np.iinfo(np.int64).max
    key, times = np.zeros(3, np.int64), np.array([-big, 0, big])
    assert nearest(key, times, key, times + np.array([1, 5, -1]), 4).tolist() == [0, -1, 2]
    assert nearest(key + 1, times, key, times, 4).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("empty", ["left", "right"])
def test_empty_side(spark, empty):
    lefts, rights = [("a", 1, 1000, 0, "")], [("a", "c", 1000, "")]
    assert run(spark, [] if empty == "left" else lefts, [] if empty == "right" else rights).count() == 0


def test_live_stream_emits_and_evicts(spark):
    path, out, state = (scratch(spark, x) for x in ("events", "out", "state"))
    schema = "entity string, bucket bigint, side int, t bigint, ref string"
    batches = [[("a", 0, 0, 1000, "l1"), ("a", 0, 1, 1050, "r1")], [("a", 0, 0, 60_000, "l2"), ("a", 0, 1, 60_010, "r2")], [("a", 0, 0, 120_000, "l3")]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        q = match_stream(spark.readStream.schema(schema).parquet(path), 100, "1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(sorted(r.left_ref for r in spark.read.schema("left_ref string").parquet(out).select(F.col("left_ref")).collect()))
        rows_kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert seen == [[], ["l1"], ["l1", "l2"]] and rows_kept <= 1
