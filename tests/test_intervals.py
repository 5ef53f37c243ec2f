import random

from loomline.operators.intervals import periods_and_gaps
from loomline.operators.sequence import bucketed, with_latest, with_previous
from pyspark.sql import functions as F

DDL = "who string, start_ms bigint, end_ms bigint, kind string, b int"


def brute(rows, most=None):
    out = set()
    for who in {r[0] for r in rows} - {None}:
        spans = sorted((s, e) for w, s, e, *_ in rows if w == who and s is not None and e is not None and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(who, "period", s, e) for s, e in merged}
        out |= {(who, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if most is None or b[0] - a[1] < most}
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(800):
        s = rnd.randrange(-2000, 20_000)
        rows.append((f"w{0 if rnd.random() < 0.4 else rnd.randrange(5)}", s, s + rnd.choice([-5, 0, 3, 20, 60, 4000 if rnd.random() < 0.02 else 9]), "x", 1))
    rows += [(None, 1, 2, "", 0), ("w1", None, 4, "", 0), ("w1", 4, None, None, None), *rows[:50]]
    df = spark.createDataFrame(rows, DDL)
    for width in (7, 100, 10**9):
        for most in (None, 15):
            got = {tuple(r) for r in periods_and_gaps(df, ["who"], bucket_ms=width, max_gap_ms=most).collect()}
            assert got == brute(rows, most), width


def test_touching_nested_single_and_empty(spark):
    rows = [("a", 0, 10, "", 0), ("a", 10, 20, "", 0), ("a", 2, 5, "", 0), ("b", 1, 2, "", 0)]
    df = spark.createDataFrame(rows, DDL)
    assert {tuple(r) for r in periods_and_gaps(df, ["who"]).collect()} == {("a", "period", 0, 20), ("b", "period", 1, 2)}
    assert periods_and_gaps(df.limit(0), ["who"]).count() == 0


def test_look_back_across_buckets(spark):
    rnd = random.Random(5)
    rows = [("k" + str(rnd.randrange(3)), rnd.randrange(5000), i, rnd.choice("abc")) for i in range(400)]
    df = bucketed(spark.createDataFrame(rows, "k string, t bigint, i int, v string"), ["k"], "t", 50)
    out = with_previous(df, ["k"], ["t", "i"], ["v", "i"])
    out = with_latest(out, ["k"], ["t", "i"], F.when(F.col("v") == "a", F.col("i")), "last_a").collect()
    for k in {r[0] for r in rows}:
        own = sorted((t, i, v) for kk, t, i, v in rows if kk == k)
        got = {(r.t, r.i): r for r in out if r.k == k}
        before = last = None
        for t, i, v in own:
            last = i if v == "a" else last
            r = got[t, i]
            assert (r.prev.i if r.prev else None) == before and r.last_a == last
            before = i
