import random

from pyspark.sql import functions as F

from loomline.operators import transcript as t

LINES = "recording_id string, pos int, start_ms bigint, end_ms bigint, text string, source string, channel string"


def lines(spark, rows):
    return spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], LINES)


def ranges(spark, rows):
    return spark.createDataFrame([("r", *r) for r in rows], "recording_id string, label string, start_ms bigint, end_ms bigint")


def test_alignment_cases(spark):
    cases = [
        ([("Speaker 1", 0, 400), ("Speaker 2", 400, 1000)], "Speaker 2"),
        ([("Speaker 2", 500, 1000), ("Speaker 1", 0, 500)], "Speaker 1"),
        ([("Speaker 1", 0, 300), ("Speaker 2", 300, 700), ("Speaker 1", 700, 1000)], "Speaker 1"),
        ([("Speaker 1", 2000, 3000)], "Other"),
    ]
    for rs, want in cases:
        got = t.align_speakers(lines(spark, [(0, 1000, "x", None, "mic")]), ranges(spark, rs)).collect()
        assert [r.label for r in got] == [want]


def test_alignment_over_many_slots(spark):
    rnd = random.Random(3)
    span = lambda: (s := rnd.randrange(-500, 300_000), s + rnd.choice([0, 10, 5_000, 90_000, 10**9, 10**12 if rnd.random() < 0.1 else 7]))
    ls, rs = [span() for _ in range(60)], [(f"S{rnd.randrange(3)}", *span()) for _ in range(40)]
    got = {r.pos: (r.label, r.overlap_ms) for r in t.align_speakers(lines(spark, [(a, b, "x", None, "mic") for a, b in ls]), ranges(spark, rs)).collect()}
    for i, (a, b) in enumerate(ls):
        by = {}
        for label, c, d in rs:
            if b > a and d > c:
                by[label] = by.get(label, 0) + max(0, min(b, d) - max(a, c, 0))
        by = {k: v for k, v in by.items() if v > 0}
        want = min(by, key=lambda k: (-by[k], k)) if by else "Other"
        assert got[i] == (want, by.get(want, 0))


def test_alignment_of_endless_spans_and_many_speakers(spark):
    ls = lines(spark, [(0, 9 * 10**18, "x", None, "mic"), (5, 1000, "y", None, "mic"), (-5, 5, "z", None, "mic")])
    rs = ranges(spark, [(f"Speaker {i}", 0, 1000) for i in range(11, 1, -1)] + [("Ann", 0, 1000)])
    got = {r.pos: (r.label, r.overlap_ms) for r in t.align_speakers(ls, rs).collect()}
    assert got == {0: ("Speaker 2", 1000), 1: ("Speaker 2", 995), 2: ("Speaker 2", 5)}
    long = ranges(spark, [("Speaker 3", 0, 9 * 10**18), ("Speaker 4", 10**17, 2 * 10**17)])
    assert {r.pos: (r.label, r.overlap_ms) for r in t.align_speakers(ls, long).collect()} == {0: ("Speaker 3", 9 * 10**18), 1: ("Speaker 3", 995), 2: ("Speaker 3", 5)}
    assert {r.label for r in t.align_speakers(ls, rs.limit(0)).collect()} == {"Other"} and t.align_speakers(ls.limit(0), rs).count() == 0


def test_the_latest_delivery_counts(spark):
    rows = [("r", 1, "old", "2024-01-01 00:00:00"), ("r", 1, "new", "2024-01-02 00:00:00"), ("r", 2, "same", None), ("r", 2, "same", None), (None, 3, "x", None)]
    df = spark.createDataFrame(rows, "recording_id string, pos int, text string, at string").withColumn("logged_at", F.col("at").cast("timestamp"))
    assert sorted((r.pos, r.text) for r in t.distinct_lines(df).collect()) == [(1, "new"), (2, "same")]


def test_granularity_counts_timed_lines(spark):
    got = t.granularity(lines(spark, [(0, 10, "", "", ""), (5, None, "", "", ""), (9, 4, "", "", "")])).first()
    assert tuple(got) == (2, 5, 0, 10) and t.granularity(lines(spark, []).limit(0)).first().n == 0


def test_turns_of_aligned_lines(spark):
    four = lines(spark, [(i * 1000, i * 1000 + 1000, x, None, "mic") for i, x in enumerate(["A one.", "A two.", "B one.", "A again."])])
    rs = ranges(spark, [("Speaker 1", 0, 2000), ("Speaker 2", 2000, 3000), ("Speaker 1", 3000, 4000)])
    got = t.aligned_blocks(four, rs).orderBy("start_ms").collect()
    assert [(r.label, r.text) for r in got] == [("Speaker 1", "A one. A two."), ("Speaker 2", "B one."), ("Speaker 1", "A again.")]


def test_channel_blocks(spark):
    rows = [(0, 1, "me one", "mic", ""), (2, 3, "me two", "mic", ""), (4, 5, "you", "speaker", ""), (6, 7, "me three", None, ""), (8, 9, " ", "mic", "")]
    got = t.channel_blocks(lines(spark, rows)).orderBy("start_ms").collect()
    assert [(r.label, r.text) for r in got] == [("In", "me one me two"), ("Out", "you"), ("In", "me three")]


def test_merge_of_channels(spark):
    first = t.merge_channels(lines(spark, [(2000, 2500, "mic", None, "mic"), (1000, 1500, "spk", None, "speaker")])).orderBy("start_ms").collect()
    assert [(r.text, r.source) for r in first] == [("spk", "speaker"), ("mic", "mic")]
    rnd = random.Random(8)
    rows = [(rnd.randrange(20_000), 0, rnd.choice(["a b", "b", "c", " ", "x c"]), None, rnd.choice(["mic", "speaker"])) for _ in range(120)]
    kept = []
    for i, (s, _, x, _, ch) in sorted(enumerate(rows), key=lambda p: (p[1][0], p[1][4] == "speaker", p[0])):
        if kept and kept[-1][2].endswith(x.strip()) and abs(s - kept[-1][1]) <= 1500:
            continue
        kept.append((i, s, x.strip(), ch))
    got = sorted((r.pos, r.start_ms, r.text, r.source) for r in t.merge_channels(lines(spark, rows)).collect())
    assert got == sorted(kept)


def test_bodies(spark):
    rows = [(0, 1000, "Hello there.", "mic", ""), (2000, 3000, "Hello there. [MUSIC]", "mic", ""), (3000, 4000, "Hi.", "speaker", ""), (20_000, 21_000, "Late.", "speaker", "")]
    got = t.render_bodies(lines(spark, rows), timestamps=True).first()
    assert got.body == "[00:00:00] Hello there. Hello there.\n\n[00:00:03] Hi.\n\n[00:00:20] Late." and got.word_count == 6
    blocks = spark.createDataFrame([("r", 1, "In", 0, 61_000, "one"), ("r", 2, "Out", None, 5, "two")], "recording_id string, first int, label string, start_ms bigint, end_ms bigint, text string")
    assert t.render_speaker_bodies(blocks, "Me").first().body == "**[Me]** · 00:00–01:01\n\none\n\n---\n\n**[Out]**\n\ntwo"
    doc = spark.range(1).select(t.markdown_document(F.lit("it's"), F.lit(4500), F.lit(3), F.lit("m"), F.lit("body")).alias("d")).first().d
    assert doc == "---\ntitle: 'it''s'\nduration_seconds: 4.5\nword_count: 3\ntoken_estimate: 4\nmodel: m\n---\n\n## Transcript\n\nbody\n"


def test_empty_tables(spark):
    none = lines(spark, []).limit(0)
    for df in (t.channel_blocks(none), t.paragraphs(none), t.merge_channels(none), t.render_bodies(none), t.align_speakers(none, ranges(spark, [("a", 0, 1)]))):
        assert df.count() == 0
