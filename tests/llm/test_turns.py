import random

import pytest

from loomline.llm.turns import Extractor, Labels, TokenTree, label_lines, mine_layouts, path, turns, unit

NAMES = ["Ann Bell", "Bo Cole-Dorn", "Cy Dane"]
LINES = "recording_id string, pos int, start_ms bigint, end_ms bigint, text string, source string, speaker string, prev string"


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def test_labels_in_any_spelling():
    read = Labels(NAMES).read
    for who in ("Ann Bell", "ANN BELL", "ann-bell", "ann.bell", "Bell, Ann", " Ann  Bell ", "Ann Bell:", "Ann Bell (host)", "A. Bell", "Ann B.", "Ann", "Mr Bell"):
        assert read(who.strip()) == "Ann Bell", who
    for who in ("Speaker 2", "SPEAKER_02", "spk2", "S2", "Speaker #2", "speaker-2:", "Speaker two", "Speaker 2 (guest)"):
        assert read(who) == "Speaker 2", who
    assert [read(x) for x in ("IN", "out", "Other ", "In short", "nobody")] == ["In", "Out", "Other", None, None]


def test_units():
    assert unit(" [00:01:02] x") == ("[00:01:02]", " x")
    assert unit(">> Speaker 1: hi")[0] == ">> Speaker 1:" and unit("00:00:01.250 --> hi")[0] == "00:00:01.250 -->"
    assert unit("one\ntwo: yes") is None and unit("") is None and unit("a" * 5000) is None and unit("-- : !") is None


def test_paths_depend_on_the_unit_alone():
    parts = Labels(NAMES).parts
    assert path("[00:01:02]", parts) == ("[0:0:0]", "", "") and path("00:00:01.250 -->", parts) == ("0:0:0.0->", "", "")
    assert path("Ann Bell:", parts) == path("bell, ann:", parts) == ("w:", "<name>", "<name>") and path("In short:", parts) == ("w:", "in", "short")
    tree = TokenTree()
    for w in ("one", "two", "three"):
        tree.add(path(f"Speaker {w}:", parts), False, True)
    assert tree.nodes[("w:",)] == tree.nodes[("w:", "speaker")] == [3, 0, 3] and tree.nodes[("w:", "speaker", "two")] == [1, 0, 1]


@pytest.mark.parametrize("text", ["- " * 60_000, "[a] " * 20_000, "x " * 60_000 + ":", "(" * 60_000, "*" * 60_001, "[" * 60_000 + "a] b", "é: " * 20_000, "1:00 " * 30_000])
def test_hostile_lines_end(text):
    label, clean = Extractor({}, Labels(NAMES)).line(text, 0)
    assert label is None and len(clean) <= len(text)


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    clock = lambda ms: f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}"
    rows, truth, t = [], [], 0
    for i in range(n):
        t += rnd.choice([1000, 4000, 70_000])
        who = rnd.choice(["Speaker 1", "Speaker 2", "Ann Bell"])
        said = rnd.choice(["we saw the plan", "that is fine", "", "um", "In short: fewer lines"])
        mark = rnd.choice(["", f"[{clock(t)}] ", f"({t // 60_000:02}:{t // 1000 % 60:02}) "])
        own, head = (who, "") if rnd.random() < 0.5 else (rnd.choice([None, " "]), f"{who}: ")
        rows.append(("r", i, t, t + 500, f"{mark}{head}{rnd.choice(['', '[MUSIC] ', 'uh, '])}{said}", "mic", own, "x"))
        truth.append((t, i, who if own or head else "In", said if said != "um" else ""))
    return rows, truth


def test_turns_against_brute_force(spark, names):
    rows, truth = corpus()
    want, last = [], None
    for t, i, who, said in truth:
        if not said:
            continue
        if last is None or last[1] != who or t - last[0] > 60_000:
            want.append([t, who, said])
        else:
            want[-1][2] += " " + said
        last = (t, who)
    df = spark.createDataFrame(rows + rows[:60], LINES).repartition(3)
    got = sorted((r.start_ms, r.speaker, r.text) for r in turns(df, names).collect())
    assert got == [tuple(x) for x in want]


def test_roles_are_inferred(spark, names):
    rows, _ = corpus()
    labels = Labels(NAMES)
    roles = mine_layouts(spark.createDataFrame(rows, LINES), labels)
    assert roles[("[0:0:0]",)] == "time" and roles[("(0:0)",)] == "time"
    assert roles[("w:", "speaker")] == "speaker" and roles[("w:", "in", "short")] is None
    ex = Extractor(roles, labels)
    assert ex.line("[00:00:01] (laughs) Speaker 2: Hm, fine") == ("Speaker 2", "fine")
    assert ex.line("In short: fine")[0] is None and ex.line("♪ mm-hmm ...")[1] == ""
    assert ex.clean("dass er kommt und geht") == "dass er kommt und geht"


def test_no_layout_is_too_long_or_too_rare(spark):
    """A four-word name, a long annotation, five units at one head, and 10,000 layouts, in one partition and in many."""
    names = spark.createDataFrame([("Ana Maria Garcia Lopez",), ("Bo Cole",)], "name string")
    clock = lambda ms: f"[00:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}]"
    marks = "!#$%&/=?^~+;"
    rows = []
    for i in range(10_000):
        t = i * 7_000
        odd = "".join(marks[i // 12**k % 12] for k in range(4))
        head = ["Ana Maria Garcia Lopez: ", f"[{'people talk ' * 8}] ", f"{clock(t % 3_600_000)} [MUSIC] (laughs) {{static}} Bo Cole: ", f"{odd} word: "][i % 4]
        rows.append(("r", i, t % 3_600_000 if i % 4 == 2 else t, t + 1, head + "hello there", "mic", None, ""))
    df = spark.createDataFrame(rows, LINES)
    one, many = (sorted(tuple(r) for r in label_lines(df.repartition(n, "pos"), names).select("pos", "speaker", "text").collect()) for n in (1, 9))
    assert one == many
    assert [(r[1], r[2]) for r in one[:3]] == [("Ana Maria Garcia Lopez", "hello there"), ("In", "hello there"), ("Bo Cole", "hello there")]
    assert all(r[2].endswith("word: hello there") for r in one[3::4]) and {r[1] for r in one[2::4]} == {"Bo Cole"}


def test_nulls_ties_and_empty(spark, names):
    rows = [(None, 1, 0, 1, "a", None, None, ""), ("r", None, 5, 6, "null place", None, None, ""), ("r", 2, None, 1, "c", None, None, ""), ("r", 3, 7, None, None, None, None, ""), ("r", 5, 9, None, "b", "speaker", "", ""), ("r", 4, 9, 3, "z" * 100_000, "speaker", None, "")]
    df = spark.createDataFrame(rows, LINES)
    assert [(r.pos, r.speaker) for r in label_lines(df, names).orderBy("start_ms", "pos").collect()] == [(-1, "In"), (4, "Out"), (5, "Out")]
    got = turns(df, names).orderBy("start_ms").collect()
    assert [(r.start_ms, r.speaker, r.n_lines) for r in got] == [(5, "In", 1), (9, "Out", 2)] and got[1].text.endswith("z b")
    assert turns(df.limit(0), names.limit(0)).count() == 0
