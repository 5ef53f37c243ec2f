import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm.splitting import boundaries, level, merge_atoms, split, split_items, word_spans


def check(text, limit, overlap, a=0, b=10_000):
    words = [text[i:j] for i, j in word_spans(text)]
    built, last = [], -1
    for n, p in enumerate(split(text, a, b, limit, overlap)):
        own = [p["text"][i:j] for i, j in word_spans(p["text"])]
        assert p["piece_no"] == n and len(own) == p["n_words"] <= max(limit, len(own) if len(words) <= limit else 0)
        lap = p["overlap_words"]
        assert own[:lap] == built[len(built) - lap :] and (n == 0 or lap == min(overlap, len(built)))
        assert a <= p["start_ms"] <= p["end_ms"] <= b and p["start_ms"] >= last
        last, built = p["start_ms"], built + own[lap:]
    assert built == words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from([". ", "! ", " ", "\n\n", "\r\n \r\n", "\n", " ", ".\n\n"])), max_size=12), st.integers(5, 30), st.integers(0, 4))
def test_any_text(parts, limit, overlap):
    check("".join(" ".join(["w"] * n) + end for n, end in parts), limit, overlap)


def brute(strength, limit, overlap):
    """Merge from single words by looking at all pairs each time."""
    pieces = [(i, i + 1) for i in range(len(strength))]
    while True:
        fit = [(strength[b - 1], d - a, i) for i, ((a, b), (_, d)) in enumerate(zip(pieces, pieces[1:])) if d - a + min(overlap, a) <= limit]
        if not fit:
            return pieces
        i = min(fit)[2]
        pieces[i : i + 2] = [(pieces[i][0], pieces[i + 1][1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([1, 1, 1, 1, 2, 3]), min_size=1, max_size=70), st.integers(6, 30), st.integers(0, 3))
def test_heap_against_all_pairs(strength, limit, overlap):
    strength[-1] = 3
    assert merge_atoms(strength, limit, overlap) == brute(strength, limit, overlap)


def test_boundaries():
    t = "One two. Three\nfour\n \nfive? six"
    assert boundaries(t, word_spans(t)) == [1, 2, 1, 3, 2, 3]
    for sep, want in (("\n\n", "paragraph"), (". ", "sentence"), (" ", "word")):
        assert split(sep.join(["w " * 9 + "w"] * 4), 0, 1, 10, 2)[0]["boundary"] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([1, 1, 1, 1, 2, 3]), min_size=1, max_size=70), st.integers(3, 30))
def test_level_is_the_coarsest_that_fits(strength, limit):
    strength[-1] = 3

    def longest(least):
        most = run = 0
        for s in strength:
            run += 1
            most = max(most, run)
            run = 0 if s >= least else run
        return most

    assert level(strength, limit) == next((n for v, n in ((3, "paragraph"), (2, "sentence")) if longest(v) <= limit), "word")


def test_each_cut_says_what_it_is():
    pieces = split("\n\n".join(["w " * 599 + "w"] * 2), 0, 1)
    assert [p["boundary"] for p in pieces] == ["paragraph", "word", "end"] and {p["level"] for p in pieces} == {"paragraph"}
    assert pieces[0]["n_words"] == 600 and sum(p["n_words"] - p["overlap_words"] for p in pieces) == 1200


def test_defined_cases(spark):
    rows = [("a", None, 0, 1, "x"), ("b", "", 0, 1, "x"), ("c", "w " * 50, None, 5, "x"), ("d", "w " * 50, 9, 5, "x"), ("e", "w", 3, 3, "x")]
    df = spark.createDataFrame(rows, "id string, text string, start_ms bigint, end_ms bigint, boundary string")
    got = split_items(df, limit=20, overlap=5).collect()
    assert {r.id for r in got} == {"b", "c", "d", "e"} and all(r.start_ms is None for r in got if r.id in "cd")
    assert {r.id for r in split_items(df, limit=20, overlap=5, only_oversized=True).collect()} == {"c", "d"}
    assert split_items(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_items(df, limit=5, overlap=5)
    check("w " * 20_000, 620, 40)
