import pytest
from pyspark.sql import functions as F

from loomline.functions import score, signal, text


def values(spark, rows, expr, ddl="x string"):
    df = spark.createDataFrame([(r,) for r in rows], ddl)
    return [r.y for r in df.select(expr(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (text.cleanup_text, {"#cakenewline": "#cake newline", "[MUSIC] welcome back [APPLAUSE]": "welcome back", "see [note] below": "see [note] below", "a  b ": "a b", "": "", None: None}),
        (text.dedup_exact_halves, {"hello hello": "hello", "café café": "café", "ab": "ab", "": "", None: None}),
        (lambda c: text.dedup_consecutive_phrases(c), {"hello world. world next": "hello world. next", "Hello hello world": "Hello world", "eat some food eat some food": "eat some food", "x": "x", "": "", None: None}),
        (text.slugify_name, {"Ben Mizrany": "ben-mizrany", "  Émile!  ": "mile", "---": ""}),
        (text.reserved_label, {"Other": True, "You": True, "In": True, "Out": True, "Speaker 1": True, "Speaker 10": True, "other": False, "speaker 1": False, "Speaker 0": False, "Speaker 01": False}),
        (text.short_title, {"one two, three": "one two, three", "a b c d e f g h, i": "a b c d e f g h", "...": "Dictation", "": "Dictation"}),
        (text.snippet, {"a " * 300: ("a " * 140)[:279] + "…", "short\n text": "short text"}),
        (text.normalize_tag, {" To Do ": "to-do", "ÄB": "Äb"}),
        (text.html_text, {"<p>a<br>b</p>": "a b"}),
        (text.kind_label, {"dictate": "Dictate", "transcribe": "Upload", "written": "Written", "scribe": "Scribe"}),
        (text.model_label, {"/m/ggml-base.en.bin": "base.en"}),
        (text.transcript_section, {"# T\n\n## Transcript\n\nhi\n\n## Notes\nx": "hi", " only ": "only"}),
        (lambda c: text.front_matter_field(c, "title"), {"---\ntitle: 'a b'\nmodel: x\n---\nbody": "a b", "title: no": None, "---\ntitle:\n---\n": None}),
        (text.is_silence_phrase, {"Thank you.": True, " [ Music ] ": True, "Transcribed by x": True, "thank you. all": False, "": True}),
        (text.html_safe, {"**a** <script>x</script>[l](javascript:y)": '<p><strong>a</strong> <a rel="noopener noreferrer">l</a></p>\n', "# T\n\n- a\n- b": "<h1>T</h1>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n", None: None}),
    ],
)
def test_text(spark, f, cases):
    assert values(spark, list(cases), f) == list(cases.values())


def test_repeated_block(spark):
    block = "The quick brown fox jumps over the lazy dog and runs away from all of it today. "
    assert values(spark, [block + block, block], text.dedup_repeated_block) == [block.strip(), block]


def test_terms(spark):
    (terms, short) = values(spark, ["The onboarding designs are designing a better onboarding flow", "cat cat dog"], text.extract_terms)
    assert "onboard" in terms and "the" not in terms and terms == sorted(set(terms)) and short == ["cat"]


def test_times(spark):
    assert values(spark, [3_661_000, -5, 400_000_000], text.format_hms, "x bigint") == ["01:01:01", "00:00:00", "111:06:40"]
    assert values(spark, [3_661_000, None], text.format_ms, "x bigint") == ["61:01", None]
    assert values(spark, [3725, 185, 5, 0, None], text.duration_text, "x bigint") == ["1h 2m", "3m 5s", "5s", "0s", "0s"]
    older, newer = (values(spark, [v], text.version_key)[0] for v in ("v1.9.3-beta", "1.10"))
    assert tuple(older) < tuple(newer) == (1, 10, 0)
    assert text.parse_days("90d") == 90


def test_scores(spark):
    new, old, bad = values(spark, ["2026-07-10T00:00:00Z", "2026-01-10T00:00:00Z", "soon"], lambda c: score.recency(c, "2026-07-11T00:00:00Z"))
    assert new > old > bad == 0
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in rows.select(score.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0, 0, 0]


def test_signal(spark):
    import math

    sine = [math.sin(i / 8) for i in range(16_000)]
    rms, none = values(spark, [sine, []], signal.rms, "x array<double>")
    assert abs(rms - 1 / math.sqrt(2)) < 0.01 and none == 0
    assert values(spark, [[0.0, 1.0, 2.0, 3.0]], lambda c: signal.resample(c, 2, 4), "x array<double>") == [[0, 0.5, 1, 1.5, 2, 2.5, 3, 3]]
    assert values(spark, [[1.0, -1.0, 2.0, 0.5]], signal.quantise, "x array<double>") == [[32767, -32767, 32767, 16383]]
    assert values(spark, [[1.0, 3.0, 5.0, 7.0, 9.0]], lambda c: signal.mix_down(c, 2), "x array<double>") == [[2, 6]]
    d = values(spark, [[float("nan"), float("inf"), 0.5]], signal.diagnostics, "x array<double>")[0]
    assert (d.n, d.nan, d.inf, d.peak, d.rms) == (3, 1, 1, 0.5, 0.5)
