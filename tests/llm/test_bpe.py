import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import bpe

PATH = os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_of(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'sdmtlvera1  é", max_size=40))
def test_any_text(text):
    from tokenizers import Tokenizer

    global _T
    if "_T" not in globals():
        _T = Tokenizer.from_file(PATH)
        _T.encode_special_tokens = True
    e = bpe.encoder_of(PATH)
    ids = e.encode(text)
    assert ids == _T.encode(text, add_special_tokens=False).ids
    d = bpe.Decoder(e.m)
    assert "".join(d.feed([i]) for i in ids) + d.finish() == text


@pytest.mark.parametrize("text", ["", "<|endoftext|> is text", "a" * 5000, " " * 3000 + "x", "abcabcab" * 3000, "don't we'll " * 12_000, "日本語テキスト👍🏽" * 300])
def test_long_and_special(encoder, library, text):
    assert encoder.encode(text) == library(text)


def test_windows_do_not_show(encoder, monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["it's ", "  ", "\n\n", "word", "12 ", "…", "'ll ", "é"]) for _ in range(2000))
    want = encoder.encode(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(bpe, "WINDOW", size)
        assert encoder.encode(text) == want


def test_memory_is_bounded_and_tokens_stable(encoder):
    rnd = random.Random(4)
    data = bytes(rnd.choice(b"etaoinshr") for _ in range(20_000))
    t, out, most = bpe.Transducer(encoder.m), [], 0
    for i in range(0, len(data), 100):
        out += t.feed(data[i : i + 100])
        most = max(most, len(t.last))
    assert out + t.finish() == encoder.word(data.decode()) and most < 4 * encoder.m.lookahead
    assert encoder.word(data[:400].decode()) == encoder.m.merge(data[:400])


@pytest.mark.parametrize("word", ["ab", "é", "1", "!?", " ", "\n \t", "'", "'re"])
def test_words_longer_than_windows(encoder, library, monkeypatch, word):
    monkeypatch.setattr(bpe, "WINDOW", 16)
    for text in (word * 100, f"x {word * 60}y", f"{word * 60} 'll 7", f" {word * 33}\n\nz", f"{word * 60}!"):
        assert encoder.encode(text) == library(text), text
        assert "".join(w for w, _ in encoder.stream(text)) == text and max(len(w) for w, _ in encoder.stream(text)) <= 40


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, None)], "doc_id bigint, text string, ids string")
    got = bpe.encode_column(df, "doc_id", "text")
    assert {r.doc_id: len(r.ids) for r in got.collect()} == {1: 2, 2: 0, 3: 0}
    assert {r.doc_id: r.text for r in bpe.decode_column(got, "doc_id", "ids").collect()} == {1: "hello world", 2: "", 3: ""}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
