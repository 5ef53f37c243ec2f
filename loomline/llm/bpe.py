"""Encoding a corpus with a public byte-level BPE tokenizer (problem 7).

Method: a bounded-lookahead streaming transducer. For every byte read so far it knows the last token of the
encoding of the text up to there; that token is the only one that ends there and is compatible with the last
token before it, where two tokens are compatible if the merge list encodes their joined bytes as just these
two. No token is longer than ``lookahead`` bytes, so whatever follows attaches to one of the last
``lookahead`` positions; tokens on which the encodings up to all of these agree are stable and are
emitted, and the bytes behind them forgotten. Text is cut into words by the tokenizer's pattern in windows,
holding back the few characters the pattern may still look at. A word that fills a window is fed while it is still open, so
memory depends neither on a text's length nor on that of its longest word.

Decoding runs the other way: token bytes go through an incremental UTF-8 state machine.

Scale: a map over documents in Arrow batches, no shuffle. The vocabulary file (under 2 MB) is read once a Python
worker; words met before come from a bounded cache.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"

#: Fixed value: the tokenizer's pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a long word can consist of but for a space before it.
RUNS = [r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*"]
#: Characters after a match on which the pattern's choice can depend (the longest contraction).
PATTERN_LOOKAHEAD = 4
WINDOW = 1 << 16
#: Longer words are fed to the transducer in steps of this many bytes.
STEP = 1 << 10
CACHE_WORDS = 200_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class MergeList:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {to_bytes(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.bytes: dict[int, bytes] = {i: b for b, i in self.ids.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (to_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        made = {to for _, to in self.ranks.values()} | {self.ids[bytes([b])] for b in range(256)}
        self.ids = {b: i for b, i in self.ids.items() if i in made}
        #: The lookahead that suffices: what follows a position can only attach to a position this close.
        self.lookahead = max(map(len, self.ids))
        ends: dict[bytes, set[int]] = {}
        for b in self.ids:
            ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.compatible = lru_cache(1 << 17)(self._compatible)
        self.reachable = lru_cache(1 << 16)(lambda t: self.merge(self.bytes[t]) == [t])

    def merge(self, data: bytes) -> list[int]:
        """The definition: apply the earliest merge in the list, leftmost first, until none applies."""
        parts = [self.ids[bytes([b])] for b in data]
        while len(parts) > 1:
            found = [(self.ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
            if not found:
                break
            rank, i = min(found)
            pair = (parts[i], parts[i + 1])
            to, out, k = self.ranks[pair][1], [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(to)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        return self.merge(self.bytes[a] + self.bytes[b]) == [a, b]


class Transducer:
    """Tokens of one word, bytes in and stable tokens out."""

    def __init__(self, merges: MergeList) -> None:
        self.m, self.data, self.last = merges, b"", []

    def feed(self, data: bytes) -> list[int]:
        """Read bytes; return the tokens that no further byte can change."""
        self._read(data)
        n, k = len(self.last), self.m.lookahead
        open_ends = set(range(max(0, n - k + 1), n + 1)) if n >= k else {0}
        while len(open_ends) > 1:  # the position where the encodings up to all open ends meet
            p = max(open_ends)
            open_ends.remove(p)
            open_ends.add(p - len(self.m.bytes[self.last[p - 1]]))
        return self._emit(open_ends.pop())

    def finish(self) -> list[int]:
        return self._emit(len(self.last))

    def _read(self, data: bytes) -> None:
        m, last, at = self.m, self.last, len(self.data)
        self.data += data
        buf, first = self.data, getattr(self, "left", None)
        for end in range(at + 1, len(buf) + 1):
            lengths = m.lengths.get(buf[end - 2 : end], ()) if end > 1 else ()
            for size in (*lengths, 1):
                start = end - size
                if start < 0 or (token := m.ids.get(buf[start:end])) is None:
                    continue
                before = last[start - 1] if start else first
                if m.reachable(token) if before is None else m.compatible(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError("the merge list gives no encoding of these bytes")

    def _emit(self, upto: int) -> list[int]:
        out, p = [], upto
        while p > 0:
            out.append(self.last[p - 1])
            p -= len(self.m.bytes[out[-1]])
        out.reverse()
        if out:
            self.left = out[-1]
        self.data, self.last = self.data[upto:], self.last[upto:]
        return out


class Encoder:
    """Ids of whole texts."""

    def __init__(self, merges: MergeList) -> None:
        self.m, self.words, self.cache = merges, regex.compile(PATTERN), {}
        self.runs = [regex.compile(r) for r in RUNS]

    def word(self, text: str) -> list[int]:
        t = Transducer(self.m)
        return self.feed(t, text) + t.finish()

    @staticmethod
    def feed(t: Transducer, text: str) -> list[int]:
        data, out = text.encode("utf-8"), []
        for i in range(0, len(data), STEP):
            out += t.feed(data[i : i + STEP]) if len(data) > STEP else (t._read(data) or [])
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids without special tokens; strings that name special tokens are ordinary text. Null and empty: no ids."""
        out: list[int] = []
        if not text:
            return out
        cache, now = self.cache, None
        for w, is_open in self.stream(text):
            if is_open or now is not None:
                now = now or Transducer(self.m)
                out += self.feed(now, w)
                if not is_open:
                    out += now.finish()
                    now = None
                continue
            ids = cache.get(w)
            if ids is None:
                ids = self.word(w)
                if len(cache) < CACHE_WORDS and len(w) < 64:
                    cache[w] = ids
            out += ids
        return out

    def stream(self, text: str) -> Iterator[tuple[str, bool]]:
        """Words of the text, read in windows; a word longer than a window comes in parts, all but the last marked open."""
        if len(text) <= WINDOW:
            yield from ((w, False) for w in self.words.findall(text))
            return
        held, at = "", 0
        while held or at < len(text):
            held, at = held + text[at : at + WINDOW], at + WINDOW
            sure, done = len(held) - PATTERN_LOOKAHEAD if at < len(text) else len(held), 0
            for found in self.words.finditer(held):
                if found.end() > sure:
                    break
                done = found.end()
                yield found.group(), False
            held = held[done:]
            if len(held) >= WINDOW and (m := self.words.match(held)).end() == len(held):
                held, at = yield from self._open_word(text, held, at)

    def _open_word(self, text: str, held: str, at: int) -> Iterator[tuple[str, bool]]:
        """The parts of a word of which ``held`` is the beginning; returns what is read beyond it, and the place in the text."""
        run = next(r for r in self.runs if r.match(held[-1]).end())
        spaces = run is self.runs[0]  # the last of several belongs to what follows, unless the text ends there
        while True:
            part = text[at : at + WINDOW]
            k, at = run.match(part).end(), at + WINDOW
            if k < len(part):
                word = held + part[:k]
                cut = len(word) - spaces
                yield word[:cut], False
                return word[cut:] + part[k:], at
            if at >= len(text):
                yield held + part, False
                return "", at
            cut = len(held) - spaces
            yield held[:cut], True
            held = held[cut:] + part


class Decoder:
    """Text of a stream of ids; bytes that are not yet a character wait for the next call."""

    def __init__(self, merges: MergeList) -> None:
        self.m, self.state = merges, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.state.decode(self.m.bytes[i]) for i in ids)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(4)
def merges_of(path: str) -> MergeList:
    return MergeList(path)


@lru_cache(4)
def encoder_of(path: str) -> Encoder:
    return Encoder(merges_of(path))


def encode_column(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: one row a row of ``df``; an empty list for null and empty text. Other columns are dropped."""
    path = os.path.join(folder, vocabulary)
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("x"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(path).encode
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = pa.array([encode(x) for x in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode_column(df: DataFrame, key: str, ids: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, text``: the text of each list of ids; empty for null and empty lists."""
    path = os.path.join(folder, vocabulary)
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{ids}`").alias("x"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch.column(1).to_pylist():
                d = Decoder(merges_of(path))
                texts.append(d.feed(x or []) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return rows.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
