"""Cutting items over a size limit at natural boundaries, with overlap (problem 6).

Method: agglomerative merging. An item starts as atomic segments; every pair of neighbours sits in a heap
under the strength of the boundary between them, and the weakest boundary is merged first while the
combined size plus the overlap fits. What remains uncut is what no merge could remove, so cuts fall at
paragraphs where possible, else at sentences, else at words. Merged without overlap, the weakest cut that is left
tells at which boundaries the item can be cut at all.

Scale: items are independent; a native length filter keeps small items out of Python, and only the four columns
in use are shipped. Nothing is grouped, so a note with many chunks costs no more than others.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_WORDS = 620
OVERLAP_WORDS = 40

#: Unicode White_Space, spelt out because Python's \s also takes the four information separators.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[^{WHITE}]+")
_LINE_END = "(?>\\r\\n|[\\n\\r\\x85\\u2028\\u2029])"
_BLANK_LINE = re.compile(f"{_LINE_END}[{WHITE}]*?{_LINE_END}")
_SENTENCE_END = re.compile(r"[.?!]\Z")
WORD, SENTENCE, PARAGRAPH = 1, 2, 3
NAMES = {WORD: "word", SENTENCE: "sentence", PARAGRAPH: "paragraph"}


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def boundaries(text: str, words: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary after each word."""
    strength = [SENTENCE if _SENTENCE_END.search(text, e - 1, e) else WORD for _, e in words]
    i = 0
    for m in _BLANK_LINE.finditer(text):
        while i < len(words) and words[i][1] <= m.start():
            i += 1
        if i:
            strength[i - 1] = PARAGRAPH
    if words:
        strength[-1] = PARAGRAPH
    return strength


def merge_atoms(strength: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges (first, past last) of the pieces without overlap."""
    net = limit - overlap
    ends, first = [], 0
    for i, s in enumerate(strength):  # atoms: sentences that fit, which no word boundary survives, and words of the others
        if s >= SENTENCE or i + 1 == len(strength):
            ends += [i + 1] if i + 1 - first <= net else range(first + 1, i + 2)
            first = i + 1
    starts = [0, *ends[:-1]]
    n = len(ends)
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(strength[ends[i] - 1], ends[i + 1] - starts[i], i, ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or ends[j] != end or ends[j] - starts[i] != size:
            continue  # one of the two has grown since
        if size + min(overlap, starts[i]) > limit:
            continue
        ends[i], after[i], alive[j] = ends[j], after[j], False
        if after[i] >= 0:
            before[after[i]] = i
            heapq.heappush(heap, (strength[ends[i] - 1], ends[after[i]] - starts[i], i, ends[after[i]]))
        if (h := before[i]) >= 0:
            heapq.heappush(heap, (strength[ends[h] - 1], ends[i] - starts[h], h, ends[i]))
    return [(starts[i], ends[i]) for i in range(n) if alive[i]] or [(0, 0)]


def level(strength: list[int], limit: int) -> str:
    """The coarsest boundary at which the item can be cut to ``limit``: the weakest cut that merging without overlap leaves."""
    cuts = [strength[b - 1] for _, b in merge_atoms(strength, limit, 0)[:-1]]
    return NAMES[min(cuts, default=PARAGRAPH)]


def split(text: str, start_ms: int | None, end_ms: int | None, limit: int = LIMIT_WORDS, overlap: int = OVERLAP_WORDS) -> list[dict]:
    """Pieces of one item; an item within the limit is its own only piece."""
    words = word_spans(text)
    if len(words) <= limit:
        return [{"piece_no": 0, "boundary": "whole", "level": "whole", "n_words": len(words), "overlap_words": 0, "start_ms": start_ms, "end_ms": end_ms, "text": text}]
    strength = boundaries(text, words)
    own = level(strength, limit)
    timed = start_ms is not None and end_ms is not None and end_ms >= start_ms
    at = lambda w: start_ms + (end_ms - start_ms) * w // len(words) if timed else None
    out = []
    for no, (a, b) in enumerate(merge_atoms(strength, limit, overlap)):
        lap = min(overlap, a)
        left = words[a - lap][0] if a else 0
        right = words[b - 1][1] if b < len(words) else len(text)
        out.append({"piece_no": no, "boundary": NAMES[strength[b - 1]] if b < len(words) else "end", "level": own, "n_words": b - a + lap, "overlap_words": lap, "start_ms": at(a - lap), "end_ms": at(b), "text": text[left:right]})
    return out


PIECES = "{key} string, piece_no int, boundary string, level string, n_words int, overlap_words int, start_ms long, end_ms long, text string"
_FIELDS = ["piece_no", "boundary", "level", "n_words", "overlap_words", "start_ms", "end_ms", "text"]
_TYPES = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]


def split_items(items: DataFrame, key: str = "id", limit: int = LIMIT_WORDS, overlap: int = OVERLAP_WORDS, only_oversized: bool = False) -> DataFrame:
    """Pieces of every item: ``key, piece_no, boundary, level, n_words, overlap_words, start_ms, end_ms, text``.

    No piece has more than ``limit`` words; each but the first repeats the last ``overlap`` words before it.
    ``boundary`` is what the piece ends at: paragraph, sentence or word, ``end`` for the last one. ``level`` is the coarsest
    of the three at which no stretch of the item exceeds the limit. Both are ``whole`` for items within it. Times are interpolated by words between those of the item.
    Defined cases: null text gives no piece; empty text is one empty piece; where a time is missing or the two are
    reversed, the pieces of a cut item have null times; repeats of an item give repeated pieces; other columns are dropped.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    rows = items.select(F.col(f"`{key}`").cast("string").alias("k"), F.col("text").alias("x"), F.col("start_ms").cast("long").alias("a"), F.col("end_ms").cast("long").alias("b")).filter("x IS NOT NULL")
    if only_oversized:
        rows = rows.filter(F.length("x") > 2 * limit)  # limit + 1 words take 2 * limit + 1 characters at least

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cols = [], {f: [] for f in _FIELDS}
            for k, x, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = split(x, a, b, limit, overlap)
                if only_oversized and pieces[0]["boundary"] == "whole":
                    continue
                keys += [k] * len(pieces)
                for f in _FIELDS:
                    cols[f] += [p[f] for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(cols[f], t) for f, t in zip(_FIELDS, _TYPES))], names=["k", *_FIELDS])

    return rows.mapInArrow(run, PIECES.format(key="k")).withColumnRenamed("k", key)
