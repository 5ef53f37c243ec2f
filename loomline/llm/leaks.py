"""Evaluation passages inside training documents (problem 8).

Method: greedy string tiling. Token n-grams shared by a document and an item are the seeds that join the two.
For each pair whose seeds could cover enough of the passage, the longest common runs of tokens not yet marked
are found with running Karp-Rabin hashes, from long to short, and marked as tiles, so no token is counted twice
and passages in another order or in pieces still count. Tiles' share of the passage decides.

Words that many passages share say nothing about which item leaked, so a word counts by one over the number of passages
that have it, and tiles must also hold enough of that weight, or long enough runs of words that only this passage has.

Scale: one map over the documents. The items' n-gram index is built once, on the driver, as sorted arrays; a worker
reads it once. Items come in blocks of bounded size; where there are several, the documents are split into words once,
written, and each block is held against the stored words. Only seeds near each other are tiled, so a document costs its
length plus its shared parts.
"""

from __future__ import annotations

import re
import statistics
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import checkpointed

#: Share of a passage that must be found, and the shortest tile.
SHARE, MIN_TILE = 1 / 3, 3
#: Leading sentences after which items go on in this many ways, at greater length, are an instruction.
WAYS = 3
#: Tokens of a block of items shipped to the workers at once; three word numbers of a block fit a long.
BLOCK_TOKENS = 2_000_000
MAX_TOKENS = 20_000_000
#: Part of the share that a passage's weight of own words must reach, or the share itself in tiles with runs of so many words that only it has.
OWN_SHARE, OWN_RUN = 0.4, 8
#: Words the two sides of a bridged change may differ by.
BRIDGE = 2

_MARKS = re.compile(r"\[[\d:.,]+\]|\(\d+:\d\d\)|<\d+\.\d+>|(?<!\d)\d+:\d\d:\d\d(?:\.\d+)?(?:\s*-->|\s+-)?|\*\*[^*\n]{1,40}\*\*\s*·\s*[\d:]+|(?:>>\s*)?\b(?:speaker|spk)[ _#]?(?:\d+|one|two|three|four|five|six)\b\s*[:\]\)-]|^[A-Z]\d?:", re.I | re.M)
_HUM = re.compile(r"(?:u+[hm]+|e+r+m*|[äa]+h+m*|e+u*h+m*|h+m+|m{2,}|m+h+m+)\Z")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n\s*\n")


def tokens(text: str) -> list[str]:
    """Words without case, accents, marks and hesitations."""
    text = _MARKS.sub(" ", _HIDDEN.sub("", text))
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text))
    return [w for w in _WORD.findall(text.casefold()) if w[0] not in "uerhmäa" or not _HUM.match(w)]


def passages(items: list[tuple[int, str]]) -> dict[int, list[str]]:
    """Tokens of each item's own passage, without an instruction before it.

    Leading sentences are an instruction if items that share them go on in at least ``WAYS`` different ways and mostly
    at greater length. A passage with several questions goes on in several ways, too, but the questions are shorter.
    """
    split = {i: [w for s in _SENTENCE.split(_HIDDEN.sub("", t)) if (w := tokens(s))] for i, t in items}
    places: dict[tuple[int, str], int] = {}
    ways: dict[int, set[str]] = defaultdict(set)
    rest: dict[int, list[int]] = defaultdict(list)

    def prefixes(ss: list[list[str]]) -> Iterator[tuple[int, int, int]]:
        """Number of sentences so far, words in them, and the place of that beginning among all."""
        place = words = 0
        for k, s in enumerate(ss[:-1], 1):
            place = places.setdefault((place, " ".join(s)), len(places) + 1)
            words += len(s)
            yield k, words, place

    for ss in {tuple(map(tuple, ss)): ss for ss in split.values()}.values():
        total = sum(map(len, ss))
        for k, words, place in prefixes(ss):
            ways[place].add(" ".join(ss[k]))
            rest[place].append(total - words)
    out = {}
    for i, ss in split.items():
        told = [k for k, words, place in prefixes(ss) if len(ways[place]) >= WAYS and statistics.median(rest[place]) >= words]
        out[i] = [w for s in ss[max(told, default=0) :] for w in s]
    return {i: p for i, p in out.items() if p}


def telling(items: dict[int, list[str]]) -> dict[int, tuple[list[float], list[bool]]]:
    """What tells each passage from the others: the weight of each word, and the starts of runs of ``OWN_RUN`` words that only it has."""
    run_of = lambda p: [tuple(p[i : i + OWN_RUN]) for i in range(len(p) - OWN_RUN + 1)]
    different = {tuple(p) for p in items.values()}
    df = Counter(w for p in different for w in set(p))
    runs = Counter(g for p in different for g in set(run_of(p)))
    return {i: ([1 / df[w] for w in p], [runs[g] == 1 for g in run_of(p)]) for i, p in items.items()}


class Index:
    """A block of items: their words by number, and where each n-gram stands, in sorted arrays."""

    def __init__(self, block: dict[int, list[str]], own: dict[int, tuple[list[float], list[bool]]] | None = None, n: int = MIN_TILE) -> None:
        self.n, self.keys = n, list(block)
        own = telling(block) if own is None else own
        self.number: dict[str, int] = {}
        self.passages = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in p]) for p in block.values()]
        self.base = len(self.number) + 1
        self.weight = [np.array(own[i][0]) for i in block]
        self.alone = [np.array(own[i][1], bool) for i in block]
        codes = [self.codes(p) for p in self.passages]
        code = np.concatenate([np.zeros(0, np.int64), *codes])
        order = np.argsort(code, kind="stable")
        self.grams, self.first = np.unique(code[order], return_index=True)
        self.last = np.append(self.first[1:], len(code))
        self.item = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])[order]
        self.place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(c), dtype=np.int32) for c in codes)])[order]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each n-gram; -1 where a word of it is in no passage."""
        if len(ids) < self.n:
            return np.zeros(0, np.int64)
        out, known = np.zeros(len(ids) - self.n + 1, np.int64), np.ones(len(ids) - self.n + 1, bool)
        for k in range(self.n):
            part = ids[k : k + len(out)]
            out = out * self.base + part
            known &= part > 0
        return np.where(known, out, -1)

    def find(self, words: list[str], share: float = SHARE) -> dict[int, tuple[int, int]]:
        """For each item that reaches the share: tokens tiled, tokens of the passage."""
        n, number = self.n, self.number
        ids = np.fromiter((number.get(w, 0) for w in words), np.int64, len(words))
        code = self.codes(ids)
        if not len(self.grams) or not len(code):
            return {}
        slot = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        at = np.flatnonzero(self.grams[slot] == code)
        if not len(at):
            return {}
        slot = slot[at]
        many = self.last[slot] - self.first[slot]
        flat = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item, place, at = self.item[flat], self.place[flat], np.repeat(at, many)
        order = np.argsort(item, kind="stable")
        item, place, at = item[order], place[order], at[order]
        out = {}
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(item))):
            i = item[a]
            passage = self.passages[i]
            need = share * len(passage)
            if (b - a) * n < need * 0.6:
                continue
            reach = np.zeros(len(passage) + n, bool)
            for k in range(n):
                reach[place[a:b] + k] = True
            if reach.sum() < need * 0.6:  # bridged words can add to what seeds reach
                continue
            tiled, tiles = covered(ids, passage, at[a:b], n)
            if tiled < need:
                continue
            weight, alone = self.weight[i], self.alone[i]
            own = sum(weight[j : j + k].sum() for j, k in tiles)
            long = sum(k for j, k in tiles if k >= OWN_RUN and alone[j : j + k - OWN_RUN + 1].any())
            if own >= OWN_SHARE * share * weight.sum() or long >= need:
                out[self.keys[i]] = (int(tiled), len(passage))
        return out


_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tile(doc: list, passage: list, n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in doc, place in passage, length), longest first. Zeros in ``doc`` are gaps no tile can cross."""
    code: dict = {}
    d = [code.setdefault(w, len(code) + 1) for w in doc]
    p = [code.setdefault(w, len(code) + 1) for w in passage]
    d_free, p_free, tiles = [w != 0 for w in doc], [True] * len(p), []

    def windows(xs: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
        top, h, run = pow(_BASE, size - 1, _MOD), 0, 0
        for i, x in enumerate(xs):
            if not free[i]:
                h = run = 0
                continue
            if run >= size:
                h -= xs[i - size] * top
            h = (h * _BASE + x) % _MOD
            run += 1
            if run >= size:
                yield i - size + 1, h

    size = min(len(p), 32)
    while size >= n:
        table: dict[int, list[int]] = {}
        for i, h in windows(p, p_free, size):
            table.setdefault(h, []).append(i)
        found, longer = [], 0
        for i, h in windows(d, d_free, size):
            for j in table.get(h, ()):
                k = 0
                while i + k < len(d) and j + k < len(p) and d[i + k] == p[j + k] and d_free[i + k] and p_free[j + k]:
                    k += 1
                if k >= size:
                    found.append((k, i, j))
                    longer = max(longer, k)
        if longer > 2 * size:
            size = longer
            continue
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if all(d_free[i : i + k]) and all(p_free[j : j + k]):
                d_free[i : i + k] = [False] * k
                p_free[j : j + k] = [False] * k
                tiles.append((i, j, k))
        size = size // 2 if size > 2 * n else size - 1
    return tiles


def covered(ids: np.ndarray, passage: np.ndarray, at: np.ndarray, n: int) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of the passage in tiles, with single changed words between two tiles of one run; and the tiles (place, length). ``at``: places of seeds in ``ids``."""
    places = np.unique(at[:, None] + np.arange(n))
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    where = np.insert(places, gaps, -1)
    doc = np.where(where < 0, 0, ids[where])
    tiles = sorted((j, int(where[i]), k) for i, j, k in tile(doc.tolist(), passage.tolist(), n))
    total = sum(k for _, _, k in tiles)
    for (j, i, k), (j2, i2, _) in zip(tiles, tiles[1:]):
        gap, other = j2 - (j + k), i2 - (i + k)
        if 0 < gap <= BRIDGE and 0 <= other <= BRIDGE + 1:
            total += gap
    return total, [(j, k) for j, _, k in tiles]


def read_items(items: DataFrame, key: str, text: str) -> dict[int, list[str]]:
    """The passages; evaluation sets beyond ``MAX_TOKENS`` words are refused rather than cut."""
    out, size = [], 0
    for r in items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("x")).dropna().distinct().toLocalIterator():
        size += len(r.x) // 5
        if size > MAX_TOKENS:
            raise ValueError(f"the evaluation items have more than {MAX_TOKENS} words")
        out.append((r.k, r.x))
    return passages(sorted(out))


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_key, item_key, tiled, size``: each document with each item of whose passage it carries at least ``share``.

    ``tiled`` of the passage's ``size`` words were found. Defined cases: null and empty texts carry nothing and leak
    nothing; passages shorter than ``MIN_TILE`` words can't be found; an empty table on either side gives no rows;
    repeated documents give repeated rows; other columns are dropped.
    """
    spark = docs.sparkSession
    own = read_items(items, item_key, text)
    signs = telling(own)
    blocks, size = [{}], 0
    for i, p in own.items():
        if size + len(p) > BLOCK_TOKENS and blocks[-1]:
            blocks.append({})
            size = 0
        blocks[-1][i] = p
        size += len(p)
    rows = docs.select(F.col(f"`{doc_key}`").alias("d"), F.col(f"`{text}`").alias("x")).filter("x IS NOT NULL AND x <> ''")
    d_type, i_type = rows.schema["d"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()

    stored = len(blocks) > 1
    if stored:
        rows = checkpointed(split_words(rows, f"d {d_type}, x array<string>"), "words")

    def scan(block: dict[int, list[str]]) -> DataFrame:
        shipped = spark.sparkContext.broadcast(Index(block, signs))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                ds, out = batch.column(0), []
                for n, x in enumerate(batch.column(1).to_pylist()):
                    out += [(n, i, *found) for i, found in index.find(x if stored else tokens(x), share).items()]
                if out:
                    at, i, tiled, total = zip(*out)
                    ids = pa.array(i, pa.int64()) if i_type == "bigint" else pa.array(i)
                    yield pa.RecordBatch.from_arrays([ds.take(pa.array(at)), ids, pa.array(tiled, pa.int32()), pa.array(total, pa.int32())], names=["d", "i", "tiled", "size"])

        return rows.mapInArrow(run, f"d {d_type}, i {i_type}, tiled int, size int")

    found = scan(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(scan(block))
    return found.select(F.col("d").alias(doc_key), F.col("i").alias(item_key), "tiled", "size")


def split_words(rows: DataFrame, schema: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens(x) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["d", "x"])

    return rows.mapInArrow(run, schema)
