"""Subject areas of documents (problem 9).

Method: the document-term matrix X is factored as W H with non-negative alternating updates, until a pass moves the
anchored part of H by less than ``TOLERANCE``. One component a subject is anchored: it starts from the terms by which hand-labelled documents
and the subject's description stand out against the corpus, and the seed is mixed in again after every update with
the weight ``ANCHOR``. A few free components start from the corpus mean and take up what all documents share. A sentence's
row of W over the fixed H is its mixture; the anchored components are subjects, so the shares of a document's
sentences are read off directly.

Scale: terms are hashed into ``WIDE`` buckets, and H has a column for each bucket that enough documents have, so its width
follows the vocabulary up to a fixed size; H is all that is shipped. X is written once, sparse, to the shared folder, the
counts of a document beside its sentences, so that passes read counts only. A pass computes W row by row and sums the two
small products the update of H needs, first within tasks, then in a shuffle. All documents take part in every pass;
nothing is sampled.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import scratch

#: Buckets terms are hashed into, and the most cells of H; with very many subjects the buckets of the fewest documents go.
WIDE, MODEL_CELLS = 1 << 20, 1 << 25
#: Free components, updates of W in a pass, and rounds over the components of H.
FREE, INNER, SWEEPS = 4, 12, 6
#: H has converged if a pass moves the anchored components by less than this part of their norm; passes at most.
TOLERANCE, MAX_PASSES = 0.002, 30
#: Weight of the seed in an anchored component after an update, and of a described term next to the labelled ones.
ANCHOR, DESCRIBED = 0.8, 0.5
#: Terms of fewer documents carry no weight; those of many are damped by this power of their count.
LEAST_DOCS, DAMPING = 3, 0.25
#: A labelled term seeds a subject by how far its share there exceeds an even one and this part of the way to all of it.
MARGIN = 0.09
#: Share of a document's sentences from which a subject is given.
QUARTER = 0.25
#: Words of a stretch without end marks that count as one sentence.
UNMARKED_WORDS = 13
#: How far the document's own mixture is mixed into that of a sentence, and the mass from which a sentence is about a subject.
CONTEXT, MIN_MASS = 0.8, 0.04
#: The table of subjects is held by the driver and every worker; more are refused.
MAX_SUBJECTS = 2_000
#: Documents handled at once, by their sentences and by their counts.
BATCH, COUNTS_BATCH = 256, 1024

_MARKS = re.compile(r"^[ \t]*(?:[>*#+-]+[ \t]+)*(?:\[[ xX]\][ \t]*)?(?:\[[\d:.,]+\][ \t]*|\(\d+:\d\d\)[ \t]*|\d+:\d\d:\d\d\S*[ \t]*(?:-->|-)?[ \t]*)?(?:\*\*[^*\n]{1,40}\*\*[ \t]*·[ \t]*[\d:]+[^\n]*|(?:>>[ \t]*)?(?:speaker|spk)[ _#]?\w+[:\])-][ \t]*|[A-Z]\d?:[ \t])?", re.I | re.M)
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}[ \t]+|\*\*)[^.?!\n]{0,80}$", re.M)
_END = re.compile(r"(?<=[.?!…])[\s\"'”»*_)]+|;\s+(?=[A-ZÀ-Þ])|\n[ \t]*\n")
_LINE = re.compile(r"\n[ \t]*(?=[*+-][ \t]|\[|\(\d|[A-Z]\d?:|\*\*|>>|(?:speaker|spk)\b|\d+:\d)", re.I)
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Combining marks, soft hyphens and marks of no width.
_UNSEEN = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u200b-\u200d\ufeff]")


def normal(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return text


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence. Headings and marks are left out; long stretches without end marks are cut evenly."""
    text = _HEADING.sub("\n\n", normal(text))
    out = []
    for line in _LINE.split(text):
        line = _MARKS.sub(" ", line)
        for s in _END.split(line):
            words = _WORD.findall(s.casefold())
            if not words:
                continue
            n = max(1, round(len(words) / UNMARKED_WORDS)) if len(words) > 2 * UNMARKED_WORDS else 1
            out += [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]
    return out


_hashed: dict[str, int] = {}


def word_hash(word: str) -> int:
    h = _hashed.get(word)
    if h is None:
        h = zlib.crc32(word.encode())
        if len(_hashed) < 200_000:
            _hashed[word] = h
    return h


def terms(hashes: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of neighbouring pairs in a sentence, and the sentence of each, in order of sentences."""
    inside = sentence[1:] == sentence[:-1]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    every, where = np.concatenate([hashes, pairs[inside]]), np.concatenate([sentence, sentence[1:][inside]])
    order = np.argsort(where, kind="stable")
    return (every[order] % np.uint64(WIDE)).astype(np.int32), where[order]


#: Damped counts; from the last one on they are alike.
_DAMPED = (1 + np.log(np.maximum(np.arange(4096), 1))).astype(np.float32)


@dataclass
class Rows:
    """Some rows of a sparse matrix."""

    index: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    @classmethod
    def count(cls, flat: np.ndarray, row: np.ndarray, rows: int) -> Rows:
        """Counts of the terms ``flat``, each in its ``row``."""
        key, n = np.unique(row.astype(np.int64) * WIDE + flat, return_counts=True)
        return cls(key % WIDE, n, np.cumsum(np.bincount(key // WIDE, minlength=rows)))

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def dot(self, ht: np.ndarray) -> np.ndarray:
        """X H' for H' of a row a column."""
        n = self.sizes()
        out = np.zeros((len(n), ht.shape[1]), ht.dtype)
        if len(self.index):
            out[n > 0] = np.add.reduceat(ht[self.index] * self.value[:, None], (self.ends - n)[n > 0], axis=0)
        return out

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), self.sizes())

    def scaled(self, columns: np.ndarray, weight: np.ndarray) -> Rows:
        """Damped counts times ``weight``, rows of length one; ``columns``: that of each bucket, -1 for none."""
        at, index = self.row_of(), columns[self.index]
        known = index >= 0
        at, index = at[known], index[known]
        v = _DAMPED[np.minimum(self.value[known], len(_DAMPED) - 1)] * weight[index]
        norm = np.sqrt(np.bincount(at, v * v, len(self.ends)))
        return Rows(index, v / np.maximum(norm, 1e-12)[at].astype(np.float32), np.cumsum(np.bincount(at, minlength=len(self.ends))))

    def product(self, w: np.ndarray, columns: int) -> np.ndarray:
        """X' W."""
        at = self.row_of()
        return np.stack([np.bincount(self.index, self.value * w[at, j], columns) for j in range(w.shape[1])], 1)


def mixtures(x: Rows, ht: np.ndarray) -> np.ndarray:
    """W for a fixed H: multiplicative updates from an even start."""
    xh, hh = np.maximum(x.dot(ht), 0), ht.T @ ht
    w = np.full(xh.shape, 1.0 / xh.shape[1], xh.dtype)
    for _ in range(INNER):
        w *= xh / np.maximum(w @ hh, 1e-12)
    return w


def updated(ht: np.ndarray, xw: np.ndarray, ww: np.ndarray) -> np.ndarray:
    """H' for a fixed W: each component in turn as good as the others let it be, and not below zero."""
    new = ht.copy()
    for _ in range(SWEEPS):
        for j in range(new.shape[1]):
            if ww[j, j] > 1e-12:
                new[:, j] = np.maximum(new[:, j] + (xw[:, j] - new @ ww[:, j]) / ww[j, j], 0)
    return new


def unit(columns: np.ndarray) -> np.ndarray:
    return columns / np.maximum(np.linalg.norm(columns, axis=0), 1e-12)


@dataclass
class Model:
    """Fitted components: ``ht`` is H transposed, anchored components first, in the order of ``subjects``; ``columns``: that of each bucket."""

    subjects: list[str]
    columns: np.ndarray
    weight: np.ndarray
    ht: np.ndarray
    #: How far each pass moved H.
    moved: list[float]

    def judge(self, flat: np.ndarray, sentence: np.ndarray, document: np.ndarray, documents: int) -> np.ndarray:
        """Share of each document's sentences about each subject. ``sentence``: of each term; ``document``: of each sentence."""
        k = len(self.subjects)
        if not len(document):
            return np.zeros((documents, k))
        own = mixtures(Rows.count(flat, sentence, len(document)).scaled(self.columns, self.weight), self.ht)[:, :k]
        context = np.stack([np.bincount(document, own[:, j], documents) for j in range(k)], 1)
        context /= np.maximum(context.sum(1, keepdims=True), 1e-12)
        own = own * ((1 - CONTEXT) + CONTEXT * k * context[document])
        best = own.argmax(1)
        about = own[np.arange(len(own)), best] > MIN_MASS
        told = np.zeros((documents, k))
        np.add.at(told, (document[about], best[about]), 1)
        return told / np.maximum(np.bincount(document, minlength=documents), 1)[:, None]


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of 32-bit integers as binaries, which cost the JVM a value a list, not one an element."""
    ends = np.append(0, np.cumsum(lengths)).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values, np.int32).tobytes())])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``packed`` lists, and their lengths."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    count = int(at[-1] - at[0]) // 4
    return np.frombuffer(data, np.int32, count, int(at[0])) if count else np.zeros(0, np.int32), np.diff(at) // 4


def flatten(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a batch of the stored matrix: terms, the sentence of each, the document of each sentence, number of documents."""
    flat, _ = unpacked(batch.column(1))
    sizes, per_doc = unpacked(batch.column(2))
    return flat.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(batch.num_rows), per_doc), batch.num_rows


def parts(batches: Iterable[pa.RecordBatch], size: int = BATCH) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def store_matrix(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Terms of every document, written to the shared folder: ``k, terms, sizes`` (terms a sentence), ``own, times`` (the document's different terms and their counts), each a packed list."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("x"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            hashes, sizes, per_doc = [], [], []
            for x in batch.column(1).to_pylist():
                ss = sentences(x) if x else []
                for s in ss:
                    hashes += map(word_hash, s)
                    sizes.append(len(s))
                per_doc.append(len(ss))
            flat, sentence = terms(np.array(hashes, np.uint64), np.repeat(np.arange(len(sizes)), sizes))
            document = np.repeat(np.arange(len(per_doc)), per_doc)[sentence]
            told = packed(flat, np.bincount(document, minlength=len(per_doc))), packed(np.bincount(sentence, minlength=len(sizes)), np.array(per_doc, int))
            counts = Rows.count(flat, document, len(per_doc))
            own, times = packed(counts.index, counts.sizes()), packed(counts.value, counts.sizes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *told, own, times], names=["k", "terms", "sizes", "own", "times"])

    path = scratch(docs.sparkSession, "matrix")
    rows.mapInArrow(run, f"k {kind}, terms binary, sizes binary, own binary, times binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def counts_of(batch: pa.RecordBatch) -> Rows:
    """The documents' counts, in the first two columns of a batch."""
    own, lengths = unpacked(batch.column(0))
    return Rows(own, unpacked(batch.column(1))[0], np.cumsum(lengths))


def summed(rows: DataFrame, height: int, width: int, product) -> np.ndarray:
    """Sum over all batches of ``product(batch)``, an array of this size; at most its rows leave a task, and its size reaches the driver."""
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in parts(batches, COUNTS_BATCH):
            p = product(batch)
            total = p if total is None else np.add(total, p, out=total)
        if total is not None:
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, j], pa.float64()) for j in range(width))], names=["t", *names])

    found = rows.mapInArrow(run, "t int, " + ", ".join(f"{n} double" for n in names)).groupBy("t").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    t = found.column("t").to_numpy()
    out = np.zeros((height, width))
    for j, n in enumerate(names):
        out[t, j] = found.column(n).to_numpy()
    return out


def vocabulary(counts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The column of each bucket (-1 for none), the documents of each column, and the number of documents."""

    def frequencies(batch: pa.RecordBatch) -> np.ndarray:
        return np.append(np.bincount(counts_of(batch).index, minlength=WIDE), batch.num_rows).astype(float)[:, None]

    counted = summed(counts, WIDE + 1, 1, frequencies)[:, 0]
    df, n = counted[:WIDE], counted[WIDE]
    kept = np.flatnonzero(df >= LEAST_DOCS)
    kept = np.sort(kept[np.argsort(-df[kept], kind="stable")[: MODEL_CELLS // width]])
    columns = np.full(WIDE, -1, np.int32)
    columns[kept] = np.arange(len(kept))
    return columns, df[kept], n


def fit(matrix: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id") -> Model:
    """Factor the stored matrix. ``labels``: ``key, annotator, subject``; ``subjects``: ``subject, description``.

    Of the labels of a document those count on which most annotators agree. Unknown subjects and documents are ignored.
    """
    spark = matrix.sparkSession
    described = {r.subject: r.description or "" for r in subjects.select("subject", "description").filter("subject IS NOT NULL").orderBy("subject").limit(MAX_SUBJECTS + 1).collect()}
    if len(described) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    names = list(described)
    k, width = len(names), len(names) + FREE
    counts = matrix.select("own", "times")
    columns, df, n = vocabulary(counts, width)
    size = len(df)
    weight = np.log((n + 1) / (df + 1)) / np.maximum(df, 1) ** DAMPING
    shipped = spark.sparkContext.broadcast((columns, weight.astype(np.float32)))
    rows_of = lambda batch: counts_of(batch).scaled(*shipped.value)

    mean = summed(counts, size, 1, lambda b: rows_of(b).product(np.ones((b.num_rows, 1), np.float32), size))[:, 0] / max(n, 1)

    votes = labels.select(F.col(f"`{key}`").alias("k"), "annotator", "subject").filter(F.col("subject").isin(names)).distinct().groupBy("k", "subject").agg(F.count("*").alias("v"))
    best = votes.groupBy("k").agg(F.max("v").alias("top"))
    agreed = votes.join(best, "k").filter("v = top").groupBy("k").agg(F.sort_array(F.collect_set("subject")).alias("told"))
    labelled = matrix.select("k", "own", "times").join(agreed, "k").select("own", "times", "told")

    def label_rows(batch: pa.RecordBatch) -> np.ndarray:
        w = np.zeros((batch.num_rows, k), np.float32)
        for i, told in enumerate(batch.column(2).to_pylist()):
            for s in told:
                w[i, names.index(s)] = 1 / len(told)
        return np.vstack([rows_of(batch).product(w, size), w.sum(0)])

    by_label = summed(labelled, size + 1, k, label_rows)
    rate = by_label[:size] / np.maximum(by_label[size], 1)
    share = (rate + 0.02 * mean[:, None]) / np.maximum(rate.sum(1) + 0.02 * k * mean, 1e-12)[:, None]
    floor = 1 / k + MARGIN * (1 - 1 / k)
    seed = np.maximum(share - floor, 0) * mean[:, None]
    for j, name in enumerate(names):
        words = _WORD.findall(normal(f"{name} {described[name]}").casefold())
        for t in columns[terms(np.array(list(map(word_hash, words)), np.uint64), np.zeros(len(words), int))[0]]:
            if t >= 0:
                seed[t, j] += DESCRIBED * mean[t]
    seed = unit(seed)
    # Free components keep off the terms that seed a subject, else one of them may grow into it.
    general = 1 - np.clip((share.max(1) - floor) / max(1 - floor, 1e-12), 0, 1)[:, None]
    start = general * mean[:, None] * np.random.default_rng(7).uniform(0.5, 1.5, (size, FREE))
    ht, moved = np.hstack([seed + 1e-3 * unit(mean[:, None]), unit(start)]), []

    while size and len(moved) < MAX_PASSES and (not moved or moved[-1] > TOLERANCE):
        now = spark.sparkContext.broadcast(ht.astype(np.float32))

        def products(batch: pa.RecordBatch) -> np.ndarray:
            x = rows_of(batch)
            w = mixtures(x, now.value)  # noqa: B023
            return np.vstack([x.product(w, size), w.T @ w])

        both = summed(counts, size + width, width, products)
        new = unit(updated(ht, both[:size], both[size:]))
        new[:, :k] = ANCHOR * seed + (1 - ANCHOR) * new[:, :k]
        new[:, k:] *= general
        new = unit(new)
        moved.append(float(np.linalg.norm(new[:, :k] - ht[:, :k]) / max(np.linalg.norm(ht[:, :k]), 1e-12)))
        ht = new
        now.unpersist()
    return Model(names, columns, weight.astype(np.float32), ht.astype(np.float32), moved)


def assign(matrix: DataFrame, model: Model, key: str = "doc_id", least: float = QUARTER) -> DataFrame:
    """``key, subject, share``: each subject that at least ``least`` of a document's sentences are about."""
    shipped = matrix.sparkSession.sparkContext.broadcast(model)
    kind = matrix.schema["k"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in parts(batches):
            share = m.judge(*flatten(batch))
            d, j = np.nonzero(share >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([m.subjects[i] for i in j], pa.string()), pa.array(share[d, j])], names=["k", "subject", "share"])

    return matrix.select("k", "terms", "sizes").mapInArrow(run, f"k {kind}, subject string, share double").withColumnRenamed("k", key)


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, subject, share`` for all documents.

    Defined cases: null, empty and wordless texts have no subject; a subject without labels rests on its description
    alone; an empty table of subjects or documents gives no rows; repeated documents give repeated rows; other columns are dropped.
    """
    matrix = store_matrix(docs, key, text)
    if subjects.isEmpty() or matrix.isEmpty():
        kind = matrix.schema["k"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, subject string, share double")
    return assign(matrix, fit(matrix, labels, subjects, key), key)
