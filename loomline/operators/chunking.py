"""Notes into search chunks, and the index over them.

Chunks have ``note_id, ordinal, start_ms, end_ms, text``. Filling a chunk up to a word budget and then starting anew is split
into stretches of a note by what a stretch does to a chunk of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.score import hashed_embedding
from loomline.functions.text import extract_terms, normalize_tag, trim_ws, word_count, words
from loomline.operators.changes import current, publish
from loomline.operators.fold import Fold, fold_sorted
from loomline.operators.log_store import live, merged_meta
from loomline.operators.sequence import gathered

TARGET_WORDS = 420
MAX_WORDS = 620
SCHEMA_VERSION = 1
CHUNK = "note_id string, ordinal int, start_ms long, end_ms long, text string"

_SPACE = re.compile("[\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def _words(text: str) -> int:
    return sum(1 for w in _SPACE.split(text) if w)


class _Transitions(Fold):
    """What a stretch of lines does to a chunk that has 0, 1, 2... words when it begins: words at its end, and chunks ended in it."""

    def __init__(self, target: int) -> None:
        self.target, self.where = target, None
        self.count, self.ended = np.arange(target), np.zeros(target, int)

    def step(self, row):
        *self.where, k = row
        self.count += k
        full = self.count >= self.target
        self.ended += full
        self.count[full] = 0
        return ()

    def end(self):
        yield *self.where, self.count.tolist(), self.ended.tolist()


class _Carry(Fold):
    """Words and chunks before each stretch of a note."""

    def __init__(self) -> None:
        self.count = self.ordinal = 0

    def step(self, row):
        stretch, count, ended = row
        yield stretch, self.count, self.ordinal
        self.ordinal += ended[self.count]
        self.count = count[self.count]


class _Assign(Fold):
    """The chunk of each line of a stretch."""

    def __init__(self, target: int) -> None:
        self.target, self.n, self.state = target, 0, None

    def step(self, row):
        *line, k, count, ordinal = row
        count, ordinal = self.state or (count, ordinal)
        yield *line, self.n, ordinal
        self.n += 1
        self.state = (count + k, ordinal) if count + k < self.target else (0, ordinal + 1)


def fill_chunks(lines: DataFrame, order: list[str], target: int = TARGET_WORDS, stretch: int = 3_600_000) -> DataFrame:
    """Lines (``note_id, start_ms, end_ms, text``) joined until a chunk has ``target`` words; blank ones don't count.

    Where a chunk ends depends on all lines before. So stretches of a note, ``stretch`` units of the first of ``order`` each, first
    tell what they do to a chunk of any size; one row a stretch is walked in order, and then every stretch knows how
    it begins. No task walks a note's lines.
    """
    note, part = F.col("note_id").cast("string").alias("note_id"), F.floor(F.col(order[0]) / F.lit(stretch)).alias("__b")
    rows = lines.withColumn("text", trim_ws(F.col("text"))).filter("text <> '' AND note_id IS NOT NULL").select(note, part, *dict.fromkeys([*order, "start_ms", "end_ms", "text"]), word_count(F.col("text")).alias("__k"))
    rows = rows.withColumn("__key", F.to_json(F.struct("note_id", "__b")))
    moves = fold_sorted(rows, "__key", order, ["note_id", "__b", "__k"], lambda: _Transitions(target), "__key string, note_id string, __b long, count array<int>, ended array<int>")
    before = fold_sorted(moves, "note_id", ["__b"], ["__b", "count", "ended"], _Carry, "note_id string, __b long, count int, ordinal int")
    placed = rows.join(before, ["note_id", "__b"])
    schema = "__key string, note_id string, b long, start_ms long, end_ms long, text string, n long, ordinal int"
    told = fold_sorted(placed, "__key", order, ["note_id", "__b", "start_ms", "end_ms", "text", "__k", "count", "ordinal"], lambda: _Assign(target), schema)
    at = F.struct("b", "n")
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))
    chunks = told.groupBy("note_id", "ordinal").agg(F.min(value("start_ms")).getField("v").alias("start_ms"), F.max(value("end_ms")).getField("v").alias("end_ms"), gathered(at, F.col("text"), " ").alias("text"))
    return chunks.select("note_id", "ordinal", "start_ms", "end_ms", "text")


def fixed_windows(text: Column, size: int = TARGET_WORDS) -> Column:
    """Groups of ``size`` words."""
    w = words(text)
    n = F.ceil(F.size(w) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def chunk_dictated(notes: DataFrame) -> DataFrame:
    """``note_id, segments``: one chunk up to 620 words, with its times; longer ones in fixed windows without."""
    texts = F.filter(F.transform("segments", lambda s: trim_ws(s["text"])), lambda t: t != "")
    rows = notes.select("note_id", F.array_join(texts, " ").alias("t"), F.get("segments", F.lit(0))["start_ms"].alias("s"), F.try_element_at("segments", F.lit(-1))["end_ms"].alias("e")).filter("t <> ''")
    short = word_count(F.col("t")) <= MAX_WORDS
    parts = rows.select("note_id", F.posexplode(F.when(short, F.array("t")).otherwise(fixed_windows(F.col("t")))).alias("ordinal", "text"), F.when(short, F.col("s")).alias("start_ms"), F.when(short, F.col("e")).alias("end_ms"))
    return parts.select("note_id", "ordinal", "start_ms", "end_ms", "text")


def markdown_blocks(text: str) -> list[str]:
    """Stretches between blank lines, and before headings."""
    blocks: list[list[str]] = [[]]
    for line in re.split(r"\r?\n", text):
        bare = _SPACE.sub(" ", line).strip(" ")
        if not bare or bare.startswith("#"):
            blocks.append([])
        if bare:
            blocks[-1].append(line)
    return ["\n".join(b) for b in blocks if b]


def written_chunks(text: str, target: int = TARGET_WORDS, most: int = MAX_WORDS) -> list[str]:
    """W11 on one text: a heading starts a chunk; blocks fill it to ``target`` but not past ``most`` words."""
    out: list[str] = []
    held: list[str] = []
    count = 0
    for block in markdown_blocks(text):
        n = _words(block)
        if held and (block.lstrip().startswith("#") or count + n > most):
            out.append("\n\n".join(held))
            held, count = [], 0
        held.append(block)
        count += n
        if count >= target:
            out.append("\n\n".join(held))
            held, count = [], 0
    return [*out, "\n\n".join(held)] if held else out


def chunk_written(notes: DataFrame) -> DataFrame:
    """``note_id, text`` in chunks at headings and blank lines."""
    rows = notes.select(F.col("note_id"), trim_ws(F.col("text")).alias("text")).filter("text <> ''")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, i, c) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for i, c in enumerate(written_chunks(t))]
            k, i, c = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(i, pa.int32()), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(c, pa.string())], names=["note_id", "ordinal", "start_ms", "end_ms", "text"])

    return rows.select(F.col("note_id").cast("string"), "text").mapInArrow(run, CHUNK)


def chunk_records(records: DataFrame) -> DataFrame:
    """All live records in chunks, each by its kind; transcripts by their blocks where they have any, else by their lines."""
    alive = live(records).withColumnRenamed("id", "note_id")
    spoken = alive.filter(F.col("kind").isin("scribe", "transcribe"))
    item = lambda c: F.transform(c, lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text")))
    lines = spoken.select("note_id", F.posexplode(F.when(F.size("speaker_blocks") > 0, item("speaker_blocks")).otherwise(item("segments"))).alias("i", "x")).select("note_id", "i", "x.*")
    written = alive.filter("kind = 'written'").select("note_id", F.coalesce("written_content", F.lit("")).alias("text"))
    return fill_chunks(lines, ["i"], stretch=1_000).unionByName(chunk_dictated(alive.filter("kind = 'dictate'"))).unionByName(chunk_written(written))


def build_index(records: DataFrame, meta: DataFrame, embed=None) -> DataFrame:
    """Chunks with id, title, kind, date, tags, terms and vector. ``embed`` turns a text column into a vector column."""
    notes = live(records).select(F.col("id").alias("note_id"), F.col("title").alias("note_title"), F.col("kind").alias("note_kind"), "created_at")
    tags = merged_meta(meta).select("note_id", "tags")
    out = chunk_records(records).join(notes, "note_id").join(tags, "note_id", "left")
    out = out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("terms", extract_terms(F.col("text")))
    vector = embed(F.col("text")) if embed else hashed_embedding(F.col("terms"))
    out = out.withColumn("vector", vector.cast("array<float>")).withColumn("id", F.concat_ws(":", "note_id", F.col("ordinal").cast("string")))
    return out.select("id", "note_id", "note_title", "note_kind", "created_at", "start_ms", "end_ms", "text", "terms", "tags", "vector")


def fingerprint(records: DataFrame) -> DataFrame:
    """One digest over all live records, whatever their order; bounded state, as digests are added up bit by bit."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("id", "created_at", "title", "word_count")]
    row = F.sha2(F.concat_ws("\x1f", *parts, F.size("segments").cast("string"), F.coalesce("written_content", F.lit(""))), 256)
    pieces = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return live(records).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *pieces), 256).alias("fingerprint"))


def write_index(index: DataFrame, target: str, model_id: str = "hashed") -> None:
    """Chunks and a one-row manifest; the manifest is published last."""
    version = publish(index, target)
    count, dim = index.sparkSession.read.parquet(f"{target}/{version}").agg(F.count("*"), F.max(F.size("vector"))).first()
    manifest = index.sparkSession.createDataFrame([(SCHEMA_VERSION, model_id, count, dim or 0)], "schema_version int, model_id string, chunks long, dim int")
    publish(manifest, f"{target}-manifest")


def read_index(spark, target: str, model_id: str = "hashed") -> DataFrame:
    """The index, after its manifest is checked."""
    manifest = current(spark, f"{target}-manifest")
    m = manifest.first() if manifest is not None else None
    if m is None:
        raise FileNotFoundError("no index has been built")
    if m.schema_version != SCHEMA_VERSION or m.model_id != model_id:
        raise ValueError("the index is of another version or model; build it anew")
    index = current(spark, target)
    if index.filter(F.size("vector") != m.dim).limit(1).count():
        raise ValueError("vectors of the index differ in length")
    return index


def with_tag(index: DataFrame, tag: str) -> DataFrame:
    """P07."""
    return index.filter(F.exists("tags", lambda t: normalize_tag(t) == normalize_tag(F.lit(tag))))
