"""Readers and writers of the stored formats."""

from __future__ import annotations

import io
import json
import os
import re
import wave
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType, _parse_datatype_string

from loomline.functions.text import front_matter_field, trim_ws
from loomline.operators.log_store import usable
from loomline.schemas import DICTATE, EXTENSIONS, HISTORY_LOG, NOTE_META, SPEAKER_NAMES
from loomline.session import hadoop_fs

FRONT_MATTER_BYTES = 4096


#: Places of lines: files in order of their names, then bytes; a log has fewer files and its files fewer bytes than fit.
FILE_BITS = 44


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, place`` of the lines of text files: ``place`` grows with the line's place in its file, and with the file's name.

    A split's lines come to a task in their order, and there are fewer than it has bytes, so the split's first byte plus
    the number of lines before in it is a place that no shuffle has to find.
    """
    lines = spark.read.text(path)
    ordinals = {unquote(f).split(":", 1)[-1].lstrip("/"): i for i, f in enumerate(sorted(lines.inputFiles(), key=unquote))}
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, 0
        for batch in batches:
            files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy(zero_copy_only=False)
            codes = files.indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
            places = np.empty(len(starts), np.int64)
            for a, z in zip([0, *cuts], [*cuts, len(starts)]) if len(starts) else ():
                own = (files.dictionary[int(codes[a])].as_py(), int(starts[a]))
                before = before if own == now else 0
                now = own
                first = (ordinals[unquote(own[0]).split(":", 1)[-1].lstrip("/")] << FILE_BITS) + own[1]
                places[a:z] = first + before + np.arange(z - a)
                before += z - a
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places)], names=["value", "place"])

    return rows.mapInArrow(run, "value string, place long")


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Usable versions of a JSON-lines log with ``seq``, and the lines that can't be read. Blank lines are skipped.

    Lines without a ``seq`` of their own take their place in the log, the order in which they were appended. A missing file
    holds no lines.
    """
    schema = StructType(_parse_datatype_string(HISTORY_LOG).fields + _parse_datatype_string("_bad string").fields)
    fs, place = hadoop_fs(spark, path)
    lines = numbered_lines(spark, path) if fs.exists(place) else spark.createDataFrame([], "value string, place long")
    rows = lines.filter("trim(value) <> ''").select("value", "place", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("value", "place", "r.*")
    rows = rows.withColumn("seq", F.coalesce("seq", "place")).drop("place")
    good = usable(rows.filter("_bad IS NULL")).drop("_bad", "value").fillna({"deleted": False, "speaker_capture": False, "dual_source": False})
    for name in ("speaker_blocks", "speaker_chunks", "session_speakers", "notes"):
        good = good.withColumn(name, F.coalesce(name, F.array().cast(good.schema[name].dataType)))
    return good, rows.filter("_bad IS NOT NULL").select(F.col("value").alias("line"))


def append_log(rows: DataFrame, path: str) -> None:
    """Versions added to a JSON-lines log."""
    rows.write.mode("append").json(path)


def _note_id(path: str):
    return F.regexp_extract(F.col("_metadata.file_path"), path, 1)


def read_sidecars(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``note_id, content`` of ``.notes/<id>/written.md`` and the parsed ``meta.json``; what can't be parsed is absent.

    Each kind is read by itself; where there is no such file, its table is empty.
    """

    def texts(name: str) -> DataFrame:
        fs, pattern = hadoop_fs(spark, f"{folder}/.notes/*/{name}")
        if not fs.globStatus(pattern):
            return spark.createDataFrame([], "note_id string, value string")
        return spark.read.option("wholetext", True).text(f"{folder}/.notes/*/{name}").select(_note_id(rf"/\.notes/([^/]+)/{re.escape(name)}$").alias("note_id"), "value")

    bodies = texts("written.md").withColumnRenamed("value", "content")
    meta = texts("meta.json").select("note_id", F.from_json("value", NOTE_META.split(", ", 1)[1]).alias("m"))
    return bodies, meta.filter("m IS NOT NULL").select("note_id", "m.*")


def read_legacy_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``path, title, model, modified_at`` of the folder's own ``*.md``; only their first 4 KB are looked at."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    head = F.substring(F.col("content"), 1, FRONT_MATTER_BYTES).cast("string")
    stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return files.select("path", F.coalesce(front_matter_field(head, "title"), stem).alias("title"), F.coalesce(front_matter_field(head, "model"), F.lit("")).alias("model"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified_at"))


def _json_array(spark: SparkSession, path: str, ddl: str, strict: bool) -> DataFrame:
    if not os.path.exists(path.removeprefix("file://")) and "://" not in path.removeprefix("file://"):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_legacy_dictate(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array; none if the file is missing, an error if it is malformed."""
    return _json_array(spark, path, DICTATE, True)


def read_speaker_names(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array; none if the file is missing or malformed."""
    return _json_array(spark, path, SPEAKER_NAMES, False)


def load_config(path: str, defaults: dict) -> dict:
    """Defaults where the file is missing; a corrupt one is moved aside."""
    p = Path(path)
    try:
        return defaults | json.loads(p.read_text(encoding="utf-8"))
    except FileNotFoundError:
        return dict(defaults)
    except ValueError:
        p.replace(f"{p}.corrupt")
        return dict(defaults)


def save_config(path: str, config: dict) -> None:
    """Written beside and renamed."""
    p = Path(path)
    part = p.with_name(p.name + ".part")
    part.write_text(json.dumps(config, indent=2, ensure_ascii=False), encoding="utf-8")
    part.replace(p)


def incomplete_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """``dir, state`` of session folders with a recording whose manifest isn't complete; a bad manifest counts as recording."""
    manifests = spark.read.option("wholetext", True).text(f"{folder}/*/session.json").select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/session\.json$", 1).alias("dir"), F.coalesce(F.get_json_object("value", "$.state"), F.lit("recording")).alias("state"))
    recorded = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "mic.wav").load(folder).select(F.regexp_replace("path", r"^(file:)/*", "file:///").alias("p"))
    recorded = recorded.select(F.regexp_extract("p", r"^(.*)/mic\.wav$", 1).alias("dir"))
    return manifests.withColumn("dir", F.regexp_replace("dir", r"^(file:)/*", "file:///")).join(recorded, "dir", "left_semi").filter("state <> 'complete'")


def decode_wav(content: bytes, rate: int | None = 16_000) -> np.ndarray | None:
    """Samples of a mono 16-bit file, -1 to 1; None if it is anything else. ``rate`` None takes any."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getnchannels() != 1 or w.getsampwidth() != 2 or (rate and w.getframerate() != rate):
                return None
            return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
    except (wave.Error, EOFError):
        return None


def encode_wav(samples, rate: int = 16_000) -> bytes:
    """A mono 16-bit file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.asarray(samples, np.float64) * 32767, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def repair_wav(content: bytes, rate: int = 16_000) -> bytes:
    """The header of a cut-off recording written anew from the file's size; an error if it holds no sample."""
    if len(content) <= 44:
        raise ValueError("no samples")
    n = (len(content) - 44) // 2
    return encode_wav(np.frombuffer(content[44 : 44 + 2 * n], "<i2") / 32767.0, rate)


@F.pandas_udf(ArrayType(FloatType()))
def wav_samples(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else decode_wav(bytes(c)))


def wav_millis(content: bytes) -> int | None:
    """Length from the header, 1 ms at least."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            return max(1, w.getnframes() * 1000 // w.getframerate())
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


def expand_inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row an item: ``path, dual``. A folder with ``mic.wav`` is one item, dual if it has ``speaker.wav``; others are searched for audio files."""
    if not paths:
        raise ValueError("no inputs")
    files = None
    for p in paths:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select("path")
        files = found if files is None else files.unionByName(found)
    named = files.distinct().select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).alias("file"))
    sessions = named.groupBy("dir").agg(F.max(F.col("file") == "mic.wav").alias("mic"), F.max(F.col("file") == "speaker.wav").alias("dual")).filter("mic")
    loose = named.join(sessions, "dir", "left_anti").filter(F.regexp_extract("file", r"\.([^.]*)$", 1).isin(EXTENSIONS))
    return sessions.select(F.col("dir").alias("path"), "dual").unionByName(loose.select("path", F.lit(False).alias("dual")))


def decode_files(files: DataFrame, decode=decode_wav, keep: Iterable[str] = ()) -> DataFrame:
    """``path, pcm`` of ``binaryFile`` rows, and the columns to ``keep``; ``decode`` turns bytes into samples or None. Other formats plug in there."""
    rows = files.select("path", "content", *keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcm = [None if c is None else decode(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else x.tolist() for x in pcm], pa.list_(pa.float32())), *batch.columns[2:]], names=["path", "pcm", *batch.schema.names[2:]])

    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("pcm", ArrayType(FloatType())), *rows.schema[2:]]))


def write_documents(docs: DataFrame, folder: str, name: str = "name", body: str = "body") -> None:
    """One file a row, named by ``name``, which may have folders; rows without text are an error. ``folder`` is mounted alike on all executors."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, b in zip(f["n"], f["b"]):
                place = Path(folder, n)
                place.parent.mkdir(parents=True, exist_ok=True)
                part = place.with_name(f".{place.name}.part")
                part.write_text(b, encoding="utf-8")
                part.replace(place)
            yield f[["n"]]

    if not docs.filter(trim_ws(F.coalesce(F.col(body), F.lit(""))) == "").isEmpty():
        raise ValueError("a document without text")
    Path(folder).mkdir(parents=True, exist_ok=True)
    docs.select(F.col(name).alias("n"), F.col(body).alias("b")).mapInPandas(run, "n string").count()


def record_failure(rows: DataFrame, path: str) -> None:
    """Rows that could not be processed, added to a dead-letter log."""
    rows.write.mode("append").json(path)
