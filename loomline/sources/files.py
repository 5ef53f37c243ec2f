"""Files beside the store: containment, digests, deletion, export, session folders and checks of input.

Paths are local or on a folder mounted alike everywhere; what touches them runs on the driver, for one record at a time. Only
digests are taken of many files, by tasks.
"""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import model_label, slugify_file
from loomline.operators.log_store import live, lookup, replay, set_markdown_path, tombstone
from loomline.operators.transcript import markdown_document, render_bodies, render_speaker_bodies, speaker_document

LEGACY = ("md::", "dictate::")
LONGEST_NAME = 80


def within(path: str, folder: str) -> str | None:
    """The real path if it exists and lies below ``folder``, links followed; else None."""
    real, base = os.path.realpath(path), os.path.realpath(folder)
    return real if os.path.exists(real) and os.path.commonpath([real, base]) == base else None


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of files; each is read whole by one task."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_id(key: str | None) -> str:
    """P21."""
    if key is None or not key.strip():
        raise ValueError("an id is needed")
    return key.strip()


def check_paths(paths: list[str]) -> list[str]:
    """P21."""
    if not paths or any(not p.strip() for p in paths):
        raise ValueError("input paths are needed, none of them blank")
    return paths


def check_folder(path: str) -> str:
    """A folder for results, made if it isn't there."""
    path = path.strip()
    if not path or not os.path.isabs(path):
        raise ValueError("the output path must be absolute")
    if os.path.exists(path) and not os.path.isdir(path):
        raise ValueError("the output path is a file")
    os.makedirs(path, exist_ok=True)
    return os.path.realpath(path)


def check_labels(mic: str, other: str) -> tuple[str, str]:
    """The two channels' labels."""
    if not mic.strip() or not other.strip():
        raise ValueError("labels can't be empty")
    return mic.strip(), other.strip()


def check_name(name: str) -> str:
    """A speaker's name."""
    name = name.strip()
    if not name or len(name.encode()) > LONGEST_NAME:
        raise ValueError(f"a name has 1 to {LONGEST_NAME} bytes")
    return name


def _not_legacy(key: str) -> str:
    if check_id(key).startswith(LEGACY):
        raise ValueError("legacy items are read-only")
    return key


def delete_record(log: DataFrame, key: str, folder: str) -> DataFrame:
    """The tombstone to append; the record's kept audio and exported file are removed if they lie in ``folder``.

    No row, and nothing removed, for unknown and deleted records.
    """
    row = tombstone(log, _not_legacy(key)).cache()
    r = row.first()
    if r is not None:
        session = r.session_dir and within(r.session_dir, folder)
        audio = not r.session_dir and r.audio_path and within(r.audio_path, folder)
        if session:
            remove_session(session)
        for p in filter(None, (audio, r.markdown_path and within(r.markdown_path, folder))):
            if os.path.isfile(p):
                os.remove(p)
    return row


def free_name(folder: str, stem: str) -> Path:
    """K15 on a folder: the name, or with the first number that is free."""
    place, n = Path(folder, f"{stem}.md"), 1
    while place.exists():
        place, n = Path(folder, f"{stem}_{n}.md"), n + 1
    return place


def export_record(log: DataFrame, key: str, folder: str, timestamps: bool = False, mic: str = "In", other: str = "Out") -> tuple[str, DataFrame]:
    """Write a transcript, by its speaker blocks if it has any (K14), and give its path and the version to append."""
    records = replay(log.filter(F.col("id") == _not_legacy(key)))
    r = lookup(records, key).select("kind", "title", "model", F.size("speaker_blocks").alias("blocks"), slugify_file(F.col("title"), F.lit("transcript")).alias("slug"), model_label(F.col("model")).alias("m")).first()
    if r is None:
        raise KeyError("no such record")
    if r.kind in ("dictate", "written"):
        raise ValueError("dictations and written notes are not exported")
    alive = live(records)
    if r.blocks and r.blocks > 0:
        blocks = alive.select(F.col("id").alias("recording_id"), F.posexplode("speaker_blocks").alias("first", "b")).select("recording_id", "first", "b.label", "b.start_ms", "b.end_ms", "b.text")
        made = alive.join(render_speaker_bodies(blocks, mic, other), F.col("id") == F.col("recording_id"), "left")
        whole = speaker_document(F.col("title"), F.col("model"), F.coalesce("body", F.lit("")))
    else:
        lines = alive.select(F.col("id").alias("recording_id"), F.posexplode("segments").alias("pos", "s")).select("recording_id", "pos", "s.start_ms", "s.end_ms", "s.text", "s.source")
        made = alive.join(render_bodies(lines, timestamps).withColumnRenamed("word_count", "words"), F.col("id") == F.col("recording_id"), "left")
        whole = markdown_document(F.col("title"), F.col("duration_ms"), F.coalesce("words", F.lit(0)), F.col("model"), F.coalesce("body", F.lit("")), F.col("notes"))
    text = made.select(whole.alias("d")).first().d
    place = free_name(folder, f"{r.slug}_{r.m}" if r.m else r.slug)
    part = place.with_name(f".{place.name}.part")
    part.write_text(text, encoding="utf-8")
    part.replace(place)
    return str(place), set_markdown_path(log, key, str(place))


def make_session(folder: str, now: datetime) -> str:
    """A folder named after the time."""
    place = Path(folder, now.strftime("%Y-%m-%d_%H-%M-%S"))
    place.mkdir(parents=True, exist_ok=True)
    return str(place)


def write_manifest(session: str, manifest: dict) -> None:
    """The session's state; written beside and renamed."""
    part = Path(session, ".session.json.part")
    part.write_text(json.dumps(manifest, indent=2, ensure_ascii=False), encoding="utf-8")
    part.replace(Path(session, "session.json"))


def write_notes(session: str, title: str, wav: str, notes: list[dict]) -> None:
    """Title and notes of a recording kept without a transcript."""
    Path(session, "notes.json").write_text(json.dumps({"format_version": 1, "title": title, "wav_file": wav, "notes": notes}, indent=2, ensure_ascii=False), encoding="utf-8")


def finish_session(session: str, keep_audio: bool) -> None:
    """After a transcription, manifest and notes go, and the rest unless the audio is kept."""
    if os.path.isdir(session):
        for name in ("session.json", "notes.json"):
            Path(session, name).unlink(missing_ok=True)
        if not keep_audio:
            remove_session(session)


def remove_session(session: str) -> None:
    """A session's files and its folder; folders within it, which no session makes, keep it."""
    for p in list(Path(session).iterdir()) if os.path.isdir(session) else ():
        if p.is_file():
            p.unlink(missing_ok=True)
    if os.path.isdir(session) and not os.listdir(session):
        os.rmdir(session)


def salvage(folder: str, wav: str, now: datetime) -> str:
    """A failed dictation's audio moved to ``dictate_failures``, copied where it can't be moved."""
    place = Path(folder, "dictate_failures", now.strftime("%Y-%m-%d_%H-%M-%S") + ".wav")
    place.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(wav, place)
    return str(place)


