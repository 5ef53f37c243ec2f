"""The record store: a log of versions, the last of which wins, with tombstones, sidecars and updates.

Every write appends a version; readers replay. Replay is one partial aggregation, so many versions of a note
shrink before the shuffle. ``seq`` is the place of a version in the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from loomline.functions.text import reserved_label, trim_ws, word_count
from loomline.operators.changes import publish
from loomline.schemas import FORMAT_VERSION, KINDS, REQUIRED


def usable(log: DataFrame) -> DataFrame:
    """Rows with no required field null and a known kind."""
    ok = F.col("kind").isin(KINDS)
    for name in REQUIRED:
        kind = log.schema[name].dataType
        # A list is null where one field of its elements is; reading that one leaves the texts alone.
        nested = isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)
        ok &= F.col(f"{name}.{kind.elementType.names[0]}" if nested else name).isNotNull()
    return log.filter(ok)


def replay(log: DataFrame, columns: list[str] | None = None, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last version of each key, with ``first_seq``, where the key first appeared.

    ``columns`` are those of use besides key, sequence and ``deleted``; only these are read, hashed and shuffled (None: all).
    Rows without key or sequence are ignored. Of versions with one sequence number a delete wins, then the larger
    fingerprint over the columns of use.
    """
    kept = [c for c in log.columns if c not in ("first_seq", key) and (columns is None or c in (*columns, seq, "deleted"))]
    payload = [c for c in kept if c not in (seq, "deleted")]
    rows = log.filter(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(key, *kept)
    dead = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in kept else F.lit(False)
    rank = F.struct(F.col(seq).alias("seq"), dead.alias("deleted"), *([F.xxhash64(*payload).alias("fp")] if payload else []))
    last = rows.groupBy(key).agg(F.max_by(F.struct(*kept), rank).alias("r"), F.min(seq).alias("first_seq"))
    order = [c for c in log.columns if c in (key, *kept)]
    return last.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in order], "first_seq")


def live(state: DataFrame) -> DataFrame:
    """P02, after replay."""
    return state.filter(~F.coalesce(F.col("deleted"), F.lit(False)))


def lookup(state: DataFrame, key: str) -> DataFrame:
    """P03."""
    return live(state).filter(F.col("id") == key)


def merged_meta(meta: DataFrame) -> DataFrame:
    """One row a note: repeats dropped; of differing rows the one with the larger fingerprint."""
    columns = [c for c in meta.columns if c != "note_id"]
    kept = meta.filter("note_id IS NOT NULL").groupBy("note_id").agg(F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("m"))
    return kept.select("note_id", *[F.col(f"m.{c}").alias(c) for c in columns])


def hydrate(state: DataFrame, meta: DataFrame | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """Titles of the sidecars, unless blank, and their bodies, with word counts, put over the records'."""
    out = state
    if bodies is not None:
        out = out.join(bodies.select(F.col("note_id").alias("__b"), F.col("content").alias("__content")), F.col("id") == F.col("__b"), "left")
        has = F.col("__content").isNotNull()
        out = out.withColumn("written_content", F.coalesce("__content", "written_content")).withColumn("word_count", F.when(has, word_count(F.col("__content")).cast("bigint")).otherwise(F.col("word_count"))).drop("__b", "__content")
    if meta is not None:
        titles = merged_meta(meta).select(F.col("note_id").alias("__m"), F.col("title").alias("__title"))
        out = out.join(titles, F.col("id") == F.col("__m"), "left")
        out = out.withColumn("title", F.when(trim_ws(F.col("__title")) != "", F.col("__title")).otherwise(F.col("title"))).drop("__m", "__title")
    return out


def next_seq(log: DataFrame) -> int:
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def new_version(log: DataFrame, key: str, **changes: Column) -> DataFrame:
    """A further version of a live record with some fields changed (K03, K05, K08 to K10); no row for unknown or deleted keys."""
    columns = log.columns
    row = lookup(replay(log.filter(F.col("id") == key)), key).select(*columns)
    for name, value in changes.items():
        row = row.withColumn(name, value)
    return row.withColumn("seq", F.lit(next_seq(log)).cast("bigint"))


def tombstone(log: DataFrame, key: str) -> DataFrame:
    """K03."""
    return new_version(log, key, deleted=F.lit(True))


def set_markdown_path(log: DataFrame, key: str, path: str) -> DataFrame:
    """K05."""
    return new_version(log, key, markdown_path=F.lit(path))


def compact(log: DataFrame, target: str) -> str:
    """Publish only the live last versions, in one swap; returns the version's name."""
    return publish(live(replay(usable(log))).drop("first_seq"), target)


def check_label(old: str, new: str) -> str:
    """A usable new label, trimmed."""
    new = new.strip()
    if not new or not old.strip():
        raise ValueError("a label is needed")
    if len(new.encode()) > 80:
        raise ValueError("a label has at most 80 bytes")
    if old == new:
        raise ValueError("the label is the same")
    return new


def relabel(items: Column, old: str, new: str) -> Column:
    """K09 on an array of structs with ``label``."""
    return F.transform(items, lambda b: F.when(b["label"] == old, b.withField("label", F.lit(new))).otherwise(b))


def count_label(items: Column, label: str) -> Column:
    return F.greatest(F.coalesce(F.size(F.filter(items, lambda b: b["label"] == label)), F.lit(0)), F.lit(0))


def relabel_all(log: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """A version with every block, chunk and session speaker of the label renamed; an error if there is none."""
    new = check_label(old, new)
    fields = ["speaker_blocks", "speaker_chunks", "session_speakers"]
    row = new_version(log, key, **{f: relabel(F.col(f), old, new) for f in fields})
    before = lookup(replay(log.filter(F.col("id") == key)), key)
    if not (before.select(sum(count_label(F.col(f), old) for f in fields).alias("n")).first() or [0])[0]:
        raise ValueError("no such label")
    return row


def relabel_one(log: DataFrame, key: str, index: int, new: str) -> DataFrame:
    """The block at ``index``, and the chunk linked to it; an error if there is no such block."""
    before = lookup(replay(log.filter(F.col("id") == key)), key)
    found = before.select(F.size("speaker_blocks").alias("n"), F.get("speaker_blocks", F.lit(index)).alias("b")).first()
    if found is None or not 0 <= index < found.n:
        raise IndexError("no such block")
    new = check_label(found.b.label or " ", new)
    link = found.b.chunk_id
    blocks = F.transform("speaker_blocks", lambda b, i: F.when(i == index, b.withField("label", F.lit(new))).otherwise(b))
    chunks = F.transform("speaker_chunks", lambda c: F.when(c["id"] == F.lit(link), c.withField("label", F.lit(new))).otherwise(c)) if link else F.col("speaker_chunks")
    return new_version(log, key, speaker_blocks=blocks, speaker_chunks=chunks)


def shifted(items: Column, by: Column, fields: tuple[str, ...]) -> Column:
    """Timelines moved by ``by`` milliseconds."""
    def move(x: Column) -> Column:
        for f in fields:
            x = x.withField(f, x[f] + by)
        return x

    return F.transform(items, move)


def attach(base: DataFrame, passes: DataFrame) -> DataFrame:
    """Records joined with one pass each (``id`` and pass-local timelines): timelines moved behind what is there, counts redone."""
    p = passes.select(F.col("id").alias("__id"), F.struct(*[c for c in passes.columns if c != "id"]).alias("p"))
    by = F.coalesce(F.col("duration_ms"), F.lit(0))
    timed = {"segments": ("start_ms", "end_ms"), "speaker_blocks": ("start_ms", "end_ms"), "speaker_chunks": ("start_ms", "end_ms"), "session_speakers": ("start_ms", "end_ms"), "notes": ("recorded_at_ms",)}
    out = base.join(p, F.col("id") == F.col("__id"), "inner")
    moved = {f: F.concat(F.coalesce(F.col(f), F.array().cast(base.schema[f].dataType)), F.coalesce(shifted(F.col(f"p.{f}"), by, names), F.array().cast(base.schema[f].dataType))) for f, names in timed.items() if f in base.columns and f in passes.columns}
    out = out.withColumns(moved)
    total = F.greatest(F.coalesce(F.element_at("segments", -1)["end_ms"], F.col("duration_ms")), F.lit(0))
    counted = F.aggregate(F.transform("segments", lambda s: word_count(s["text"])), F.lit(0), lambda a, n: a + F.greatest(n, F.lit(0))).cast("bigint")
    scalars = {f: F.coalesce(F.col(f"p.{f}"), F.col(f)) for f in ("model", "source_path", "session_dir", "audio_path") if f in passes.columns}
    return out.withColumns({"duration_ms": total, "word_count": counted, **scalars}).drop("__id", "p")


def upsert_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of ``changes`` put over those of ``meta``; null fields keep what is there."""
    columns = [c for c in meta.columns if c != "note_id"]
    a, b = meta.alias("a"), changes.alias("b")
    return a.join(b, F.col("a.note_id") == F.col("b.note_id"), "full_outer").select(F.coalesce("a.note_id", "b.note_id").alias("note_id"), *[F.coalesce(F.col(f"b.{c}") if c in changes.columns else F.lit(None), F.col(f"a.{c}")).alias(c) for c in columns])


def save_name(names: DataFrame, name: str, slug: str, now: str, old_slug: str | None = None) -> DataFrame:
    """Upsert by slug, or rename ``old_slug``; a rename onto another person's slug is an error."""
    if old_slug and old_slug != slug and not names.filter(F.col("slug") == slug).isEmpty():
        raise ValueError("another person has that name")
    gone = [slug, *([old_slug] if old_slug else [])]
    born = names.filter(F.col("slug").isin(gone)).agg(F.min("created_at")).first()[0] or now
    row = names.sparkSession.createDataFrame([(name, slug, born, now)], names.schema)
    return names.filter(~F.col("slug").isin(gone)).unionByName(row)


def delete_name(names: DataFrame, slug: str) -> DataFrame:
    return names.filter(F.col("slug") != slug)


def may_rename_to(names: DataFrame, column: str = "name") -> DataFrame:
    """Names that aren't reserved."""
    return names.filter(~reserved_label(F.col(column)))


def first_version(**fields: object) -> dict[str, object]:
    """A new, empty record's fields (``create_empty``)."""
    empty = {"format_version": FORMAT_VERSION, "kind": "written", "title": "", "model": "", "segments": [], "duration_ms": 0, "word_count": 0, "deleted": False}
    return empty | fields
