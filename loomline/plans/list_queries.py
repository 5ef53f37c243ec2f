"""Queries of writers, lists, labels, progress and small scalars over whole test tables, each with SQL."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import progress, score, signal, text
from loomline.operators import log_store, read_models, transcript
from loomline.operators.fold import cells
from loomline.operators.search import result_lines
from loomline.plans import fold_sql
from loomline.plans.reference_queries import SQL as REFERENCE_SQL
from loomline.plans.reference_queries import _ALIGNED, _CHUNKS, _LIVE, _TURNS, SUMMARY, chunks, history, records, s_block, s_cleanup, s_hms, s_mmss, s_trim, s_words, turns
from loomline.session import scratch, table
from loomline.sources.records import decode_files, encode_wav, read_legacy_dictate, read_legacy_markdown, read_sidecars, read_speaker_names, wav_millis, write_documents
from loomline.streaming.hooks import diarize, labelled_ranges, transcribe_both
from loomline.streaming.phrases import PHRASE, Limits, at_rate, debounced, phrases_stream, retimed

QUERIES: dict = {}
SQL: dict[str, str] = {}
PHRASES = REFERENCE_SQL["phrase_segments"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def alive(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return log_store.live(records(spark, sf, *columns))


# Writers


_DOC = f"""'---' || chr(10) || 'title: ''' || replace(title, '''', '''''') || '''' || chr(10) || 'duration_seconds: ' || printf('%.1f', greatest(duration_ms, 0) / 1000.0) || chr(10) || 'word_count: ' || word_count || chr(10) || 'token_estimate: ' || CAST(round(word_count * 1.3) AS BIGINT) || chr(10) || 'model: ' || model || chr(10) || '---' || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || 'body'
    || CASE WHEN len(notes) > 0 THEN chr(10) || chr(10) || '## Notes' || chr(10) || array_to_string(list_transform(notes, lambda q, i: '[' || i || '] (' || {s_hms("q.recorded_at_ms")} || ') ' || q.text || chr(10)), '') ELSE '' END || chr(10)"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = alive(spark, sf, "title", "duration_ms", "word_count", "model", "notes")
    return rows.select("id", "title", "model", transcript.markdown_document(F.col("title"), F.col("duration_ms"), F.col("word_count"), F.col("model"), F.lit("body"), F.col("notes")).alias("document"))


@query(f"WITH {_LIVE} SELECT id, {_DOC} AS document FROM alive")
def markdown_documents(spark, sf):
    return _documents(spark, sf).select("id", "document")


@query(f"WITH {_LIVE} SELECT id, nullif(regexp_replace({s_trim('title')}, '^[''\"]+|[''\"]+$', '', 'g'), '') AS title, nullif({s_trim('model')}, '') AS model FROM alive WHERE title NOT LIKE '%''%' AND title NOT LIKE '%\"%'")
def front_matter(spark, sf):
    """The fields read back from the written documents; titles without quotation marks."""
    docs = _documents(spark, sf).filter(~F.col("title").rlike("['\"]"))
    return docs.select("id", text.front_matter_field(F.col("document"), "title").alias("title"), text.front_matter_field(F.col("document"), "model").alias("model"))


@query(f"WITH {_LIVE} SELECT id, 'body' AS section FROM alive WHERE coalesce(len(notes), 0) = 0")
def transcript_sections(spark, sf):
    """What the reader shows of the written documents that have no notes."""
    docs = _documents(spark, sf).filter(~F.contains("document", F.lit("\n## Notes\n")))
    return docs.select("id", text.transcript_section(F.col("document")).alias("section"))


@query("SELECT doc_id, coalesce(lang, 'none') || '_note' AS base, coalesce(lang, 'none') || '_note' || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END || '.md' AS name FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(lang, 'none') ORDER BY doc_id) AS n FROM documents)")
def unique_file_names(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("lang", F.lit("none")), F.lit("_note")).alias("base"))
    return read_models.unique_file_names(docs).select(F.col("id").alias("doc_id"), "base", "name")


@query("SELECT doc_id, CASE WHEN trim(slug) = '' THEN 'untitled' ELSE slug END AS slug FROM (SELECT doc_id, translate(regexp_replace(coalesce(source, '') || ': ' || coalesce(save_folder, '') || '.v1', '\\.[^./\\\\]*$', ''), ' /\\:*?\"<>|', '_---------') AS slug FROM documents)")
def file_slugs(spark, sf):
    name = F.concat(F.coalesce("source", F.lit("")), F.lit(": "), F.coalesce("save_folder", F.lit("")), F.lit(".v1"))
    return table(spark, sf, "documents").select("doc_id", text.slugify_file(name, F.lit("untitled")).alias("slug"))


@query(f"WITH {_CHUNKS} SELECT id, printf('%.3f', 0.5) || chr(9) || note_title || coalesce(' [' || CASE WHEN start_ms IS NOT NULL THEN {s_mmss('start_ms')} || '-' || {s_mmss('coalesce(end_ms, start_ms)')} END || ']', '') || chr(9) || note_id || chr(9) || text AS line FROM c WHERE note_title IS NOT NULL AND text IS NOT NULL AND note_id IS NOT NULL")
def search_lines(spark, sf):
    rows = chunks(spark, sf).filter("note_title IS NOT NULL AND text IS NOT NULL AND note_id IS NOT NULL").withColumns({"total": F.lit(0.5), "snippet": F.col("text")})
    keyed = rows.withColumn("snippet", F.concat(F.lit("\x00"), "id", F.lit("\x00"), "snippet"))
    return result_lines(keyed).select(F.split("line", "\x00")[1].alias("id"), F.regexp_replace("line", "\x00[^\x00]*\x00", "").alias("line"))


# Stored formats, written to the shared folder and read back


def _local(path: str) -> str:
    """A scratch path as the file writers see it; they need a folder mounted alike everywhere."""
    if "://" in path.removeprefix("file://"):
        raise ValueError("the shared folder is not mounted as files")
    return path.removeprefix("file://")


def _json_file(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A small table of fixed size as one JSON array."""
    path = f"{_local(scratch(spark, name))}.json"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict() for r in rows.collect()], f, ensure_ascii=False)
    return "file://" + path


@query("SELECT CAST(item_id AS VARCHAR) AS id, benchmark AS timestamp, text FROM eval_items")
def dictate_scan(spark, sf):
    rows = table(spark, sf, "eval_items").select(F.col("item_id").cast("string").alias("id"), F.col("benchmark").alias("timestamp"), "text")
    return read_legacy_dictate(spark, _json_file(spark, rows, "dictations"))


@query("SELECT name, slug, created_at, updated_at FROM speaker_names ORDER BY lower(name)")
def names_scan(spark, sf):
    rows = table(spark, sf, "speaker_names").select("name", "slug", "created_at", "updated_at")
    return read_models.names_in_order(read_speaker_names(spark, _json_file(spark, rows, "names")))


@query(f"SELECT doc_id || '.md' AS file, coalesce(nullif(regexp_replace({s_trim('save_folder')}, '^[''\"]+|[''\"]+$', '', 'g'), ''), CAST(doc_id AS VARCHAR)) AS title, coalesce(nullif({s_trim('source')}, ''), '') AS model FROM documents WHERE {s_trim('text')} <> ''")
def markdown_scan(spark, sf):
    """Every document written as a Markdown file by tasks and its front matter read back."""
    folder = _local(scratch(spark, "documents"))
    docs = table(spark, sf, "documents").filter(text.trim_ws(F.col("text")) != "")
    head = F.concat(F.lit("---\ntitle: '"), F.coalesce("save_folder", F.lit("")), F.lit("'\nmodel: "), F.coalesce("source", F.lit("")), F.lit("\n---\n\n"), "text")
    write_documents(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), head.alias("body")), folder)
    return read_models.latest_files(read_legacy_markdown(spark, "file://" + folder)).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "title", "model")


@query(f"WITH m AS (SELECT note_id, max(title) AS title FROM note_meta WHERE note_id IS NOT NULL GROUP BY note_id) SELECT note_id, title, 'Body of ' || note_id AS content FROM m")
def sidecar_scan(spark, sf):
    """A body and a JSON file a note, written by tasks and read back."""
    folder = _local(scratch(spark, "sidecars"))
    meta = table(spark, sf, "note_meta").filter("note_id IS NOT NULL").groupBy("note_id").agg(F.max("title").alias("title"))
    files = meta.select(F.explode(F.array(F.struct(F.concat(F.lit(".notes/"), "note_id", F.lit("/meta.json")).alias("name"), F.to_json(F.struct("title", F.array(F.lit("t")).alias("tags"))).alias("body")), F.struct(F.concat(F.lit(".notes/"), "note_id", F.lit("/written.md")).alias("name"), F.concat(F.lit("Body of "), "note_id").alias("body")))).alias("f")).select("f.*")
    write_documents(files, folder)
    bodies, read = read_sidecars(spark, "file://" + folder)
    return read.join(bodies, "note_id", "full").select("note_id", "title", "content")


@query("SELECT vec_id, 4 AS millis, list_transform(embedding, lambda v: CAST(trunc(least(greatest(CAST(v AS DOUBLE) * 32767, -32768), 32767)) AS DOUBLE) / 32768) AS pcm FROM embeddings")
def wav_round_trip(spark, sf):
    """Samples encoded as files in memory, their length read from the header, and decoded.

    As SQL has it, NaN is the highest sample and null the lowest, and a sample cut to zero keeps its sign; a file of whole numbers can't, so the sign is the input's.
    """

    def run(batches):
        for batch in batches:
            made = [None if v is None else encode_wav(v) for v in cells(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()), pa.array([None if m is None else wav_millis(m) for m in made], pa.int32())], names=["path", "given", "content", "millis"])

    bounded = F.transform("embedding", lambda v: F.least(F.greatest(v, F.lit(-2.0).cast("float")), F.lit(2.0).cast("float")))
    files = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), bounded.alias("given")).mapInArrow(run, "path string, given array<float>, content binary, millis int")
    signed = F.zip_with(F.col("pcm").cast("array<double>"), "given", lambda p, v: F.when(p == 0, v.cast("double") * 0).otherwise(p))
    return decode_files(files, keep=["given", "millis"]).select(F.col("path").cast("bigint").alias("vec_id"), "millis", signed.alias("pcm"))


# Updates of the store


@query(f"WITH {_LIVE}, one AS (SELECT min(id) AS id FROM alive WHERE kind = 'written') SELECT a.id, (SELECT max(seq) + 1 FROM ok) AS seq, true AS deleted, title FROM alive a JOIN one USING (id)")
def tombstoned(spark, sf):
    first = alive(spark, sf, "kind").filter("kind = 'written'").agg(F.min("id")).first()[0]
    return log_store.tombstone(history(spark, sf), first or "").select("id", "seq", "deleted", "title")


@query(f"WITH {_LIVE}, one AS (SELECT max(id) AS id FROM alive) SELECT a.id, (SELECT max(seq) + 1 FROM ok) AS seq, kind, '/notes/x.md' AS markdown_path, title FROM alive a JOIN one USING (id)")
def markdown_path_set(spark, sf):
    last = alive(spark, sf).agg(F.max("id")).first()[0]
    return log_store.set_markdown_path(history(spark, sf), last or "", "/notes/x.md").select("id", "seq", "kind", "markdown_path", "title")


@query(f"WITH {_LIVE}, one AS (SELECT min(id) AS id FROM alive WHERE kind = 'scribe') SELECT id, kind, title, duration_ms FROM alive JOIN one USING (id)")
def record_lookup(spark, sf):
    first = alive(spark, sf, "kind").filter("kind = 'scribe'").agg(F.min("id")).first()[0]
    return log_store.lookup(records(spark, sf, "kind", "title", "duration_ms"), first or "").select("id", "kind", "title", "duration_ms")


def blocked(spark: SparkSession, sf: str) -> DataFrame:
    """The live records as a log, with the labelled chunks of their recording as blocks, in order."""
    block = F.struct("label", "start_ms", "end_ms", F.lit("").alias("text"), F.col("id").alias("chunk_id"))
    blocks = turns(spark, sf).filter("label IS NOT NULL AND start_ms IS NOT NULL").groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "id", block.alias("b")))).alias("bs"))
    log = log_store.live(log_store.replay(history(spark, sf))).drop("first_seq")
    kind = log.schema["speaker_blocks"].dataType
    return log.join(blocks, log["id"] == blocks["recording_id"], "left").withColumn("speaker_blocks", F.coalesce(F.col("bs.b").cast(kind), F.array().cast(kind))).drop("recording_id", "bs")


_BLOCKED = f"{_LIVE}, {_TURNS}, b AS (SELECT recording_id AS id, id AS chunk_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, id) AS place FROM turns WHERE label IS NOT NULL AND start_ms IS NOT NULL AND recording_id IN (SELECT id FROM alive))"


@query(f"WITH {_BLOCKED} SELECT id, (SELECT max(seq) + 1 FROM alive) AS seq, chunk_id, CASE WHEN label = 'Other' THEN 'Guest' ELSE label END AS label FROM b WHERE id = (SELECT min(id) FROM b WHERE label = 'Other')")
def relabelled_blocks(spark, sf):
    log = blocked(spark, sf)
    first = log.filter(F.exists("speaker_blocks", lambda b: b["label"] == "Other")).agg(F.min("id")).first()[0]
    if first is None:
        return spark.createDataFrame([], "id string, seq bigint, chunk_id string, label string")
    return log_store.relabel_all(log, first, "Other", "Guest").select("id", "seq", F.explode("speaker_blocks").alias("b")).select("id", "seq", "b.chunk_id", "b.label")


@query(f"WITH {_BLOCKED} SELECT id, chunk_id, CASE WHEN place = 2 THEN 'Renamed' ELSE label END AS label FROM b WHERE id = (SELECT max(id) FROM b WHERE place = 2)")
def relabelled_block(spark, sf):
    log = blocked(spark, sf)
    last = log.filter(F.size("speaker_blocks") > 1).agg(F.max("id")).first()[0]
    if last is None:
        return spark.createDataFrame([], "id string, chunk_id string, label string")
    return log_store.relabel_one(log, last, 1, "Renamed").select("id", F.explode("speaker_blocks").alias("b")).select("id", "b.chunk_id", "b.label")


@query(f"WITH m AS (SELECT note_id, max(title) AS title FROM note_meta WHERE note_id IS NOT NULL GROUP BY note_id), n AS (SELECT DISTINCT note_id, 'New ' || note_id AS title FROM chunks WHERE note_id IS NOT NULL) SELECT coalesce(m.note_id, n.note_id) AS note_id, coalesce(n.title, m.title) AS title FROM m FULL JOIN n ON m.note_id = n.note_id")
def titles_edited(spark, sf):
    meta = table(spark, sf, "note_meta").filter("note_id IS NOT NULL").groupBy("note_id").agg(F.max("title").alias("title"))
    edits = chunks(spark, sf).select("note_id").filter("note_id IS NOT NULL").distinct().withColumn("title", F.concat(F.lit("New "), "note_id"))
    return log_store.upsert_meta(meta, edits)


@query("WITH old AS (SELECT min(slug) AS slug FROM speaker_names) SELECT name, slug, created_at FROM speaker_names WHERE slug <> (SELECT slug FROM old) UNION ALL SELECT 'New Person', 'new-person', coalesce(min(created_at), '2024-01-01T00:00:00Z') FROM speaker_names WHERE slug = (SELECT slug FROM old)")
def names_saved(spark, sf):
    names = table(spark, sf, "speaker_names")
    old = names.agg(F.min("slug")).first()[0]
    return read_models.names_in_order(log_store.save_name(names, "New Person", "new-person", "2024-01-01T00:00:00Z", old)).select("name", "slug", "created_at")


# Lists


@query(f"WITH {_LIVE} SELECT id, created_at, CAST(row_number() OVER (ORDER BY created_at DESC, first_seq) AS INTEGER) AS place FROM alive ORDER BY place LIMIT 6")
def recent_six(spark, sf):
    items = read_models.recent(read_models.list_summaries(records(spark, sf, *SUMMARY)).select("id", "created_at", "first_seq"))
    return items.select("id", "created_at", F.row_number().over(Window.orderBy(F.desc("created_at"), "first_seq")).alias("place"))  # six rows


@query(f"WITH {_LIVE} SELECT id, kind FROM alive WHERE kind = 'transcribe'")
def of_kind(spark, sf):
    return read_models.of_kind(alive(spark, sf, "kind"), "upload").select("id", "kind")


@query("SELECT DISTINCT note_id, list_slice(coalesce(tags, []), 1, 3) AS tags FROM note_meta WHERE len(list_intersect(tags, ['team', 'work'])) > 0")
def with_any_tag(spark, sf):
    return read_models.previews(read_models.with_any_tag(table(spark, sf, "note_meta"), ["team", "work"])).select("note_id", "tags").distinct()


@query("SELECT note_id, starts_with(note_id, 'md::') OR starts_with(note_id, 'dictate::') AS legacy FROM (SELECT 'md::' || doc_id AS note_id FROM documents UNION ALL SELECT note_id FROM documents WHERE note_id IS NOT NULL)")
def legacy_ids(spark, sf):
    docs = table(spark, sf, "documents")
    ids = docs.select(F.concat(F.lit("md::"), F.col("doc_id").cast("string")).alias("note_id")).unionAll(docs.select("note_id").filter("note_id IS NOT NULL"))
    return ids.select("note_id", read_models.legacy_id(F.col("note_id")).alias("legacy"))


@query(f"WITH {_LIVE}, placed AS (SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after, row_number() OVER w AS n FROM alive WINDOW w AS (ORDER BY created_at DESC, id)) SELECT id, before, after FROM placed WHERE id = (SELECT max(id) FROM alive)")
def note_neighbours(spark, sf):
    items = alive(spark, sf, "created_at").select("id", "created_at")
    key = items.agg(F.max("id")).first()[0]
    before, after = read_models.neighbours(items, key) if key else (None, None)
    return spark.createDataFrame([(key, before, after)] if key else [], "id string, before string, after string")


_TITLE = "strftime(CAST(created_at AS TIMESTAMPTZ), '%H:%M %d/%m/%y')"
_SOME = "coalesce(len(m.tags), 0) > 0 OR coalesce(len(m.keywords), 0) > 0"


@query(f"""WITH {_LIVE}, named AS (SELECT *, CASE WHEN kind = 'dictate' THEN {_TITLE} ELSE title END AS t FROM alive WHERE TRY_CAST(created_at AS TIMESTAMPTZ) IS NOT NULL),
    judged AS (SELECT id, {s_trim("coalesce(written_content, '')")} = '' AND coalesce(len(segments), 0) = 0 AND t = {_TITLE} AS empty, kind = 'scribe' AS recording, duration_ms > 60000 AS described FROM named)
    SELECT id, empty, CASE WHEN recording THEN 'keep' WHEN empty AND described THEN 'prompt' WHEN empty THEN 'delete' ELSE 'keep' END AS action FROM judged""")
def leave_guards(spark, sf):
    rows = alive(spark, sf, "kind", "title", "created_at", "segments", "written_content", "duration_ms").filter(score.instant(F.col("created_at")).isNotNull())
    title = F.when(F.col("kind") == "dictate", F.date_format(score.instant(F.col("created_at")), "HH:mm dd/MM/yy")).otherwise(F.col("title"))
    empty = read_models.empty_note(F.col("written_content"), F.col("segments"), title, F.col("created_at"))
    return rows.select("id", empty.alias("empty"), read_models.leave_guard(F.col("kind") == "scribe", empty, F.col("duration_ms") > 60_000).alias("action"))


@query("SELECT c_custkey, CASE WHEN e.p IS NOT NULL THEN least(greatest(e.p, 0), 1) ELSE 0 END AS progress, CASE WHEN e.p IS NOT NULL THEN 'processing' ELSE 'queued' END AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice / 200000, o_orderkey) AS p FROM orders GROUP BY o_custkey) e ON o_custkey = c_custkey")
def queue_updates(spark, sf):
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("progress"), F.lit("queued").alias("status"))
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("item_id"), (F.col("o_totalprice") / 200_000).cast("double").alias("progress"), F.col("o_orderkey").alias("seq"))
    return read_models.apply_progress(items, events).select(F.col("id").alias("c_custkey"), "progress", "status")


@query(f"WITH {_ALIGNED} SELECT recording_id, id, label FROM turns WHERE label = 'You' OR label = 'Other'")
def own_turns(spark, sf):
    return read_models.own_turns(turns(spark, sf), "Other", True).select("recording_id", "id", "label")


# Labels and texts


@query("SELECT vec_id, 'Speaker ' || (label + 1) AS label, CASE WHEN label = 0 THEN 'Me' WHEN label = 1 THEN 'Them' ELSE 'S' || label END AS shown FROM embeddings")
def speaker_labels(spark, sf):
    raw = F.when(F.col("label") == 0, "In").when(F.col("label") == 1, "Out").otherwise(F.concat(F.lit("S"), F.col("label").cast("string")))
    return table(spark, sf, "embeddings").select("vec_id", text.speaker_label(F.col("label")).alias("label"), text.display_label(raw, "Me", "Them").alias("shown"))


@query("SELECT s_suppkey, regexp_replace(regexp_replace(regexp_extract('/models/ggml-' || s_name || '.v2.bin', '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), 'ggml-', '') AS model FROM supplier")
def model_labels(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", text.model_label(F.concat(F.lit("/models/ggml-"), "s_name", F.lit(".v2.bin"))).alias("model"))


@query(f"WITH {_LIVE} SELECT id, CASE kind WHEN 'dictate' THEN 'Dictate' WHEN 'transcribe' THEN 'Upload' WHEN 'written' THEN 'Written' ELSE 'Scribe' END AS kind, CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s // 60 > 0 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM (SELECT id, kind, greatest(duration_ms // 1000, 0) AS s FROM alive)")
def kinds_and_durations(spark, sf):
    return alive(spark, sf, "kind", "duration_ms").select("id", text.kind_label(F.col("kind")).alias("kind"), text.duration_text(F.col("duration_ms") / 1000).alias("duration"))


@query(f"WITH {_LIVE}, said AS (SELECT id, array_to_string(list_filter(list_transform(segments, lambda s: {s_cleanup('s.text')}), lambda t: t <> ''), ' ') AS t FROM alive WHERE kind = 'dictate') SELECT id, len({s_words('t')}) AS n FROM said")
def dictation_words(spark, sf):
    """Words of the cleaned dictations before repeats are dropped."""
    rows = alive(spark, sf, "kind", "segments").filter("kind = 'dictate'")
    joined = F.array_join(F.filter(F.transform("segments", lambda s: text.cleanup_text(s["text"])), lambda t: t != ""), " ")
    return rows.select("id", text.word_count(joined).cast("bigint").alias("n"))


_JOINED = f"joined AS (SELECT id, array_to_string(list_filter(list_transform(segments, lambda s: {s_cleanup('s.text')}), lambda t: t <> ''), ' ') AS x FROM alive WHERE kind = 'dictate')"
_HALVES = f"halves AS (SELECT id, x, {s_trim('x')} AS t FROM joined), halved AS (SELECT id, CASE WHEN length(t) > 0 AND {s_trim('substring(t, 1, length(t) // 2)')} = {s_trim('substring(t, length(t) // 2 + 1)')} THEN {s_trim('substring(t, 1, length(t) // 2)')} ELSE x END AS text FROM halves)"


@query(f"WITH RECURSIVE {_LIVE}, {_JOINED}, {_HALVES}, {fold_sql.phrases('halved', 'id', 'text')} SELECT id, {s_block('text')} AS text FROM said")
def dictation_texts(spark, sf):
    rows = alive(spark, sf, "kind", "segments").filter("kind = 'dictate'")
    return rows.select("id", transcript.dictation_text(F.transform("segments", lambda s: s["text"])).alias("text"))


@query("SELECT o_orderkey, CAST(o_orderkey % 400 AS INTEGER) AS days FROM orders")
def days_parsed(spark, sf):
    days = table(spark, sf, "orders").select("o_orderkey", F.concat((F.col("o_orderkey") % 400).cast("string"), F.lit("d")).alias("since"))
    return days.select("o_orderkey", text.days(F.col("since")).alias("days"))


# Signals


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(n, lambda v: v * v))), 6) AS length, round(n[1], 6) + 0::DOUBLE AS first FROM (SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w)))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) WHERE list_sum(list_transform(x, lambda v: v * v)) > 0)")
def unit_vectors(spark, sf):
    unit = score.l2_normalize(F.col("embedding"))
    rows = table(spark, sf, "embeddings").filter(score.dot(score.doubles(F.col("embedding")), score.doubles(F.col("embedding"))) > 0).select("vec_id", unit.alias("n"))
    return rows.select("vec_id", F.round(F.sqrt(score.dot(F.col("n"), F.col("n"))), 6).alias("length"), (F.round(F.col("n")[0], 6) + F.lit(0.0)).alias("first"))


@query("SELECT event_id, CAST(floor(event_id * 1000 / 16000) AS BIGINT) AS ms FROM events")
def sample_times(spark, sf):
    return table(spark, sf, "events").select("event_id", signal.samples_to_ms(F.col("event_id")).alias("ms"))


@query("SELECT vec_id, len(embedding) >= 64 AND len(list_filter(embedding, lambda v: isfinite(v))) = len(embedding) AS usable, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)) / len(embedding)) >= 0.001 AS signal FROM embeddings")
def usable_pcm(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", signal.usable_pcm(v, 64).alias("usable"), signal.has_signal(v).alias("signal"))


@query("""SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN i >= 100 AND i < 150 THEN x[i - 100 + 1] WHEN i >= 10 AND i < 74 THEN x[i - 10 + 1] ELSE 0 END + 0::DOUBLE AS sample
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(0, 150)) AS i FROM embeddings)""")
def assembled_pcm(spark, sf):
    pieces = F.array(F.struct(F.lit(10).alias("start"), F.col("embedding").alias("pcm")), F.struct(F.lit(100).alias("start"), F.col("embedding").alias("pcm")))
    line = signal.assembled(pieces, F.lit(150))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(line).alias("i", "x")).select("vec_id", "i", (F.col("x") + F.lit(0.0)).alias("sample"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(x[2 * i + 1], 6) + 0::DOUBLE AS sample FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)")
def packets_at_rate(spark, sf):
    packets = table(spark, sf, "embeddings").select("vec_id", F.lit(32_000).alias("native_rate"), F.col("embedding").alias("samples"))
    return at_rate(packets).select("vec_id", F.posexplode("samples").alias("i", "x")).select("vec_id", "i", (F.round(F.col("x").cast("double"), 6) + F.lit(0.0)).alias("sample"))


@query("SELECT event_id, 1000 + least(greatest(a, 0), 500) AS start_ms, 1000 + greatest(least(greatest(z, 0), 500), least(greatest(a, 0), 500)) AS end_ms FROM (SELECT event_id, event_id % 700 - 100 AS a, event_id % 900 - 200 AS z FROM events)")
def retimed_segments(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.lit(1000).cast("bigint").alias("offset_ms"), F.lit(500).cast("bigint").alias("phrase_ms"), (F.col("event_id") % 700 - 100).alias("start_ms"), (F.col("event_id") % 900 - 200).alias("end_ms"))
    return retimed(rows).select("event_id", "start_ms", "end_ms")


@query("SELECT CAST(vec_id AS VARCHAR) AS recording_id, 'Speaker ' || (s + 1) AS label, s * 32 AS start_ms, s * 32 + 32 AS end_ms FROM embeddings, (SELECT unnest([0, 1]) AS s)")
def hooked_ranges(spark, sf):
    """A stand-in diarizer that hears a speaker in each half."""
    pcm = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("recording_id"), F.col("embedding").alias("pcm"))
    return labelled_ranges(diarize(pcm, lambda v: [(0, 0, len(v) // 2), (1, len(v) // 2, len(v))]))


@query("SELECT CAST(vec_id AS VARCHAR) AS recording_id, 0 AS pos, CASE source WHEN 'mic' THEN 64 ELSE 32 END AS start_ms, 100 AS end_ms, source || ' line' AS text, source FROM embeddings, (SELECT unnest(['mic', 'speaker']) AS source)")
def hooked_lines(spark, sf):
    """A stand-in recogniser that starts a line at the number of samples; both channels merged."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("recording_id"), F.explode(F.array(F.lit("mic"), F.lit("speaker"))).alias("channel"), "embedding")
    pcm = rows.withColumn("pcm", F.when(F.col("channel") == "mic", F.col("embedding")).otherwise(F.slice("embedding", 1, 32))).select("recording_id", "channel", "pcm")
    return transcribe_both(pcm, lambda v: [(len(v), 100, "mic line" if len(v) == 64 else "speaker line")])


@query(PHRASES)
def phrase_stream(spark, sf):
    """The packets of every session as a stream; the same phrases as the batch replay."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    loud = F.when(F.col("value") > 20, F.lit(0.5)).otherwise(F.lit(0.0))
    packets = table(spark, sf, "events").filter("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("session_id"), (F.row_number().over(w) - 1).cast("bigint").alias("packet_no"), F.array_repeat(loud, 512).cast("array<float>").alias("samples"), F.lead("event_id").over(w).isNull().alias("is_end"))
    path, out, state = (scratch(spark, f"phrases-{x}") for x in ("packets", "out", "state"))
    packets.write.parquet(path)
    stream = phrases_stream(spark.readStream.schema(packets.schema).parquet(path), limits=Limits(step=512, least=2048, quiet=2))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(PHRASE).parquet(out)


# Progress


@query("SELECT event_id, round(0.05 + least(greatest(value / 100, 0), 1) * 0.95, 6) AS decoded, round(least(greatest(value / 100, 0), 1) * CASE WHEN event_type = 'click' THEN 0.85 ELSE 1 END, 6) AS beside, round(least(greatest(value / 100, 0), 1) / 2 + CASE WHEN event_type = 'view' THEN 0.5 ELSE 0 END, 6) AS half, CASE WHEN value / 100 < 0.01 THEN 0 ELSE round(pow(least(greatest(value / 100 * 2.4, 0), 1), 0.52), 6) END AS meter FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL")
def progress_maps(spark, sf):
    p = F.col("value") / 100
    rows = table(spark, sf, "events").filter("value IS NOT NULL AND event_type IS NOT NULL")
    return rows.select(
        "event_id", F.round(progress.after_decoding(p), 6).alias("decoded"), F.round(progress.beside_diarization(p, F.col("event_type") == "click"), 6).alias("beside"),
        F.round(progress.half(p, F.col("event_type") == "view"), 6).alias("half"), F.round(progress.meter_height(p), 6).alias("meter"),
    )


@query("""SELECT o_custkey, o_orderkey, round((cum - q) / total, 6) AS band_start, CASE WHEN last THEN 1.0::DOUBLE ELSE round(cum / total, 6) END AS band_end, most FROM (
    SELECT o_custkey, o_orderkey, q, sum(q) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS cum, sum(q) OVER (PARTITION BY o_custkey) AS total,
        lead(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NULL AS last, max(q) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS most FROM (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS q FROM orders))""")
def progress_bands(spark, sf):
    q = F.floor("o_totalprice").cast("bigint")
    stages = table(spark, sf, "orders").select("o_custkey", "o_orderkey", q.alias("q"), q.alias("most"))
    made = progress.bands(progress.monotone(stages, "o_custkey", "o_orderkey", "most"), "o_custkey", "o_orderkey", "q")
    return made.select("o_custkey", "o_orderkey", F.round("band_start", 6).alias("band_start"), F.round("band_end", 6).alias("band_end"), "most")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, lag(p) OVER w AS before, lag(ms) OVER w AS earlier FROM (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) / 4000 AS p, o_orderkey % 2000 AS ms FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    WHERE p >= 100 OR before IS NULL OR abs(p - before) >= 1 OR ms - earlier >= 100""")
def progress_told(spark, sf):
    events = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice").cast("double") / 4000).alias("p"), (F.col("o_orderkey") % 2000).alias("ms"))
    return progress.worth_telling(events, "o_custkey", "o_orderkey", "p", "ms").select("o_custkey", "o_orderkey")


@query("""WITH RECURSIVE r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, least(greatest(CAST(o_totalprice AS DOUBLE) / 100000, 0.2), 5.0) AS x FROM orders),
    f AS (SELECT o_custkey, n, CAST(x AS DOUBLE) AS v FROM r WHERE n = 1 UNION ALL SELECT r.o_custkey, r.n, f.v + (r.x - f.v) * 0.35::DOUBLE FROM f JOIN r ON r.o_custkey = f.o_custkey AND r.n = f.n + 1)
    SELECT o_custkey, round(arg_max(v, n), 6) AS factor FROM f GROUP BY o_custkey""")
def speed_factors(spark, sf):
    ratios = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice").cast("double") / 100_000).alias("r")))).alias("rs"))
    return ratios.select("o_custkey", F.round(progress.speed_factor(F.col("rs.r")), 6).alias("factor"))


@query("""WITH e AS (SELECT DISTINCT user_id, ts, event_id, value FROM events), g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS opens FROM e),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, CAST(max(epoch_us(ts)) + 300000000 AS BIGINT) AS at_us, max(ts) = min(ts) AS alone FROM s WHERE user_id IS NOT NULL GROUP BY user_id, n""")
def debounced_events(spark, sf):
    """The ends of the pauses; several events can share the last moment, so of their values only the number is compared."""
    events = table(spark, sf, "events").filter("user_id IS NOT NULL").withColumn("v", F.col("ts"))
    spans = debounced(events, "user_id", "ts", "v", "5 minutes")
    first = events.groupBy("user_id", F.session_window("ts", "5 minutes").alias("w")).agg(F.min("ts").alias("first")).select("user_id", F.col("w.end").alias("at"), "first")
    joined = spans.join(first, ["user_id", "at"])
    return joined.select("user_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), (F.col("v") == F.col("first")).alias("alone"))
