"""Queries of the record store, transcript flow, retrieval and read models over whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import signal, text
from loomline.functions.score import cosine, recency
from loomline.functions.text import NOISE_TAGS, SILENCE_PHRASES, STOP_WORDS
from loomline.operators import chunking, log_store, read_models, transcript
from loomline.operators.search import SearchOptions, score, search, since
from loomline.plans import fold_sql
from loomline.schemas import REQUIRED
from loomline.session import scratch, table
from loomline.sources.records import read_log
from loomline.streaming.phrases import Limits, phrases_batch

NOW = "2024-06-12T12:00:00Z"
QUERY = "budget review of the crop harvest and the ledger audit"

#: Unicode White_Space as a class of DuckDB's regular expressions.
WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def s_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def s_collapse(x: str) -> str:
    return s_trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def s_cleanup(x: str) -> str:
    tags = "|".join(NOISE_TAGS)
    x = f"regexp_replace({x}, '\\[[A-Z][A-Za-z_ ]*\\]', '', 'g')"
    x = f"regexp_replace({x}, '(?i)\\[({tags})\\]', '', 'g')"
    x = f"regexp_replace({x}, '(?i)(#[\\p{{L}}\\p{{N}}_]+?)(newline)', '\\1 \\2', 'g')"
    return s_collapse(x)


def s_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def s_mmss(x: str) -> str:
    s = f"greatest(CAST(floor({x} / 1000.0) AS BIGINT), 0)"
    return f"(lpad(CAST({s} // 60 AS VARCHAR), CAST(greatest(length(CAST({s} // 60 AS VARCHAR)), 2) AS INTEGER), '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0'))"


_USABLE = f"SELECT DISTINCT * FROM history_log WHERE seq IS NOT NULL AND kind IN ('scribe', 'dictate', 'transcribe', 'written') AND {' AND '.join(f'{c} IS NOT NULL' for c in REQUIRED)}"
_STATE = f"ok AS ({_USABLE}), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, coalesce(deleted, false) DESC) AS n, min(seq) OVER (PARTITION BY id) AS first_seq FROM ok), state AS (SELECT * FROM ranked WHERE n = 1)"
_LIVE = f"{_STATE}, alive AS (SELECT * FROM state WHERE NOT coalesce(deleted, false))"
_LINES = "lines AS (SELECT DISTINCT recording_id, channel, pos, start_ms, end_ms, text, source, speaker FROM asr_segments WHERE recording_id IS NOT NULL AND pos IS NOT NULL)"
_TURNS = "turns AS (SELECT DISTINCT recording_id, id, start_ms, end_ms, label FROM speaker_chunks WHERE recording_id IS NOT NULL)"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def s_neighbours(source: str, same: str, order: str, gap: int | None = None) -> str:
    """Neighbours with equal ``same`` as one row."""
    far = f" OR coalesce(start_ms - lag(end_ms) OVER w >= {gap}, true)" if gap is not None else ""
    return f"""
        marked AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR lag({same}) OVER w IS DISTINCT FROM {same}{far} THEN 1 ELSE 0 END AS opens FROM {source} WINDOW w AS (PARTITION BY recording_id ORDER BY {order})),
        isles AS (SELECT *, sum(opens) OVER (PARTITION BY recording_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS isle FROM marked)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    return log_store.usable(table(spark, sf, "history_log"))


def records(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return log_store.replay(history(spark, sf), list(columns))


#: Columns of a record that the lists need.
SUMMARY = ["kind", "created_at", "title", "model", "word_count", "duration_ms", "written_content", "segments", "markdown_path"]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.distinct_lines(table(spark, sf, "asr_segments"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "speaker_chunks").select("recording_id", "id", "start_ms", "end_ms", "label").filter("recording_id IS NOT NULL").distinct()


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_STATE} SELECT id, seq, first_seq, kind, title, coalesce(deleted, false) AS deleted FROM state")
def lww_replay(spark, sf):
    return records(spark, sf, "kind", "title").select("id", "seq", "first_seq", "kind", "title", F.coalesce("deleted", F.lit(False)).alias("deleted"))


@query(f"WITH {_LIVE} SELECT id, kind, title, word_count, len(segments) AS n_segments FROM alive")
def log_scan(spark, sf):
    """The log as text in its order, without numbers and with lines that aren't JSON between; read back and replayed."""
    log = table(spark, sf, "history_log").filter("seq IS NOT NULL").distinct().orderBy("seq")
    path = scratch(spark, "log")
    log.select(F.explode(F.array(F.to_json(F.struct(*[c for c in log.columns if c != "seq"])), F.lit('{"id": "cut'), F.lit(" "))).alias("value")).write.text(path)
    good, _ = read_log(spark, path)
    return log_store.live(log_store.replay(good)).select("id", "kind", "title", "word_count", F.size("segments").cast("bigint").alias("n_segments"))


@query(f"WITH {_LIVE} SELECT id, kind, created_at, title, duration_ms, word_count FROM alive")
def live_records(spark, sf):
    return log_store.live(records(spark, sf, "kind", "created_at", "title", "duration_ms", "word_count")).select("id", "kind", "created_at", "title", "duration_ms", "word_count")


@query(f"""WITH {_LIVE}, meta AS (SELECT note_id, max(title) AS title, count(DISTINCT coalesce(title, '')) AS k FROM note_meta WHERE note_id IS NOT NULL GROUP BY note_id)
    SELECT id, CASE WHEN {s_trim("m.title")} <> '' THEN m.title ELSE a.title END AS title FROM alive a LEFT JOIN meta m ON a.id = m.note_id""")
def sidecar_hydrate(spark, sf):
    return log_store.hydrate(log_store.live(records(spark, sf, "title")), table(spark, sf, "note_meta")).select("id", "title")


def s_excerpt(x: str) -> str:
    return f"CASE WHEN length({x}) > 120 THEN substring({x}, 1, 120) || '…' ELSE {x} END"


@query(f"""WITH {_LIVE}, parts AS (
        SELECT *, {s_trim("coalesce(written_content, '')")} AS body, coalesce(list_filter(list_transform(segments, lambda s: {s_collapse("s.text")}), lambda t: t <> '')[1], '') AS said FROM alive)
    SELECT id, kind, created_at, title, model, word_count, duration_ms // 1000 AS duration_secs, CASE WHEN kind = 'written' AND body <> '' THEN {s_excerpt("body")} ELSE {s_excerpt("said")} END AS excerpt,
        markdown_path IS NOT NULL AS has_markdown, 'store' AS source FROM parts""")
def list_summaries(spark, sf):
    return read_models.list_summaries(records(spark, sf, *SUMMARY)).select(*read_models.ITEM)


@query(f"""WITH {_LIVE}, parts AS (
        SELECT *, {s_trim("coalesce(written_content, '')")} AS body, coalesce(list_filter(list_transform(segments, lambda s: {s_collapse("s.text")}), lambda t: t <> '')[1], '') AS said FROM alive),
    files AS (SELECT coalesce(save_folder, '') || '/' || doc_id || '.md' AS path, created_at AS modified_at FROM documents),
    store AS (SELECT id, kind, created_at, title, word_count, CASE WHEN kind = 'written' AND body <> '' THEN {s_excerpt("body")} ELSE {s_excerpt("said")} END AS excerpt, 'store' AS source FROM parts),
    md AS (SELECT 'md::' || path AS id, 'scribe' AS kind, modified_at AS created_at, path AS title, 0 AS word_count, '' AS excerpt, 'legacymarkdown' AS source FROM files WHERE path NOT IN (SELECT markdown_path FROM alive WHERE markdown_path IS NOT NULL)),
    old AS (SELECT 'dictate::' || item_id AS id, 'dictate' AS kind, benchmark AS created_at,
        CASE WHEN regexp_replace(array_to_string({s_words("text")}[1:8], ' '), '[^\\p{{L}}\\p{{N}}]+$', '') = '' THEN 'Dictation' ELSE regexp_replace(array_to_string({s_words("text")}[1:8], ' '), '[^\\p{{L}}\\p{{N}}]+$', '') END AS title,
        len({s_words("text")}) AS word_count, {s_excerpt(s_collapse("text"))} AS excerpt, 'legacydictate' AS source FROM eval_items)
    SELECT * FROM store UNION ALL SELECT * FROM md UNION ALL SELECT * FROM old""")
def unified_list(spark, sf):
    path = F.concat(F.coalesce("save_folder", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    files = table(spark, sf, "documents").select(path.alias("path"), path.alias("title"), F.lit("").alias("model"), F.col("created_at").alias("modified_at"))
    entries = table(spark, sf, "eval_items").select(F.col("item_id").cast("string").alias("id"), F.col("benchmark").alias("timestamp"), "text")
    return read_models.unified_list(records(spark, sf, *SUMMARY), files, entries).select("id", "kind", "created_at", "title", "word_count", "excerpt", "source")


@query(f"""WITH {_LIVE}, tags AS (SELECT unnest(tags) AS t FROM (SELECT DISTINCT note_id, tags FROM note_meta WHERE note_id IN (SELECT id FROM alive)))
    SELECT {s_trim("t")} AS tag, count(*) AS count FROM tags WHERE {s_trim("t")} <> '' GROUP BY tag""")
def tag_vocabulary(spark, sf):
    return read_models.by_name(read_models.tag_vocabulary(table(spark, sf, "note_meta"), records(spark, sf)))


@query(f"""WITH {_LIVE} SELECT CAST(sum(greatest(duration_ms // 1000, 0)) AS BIGINT) AS week_secs FROM (SELECT duration_ms, CAST(created_at AS TIMESTAMPTZ) AS d FROM alive)
    WHERE isoyear(d) = 2024 AND weekofyear(d) = 24 AND year(d) = 2024""")
def iso_week_total(spark, sf):
    alive = log_store.live(records(spark, sf, "created_at", "duration_ms"))
    return read_models.recorded_this_week(alive.select("created_at", F.expr("duration_ms div 1000").alias("duration_secs")), NOW)


@query(f"WITH {_LIVE} SELECT count(*) AS notes, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("scribe", "dictate", "transcribe", "written")) + " FROM alive")
def counts_by_kind(spark, sf):
    return read_models.counts_by_kind(records(spark, sf, "kind"))


@query("""SELECT note_id, len(coalesce(tags, [])) > 0 OR len(coalesce(keywords, [])) > 0 OR len(coalesce(layer_item_ids, [])) > 0 AS described FROM (SELECT DISTINCT * FROM note_meta)""")
def has_metadata(spark, sf):
    meta = table(spark, sf, "note_meta").distinct()
    return meta.select("note_id", read_models.has_metadata(meta).alias("described"))


@query(f"""WITH {_LINES} SELECT count(*) AS n, CAST(sum(greatest(end_ms - start_ms, 0)) // count(end_ms - start_ms) AS BIGINT) AS avg_ms,
    min(greatest(end_ms - start_ms, 0)) AS min_ms, max(greatest(end_ms - start_ms, 0)) AS max_ms FROM lines WHERE end_ms IS NOT NULL AND start_ms IS NOT NULL""")
def segment_granularity(spark, sf):
    return transcript.granularity(lines(spark, sf))


_ALIGNED = f"""{_LINES}, {_TURNS}, pairs AS (
        SELECT l.recording_id, l.pos, t.label, sum(least(l.end_ms, t.end_ms) - greatest(l.start_ms, t.start_ms, 0)) AS o
        FROM lines l JOIN turns t ON l.recording_id = t.recording_id AND greatest(l.start_ms, 0) < t.end_ms AND greatest(t.start_ms, 0) < l.end_ms
        WHERE l.end_ms > l.start_ms AND t.end_ms > t.start_ms AND t.label IS NOT NULL GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY recording_id, pos ORDER BY o DESC, TRY_CAST(regexp_extract(label, '^Speaker ([1-9][0-9]*)$', 1) AS BIGINT) NULLS LAST, label) AS n FROM pairs)"""


@query(f"""WITH {_ALIGNED} SELECT l.recording_id, l.pos, coalesce(label, 'Other') AS label, CAST(coalesce(o, 0) AS BIGINT) AS overlap_ms FROM lines l LEFT JOIN best b ON l.recording_id = b.recording_id AND l.pos = b.pos AND n = 1""")
def speaker_align(spark, sf):
    return transcript.align_speakers(lines(spark, sf), turns(spark, sf))


@query(f"""WITH {_TURNS}, src AS (SELECT * FROM turns WHERE start_ms IS NOT NULL), {s_neighbours("src", "label", "start_ms, id")}
    SELECT recording_id, label, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, id)) FILTER (end_ms IS NOT NULL) AS end_ms, count(*) AS n_lines FROM isles GROUP BY recording_id, isle, label""")
def speaker_turns(spark, sf):
    return transcript.label_turns(turns(spark, sf)).select("recording_id", "label", "start_ms", "end_ms", "n_lines")


@query(f"""WITH {_LINES}, src AS (SELECT *, {s_trim("text")} AS t, CASE WHEN source = 'speaker' THEN 'Out' ELSE 'In' END AS label FROM lines WHERE start_ms IS NOT NULL AND {s_trim("text")} <> ''), {s_neighbours("src", "label", "start_ms, pos")}
    SELECT recording_id, label, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, pos)) FILTER (end_ms IS NOT NULL) AS end_ms, count(*) AS n_lines, string_agg(t, ' ' ORDER BY start_ms, pos) AS text FROM isles GROUP BY recording_id, isle, label""")
def channel_blocks(spark, sf):
    return transcript.channel_blocks(lines(spark, sf)).select("recording_id", "label", "start_ms", "end_ms", "n_lines", "text")


@query(f"""WITH {_LINES}, src AS (SELECT recording_id, pos, start_ms, end_ms, CASE WHEN source = 'speaker' THEN 'speaker' ELSE 'mic' END AS channel_key, {s_cleanup("text")} AS t FROM lines WHERE start_ms IS NOT NULL AND {s_cleanup("text")} <> ''), {s_neighbours("src", "channel_key", "start_ms, pos", 8000)}
    SELECT recording_id, channel_key, min(start_ms) AS start_ms, count(*) AS n_lines, string_agg(t, ' ' ORDER BY start_ms, pos) AS text FROM isles GROUP BY recording_id, isle, channel_key""")
def paragraphs(spark, sf):
    return transcript.paragraphs(lines(spark, sf)).select("recording_id", "channel_key", "start_ms", "n_lines", "text")


@query(f"""WITH RECURSIVE {_LINES}, src AS (SELECT recording_id, pos, start_ms, end_ms, coalesce({s_trim("text")}, '') AS text, CASE WHEN channel = 'speaker' THEN 'speaker' ELSE 'mic' END AS source,
        row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, coalesce(channel = 'speaker', false), pos) AS n FROM lines WHERE start_ms IS NOT NULL),
    walk AS (SELECT *, text AS last, start_ms AS at, true AS keep FROM src WHERE n = 1
        UNION ALL SELECT s.*, CASE WHEN near THEN w.last ELSE s.text END, CASE WHEN near THEN w.at ELSE s.start_ms END, NOT near
        FROM walk w JOIN src s ON s.recording_id = w.recording_id AND s.n = w.n + 1, LATERAL (SELECT ends_with(w.last, s.text) AND abs(s.start_ms - w.at) <= 1500 AS near))
    SELECT recording_id, pos, start_ms, end_ms, text, source FROM walk WHERE keep""")
def dual_merge(spark, sf):
    return transcript.merge_channels(lines(spark, sf))


def s_block(x: str) -> str:
    """A text cut where its opening comes again."""
    mark = f"lower(substring({x}, 1, greatest(least(length({x}) // 5, 100), 20)))"
    hit = f"strpos(lower(substring({x}, length({x}) // 2 + 1)), {mark})"
    return f"CASE WHEN length({x}) >= 120 AND {hit} > 0 THEN regexp_replace(substring({x}, 1, length({x}) // 2 + {hit} - 1), '{WS}+$', '') ELSE {x} END"


def s_hms(x: str) -> str:
    s = f"greatest(CAST(floor({x} / 1000.0) AS BIGINT), 0)"
    two = lambda v: f"lpad(CAST({v} AS VARCHAR), CAST(greatest(length(CAST({v} AS VARCHAR)), 2) AS INTEGER), '0')"
    return f"({two(f'({s} // 3600)')} || ':' || {two(f'({s} % 3600 // 60)')} || ':' || {two(f'({s} % 60)')})"


@query(f"""WITH RECURSIVE {_LINES}, raw AS (SELECT {{'r': recording_id, 'p': pos}} AS k, {s_cleanup("text")} AS text FROM lines WHERE start_ms IS NOT NULL), {fold_sql.phrases("raw", "k", "text")},
    src AS (SELECT recording_id, pos, start_ms, end_ms, CASE WHEN source = 'speaker' THEN 'speaker' ELSE 'mic' END AS channel_key, {s_block("s.text")} AS t FROM lines l JOIN said s ON s.k.r = l.recording_id AND s.k.p = l.pos WHERE {s_block("s.text")} <> ''), {s_neighbours("src", "channel_key", "start_ms, pos", 8000)},
    parts AS (SELECT recording_id, isle, min(start_ms) AS began, string_agg(t, ' ' ORDER BY start_ms, pos) AS t FROM isles GROUP BY recording_id, isle)
    SELECT recording_id, string_agg('[' || {s_hms("began")} || '] ' || t, chr(10) || chr(10) ORDER BY isle) AS body, CAST(sum(len({s_words("t")})) AS BIGINT) AS word_count FROM parts GROUP BY recording_id""")
def transcript_bodies(spark, sf):
    return transcript.render_bodies(lines(spark, sf), timestamps=True)


@query(f"""WITH RECURSIVE {_ALIGNED}, src AS (SELECT l.recording_id, l.pos, l.start_ms, l.end_ms, coalesce(b.label, 'Other') AS label, {s_trim("l.text")} AS t FROM lines l LEFT JOIN best b ON l.recording_id = b.recording_id AND l.pos = b.pos AND n = 1 WHERE l.start_ms IS NOT NULL AND {s_trim("l.text")} <> ''), {s_neighbours("src", "label", "start_ms, pos")},
    blocks AS (SELECT recording_id, isle, label, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, pos)) FILTER (end_ms IS NOT NULL) AS end_ms, string_agg(t, ' ' ORDER BY start_ms, pos) AS t FROM isles GROUP BY recording_id, isle, label),
    raw AS (SELECT {{'r': recording_id, 'i': isle}} AS k, {s_cleanup("t")} AS text FROM blocks), {fold_sql.phrases("raw", "k", "text")},
    heads AS (SELECT b.recording_id, isle, '**[' || label || ']**' || CASE WHEN end_ms IS NOT NULL THEN ' · ' || {s_mmss("start_ms")} || '–' || {s_mmss("end_ms")} ELSE '' END || chr(10) || chr(10) AS head, {s_block("s.text")} AS clean FROM blocks b JOIN said s ON s.k.r = b.recording_id AND s.k.i = b.isle)
    SELECT recording_id, coalesce(string_agg(CASE WHEN clean <> '' THEN CASE WHEN isle = 1 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END || head || clean END, '' ORDER BY isle), '') AS body FROM heads GROUP BY recording_id""")
def speaker_bodies(spark, sf):
    return transcript.render_speaker_bodies(transcript.aligned_blocks(lines(spark, sf), turns(spark, sf)))


@query(f"""WITH {_LINES} SELECT recording_id, pos, text FROM lines WHERE text IS NOT NULL AND lower({s_trim("text")}) NOT IN ('', {", ".join(f"'{p}'" for p in SILENCE_PHRASES)})
    AND NOT lower({s_trim("text")}) LIKE 'transcribed by%' AND NOT lower({s_trim("text")}) LIKE 'subtitles by%' AND NOT regexp_matches(lower({s_trim("text")}), '^\\[{WS}*({"|".join(NOISE_TAGS)}){WS}*\\]$')""")
def hallucination_filter(spark, sf):
    return transcript.drop_silence_phrases(lines(spark, sf)).select("recording_id", "pos", "text")


@query(f"WITH {_LINES} SELECT recording_id, pos, {s_cleanup('text')} AS text FROM lines")
def cleanup_text(spark, sf):
    return lines(spark, sf).select("recording_id", "pos", text.cleanup_text(F.col("text")).alias("text"))


@query(f"""WITH t AS (SELECT doc_id, text, {s_trim("text")} AS x FROM documents), h AS (SELECT *, {s_trim("substring(x, 1, length(x) // 2)")} AS a, {s_trim("substring(x, length(x) // 2 + 1)")} AS b FROM t)
    SELECT doc_id, CASE WHEN length(x) > 0 AND a = b THEN a ELSE text END AS text FROM h""")
def dedup_halves(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.dedup_exact_halves(F.col("text")).alias("text"))


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n, lower(substring(text, 1, greatest(least(length(text) // 5, 100), 20))) AS mark FROM documents),
    p AS (SELECT *, strpos(lower(substring(text, n // 2 + 1)), mark) AS hit FROM t)
    SELECT doc_id, CASE WHEN n >= 120 AND hit > 0 THEN regexp_replace(substring(text, 1, n // 2 + hit - 1), '""" + WS + """+$', '') ELSE text END AS text FROM p""")
def dedup_block(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.dedup_repeated_block(F.col("text")).alias("text"))


@query(f"""WITH RECURSIVE {_LINES}, src AS (SELECT {{'r': recording_id, 'p': pos}} AS k, text FROM lines), {fold_sql.phrases("src", "k", "text")}
    SELECT l.recording_id, l.pos, s.text FROM lines l LEFT JOIN said s ON s.k.r = l.recording_id AND s.k.p = l.pos""")
def dedup_phrases(spark, sf):
    return lines(spark, sf).select("recording_id", "pos", text.dedup_consecutive_phrases("text").alias("text"))


def s_stem(x: str) -> str:
    ends = "".join(f" WHEN ends_with({x}, '{e}') AND strlen({x}) > {len(e) + 3} THEN substring({x}, 1, length({x}) - {len(e)})" for e in ("ing", "ed", "es", "s"))
    return f"CASE{ends} ELSE {x} END"


_TERMS = f"""tokens AS (SELECT k, translate(regexp_replace(unnest(string_split_regex(x, '[^\\p{{L}}\\p{{N}}-]+')), '^-+|-+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM texts),
    stems AS (SELECT k, {s_stem("t")} AS term FROM tokens WHERE strlen(t) >= 3 AND t NOT IN ({_STOP})),
    terms AS (SELECT k, term FROM stems GROUP BY k, term HAVING count(*) > 1 OR strlen(term) > 4)"""


@query(f"WITH texts AS (SELECT doc_id AS k, text AS x FROM documents), {_TERMS} SELECT k AS doc_id, term FROM terms")
def extract_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(text.extract_terms(F.col("text"))).alias("term"))


@query(f"WITH w AS (SELECT doc_id, {s_words('text')} AS w FROM documents), n AS (SELECT doc_id, w, unnest(range(0, (len(w) + 419) // 420)) AS i FROM w) SELECT doc_id, CAST(i AS INTEGER) AS ordinal, array_to_string(w[i * 420 + 1 : i * 420 + 420], ' ') AS text FROM n")
def chunk_fixed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"))).alias("ordinal", "text"))


@query(f"""WITH RECURSIVE {_LINES}, src AS (SELECT recording_id AS note_id, start_ms, pos, end_ms, {s_trim("text")} AS text FROM lines WHERE start_ms IS NOT NULL AND {s_trim("text")} <> ''), {fold_sql.filled("src", "note_id", "start_ms, pos", f"len({s_words('text')})", 420)}
    SELECT note_id, CAST(ordinal AS INTEGER) AS ordinal, min(start_ms) AS start_ms, arg_max(end_ms, n) FILTER (end_ms IS NOT NULL) AS end_ms, string_agg(text, ' ' ORDER BY n) AS text FROM filled GROUP BY note_id, ordinal""")
def chunk_greedy(spark, sf):
    rows = lines(spark, sf).filter("start_ms IS NOT NULL").withColumnRenamed("recording_id", "note_id")
    return chunking.fill_chunks(rows, ["start_ms", "pos"])


@query(f"""WITH RECURSIVE src AS (SELECT CAST(doc_id AS VARCHAR) AS note_id, {s_trim("text")} AS t FROM documents WHERE {s_trim("text")} <> ''), {fold_sql.written("src", "note_id", "t", WS, lambda b: f"len({s_words(b)})", 420, 620)}
    SELECT note_id, ordinal, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms, text FROM written""")
def chunk_written(spark, sf):
    return chunking.chunk_written(table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), "text").filter("text IS NOT NULL"))


def s_terms(source: str, key: str) -> str:
    """CTE ``terms`` of each text ``x`` of ``source``."""
    return _TERMS.replace("FROM texts", f"FROM (SELECT {key} AS k, x FROM {source})")


@query(f"""WITH RECURSIVE {_LIVE}, items AS (SELECT id AS note_id, unnest(CASE WHEN len(speaker_blocks) > 0 THEN list_transform(speaker_blocks, lambda b: {{'a': b.start_ms, 'z': b.end_ms, 't': b.text}}) ELSE list_transform(segments, lambda b: {{'a': b.start_ms, 'z': b.end_ms, 't': b.text}}) END) AS x,
        generate_subscripts(CASE WHEN len(speaker_blocks) > 0 THEN list_transform(speaker_blocks, lambda b: 1) ELSE list_transform(segments, lambda b: 1) END, 1) AS i FROM alive WHERE kind IN ('scribe', 'transcribe')),
    src AS (SELECT note_id, i, x.a AS start_ms, x.z AS end_ms, {s_trim("x.t")} AS text FROM items WHERE {s_trim("x.t")} <> ''), {fold_sql.filled("src", "note_id", "i", f"len({s_words('text')})", 420)},
    spoken AS (SELECT note_id, ordinal, arg_min(start_ms, n) AS start_ms, arg_max(end_ms, n) FILTER (end_ms IS NOT NULL) AS end_ms, string_agg(text, ' ' ORDER BY n) AS text FROM filled GROUP BY note_id, ordinal),
    said AS (SELECT id AS note_id, array_to_string(list_filter(list_transform(segments, lambda g: {s_trim("g.text")}), lambda t: t <> ''), ' ') AS t, segments[1].start_ms AS a, segments[-1].end_ms AS z FROM alive WHERE kind = 'dictate'),
    said_w AS (SELECT *, {s_words("t")} AS w FROM said WHERE t <> ''),
    dictated AS (SELECT note_id, 0 AS ordinal, a AS start_ms, z AS end_ms, t AS text FROM said_w WHERE len(w) <= 620
        UNION ALL SELECT note_id, i, NULL, NULL, array_to_string(w[i * 420 + 1 : i * 420 + 420], ' ') FROM (SELECT *, unnest(range(0, (len(w) + 419) // 420)) AS i FROM said_w WHERE len(w) > 620)),
    bodies AS (SELECT id AS note_id, {s_trim("coalesce(written_content, '')")} AS t FROM alive WHERE kind = 'written' AND {s_trim("coalesce(written_content, '')")} <> ''), {fold_sql.written("bodies", "note_id", "t", WS, lambda b: f"len({s_words(b)})", 420, 620)},
    every AS (SELECT note_id, CAST(ordinal AS INTEGER) AS ordinal, start_ms, end_ms, text FROM spoken UNION ALL SELECT note_id, CAST(ordinal AS INTEGER), start_ms, end_ms, text FROM dictated UNION ALL SELECT note_id, ordinal, NULL, NULL, text FROM written),
    keyed AS (SELECT *, note_id || ':' || ordinal AS id, text AS x FROM every), {s_terms("keyed", "id")}, of_chunk AS (SELECT k, list(term ORDER BY term) AS terms FROM terms GROUP BY k),
    meta AS (SELECT note_id, any_value(tags) AS tags FROM (SELECT DISTINCT note_id, tags FROM note_meta WHERE note_id IS NOT NULL AND tags IS NOT NULL) GROUP BY note_id)
    SELECT c.id, c.note_id, a.title AS note_title, a.kind AS note_kind, a.created_at, c.start_ms, c.end_ms, c.text, array_to_string(coalesce(o.terms, []), ' ') AS terms, array_to_string(coalesce(m.tags, []), '|') AS tags
    FROM keyed c JOIN alive a ON a.id = c.note_id LEFT JOIN of_chunk o ON o.k = c.id LEFT JOIN meta m ON m.note_id = c.note_id""")
def build_index(spark, sf):
    index = chunking.build_index(records(spark, sf, "title", "kind", "created_at", "segments", "speaker_blocks", "written_content"), table(spark, sf, "note_meta"))
    return index.drop("vector").withColumns({"terms": F.array_join("terms", " "), "tags": F.array_join("tags", "|")})


_CHUNKS = "c AS (SELECT DISTINCT * FROM chunks)"
_DAYS = f"CAST(floor((epoch_us(TIMESTAMPTZ '{NOW}') - epoch_us(TRY_CAST(created_at AS TIMESTAMPTZ))) / 86400000000.0) AS BIGINT)"
_RECENCY = f"CASE WHEN {_DAYS} IS NULL THEN 0 ELSE pow(0.5, greatest({_DAYS}, 0) / 90.0) END"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").distinct()


@query(f"WITH {_CHUNKS} SELECT id, round({_RECENCY}, 6) AS recency FROM c")
def recency_scores(spark, sf):
    return chunks(spark, sf).select("id", F.round(recency(F.col("created_at"), NOW), 6).alias("recency"))


@query(f"WITH {_CHUNKS} SELECT id, CASE WHEN length(x) > 280 THEN substring(x, 1, 279) || '…' ELSE x END AS snippet FROM (SELECT id, {s_collapse('text')} AS x FROM c)")
def snippets(spark, sf):
    return chunks(spark, sf).select("id", text.snippet(F.col("text")).alias("snippet"))


@query(f"WITH {_CHUNKS} SELECT id, CASE WHEN start_ms IS NOT NULL THEN {s_mmss('start_ms')} || '-' || {s_mmss('coalesce(end_ms, start_ms)')} END AS anchor FROM c")
def timestamp_anchors(spark, sf):
    return chunks(spark, sf).select("id", text.timestamp_anchor(F.col("start_ms"), F.col("end_ms")).alias("anchor"))


@query(f"WITH {_CHUNKS} SELECT id FROM c WHERE len(list_filter(tags, lambda t: replace(translate({s_trim('t')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ', '-') = 'to-do')) > 0")
def tag_filter(spark, sf):
    return chunking.with_tag(chunks(spark, sf), "To-Do").select("id")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS score FROM embeddings, q
    ORDER BY score DESC, vec_id LIMIT 20""")
def cosine_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    q = [float(x) for x in vectors.filter("vec_id = 0").first().embedding]
    return vectors.select("vec_id", F.round(cosine(F.array(*[F.lit(x) for x in q]), F.col("embedding")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


_Q_TERMS = "audit, budget, crop, harvest, ledger, review".split(", ")
#: Those of ``QUERY``: words of four bytes or fewer count only if they come twice.
_FOUND_TERMS = [t for t in _Q_TERMS if len(t) > 4]
_Q_VECTOR = [0.5, -0.25, 0.125, 0.75, -0.5, 0.0, 0.25, 1.0]
_HYBRID = f"""{_CHUNKS}, s AS (SELECT *, round(greatest(coalesce(CASE WHEN len(vector) = 8 AND list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])) > 0 THEN list_cosine_similarity(CAST(vector AS DOUBLE[]), {_Q_VECTOR}::DOUBLE[]) END, 0), 0), 6) AS v,
        round(len(list_intersect(list_distinct(coalesce(terms, [])), {_Q_TERMS})) / 6.0, 6) AS k, CASE WHEN len(list_intersect(list_transform(coalesce(tags, []), lambda t: replace(translate({s_trim("t")}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ', '-')), {_Q_TERMS})) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g, round({_RECENCY}, 6) AS r FROM c)"""


@query(f"WITH {_HYBRID} SELECT id, v AS vector_score, k AS keyword_score, g AS tag_score, r AS recency_score FROM s WHERE 0.60 * v + 0.25 * k + 0.05 * g + 0.10 * r > 0")
def hybrid_scores(spark, sf):
    scored = score(chunks(spark, sf), _Q_TERMS, _Q_VECTOR, NOW).filter("total > 0")
    return scored.select("id", "vector_score", "keyword_score", "tag_score", "recency_score")


_SEARCHED = _HYBRID.replace(str(_Q_TERMS), str(_FOUND_TERMS)).replace("/ 6.0", "/ 5.0")


@query(f"""WITH {_SEARCHED} SELECT id, note_id, note_title, note_kind, created_at, start_ms, end_ms, CASE WHEN length({s_collapse('text')}) > 280 THEN substring({s_collapse('text')}, 1, 279) || '…' ELSE {s_collapse('text')} END AS snippet,
    list_sort(list_intersect(list_distinct(coalesce(terms, [])), {_FOUND_TERMS})) AS matched_terms, v AS vector_score, k AS keyword_score, g AS tag_score, r AS recency_score, round(0.60 * v + 0.25 * k + 0.05 * g + 0.10 * r, 6) AS total
    FROM s WHERE round(0.60 * v + 0.25 * k + 0.05 * g + 0.10 * r, 6) > 0 ORDER BY total DESC, created_at DESC, id LIMIT 20""")
def hybrid_search(spark, sf):
    return search(chunks(spark, sf), SearchOptions(QUERY, limit=20), NOW, vector=_Q_VECTOR)


@query(f"WITH {_CHUNKS} SELECT id FROM c WHERE TRY_CAST(created_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '{NOW}' - INTERVAL 90 DAY")
def since_filter(spark, sf):
    return since(chunks(spark, sf), 90, NOW).select("id")


_PCM = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings"


@query(f"""WITH raw AS (SELECT vec_id, list_concat(x, CASE vec_id % 3 WHEN 0 THEN ['nan'::DOUBLE] WHEN 1 THEN ['inf'::DOUBLE, '-inf'::DOUBLE] ELSE [] END) AS y, x FROM ({_PCM}))
    SELECT vec_id, CAST(len(y) AS INTEGER) AS n, round(len(y) / 16000.0, 6) AS secs, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak,
    CAST(len(list_filter(y, lambda v: isnan(v))) AS INTEGER) AS nan, CAST(len(list_filter(y, lambda v: isinf(v))) AS INTEGER) AS inf, round(least(greatest(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) * 4, 0), 1), 6) AS level FROM raw""")
def pcm_stats(spark, sf):
    bad = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(float("nan")))).when(F.col("vec_id") % 3 == 1, F.array(F.lit(float("inf")), F.lit(float("-inf")))).otherwise(F.array().cast("array<double>"))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", signal.diagnostics(F.concat(F.col("embedding").cast("array<double>"), bad)).alias("d"))
    return rows.select("vec_id", "d.n", F.round("d.secs", 6).alias("secs"), F.round("d.rms", 6).alias("rms"), F.round("d.peak", 6).alias("peak"), "d.nan", "d.inf", F.round(signal.level(F.col("embedding")), 6).alias("level"))


@query(f"""SELECT vec_id, CAST(i AS INTEGER) AS i, round(x[a + 1] + (x[least(a + 2, len(x))] - x[a + 1]) * (f - a), 6) + 0.0::DOUBLE AS sample
    FROM (SELECT vec_id, x, i, i * 2.75625::DOUBLE AS f, CAST(floor(i * 2.75625::DOUBLE) AS BIGINT) AS a FROM (SELECT vec_id, x, unnest(range(0, len(x) * 16000 // 44100)) AS i FROM ({_PCM})))""")
def resample(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(signal.resample(F.col("embedding"), 44_100, 16_000)).alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + F.lit(0.0)).alias("sample"))


@query(f"SELECT vec_id, list_transform(x, lambda v: CAST(trunc(least(greatest(v * 32767, -32768), 32767)) AS SMALLINT)) AS pcm FROM ({_PCM})")
def quantise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", signal.quantise(F.col("embedding")).alias("pcm"))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS i, round((x[2 * i + 1] + x[2 * i + 2]) / 2, 6) + 0::DOUBLE AS sample FROM (SELECT vec_id, x, unnest(range(0, len(x) // 2)) AS i FROM ({_PCM}))")
def mix_down(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(signal.mix_down(F.col("embedding"), 2)).alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + F.lit(0.0)).alias("sample"))


@query("SELECT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_matches(name, '^(Other|You|In|Out|Speaker [1-9][0-9]*)$') AS reserved FROM (SELECT name FROM speaker_names UNION ALL SELECT s_name FROM supplier UNION ALL SELECT DISTINCT label FROM speaker_chunks WHERE label IS NOT NULL)")
def speaker_slugs(spark, sf):
    names = table(spark, sf, "speaker_names").select("name").unionAll(table(spark, sf, "supplier").select("s_name")).unionAll(table(spark, sf, "speaker_chunks").select("label").dropna().distinct())
    return names.select("name", text.slugify_name(F.col("name")).alias("slug"), text.reserved_label(F.col("name")).alias("reserved"))


@query("SELECT recording_id, id, label, corrections[-1].from_label AS from_label, corrections[-1].to_label AS to_label FROM (SELECT DISTINCT * FROM speaker_chunks)")
def last_corrections(spark, sf):
    return transcript.last_correction(table(spark, sf, "speaker_chunks").distinct())


@query(f"""WITH {_LIVE}, base AS (SELECT * FROM alive WHERE kind = 'dictate'), pass AS (SELECT * FROM base WHERE len(segments) > 0)
    SELECT b.id, i AS place, CAST(x.start_ms AS BIGINT) AS start_ms, CAST(x.end_ms AS BIGINT) AS end_ms, greatest(coalesce(p.segments[-1].end_ms + coalesce(b.duration_ms, 0), b.duration_ms), 0) AS duration_ms
    FROM base b JOIN pass p ON p.id = b.id, LATERAL (SELECT unnest(list_concat(b.segments, list_transform(p.segments, lambda s: struct_pack(start_ms := s.start_ms + coalesce(b.duration_ms, 0), end_ms := s.end_ms + coalesce(b.duration_ms, 0), text := s.text, source := s.source, speaker := s.speaker)))) AS x, unnest(range(1, len(b.segments) + len(p.segments) + 1)) AS i)""")
def attach_timeline(spark, sf):
    """Each dictation attached to itself as a second pass."""
    base = log_store.live(log_store.replay(history(spark, sf))).filter("kind = 'dictate'").drop("first_seq")
    passes = base.filter(F.size("segments") > 0).select("id", "segments")
    out = log_store.attach(base, passes)
    return out.select("id", F.posexplode("segments").alias("place", "x"), "duration_ms").select("id", (F.col("place") + 1).cast("bigint").alias("place"), "x.start_ms", "x.end_ms", "duration_ms")


@query(f"""WITH {_ALIGNED}, shown AS (SELECT l.recording_id, count(DISTINCT b.label) AS k FROM lines l JOIN best b ON l.recording_id = b.recording_id AND l.pos = b.pos AND n = 1 WHERE b.label <> 'Other' AND l.start_ms IS NOT NULL AND {s_trim("l.text")} <> '' GROUP BY l.recording_id)
    SELECT t.recording_id, count(DISTINCT label) AS raw_speakers, coalesce(any_value(k), 0) AS block_speakers FROM turns t LEFT JOIN shown s ON s.recording_id = t.recording_id GROUP BY t.recording_id""")
def diarization_yield(spark, sf):
    ranges = turns(spark, sf)
    return transcript.diarization_yield(ranges, transcript.aligned_blocks(lines(spark, sf), ranges))


@query("""SELECT round(coalesce(avg(CASE WHEN o_orderstatus IN ('F') THEN 1.0 WHEN o_orderstatus = 'P' THEN least(greatest(o_totalprice / 500000, 0), 1) ELSE 0 END), 0), 6) AS progress, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, 0 AS failed FROM orders""")
def queue_progress(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "processing").otherwise("queued")
    return read_models.batch_progress(table(spark, sf, "orders").select(status.alias("status"), (F.col("o_totalprice") / 500000).cast("double").alias("progress")))


@query("SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(p_brand, '([0-9])[0-9]$', 1) AS BIGINT), 0) AS major, coalesce(TRY_CAST(regexp_extract(p_brand, '[0-9]([0-9])$', 1) AS BIGINT), 0) AS minor, p_size AS patch FROM part")
def version_order(spark, sf):
    digits = lambda p: F.regexp_extract("p_brand", p, 1)
    version = F.concat_ws(".", digits("([0-9])[0-9]$"), digits("[0-9]([0-9])$"), F.concat(F.col("p_size").cast("string"), F.lit("-beta")))
    return table(spark, sf, "part").select("p_partkey", text.version_key(version).alias("v")).select("p_partkey", "v.major", "v.minor", F.col("v.patch").cast("int").alias("patch"))


@query(f"SELECT doc_id, {s_collapse("regexp_replace(text, '<[^>]+>', ' ', 'g')")} AS text FROM documents")
def html_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.html_text(F.col("text")).alias("text"))


@query()
def html_safe(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.html_safe("text").alias("html"))


_PIECES = " || ',' || ".join(f"CAST(sum(CAST(('0x' || substring(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(f"""WITH {_LIVE}, rows AS (SELECT sha256(array_to_string([coalesce(id, chr(0)), coalesce(created_at, chr(0)), coalesce(title, chr(0)), coalesce(CAST(word_count AS VARCHAR), chr(0)), CAST(len(segments) AS VARCHAR), coalesce(written_content, '')], chr(31))) AS h FROM alive)
    SELECT count(*) AS n, sha256({_PIECES}) AS fingerprint FROM rows""")
def corpus_fingerprint(spark, sf):
    return chunking.fingerprint(records(spark, sf, "created_at", "title", "word_count", "segments", "written_content"))


@query("""WITH RECURSIVE src AS (SELECT CAST(user_id AS VARCHAR) AS session_id, coalesce(value > 20, false) AS loud, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id IS NOT NULL),
    walk AS (
        SELECT session_id, 0::BIGINT AS n, 0::BIGINT AS first, 0::BIGINT AS scored, 0 AS quiet, false AS heard, NULL::BIGINT AS cut_from, NULL::BIGINT AS cut_to FROM (SELECT DISTINCT session_id FROM src)
        UNION ALL
        SELECT session_id, n, CASE WHEN cut THEN first + scored ELSE first END, CASE WHEN cut THEN 0 ELSE scored END, CASE WHEN cut THEN 0 ELSE quiet END, NOT cut AND heard, CASE WHEN cut THEN first END, CASE WHEN cut THEN first + scored END FROM (
            SELECT *, heard AND scored >= 2048 AND quiet >= 2 AS cut FROM (
                SELECT w.session_id, s.n, w.first, w.scored + 512 AS scored, CASE WHEN s.loud THEN 0 ELSE w.quiet + 1 END AS quiet, w.heard OR s.loud AS heard FROM walk w JOIN src s ON s.session_id = w.session_id AND s.n = w.n + 1))
    ), last AS (SELECT session_id, arg_max(first, n) AS first, arg_max(scored, n) AS scored FROM walk GROUP BY session_id)
    SELECT session_id, cut_from AS start_sample, cut_to AS end_sample, NULL::VARCHAR AS error FROM walk WHERE cut_from IS NOT NULL
    UNION ALL SELECT session_id, first, first + scored, NULL FROM last WHERE scored > 0""")
def phrase_segments(spark, sf):
    events = table(spark, sf, "events")
    loud = F.when(F.col("value") > 20, F.lit(0.5)).otherwise(F.lit(0.0))
    numbered = events.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("packet_no"), F.array_repeat(loud, 512).cast("array<float>").alias("samples"))
    return phrases_batch(numbered, limits=Limits(step=512, least=2048, quiet=2))
