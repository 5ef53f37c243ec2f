"""Queries of the general operators for training data: problems 1 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.changes import merge_into
from loomline.operators.intervals import periods_and_gaps
from loomline.operators.log_store import live, usable
from loomline.schemas import REQUIRED
from loomline.session import scratch, table

#: Gaps from this length on (a day) separate sittings and are not listed.
LONGEST_GAP_MS = 86_400_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = usable(table(spark, sf_dir, "history_log")).select("id", "seq", "deleted")
    return live(merge_into(log, scratch(spark, "history"))).select("id", "seq")


#: What SQL can compare of a record's lists.
_LISTS = {"segments": "text", "speaker_blocks": "label", "speaker_chunks": "id", "session_speakers": "label", "notes": "text"}
_SCALARS = ["id", "seq", "format_version", "kind", "created_at", "title", "model", "duration_ms", "word_count", "speaker_capture", "dual_source", "source_path", "markdown_path", "session_dir", "audio_path", "written_content"]


def _field(name: str):
    return lambda x: x[name]


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole current records; of the lists their lengths and one field of all elements."""
    state = live(merge_into(usable(table(spark, sf_dir, "history_log")), scratch(spark, "records")))
    sizes = [F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint").alias(f"n_{c}") for c in _LISTS]
    said = [F.array_join(F.transform(c, _field(f)), "|").alias(f"of_{c}") for c, f in _LISTS.items()]
    return state.select(*_SCALARS, *sizes, *said)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["recording_id", "start_ms", "end_ms"]
    lines = table(spark, sf_dir, "asr_segments").select(F.lit("segment").alias("layer"), *columns)
    chunks = table(spark, sf_dir, "speaker_chunks").select(F.lit("chunk").alias("layer"), *columns)
    found = periods_and_gaps(lines.unionByName(chunks), ["layer", "recording_id"], max_gap_ms=LONGEST_GAP_MS)
    return found.select("layer", "recording_id", "kind", "start_ms", "end_ms")


QUERIES = {"p1_found": p1_found, "p1_state": p1_state, "p4_found": p4_found}

_STATE = f"""
    WITH ok AS (
        SELECT DISTINCT * FROM history_log WHERE seq IS NOT NULL AND kind IN ('scribe', 'dictate', 'transcribe', 'written') AND {" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)}
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, coalesce(deleted, false) DESC) AS n FROM ok)
"""

SQL = {
    "p1_state": f"""
        {_STATE} SELECT {", ".join(_SCALARS)}, {", ".join(f"len({c}) AS n_{c}" for c in _LISTS)}, {", ".join(f"array_to_string(list_transform({c}, lambda x: x.{f}), '|') AS of_{c}" for c, f in _LISTS.items())}
        FROM ranked WHERE n = 1 AND NOT coalesce(deleted, false)
    """,
    "p1_found": f"""
        WITH ok AS (
            SELECT DISTINCT id, seq, coalesce(deleted, false) AS deleted FROM history_log
            WHERE seq IS NOT NULL AND kind IN ('scribe', 'dictate', 'transcribe', 'written')
              AND {" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)}
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, deleted DESC) AS n FROM ok)
        SELECT id, seq FROM ranked WHERE n = 1 AND NOT deleted
    """,
    "p4_found": f"""
        WITH spans AS (
            SELECT 'segment' AS layer, recording_id, start_ms AS s, end_ms AS e FROM asr_segments
            UNION ALL SELECT 'chunk', recording_id, start_ms, end_ms FROM speaker_chunks
        ), seen AS (
            SELECT *, max(e) OVER (PARTITION BY layer, recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
            FROM spans WHERE s IS NOT NULL AND e > s AND recording_id IS NOT NULL
        ), labelled AS (
            SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
                OVER (PARTITION BY layer, recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM seen
        ), periods AS (SELECT layer, recording_id, isle, min(s) AS s, max(e) AS e FROM labelled GROUP BY ALL),
        gaps AS (SELECT layer, recording_id, e AS s, lead(s) OVER (PARTITION BY layer, recording_id ORDER BY isle) AS e FROM periods)
        SELECT layer, recording_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
        UNION ALL SELECT layer, recording_id, 'gap', s, e FROM gaps WHERE e - s < {LONGEST_GAP_MS}
    """,
}
