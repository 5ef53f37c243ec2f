"""Schemas of the stored entities, as DDL."""

SEGMENT = "STRUCT<start_ms:BIGINT,end_ms:BIGINT,text:STRING,source:STRING,speaker:STRING>"
BLOCK = "STRUCT<label:STRING,start_ms:BIGINT,end_ms:BIGINT,text:STRING,chunk_id:STRING>"
CORRECTION = "STRUCT<from_label:STRING,to_label:STRING,corrected_at_ms:BIGINT,auto:BOOLEAN>"
CHUNK = f"STRUCT<id:STRING,start_ms:BIGINT,end_ms:BIGINT,label:STRING,corrections:ARRAY<{CORRECTION}>>"
SESSION_SPEAKER = "STRUCT<session_speaker_id:STRING,label:STRING,start_ms:BIGINT,end_ms:BIGINT,duration_ms:BIGINT>"
NOTE = "STRUCT<id:STRING,text:STRING,recorded_at_ms:BIGINT>"

HISTORY = f"""
format_version INT, id STRING, kind STRING, created_at STRING, title STRING, model STRING,
segments ARRAY<{SEGMENT}>, speaker_blocks ARRAY<{BLOCK}>, speaker_chunks ARRAY<{CHUNK}>,
session_speakers ARRAY<{SESSION_SPEAKER}>, notes ARRAY<{NOTE}>,
duration_ms BIGINT, word_count BIGINT, speaker_capture BOOLEAN, dual_source BOOLEAN,
source_path STRING, markdown_path STRING, session_dir STRING, audio_path STRING, written_content STRING, deleted BOOLEAN
"""
HISTORY_LOG = "seq BIGINT, " + HISTORY
NOTE_META = "note_id STRING, title STRING, tags ARRAY<STRING>, keywords ARRAY<STRING>, layer_item_ids ARRAY<STRING>"
SPEAKER_NAMES = "name STRING, slug STRING, created_at STRING, updated_at STRING"
DICTATE = "id STRING, timestamp STRING, text STRING"

#: Columns a usable record must have, and the kinds it may be of.
REQUIRED = ["format_version", "id", "kind", "created_at", "title", "model", "segments", "duration_ms", "word_count"]
KINDS = ["scribe", "dictate", "transcribe", "written"]
EXTENSIONS = ["wav", "mp3", "m4a", "ogg", "flac"]
FORMAT_VERSION = 1
