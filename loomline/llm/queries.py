"""Queries of this subpackage's operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bpe import encode_column
from loomline.llm.leaks import find_leaks
from loomline.llm.nearest import match_tables
from loomline.llm.pii import learn_names, scan
from loomline.llm.splitting import split_items
from loomline.llm.sql import SQL
from loomline.llm.subjects import subject_areas
from loomline.llm.turns import label_lines, turn_starts, turns
from loomline.session import table

TOLERANCE_MS = 1_500


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = match_tables(spark, f"{sf_dir}/asr_segments.parquet", f"{sf_dir}/speaker_chunks.parquet", "recording_id", "start_ms", "pos", "start_ms", "id", TOLERANCE_MS)
    return pairs.select(F.col("entity").alias("recording_id"), F.col("left_ref").cast("bigint").alias("pos"), F.col("right_ref").alias("chunk_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = label_lines(table(spark, sf_dir, "asr_segments"), table(spark, sf_dir, "speaker_names"))
    return turn_starts(labelled.drop("text")).filter("opens").select("recording_id", "start_ms", "speaker").distinct()


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(table(spark, sf_dir, "asr_segments"), table(spark, sf_dir, "speaker_names"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "asr_segments").select(F.lit("segment").alias("layer"), F.col("recording_id").alias("record_id"), F.col("pos").cast("bigint").alias("line_no"), "text")
    written = table(spark, sf_dir, "history_log").select(F.lit("written").alias("layer"), F.col("id").alias("record_id"), F.col("seq").alias("line_no"), F.col("written_content").alias("text"))
    return lines.unionByName(written).filter("text IS NOT NULL")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    found = scan(texts, "text", learn_names(texts, "text", table(spark, sf_dir, "speaker_names")), only_found=True)
    each = found.select("layer", "record_id", "line_no", F.explode(F.transform(F.col("spans"), lambda s, i: F.struct(s["kind"].alias("pii_type"), F.size(F.filter(F.slice("spans", 1, i + 1), lambda t: t["kind"] == s["kind"])).cast("bigint").alias("nth")))).alias("x"))
    return each.select("layer", "record_id", "line_no", "x.pii_type", "x.nth").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    found = scan(texts, "text", learn_names(texts, "text", table(spark, sf_dir, "speaker_names")))
    return found.select("layer", "record_id", "line_no", F.col("redacted").alias("text")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_items(table(spark, sf_dir, "chunks"), only_oversized=True)
    return pieces.select(F.col("id").alias("chunk_id"), F.col("level").alias("boundary")).distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "chunks").select("id", "text", "start_ms", "end_ms").distinct())


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subject_areas(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))
    return found.select("doc_id", "subject").distinct()


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted, "p9_found": p9_found, "p8_found": p8_found, "p2_found": p2_found, "p3_found": p3_found, "p3_turns": p3_turns, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_ids": p7_ids}
