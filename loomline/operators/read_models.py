"""Lists, statistics and vocabularies over the live records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.score import instant
from loomline.functions.text import legacy_excerpt, segment_excerpt, short_title, trim_ws, word_count, written_excerpt
from loomline.operators.log_store import live, merged_meta

ITEM = ["id", "kind", "created_at", "title", "model", "word_count", "duration_secs", "excerpt", "has_markdown", "source"]


def list_summaries(records: DataFrame) -> DataFrame:
    """One light row a live record; ``records`` is hydrated."""
    body = written_excerpt(F.coalesce("written_content", F.lit("")))
    excerpt = F.when((F.col("kind") == "written") & (body != ""), body).otherwise(segment_excerpt(F.col("segments")))
    return live(records).select(
        "id", "kind", "created_at", "title", "model", "word_count", F.expr("duration_ms div 1000").alias("duration_secs"), F.coalesce(excerpt, F.lit("")).alias("excerpt"),
        F.col("markdown_path").isNotNull().alias("has_markdown"), F.lit("store").alias("source"), *(["first_seq"] if "first_seq" in records.columns else []),
    )


def legacy_markdown_items(files: DataFrame, records: DataFrame) -> DataFrame:
    """Exported files (``path, title, model, modified_at``) that no live record names."""
    known = live(records).select(F.col("markdown_path").alias("path")).filter("path IS NOT NULL")
    rows = files.join(known, "path", "left_anti")
    return rows.select(F.concat(F.lit("md::"), "path").alias("id"), F.lit("scribe").alias("kind"), F.col("modified_at").alias("created_at"), "title", "model", F.lit(0).cast("bigint").alias("word_count"), F.lit(0).cast("bigint").alias("duration_secs"), F.lit("").alias("excerpt"), F.lit(True).alias("has_markdown"), F.lit("legacymarkdown").alias("source"))


def legacy_dictate_items(entries: DataFrame) -> DataFrame:
    """Old dictations (``id, timestamp, text``)."""
    return entries.select(F.concat(F.lit("dictate::"), "id").alias("id"), F.lit("dictate").alias("kind"), F.col("timestamp").alias("created_at"), short_title(F.col("text")).alias("title"), F.lit("").alias("model"), word_count(F.col("text")).cast("bigint").alias("word_count"), F.lit(0).cast("bigint").alias("duration_secs"), legacy_excerpt(F.col("text")).alias("excerpt"), F.lit(False).alias("has_markdown"), F.lit("legacydictate").alias("source"))


def unified_list(records: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """Store, exported files and old dictations in one shape; order it with ``newest_first``."""
    return list_summaries(records).select(*ITEM).unionByName(legacy_markdown_items(files, records)).unionByName(legacy_dictate_items(entries))


def newest_first(items: DataFrame) -> DataFrame:
    """By the text of the date, ties by first appearance or id."""
    return items.orderBy(F.desc("created_at"), "first_seq" if "first_seq" in items.columns else "id")


def latest_files(files: DataFrame) -> DataFrame:
    """Exported files, the last modified first, by the text of the date."""
    return files.orderBy(F.desc("modified_at"), "path")


def path_order(files: DataFrame) -> DataFrame:
    """O08."""
    return files.orderBy("path")


def recent(items: DataFrame, n: int = 6) -> DataFrame:
    """The first few of the newest-first list, a top-k per task and one of their results."""
    return newest_first(items).limit(n)


def previews(items: DataFrame, most: int = 3) -> DataFrame:
    """At most the first three tags."""
    return items.withColumn("tags", F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, most))


def own_turns(blocks: DataFrame, name: str, only_own: bool) -> DataFrame:
    """All turns, or those of the user, whose label is ``You`` or their display name."""
    return blocks.filter(F.col("label").isin("You", name)) if only_own else blocks


def without_item(queue: DataFrame, key: str) -> DataFrame:
    """P25: a queue without one item."""
    return queue.filter(~F.col("id").eqNullSafe(F.lit(key)))


def neighbours(items: DataFrame, key: str) -> tuple[str | None, str | None]:
    """Ids of the items before and after one in the newest-first list, each by a cut of one row."""
    own = items.filter(F.col("id") == key).select("created_at", "id").first()
    if own is None:
        return None, None
    same, at = F.col("created_at") == own.created_at, F.col("created_at")
    before = items.filter((at > own.created_at) | (same & (F.col("id") < own.id))).orderBy("created_at", F.desc("id")).limit(1).first()
    after = items.filter((at < own.created_at) | (same & (F.col("id") > own.id))).orderBy(F.desc("created_at"), "id").limit(1).first()
    return before and before.id, after and after.id


def legacy_id(c: Column) -> Column:
    """P18."""
    return F.startswith(c, F.lit("md::")) | F.startswith(c, F.lit("dictate::"))


def of_kind(items: DataFrame, kind: str) -> DataFrame:
    """``all`` or one kind; uploads are transcriptions."""
    return items if kind == "all" else items.filter(F.col("kind") == {"upload": "transcribe"}.get(kind, kind))


def with_any_tag(items: DataFrame, tags: list[str]) -> DataFrame:
    """No tags, no filter."""
    return items.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else items


def tag_vocabulary(meta: DataFrame, records: DataFrame) -> DataFrame:
    """How often each tag is on a live note, repeats on a note included; order it with ``by_name``."""
    known = live(records).select(F.col("id").alias("note_id"))
    tags = merged_meta(meta.select("note_id", "tags")).join(known, "note_id", "left_semi").select(F.explode("tags").alias("t"))
    return tags.select(trim_ws(F.col("t")).alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("count"))


def by_name(vocabulary: DataFrame) -> DataFrame:
    """O06."""
    return vocabulary.orderBy("tag")


def recorded_this_week(items: DataFrame, now: str) -> DataFrame:
    """Seconds recorded in the ISO week, and calendar year, of ``now``; null if nothing was."""
    at, then = instant(F.col("created_at")), F.to_timestamp(F.lit(now))
    same = F.lit(True)
    for part in ("YEAROFWEEK", "WEEK", "YEAR"):
        same &= F.extract(F.lit(part), at) == F.extract(F.lit(part), then)
    return items.filter(same).agg(F.sum(F.greatest("duration_secs", F.lit(0))).alias("week_secs"))


def counts_by_kind(records: DataFrame) -> DataFrame:
    """A03, A04, in one pass."""
    return live(records).agg(F.count("*").alias("notes"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("scribe", "dictate", "transcribe", "written")])


def dashboard(records: DataFrame, now: str) -> DataFrame:
    """One row of statistics; what isn't kept yet is null."""
    week = recorded_this_week(list_summaries(records), now)
    return counts_by_kind(records).crossJoin(week).withColumns({"float_layers": F.lit(None).cast("bigint"), "drafts_to_review": F.lit(None).cast("bigint")})  # both one row


def empty_note(body: Column, segments: Column, title: Column, created_at: Column) -> Column:
    """Nothing written or said, and the title still the one made from the date."""
    return (trim_ws(F.coalesce(body, F.lit(""))) == "") & (F.coalesce(F.size(segments), F.lit(0)) <= 0) & (title == F.date_format(instant(created_at), "HH:mm dd/MM/yy"))


def has_metadata(meta: DataFrame) -> Column:
    """P14."""
    some = F.lit(False)
    for c in ("tags", "keywords", "layer_item_ids"):
        some |= F.coalesce(F.size(c), F.lit(0)) > 0
    return some


def leave_guard(recording: Column, empty: Column, described: Column) -> Column:
    """P15."""
    return F.when(recording, "keep").when(empty & described, "prompt").when(empty, "delete").otherwise("keep")


def names_in_order(names: DataFrame) -> DataFrame:
    """O05."""
    return names.orderBy(F.lower("name"))


def batch_progress(items: DataFrame) -> DataFrame:
    """Mean progress and counters of a queue (``status, progress``)."""
    part = F.when(F.col("status").isin("done", "error"), 1.0).when(F.col("status") == "processing", F.least(F.greatest(F.col("progress"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return items.agg(F.coalesce(F.round(F.avg(part), 6), F.lit(0.0)).alias("progress"), F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("completed"), F.count_if(F.col("status") == "error").alias("failed"))


def apply_progress(items: DataFrame, events: DataFrame) -> DataFrame:
    """The last event of each queued item put over it."""
    last = events.groupBy("item_id").agg(F.max_by("progress", "seq").alias("__p"))
    joined = items.join(last, items["id"] == last["item_id"], "left")
    got = F.col("__p").isNotNull()
    return joined.withColumn("progress", F.when(got, F.least(F.greatest("__p", F.lit(0.0)), F.lit(1.0))).otherwise(F.col("progress"))).withColumn("status", F.when(got, "processing").otherwise(F.col("status"))).drop("__p", "item_id")


def unique_file_names(exports: DataFrame, base: str = "base") -> DataFrame:
    """``name``: the base, then ``_1``, ``_2``... for further files of that base, in order of ``id``."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(base).orderBy("id")) - 1
    return exports.withColumn("name", F.concat(F.col(base), F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".md")))
