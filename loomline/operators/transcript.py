"""The transcript dataflow: channels, speakers, turns, paragraphs and rendering.

Lines have ``recording_id, pos, start_ms, end_ms, text, source``. Look-backs are split by (recording, time bucket), texts are
joined by bucket first, and the overlap join meets in slots as long as the spans, so that no recording is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.functions.text import cleanup_text, dedup_consecutive_phrases, dedup_exact_halves, dedup_repeated_block, format_hms, format_ms, is_silence_phrase, trim_ws, word_count
from loomline.operators.fold import Fold, fold_sorted
from loomline.operators.sequence import BUCKET_MS, bucketed, gathered, joined_text, with_latest, with_previous
from loomline.session import checkpointed

PARAGRAPH_GAP_MS = 8_000
NEAR_DUPLICATE_MS = 1_500
#: The shortest slot in which spans meet is 2 to this power of milliseconds long, about a minute; longer spans have longer slots.
LEAST_BITS = 16


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row a line, that of its latest delivery (``logged_at``), else of the larger fingerprint; lines without recording or place are left out."""
    kept = [c for c in ("channel", "start_ms", "end_ms", "text", "source", "speaker") if c in lines.columns]
    rank = F.struct(*([F.col("logged_at")] if "logged_at" in lines.columns else []), F.xxhash64(*kept).alias("fp"))
    rows = lines.filter("recording_id IS NOT NULL AND pos IS NOT NULL").groupBy("recording_id", "pos").agg(F.max_by(F.struct(*kept), rank).alias("l"))
    return rows.select("recording_id", "pos", *[F.col(f"l.{c}").alias(c) for c in kept])


def drop_silence_phrases(lines: DataFrame) -> DataFrame:
    """P09."""
    return lines.filter(F.col("text").isNotNull() & ~is_silence_phrase(F.col("text")))


def merge_neighbours(lines: DataFrame, same: list[str], order: list[str], gap_ms: int | None = None) -> DataFrame:
    """Neighbours with equal ``same`` columns, and less than ``gap_ms`` between, as one row.

    ``order`` starts with a time that is never null. Gives ``recording_id, first``, the order columns of the first row,
    the ``same`` columns, ``start_ms, end_ms`` (the last end that is there), ``n_lines`` and ``text`` joined by spaces.
    """
    rows = bucketed(lines.filter(F.col(order[0]).isNotNull()), ["recording_id"], order[0])
    seen = with_previous(rows, ["recording_id"], order, [*same, "end_ms"])
    opens = F.col("prev").isNull()
    for c in same:
        opens |= ~F.col(f"prev.{c}").eqNullSafe(F.col(c))
    if gap_ms is not None:
        opens |= F.coalesce(F.col("start_ms") - F.col("prev.end_ms") >= gap_ms, F.lit(True))
    marked = with_latest(seen.withColumn("opens", opens), ["recording_id"], order, F.when(F.col("opens"), F.struct(*order)), "first")
    place, group = F.struct(*order), ["recording_id", "first", *same]
    parts = marked.groupBy(*group, "__b").agg(
        F.min(F.struct(place.alias("at"), F.col("start_ms"))).alias("lo"),
        F.max(F.when(F.col("end_ms").isNotNull(), F.struct(place.alias("at"), F.col("end_ms")))).alias("hi"),
        F.count("*").alias("n"),
        gathered(place, F.col("text"), " ").alias("t"),
    )
    return parts.groupBy(*group).agg(F.min("lo").getField("start_ms").alias("start_ms"), F.max("hi").getField("end_ms").alias("end_ms"), F.sum("n").alias("n_lines"), gathered(F.col("__b"), F.col("t"), " ").alias("text"))


def channel_blocks(lines: DataFrame) -> DataFrame:
    """Lines without text dropped, the rest as In or Out, neighbours merged."""
    rows = lines.withColumn("text", trim_ws(F.col("text"))).filter("text <> ''")
    rows = rows.withColumn("label", F.when(F.col("source") == "speaker", "Out").otherwise("In"))
    return merge_neighbours(rows, ["label"], ["start_ms", "pos"])


def label_turns(chunks: DataFrame) -> DataFrame:
    """W02 over labelled spans with ``id``."""
    rows = chunks.withColumn("text", F.coalesce(F.col("text") if "text" in chunks.columns else F.lit(""), F.lit("")))
    return merge_neighbours(rows, ["label"], ["start_ms", "id"])


def paragraphs(lines: DataFrame, clean=cleanup_text) -> DataFrame:
    """Lines that are not blank once cleaned, without gaps of eight seconds, of one channel. ``clean`` makes the text that stays."""
    rows = lines.withColumn("text", clean(F.col("text"))).filter("text <> ''")
    rows = rows.withColumn("channel_key", F.when(F.col("source") == "speaker", "speaker").otherwise("mic"))
    return merge_neighbours(rows, ["channel_key"], ["start_ms", "pos"], PARAGRAPH_GAP_MS)


def label_rank(label: Column) -> Column:
    """Numbered speakers in order of their numbers, then other labels in order of their text."""
    number = F.regexp_extract(label, r"^Speaker ([1-9]\d{0,17})$", 1).try_cast("bigint")
    return F.struct(F.coalesce(number, F.lit(2**63 - 1)).alias("number"), label.alias("label"))


def align_speakers(lines: DataFrame, ranges: DataFrame, line_key: str = "pos", label: str = "label") -> DataFrame:
    """The label that overlaps each line longest; on a tie the lowest speaker number; ``Other`` without overlap.

    Gives ``recording_id, line_key, label, overlap_ms``. A span lies in slots of its own length, three at most, and, for the
    longer spans of the other side, in theirs. A pair meets in slots of the longer one's length, in the first
    that both lie in, so it counts once. Times below zero count as zero; spans without a time or length overlap nothing.
    """
    clamp = lambda c: F.greatest(F.col(c), F.lit(0)).cast("bigint")
    own = lines.select("recording_id", line_key, "start_ms", "end_ms").filter(F.col("recording_id").isNotNull())
    spans = own.filter("end_ms > start_ms AND end_ms > 0").select("recording_id", line_key, clamp("start_ms").alias("s"), clamp("end_ms").alias("e"))
    turns = ranges.filter(F.col("recording_id").isNotNull() & F.col(label).isNotNull()).filter("end_ms > start_ms AND end_ms > 0")
    turns = turns.select("recording_id", F.col(label).alias("label"), clamp("start_ms").alias("rs"), clamp("end_ms").alias("re"))

    bits = lambda a, z: F.least(F.greatest(F.ceil(F.log2((F.col(z) - F.col(a)).cast("double"))), F.lit(LEAST_BITS)), F.lit(63)).cast("int")
    spans, turns = spans.withColumn("own", bits("s", "e")), turns.withColumn("own_r", bits("rs", "re"))
    lengths = lambda df, c: [r[0] for r in df.select(c).distinct().collect()]  # noqa: E731  at most 48 numbers
    slots = lambda a, z: F.explode(F.expr(f"sequence(shiftright({a}, least(bits, 62)), shiftright({z} - 1, least(bits, 62)))"))

    def placed(df: DataFrame, mine: str, others: list[int], a: str, z: str) -> DataFrame:
        levels = F.array_union(F.array(F.col(mine)), F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col(mine)))
        return df.withColumn("bits", F.explode(levels)).withColumn("slot", slots(a, z))

    pairs = placed(spans, "own", lengths(turns, "own_r"), "s", "e").join(placed(turns, "own_r", lengths(spans, "own"), "rs", "re"), ["recording_id", "bits", "slot"])
    shared = pairs.filter("s < re AND rs < e AND bits = greatest(own, own_r) AND slot = shiftright(greatest(s, rs), least(bits, 62))")
    summed = shared.groupBy("recording_id", line_key, "label").agg(F.sum(F.least("e", "re") - F.greatest("s", "rs")).alias("overlap"))
    best = F.min(F.struct((-F.col("overlap")).alias("less"), label_rank(F.col("label")).alias("rank")))
    every = own.select("recording_id", line_key, F.lit(None).cast("string").alias("label"), F.lit(0).cast("bigint").alias("overlap"))
    chosen = summed.unionByName(every).groupBy("recording_id", line_key).agg(best.alias("b"))
    return chosen.select("recording_id", line_key, F.coalesce("b.rank.label", F.lit("Other")).alias("label"), (-F.col("b.less")).alias("overlap_ms"))


def aligned_blocks(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines under the labels of ``align_speakers``, those without text dropped, neighbours merged."""
    labelled = lines.join(align_speakers(lines, ranges).drop("overlap_ms"), ["recording_id", "pos"])
    return merge_neighbours(labelled.withColumn("text", trim_ws(F.col("text"))).filter("text <> ''"), ["label"], ["start_ms", "pos"])


class _DropNearDuplicates(Fold):
    def __init__(self) -> None:
        self.kept: tuple[str, int] | None = None

    def step(self, row):
        *head, start, end, text, source = row
        if self.kept and self.kept[0].endswith(text) and abs(start - self.kept[1]) <= NEAR_DUPLICATE_MS:
            return
        self.kept = (text, start)
        yield *head, start, end, text, source


def merge_channels(lines: DataFrame) -> DataFrame:
    """Both channels in order of start, the microphone first; a line that ends the last kept one within 1.5 s is dropped.

    A pause of more than 1.5 s between two starts ends what a line can be dropped for, so each stretch between such pauses is
    walked by itself.
    """
    rows = lines.filter("start_ms IS NOT NULL AND recording_id IS NOT NULL").withColumn("text", F.coalesce(trim_ws(F.col("text")), F.lit("")))
    rows = rows.withColumn("source", F.when(F.col("channel") == "speaker", "speaker").otherwise("mic")).withColumn("__rank", (F.col("source") == "speaker").cast("int"))
    order = ["start_ms", "__rank", "pos"]
    placed = bucketed(rows.select("recording_id", *order, "end_ms", "text", "source"), ["recording_id"], "start_ms")
    seen = with_previous(placed, ["recording_id"], order, ["start_ms"])
    pause = F.coalesce(F.col("start_ms") - F.col("prev.start_ms") > NEAR_DUPLICATE_MS, F.lit(True))
    stretched = with_latest(seen.withColumn("__opens", pause).drop("prev"), ["recording_id"], order, F.when(F.col("__opens"), F.struct(*order)), "__first")
    keyed = stretched.withColumn("__stretch", F.to_json(F.struct("recording_id", "__first")))
    schema = "__stretch string, recording_id string, pos long, start_ms long, end_ms long, text string, source string"
    return fold_sorted(keyed, "__stretch", order, ["recording_id", "pos", "start_ms", "end_ms", "text", "source"], _DropNearDuplicates, schema).drop("__stretch")


def granularity(lines: DataFrame) -> DataFrame:
    """Number of lines with both times, and their lengths; reversed ones have none. Lines without a time don't count."""
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    timed = lines.filter("start_ms IS NOT NULL AND end_ms IS NOT NULL").select(length.alias("n"))
    return timed.agg(F.count("*").alias("n"), F.expr("sum(n) div count(n)").alias("avg_ms"), F.min("n").alias("min_ms"), F.max("n").alias("max_ms"))


def clean_line(c: Column) -> Column:
    """One line as it is rendered."""
    return dedup_repeated_block(dedup_consecutive_phrases(cleanup_text(c)))


def dictation_text(pieces: Column) -> Column:
    """A dictation's lines as one text."""
    return dedup_repeated_block(dedup_consecutive_phrases(dedup_exact_halves(F.array_join(F.filter(F.transform(pieces, cleanup_text), lambda t: t != ""), " "))))


def render_bodies(lines: DataFrame, timestamps: bool = False) -> DataFrame:
    """``recording_id, body, word_count``: paragraphs with a blank line between."""
    # Written once: the look-backs of the paragraphs read it several times, and Python would make it anew each time.
    kept = checkpointed(lines.select("recording_id", "pos", "start_ms", "end_ms", "source", clean_line(F.col("text")).alias("text")), "lines")
    parts = paragraphs(kept, clean=lambda c: c)
    text = F.concat(F.lit("["), format_hms(F.col("start_ms")), F.lit("] "), F.col("text")) if timestamps else F.col("text")
    rows = parts.select("recording_id", "first", F.col("first.start_ms").alias("at"), text.alias("t"), word_count(F.col("text")).alias("n"))
    pieces = rows.groupBy("recording_id", F.floor(F.col("at") / BUCKET_MS).alias("b")).agg(gathered(F.col("first"), F.col("t"), "\n\n").alias("t"), F.sum("n").alias("n"))
    return pieces.groupBy("recording_id").agg(gathered(F.col("b"), F.col("t"), "\n\n").alias("body"), F.sum("n").cast("bigint").alias("word_count"))


def render_speaker_bodies(blocks: DataFrame, mic: str = "In", other: str = "Out") -> DataFrame:
    """``recording_id, body`` of blocks with ``first, label, start_ms, end_ms, text``; separators stand before all but the first."""
    label = F.when(F.col("label") == "In", mic).when(F.col("label") == "Out", other).otherwise(F.col("label"))
    times = F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), F.concat(F.lit(" · "), format_ms(F.col("start_ms")), F.lit("–"), format_ms(F.col("end_ms")))).otherwise("")
    rows = checkpointed(blocks.select("recording_id", "first", F.concat(F.lit("**["), label, F.lit("]**"), times, F.lit("\n\n")).alias("head"), clean_line(F.col("text")).alias("clean")), "blocks")
    firsts = rows.groupBy("recording_id").agg(F.min("first").alias("opening"))
    marked = rows.join(firsts, "recording_id").withColumn("t", F.when(F.col("clean") != "", F.concat(F.when(F.col("first") == F.col("opening"), "").otherwise("\n\n---\n\n"), "head", "clean")))
    time = "first.start_ms" if isinstance(blocks.schema["first"].dataType, StructType) else "first"
    return joined_text(marked, ["recording_id"], ["first"], "t", "body", "", time=time)


def markdown_document(title: Column, duration_ms: Column, words: Column, model: Column, body: Column, notes: Column | None = None) -> Column:
    """Front matter, transcript and notes."""
    head = F.concat(
        F.lit("---\ntitle: '"), F.replace(title, F.lit("'"), F.lit("''")), F.lit("'\nduration_seconds: "), F.call_function("format_number", F.greatest(duration_ms, F.lit(0)) / 1000.0, F.lit("0.0")),
        F.lit("\nword_count: "), words.cast("string"), F.lit("\ntoken_estimate: "), F.round(words * 1.3).cast("bigint").cast("string"),
        F.lit("\nmodel: "), model, F.lit("\n---\n\n## Transcript\n\n"), body,
    )
    if notes is None:
        return F.concat(head, F.lit("\n"))
    lines = F.transform(notes, lambda n, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), format_hms(n["recorded_at_ms"]), F.lit(") "), n["text"], F.lit("\n")))
    return F.concat(head, F.when(F.size(notes) > 0, F.concat(F.lit("\n\n## Notes\n"), F.array_join(lines, ""))).otherwise(""), F.lit("\n"))


def speaker_document(title: Column, model: Column, body: Column) -> Column:
    """Front matter without a duration, and a body of speaker blocks."""
    return F.concat(F.lit("---\ntitle: '"), F.replace(title, F.lit("'"), F.lit("''")), F.lit("'\nword_count: "), word_count(body).cast("string"), F.lit("\nmodel: "), model, F.lit("\n---\n\n## Transcript\n\n"), body, F.lit("\n"))


def diarization_yield(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Speakers heard and speakers shown, by recording."""
    heard = ranges.groupBy("recording_id").agg(F.count_distinct("label").alias("raw_speakers"))
    shown = blocks.filter("label <> 'Other'").groupBy("recording_id").agg(F.count_distinct("label").alias("block_speakers"))
    return heard.join(shown, "recording_id", "left").select("recording_id", "raw_speakers", F.coalesce("block_speakers", F.lit(0)).alias("block_speakers"))


def last_correction(chunks: DataFrame) -> DataFrame:
    """Each chunk with its last correction."""
    return chunks.select("recording_id", "id", "label", F.try_element_at("corrections", F.lit(-1)).alias("c")).select("recording_id", "id", "label", "c.from_label", "c.to_label")
