"""Text scalars as column expressions; the few that need a fold are Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.functions.markdown import markdown_to_html

# Words that are never search terms.
STOP_WORDS = [
    "about", "after", "again", "also", "and", "are", "because", "been", "but", "can", "could", "did", "does", "for", "from", "had", "has",
    "have", "her", "him", "his", "how", "into", "its", "just", "like", "not", "our", "out", "she", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "those", "was", "were", "what", "when", "where", "which", "who", "why", "with", "would", "you", "your",
]
# Annotations a recogniser writes in brackets, and phrases it makes up in silence.
NOISE_TAGS = ["silence", "blank_audio", "no_speech", "music", "applause", "laughter", "noise", "inaudible"]
SILENCE_PHRASES = [
    "thank you.", "thanks.", "thanks for watching.", "thank you for watching.", "thank you for listening.", "please subscribe.",
    "see you next time.", "you.", "bye.", "bye-bye.", "bye bye.",
]
SILENCE_PREFIXES = ["transcribed by", "subtitles by"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def trim_ws(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Runs of characters other than Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def collapse_ws(c: Column) -> Column:
    """Words with one space between."""
    return trim_ws(F.regexp_replace(c, r"(?U)\s+", " "))


def cleanup_text(c: Column) -> Column:
    """Without recogniser annotations, with fused hashtags split."""
    c = F.regexp_replace(c, r"\[[A-Z][A-Za-z_ ]*\]", "")
    c = F.regexp_replace(c, rf"(?i)\[({'|'.join(NOISE_TAGS)})\]", "")
    c = F.regexp_replace(c, r"(?iU)(#\w+?)(newline)", "$1 $2")
    return collapse_ws(c)


def dedup_exact_halves(c: Column) -> Column:
    """One copy of a text that is the same twice over."""
    t = trim_ws(c)
    half = F.floor(F.length(t) / 2).cast("int")
    first, second = trim_ws(F.substring(t, F.lit(1), half)), trim_ws(F.substring(t, half + 1, F.length(t)))
    return F.when((F.length(t) > 0) & (first == second), first).otherwise(c)


def dedup_repeated_block(c: Column) -> Column:
    """Cut where the opening comes again in the second half; lengths in characters."""
    n = F.length(c)
    mark = F.lower(F.substring(c, F.lit(1), F.greatest(F.least(F.floor(n / 5), F.lit(100)), F.lit(20)).cast("int")))
    half = F.floor(n / 2).cast("int")
    at = F.position(mark, F.lower(F.substring(c, half + 1, n)))
    return F.when((n >= 120) & (at > 0), F.regexp_replace(F.substring(c, F.lit(1), half + at - 1), r"(?U)\s+$", "")).otherwise(c)


def format_hms(ms: Column) -> Column:
    """HH:MM:SS."""
    s = F.greatest(F.floor(ms / 1000), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), F.greatest(F.length(x.cast("string")), F.lit(2)), F.lit("0"))
    return F.when(ms.isNotNull(), F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60)))


def format_ms(ms: Column) -> Column:
    """MM:SS, minutes as many as there are."""
    s = F.greatest(F.floor(ms / 1000), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), F.greatest(F.length(x.cast("string")), F.lit(2)), F.lit("0"))
    return F.when(ms.isNotNull(), F.concat_ws(":", two(F.floor(s / 60)), two(s % 60)))


def timestamp_anchor(start: Column, end: Column) -> Column:
    """``mm:ss-mm:ss``; null without a start, the start twice without an end."""
    return F.when(start.isNotNull(), F.concat_ws("-", format_ms(start), format_ms(F.coalesce(end, start))))


def cut(c: Column, most: int, keep: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, keep), F.lit("…"))).otherwise(c)


def snippet(c: Column) -> Column:
    """At most 280 characters on one line."""
    return cut(collapse_ws(c), 280, 279)


def segment_excerpt(segments: Column) -> Column:
    """The first segment with text, on one line, cut after 120 characters."""
    texts = F.filter(F.transform(segments, lambda s: collapse_ws(s["text"])), lambda t: t != "")
    return cut(F.coalesce(F.get(texts, F.lit(0)), F.lit("")), 120, 120)


def written_excerpt(c: Column) -> Column:
    """The trimmed text, cut after 120 characters."""
    return cut(trim_ws(c), 120, 120)


def legacy_excerpt(c: Column) -> Column:
    """The text of an old dictation on one line, cut after 120 characters."""
    return cut(collapse_ws(c), 120, 120)


def short_title(c: Column) -> Column:
    """The first eight words without punctuation at the end."""
    t = F.regexp_replace(F.array_join(F.slice(words(c), 1, 8), " "), r"[^\p{IsAlphabetic}\p{N}]+$", "")
    return F.when(t == "", F.lit("Dictation")).otherwise(t)


def stem(t: Column) -> Column:
    """Without the first of the endings ing, ed, es, s that leaves more than three bytes."""
    out = t
    for ending in ("s", "es", "ed", "ing"):
        out = F.when(F.endswith(t, F.lit(ending)) & (F.octet_length(t) > len(ending) + 3), F.substring(t, F.lit(1), F.length(t) - len(ending))).otherwise(out)
    return out


def raw_terms(c: Column) -> Column:
    """Stemmed tokens of a text, repeats kept."""
    tokens = F.transform(F.split(c, r"[^\p{IsAlphabetic}\p{N}-]+"), lambda t: ascii_lower(F.regexp_replace(t, "^-+|-+$", "")))
    kept = F.filter(tokens, lambda t: (F.octet_length(t) >= 3) & ~t.isin(STOP_WORDS))
    return F.transform(kept, stem)


def extract_terms(c: Column) -> Column:
    """Terms that come twice or have more than four bytes, sorted, once each."""
    def counted(ts: Column) -> Column:
        runs = F.aggregate(
            F.array_sort(ts),
            F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")),
            lambda a, t: F.when(a["t"] == t, F.struct(t.alias("t"), (a["n"] + 1).alias("n"), F.when((a["n"] == 1) & (F.octet_length(t) <= 4), F.concat(a["out"], F.array(t))).otherwise(a["out"]).alias("out"))).otherwise(
                F.struct(t.alias("t"), F.lit(1).alias("n"), F.when(F.octet_length(t) > 4, F.concat(a["out"], F.array(t))).otherwise(a["out"]).alias("out"))
            ),
            lambda a: a["out"],
        )
        return runs

    return counted(raw_terms(c))


def normalize_tag(c: Column) -> Column:
    """E19."""
    return F.replace(ascii_lower(trim_ws(c)), F.lit(" "), F.lit("-"))


def front_matter_field(c: Column, key: str) -> Column:
    """A field of the leading ``---`` block, without quotes; null if absent or empty."""
    block = F.regexp_extract(c, r"(?s)\A---(.*?)\n---", 1)
    value = F.regexp_replace(trim_ws(F.regexp_extract(block, rf"(?m)^{re.escape(key)}:(.*)$", 1)), "^['\"]+|['\"]+$", "")
    return F.when(value != "", value)


def slugify_name(c: Column) -> Column:
    """E25."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify_file(c: Column, otherwise: Column) -> Column:
    """A file name without its extension and characters file systems refuse."""
    base = F.regexp_replace(c, r"\.[^./\\]*$", "")
    slug = F.translate(base, ' /\\:*?"<>|', "_---------")
    return F.when(trim_ws(slug) == "", otherwise).otherwise(slug)


def speaker_label(i: Column) -> Column:
    """E27."""
    return F.concat(F.lit("Speaker "), (i + 1).cast("string"))


def display_label(label: Column, mic: str, other: str) -> Column:
    """E28."""
    return F.when(label == "In", F.lit(mic)).when(label == "Out", F.lit(other)).otherwise(label)


def reserved_label(label: Column) -> Column:
    """P16."""
    return label.rlike(r"^(Other|You|In|Out|Speaker [1-9][0-9]*)$")


def is_silence_phrase(c: Column) -> Column:
    """Text a recogniser makes up in silence, or none at all."""
    t = F.lower(trim_ws(c))
    made_up = t.isin(["", *SILENCE_PHRASES]) | t.rlike(rf"(?U)^\[\s*({'|'.join(NOISE_TAGS)})\s*\]$")
    for p in SILENCE_PREFIXES:
        made_up |= F.startswith(t, F.lit(p))
    return made_up


def html_text(c: Column) -> Column:
    """E32."""
    return collapse_ws(F.regexp_replace(c, "<[^>]+>", " "))


def version_key(c: Column) -> Column:
    """The leading digits of three parts, comparable."""
    part = lambda i: F.coalesce(F.regexp_extract(F.coalesce(F.get(F.split(F.regexp_replace(c, "^v", ""), r"\."), F.lit(i)), F.lit("")), r"^(\d+)", 1).try_cast("bigint"), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def duration_text(seconds: Column) -> Column:
    """``1h 2m``, ``3m 4s`` or ``5s``."""
    s = F.greatest(F.coalesce(F.floor(seconds), F.lit(0)), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def kind_label(c: Column) -> Column:
    """E35."""
    return F.when(c == "dictate", "Dictate").when(c == "transcribe", "Upload").when(c == "written", "Written").otherwise("Scribe")


def model_label(path: Column) -> Column:
    """The file's stem without its prefix."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", ""), "ggml-", "")


def transcript_section(c: Column) -> Column:
    """What follows the heading ``## Transcript``, up to the next of its level; else the whole text."""
    part = F.regexp_extract(c, r"(?ms)^## Transcript[^\S\n]*$(.*?)(?=^## |\z)", 1)
    return F.when(c.rlike(r"(?m)^## Transcript[^\S\n]*$"), trim_ws(part)).otherwise(trim_ws(c))


def days(c: Column) -> Column:
    """E36 as a column: null for what isn't a number of days."""
    return F.regexp_extract(trim_ws(c), r"^(\d+)d?$", 1).try_cast("int")


def parse_days(text: str) -> int:
    """``90d`` as 90."""
    return int(text.strip().removesuffix("d"))


_TAIL = re.compile(r"(?:[^\w]|_)+\Z")
LONGEST_PHRASE = 5


_FOLD = str.maketrans(_UPPER, _LOWER)


def _bare(token: str) -> str:
    return (token if token[-1].isalnum() else _TAIL.sub("", token)).translate(_FOLD)


def drop_repeated_phrases(text: str) -> str:
    """W13 on one text."""
    tokens = text.split()
    if len(tokens) < 2:
        return text
    keys = [_bare(t) for t in tokens]
    if not any(a == b for d in range(1, LONGEST_PHRASE + 1) for a, b in zip(keys, keys[d:])):
        return " ".join(tokens)  # nothing within reach comes twice
    kept = [0]
    at = 1
    while at < len(tokens):
        for size in range(min(LONGEST_PHRASE, len(kept), len(tokens) - at), 0, -1):
            if [keys[k] for k in kept[-size:]] == keys[at : at + size]:
                at += size
                break
        else:
            kept.append(at)
            at += 1
    return " ".join(tokens[k] for k in kept)


@F.pandas_udf(StringType())
def dedup_consecutive_phrases(texts: pd.Series) -> pd.Series:
    """Phrases of up to five words said again right away are dropped; null stays null."""
    return texts.map(drop_repeated_phrases, na_action="ignore")


@F.pandas_udf(StringType())
def html_safe(texts: pd.Series) -> pd.Series:
    """Markdown as HTML of safe tags only; null stays null."""
    return texts.map(markdown_to_html, na_action="ignore")
