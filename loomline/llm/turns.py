"""Transcript lines into clean, ordered speaker turns (problem 3).

Method: line templates are mined with a fixed-depth token tree. The head of a line, up to a closing mark such as
``:``, ``]``, ``)``, ``>`` or ``-``, is a unit. A unit goes down the tree by its layout (its marks, with numbers and words
as slots), then by its first and second word, where parts of known names are masked. Every node counts its lines, those
whose number slot agrees with the line's start, and those whose word slot reads as a label. A unit's role is that of the
deepest node on its path that holds enough lines: a time mark, a speaker mark, or neither. Extraction peels units off
the heads by these roles; merge rules then join neighbouring lines of one speaker into turns.

A node's place depends on nothing but the unit itself, so counts of partitions simply add up and results don't depend
on how lines are spread. Nodes under ``LEAST_SHARE`` of all heads lend their lines to the nodes above; where even the
layout is that rare, a unit is judged by its own line: a time must agree with the line's start, and a label be a full name or a
speaker word with its number.

Scale: two passes over the text, each a map; between them at most ``DEPTH / LEAST_SHARE`` nodes reach the driver,
however large the corpus. Turns come from look-backs split by (recording, time bucket), so a recording with a third of
all lines is spread over many tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.sequence import bucketed, gathered, with_latest, with_previous
from loomline.session import checkpointed

TURN_GAP_MS = 60_000
#: The names table is held by every worker; more rows than this are refused.
MAX_NAMES = 100_000
#: Readings a worker remembers, and the length from which it reads anew.
MAX_REMEMBERED, LONG_LABEL = 65_536, 200

#: Levels of the tree, and the share of all heads a node must hold to give its lines a role.
DEPTH, LEAST_SHARE = 3, 1e-4
#: Slots of a layout that tell it from others; longer ones that begin alike are one.
LAYOUT_SLOTS = 24
#: Nodes a task counts before it hands them on; sums over tasks are the same whatever it is.
MAX_COUNTED = 50_000
#: A number slot agrees with a line's start if they are this close.
TIME_SLACK_MS = 2_000
ROLE_SHARE = 0.5

# Number words, words for a numbered speaker, and labels that are neither person nor number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
SPEAKER_WORDS = "speaker|spkr|spk|sprecher|hablante|s"
CHANNEL_LABELS = {"in": "In", "out": "Out", "other": "Other"}
#: Hesitation and humming sounds, as whole words.
HUM = r"(?:u+[hm]+|e+r+m*|[äe]+h+m*|e+u+h+|h+m+|m{2,}|m+h+m+)"
_HESITATION = re.compile(rf"(?<![\w'’-]){HUM}(?:-{HUM})*(?![\w'’]|-\w)(?:\s*(?:,|\.{{3}}|…))?(?:\s+-(?=\s))?", re.I)
_GERMAN = re.compile(r"\b(?:der|die|das|und|ist|ich|nicht|mit|wir|zu|zum|ging|noch|war)\b", re.I)
_GERMAN_ER = re.compile(r"er\Z", re.I)
#: Annotations: anything in square, round, curly or angle brackets or between asterisks without sentence-like content, and notes.
_ANNOTATION = re.compile(r"\[(?!\s*(?:at|dot)\s*\])[^\[\]@\n]+\]|\{(?!\s*(?:at|dot)\s*\})[^{}\n]+\}|<[^<>@\n]+>|\*[^*\n]+\*|\((?!\s*(?:at|dot)\s*\))(?:[^\W\d_]|[ _'’-]|\b\d\b)+\)|[♪♫♩]+")
_TIME = re.compile(r"\d+(?::\d\d){1,2}(?:[.,]\d+)?|\d+[.,]\d+")
_CLOSED = re.compile(r"[:\])>}–—|-](?=\s|\Z)")
_SLOT = re.compile(r"[^\W\d_](?:[\w.,'’ -]*[\w.])?|\d+|\s+|(?P<mark>[^\w\s])(?P=mark)*")
_SLOT_WORD = re.compile(r"[^\W\d_]+")
_BRACKET = re.compile(r"[\[{<*(♪♫♩]")
_WORDLIKE = re.compile(r"[^\W_]")


def fold(text: str) -> str:
    """Letters and digits of a label, without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if c.isalnum())


_NUMBERED = re.compile(rf"(?:{SPEAKER_WORDS})0*(\d+|{'|'.join(NUMBER_WORDS)})\Z")
_TITLE = re.compile(r"\s*(?:mr|mrs|ms|dr|prof|frau|herr|sra|sr|señora|señor)\b\.?\s+", re.I)
_ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")


class Labels:
    """Reads speaker labels in whatever spelling."""

    def __init__(self, names: list[str]) -> None:
        keys: dict[str, set[str]] = {}
        for name in names:
            parts = name.split()
            if not parts:
                continue
            given, family = parts[0], "".join(parts[1:])
            for spelt in (name, family + given, given, family, given[:1] + family, given + family[:1]):
                if fold(spelt):
                    keys.setdefault(fold(spelt), set()).add(name)
        self.people = {k: next(iter(v)) for k, v in keys.items() if len(v) == 1}
        self.full = {fold(n) for n in names if len(n.split()) > 1}
        self.parts = {fold(w) for n in names for w in _SLOT_WORD.findall(n) if len(w) > 1}
        self.seen: dict[str, str | None] = {}

    def read(self, label: str) -> str | None:
        """The agreed label; None if ``label`` names no one."""
        if len(label) > LONG_LABEL:
            return self._read(label)
        if label not in self.seen:
            if len(self.seen) >= MAX_REMEMBERED:
                self.seen.clear()
            self.seen[label] = self._read(label)
        return self.seen[label]

    def _read(self, label: str) -> str | None:
        bare = fold(_ASIDE.sub(" ", label)) or fold(label)
        if m := _NUMBERED.match(bare):
            n = m.group(1)
            return f"Speaker {int(n) if n.isdigit() else NUMBER_WORDS.index(n)}"
        return CHANNEL_LABELS.get(bare) or self.people.get(bare) or self.people.get(fold(_TITLE.sub("", label)))

    def plain(self, label: str) -> bool:
        """Whether ``label`` is unmistakable outside a known layout: a full name or a speaker word with its number."""
        bare = fold(label)
        return bare in self.full or (bool(_NUMBERED.match(bare)) and len(bare) > 3)


def unit(text: str) -> tuple[str, str] | None:
    """The unit at the head of ``text`` and the rest; None if the first line has no closing mark after a word or number."""
    text = text.lstrip()
    word = _WORDLIKE.search(text)
    m = word and _CLOSED.search(text, word.start())
    if not m or text.find("\n", 0, m.end()) >= 0:
        return None
    return text[: m.end()], text[m.end() :]


def path(own: str, parts: set[str]) -> tuple[str, str, str]:
    """A unit's way down the tree: its layout, its first and its second word; parts of known names are masked."""
    kind = lambda m: "0" if m[0].isdigit() else "w" if m[0].isalpha() else " " if m[0].isspace() else m[0]
    slots = (k for m in _SLOT.finditer(own) if (k := kind(m.group())) != " ")
    layout = "".join(islice(slots, LAYOUT_SLOTS))
    words = [m.group() for m, _ in zip(_SLOT_WORD.finditer(own), range(DEPTH - 1))]
    first, second = ["<name>" if fold(w) in parts else w.casefold() for w in words] + [""] * (DEPTH - 1 - len(words))
    return layout, first, second


def slot_time(u: str) -> list[int]:
    """What the unit's numbers mean in milliseconds as h:m:s, m:s or seconds; empty if it holds more than a time."""
    m = _TIME.search(u)
    if not m or any(c.isalnum() for c in u[: m.start()] + u[m.end() :]):
        return []
    whole, _, part = m.group().replace(",", ".").partition(".")
    seconds = 0
    for x in whole.split(":"):
        seconds = seconds * 60 + int(x)
    return [seconds * 1000 + int((part + "000")[:3])]


def slot_label(u: str) -> str:
    return re.sub(r"^[\W_]+|[\W_]+$", "", u)


class TokenTree:
    """Counts of the nodes on the paths of units: [lines, lines with agreeing time, lines with a label]."""

    def __init__(self) -> None:
        self.nodes: dict[tuple[str, ...], list[int]] = {}

    def add(self, way: tuple[str, ...], timed: bool, labelled: bool) -> None:
        for depth in range(1, DEPTH + 1):
            n = self.nodes.setdefault(way[:depth], [0, 0, 0])
            n[0] += 1
            n[1] += timed
            n[2] += labelled


Roles = dict[tuple[str, ...], str | None]


def read_names(names: DataFrame, column: str = "name") -> list[str]:
    rows = names.select(F.col(column).alias("n")).filter("n IS NOT NULL").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} speaker names")
    return sorted(r.n for r in rows)


def mine_layouts(lines: DataFrame, labels: Labels) -> Roles:
    """Role of each node that holds enough lines: ``time``, ``speaker`` or None. ``lines`` has ``text`` and ``start_ms``; lines without one don't count."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = TokenTree()

        def counted() -> pd.DataFrame:
            rows = [("\x1f".join(t), *n) for t, n in tree.nodes.items()]
            tree.nodes.clear()
            return pd.DataFrame(rows, columns=["node", "n", "timed", "labelled"])

        for f in frames:
            for text, start in zip(f["text"], f["start_ms"]):
                while (u := unit(text)) is not None:
                    own, text = u
                    times = slot_time(own)
                    label = labels.read(slot_label(own)) is not None
                    tree.add(path(own, labels.parts), bool(times) and abs(times[0] - start) <= TIME_SLACK_MS, label)
                    if not times and not label and not _ANNOTATION.fullmatch(own):
                        break  # extraction never looks beyond such a unit
            if len(tree.nodes) > MAX_COUNTED:
                yield counted()
        yield counted()

    closed = F.col("text").rlike(r"(?U)[:\])>}–—|-](\s|\z)")  # else there is no unit
    mined = lines.select("text", F.col("start_ms").cast("long").alias("start_ms")).filter(closed & F.col("start_ms").isNotNull()).mapInPandas(run, "node string, n long, timed long, labelled long")
    summed = mined.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "timed", "labelled")])
    summed = checkpointed(summed, "layouts")
    heads = summed.filter(~F.contains("node", F.lit("\x1f"))).agg(F.sum("n")).first()[0] or 0  # the layouts themselves
    roles: Roles = {}
    for r in summed.filter(F.col("n") >= LEAST_SHARE * heads).toLocalIterator():
        roles[tuple(r.node.split("\x1f"))] = "time" if r.timed >= ROLE_SHARE * r.n else "speaker" if r.labelled >= ROLE_SHARE * r.n else None
    return roles


class Extractor:
    """Applies mined layouts to lines."""

    def __init__(self, roles: Roles, labels: Labels) -> None:
        self.labels, self.roles = labels, roles

    def role(self, own: str, fallback: str | None) -> str | None:
        """That of the deepest node on the unit's path; ``fallback`` if its layout is too rare to have one."""
        way = path(own, self.labels.parts)
        return next((self.roles[way[:d]] for d in range(DEPTH, 0, -1) if way[:d] in self.roles), fallback)

    def line(self, text: str, start: int | None = None) -> tuple[str | None, str]:
        """The label marked at the head, and the text without marks, annotations and hesitations."""
        label = None
        while (u := unit(text)) is not None:
            own, rest = u
            slot = slot_label(own)
            if times := slot_time(own):
                agrees = start is not None and abs(times[0] - start) <= TIME_SLACK_MS
                if self.role(own, "time" if agrees else None) != "time" and not _ANNOTATION.fullmatch(own):
                    break
            elif (read := self.labels.read(slot)) and (self.labels.plain(slot) or self.role(own, None) == "speaker"):
                label = label or read
            elif not _ANNOTATION.fullmatch(own):
                break
            text = rest
        return label, self.clean(text)

    @staticmethod
    def clean(text: str) -> str:
        if _BRACKET.search(text):
            text = _ANNOTATION.sub(" ", text)

        def gone(m: re.Match) -> str:
            return m.group() if _GERMAN_ER.fullmatch(m.group()) and _GERMAN.search(text) else " "

        text = _HESITATION.sub(gone, text)
        text = " ".join(text.split())
        return text if _WORDLIKE.search(text) else ""


def label_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``recording_id, pos, start_ms, end_ms, speaker, text``: lines that count, under agreed labels and cleaned.

    ``lines`` has these columns and ``source``. Not counted: lines with a null recording, start or text, and those
    without words. Labels that name no one become ``Other``. Repeats stay; other columns are dropped.
    """
    rows = lines.select("recording_id", F.coalesce(F.col("pos"), F.lit(-1)).cast("long").alias("pos"), F.col("start_ms").cast("long").alias("start_ms"), F.coalesce(F.col("end_ms"), F.col("start_ms")).cast("long").alias("end_ms"), "speaker", "text", "source")
    rows = rows.filter("recording_id IS NOT NULL AND start_ms IS NOT NULL AND text IS NOT NULL")
    labels = Labels(read_names(names))
    shipped = lines.sparkSession.sparkContext.broadcast((mine_layouts(rows, labels), labels))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ex = Extractor(*shipped.value)
        for f in frames:
            speakers, texts = [], []
            for text, own, source, start in zip(f["text"], f["speaker"], f["source"], f["start_ms"].tolist()):
                marked, clean = ex.line(text, start)
                if isinstance(own, str) and own.strip():
                    who = ex.labels.read(own.strip()) or "Other"
                else:
                    who = marked or ("Out" if source == "speaker" else "In")
                speakers.append(who)
                texts.append(clean)
            yield f.drop(columns=["source"]).assign(speaker=speakers, text=texts)[[bool(t) for t in texts]]

    return rows.mapInPandas(run, "recording_id string, pos long, start_ms long, end_ms long, speaker string, text string")


def turn_starts(labelled: DataFrame) -> DataFrame:
    """The labelled lines, with ``opens``: whether a turn begins there. Repeats of a line follow it and open nothing."""
    # Written once: the look-back reads it twice, and what Python made would be made twice.
    rows = bucketed(checkpointed(labelled, "lines"), ["recording_id"], "start_ms")
    seen = with_previous(rows, ["recording_id"], ["start_ms", "pos"], ["speaker", "start_ms", "pos"])
    change = F.col("prev").isNull() | (F.col("prev.speaker") != F.col("speaker")) | (F.col("start_ms") - F.col("prev.start_ms") > TURN_GAP_MS)
    return seen.withColumn("opens", change).withColumn("repeat", F.coalesce((F.col("prev.start_ms") == F.col("start_ms")) & (F.col("prev.pos") == F.col("pos")), F.lit(False)))


def turns(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``recording_id, start_ms, end_ms, speaker, n_lines, text``: ordered turns of one speaker.

    A turn begins at a recording's first line that counts, where the speaker differs from the line before, and after
    more than ``TURN_GAP_MS`` between two starts. Repeated lines count once; an empty table gives no turns.
    """
    starts = turn_starts(label_lines(lines, names)).filter(~F.col("repeat")).drop("prev", "repeat")
    opened = with_latest(starts, ["recording_id"], ["start_ms", "pos"], F.when(F.col("opens"), F.struct("start_ms", "pos")), "turn")
    group, place = ["recording_id", "turn", "speaker"], F.struct("start_ms", "pos")
    parts = opened.groupBy(*group, "__b").agg(F.max("end_ms").alias("e"), F.count("*").alias("n"), gathered(place, F.col("text"), " ").alias("t"))
    grouped = parts.groupBy(*group).agg(F.max("e").alias("end_ms"), F.sum("n").alias("n_lines"), gathered(F.col("__b"), F.col("t"), " ").alias("text"))
    return grouped.select("recording_id", F.col("turn.start_ms").alias("start_ms"), F.greatest("end_ms", F.col("turn.start_ms")).alias("end_ms"), "speaker", "n_lines", "text")
