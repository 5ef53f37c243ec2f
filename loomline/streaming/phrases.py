"""Continuous audio cut into phrases at pauses, as a stream and as a batch replay that gives the same cuts.

Samples come in packets per session. They are scored in steps of 512 ms over up to four steps of context; a phrase ends
once speech was heard, at least 30 s were scored and the last 512 ms were quiet. How samples are packed doesn't matter.
The scorer is a hook: a function from samples to the probability of speech in each 512-sample frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.operators.fold import Fold, fold_sorted

FRAME, RATE = 512, 16_000
PHRASE = "session_id string, start_sample long, end_sample long, error string"
STATE = "tail array<float>, context array<float>, scored long, quiet long, heard boolean, start long, next_packet long, failed boolean"



@dataclass(frozen=True)
class Limits:
    """In samples: of a scoring step, a phrase at least, and the buffer at most; in frames: the quiet that ends a phrase."""

    step: int = 8_192
    least: int = 30 * RATE
    most: int = 60 * RATE
    quiet: int = 16


Scorer = Callable[[np.ndarray], np.ndarray]


def loudness(pcm: np.ndarray) -> np.ndarray:
    """A stand-in scorer: a frame is speech if its level is 0.01 or more."""
    frames = pcm[: len(pcm) // FRAME * FRAME].reshape(-1, FRAME).astype(np.float64)
    return (np.sqrt((frames**2).mean(axis=1)) >= 0.01).astype(float)


class Cutter:
    """One session's state: samples not yet scored, their context, and counts."""

    def __init__(self, score: Scorer = loudness, limits: Limits = Limits()) -> None:
        self.score, self.limits = score, limits
        self.tail = np.zeros(0, np.float32)
        self.context = np.zeros(0, np.float32)
        self.scored = self.quiet = self.start = 0
        self.heard = False

    def push(self, pcm: np.ndarray) -> list[tuple[int, int]]:
        """Phrases that end within the samples so far, as (first, past last)."""
        cuts, lim = [], self.limits
        data = np.concatenate([self.tail, np.asarray(pcm, np.float32)])
        at = 0
        while len(data) - at >= lim.step:
            self.context = np.concatenate([self.context, data[at : at + lim.step]])[-4 * lim.step :]
            at += lim.step
            for p in self.score(self.context)[-(lim.step // FRAME) :]:
                self.heard |= bool(p >= 0.5)
                self.quiet = 0 if p >= 0.5 else self.quiet + 1
            self.scored += lim.step
            if self.heard and self.scored >= lim.least and self.quiet >= lim.quiet:
                cuts.append((self.start, self.start + self.scored))
                self.start += self.scored
                self.scored, self.quiet, self.heard = 0, 0, False
            elif self.scored > lim.most:
                raise OverflowError("no pause within the buffer's limit")
        self.tail = data[at:]
        if self.scored + len(self.tail) > lim.most:
            raise OverflowError("no pause within the buffer's limit")
        return cuts

    def finish(self) -> list[tuple[int, int]]:
        end = self.start + self.scored + len(self.tail)
        return [(self.start, end)] if end > self.start else []


def phrases_stream(packets: DataFrame, score: Scorer = loudness, limits: Limits = Limits()) -> DataFrame:
    """``packets`` (``session_id, packet_no, samples, is_end``, and ``is_cancel`` if sessions can be cancelled) as a stream of phrases.

    Packets of a session come in order from batch to batch; a missing or repeated number, or too long a stretch without a
    pause, poisons the session: it gives one row with ``error``, and the batch replay has to take over. A cancelled
    session gives one row with the error ``cancelled``; what it has said in that batch and what was still open is dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c, expected, failed = Cutter(score, limits), 0, False
        if state.exists:
            tail, context, c.scored, c.quiet, c.heard, c.start, expected, failed = state.get
            c.tail, c.context = np.array(tail, np.float32), np.array(context, np.float32)
        rows: list[tuple] = []
        own = pd.concat(list(frames)).sort_values("packet_no")
        stops = own["is_cancel"].fillna(False) if "is_cancel" in own else [False] * len(own)
        for n, samples, end, stop in zip(own["packet_no"], own["samples"], own["is_end"], stops):
            if failed:
                break
            try:
                if stop:
                    raise OverflowError("cancelled")
                if n != expected:
                    raise OverflowError("a packet is missing or comes twice")
                expected += 1
                rows += [(key[0], a, b, None) for a, b in c.push(samples)]
                if end:
                    rows += [(key[0], a, b, None) for a, b in c.finish()]
                    c = Cutter(score, limits)
            except OverflowError as e:
                failed = True
                rows = [(key[0], None, None, str(e))]
        state.update((c.tail.tolist(), c.context.tolist(), c.scored, c.quiet, c.heard, c.start, expected, failed))
        if rows:
            yield pd.DataFrame(rows, columns=["session_id", "start_sample", "end_sample", "error"]).astype({"start_sample": "Int64", "end_sample": "Int64"})

    return packets.groupBy("session_id").applyInPandasWithState(step, PHRASE, STATE, "append", GroupStateTimeout.NoTimeout)


class _Replay(Fold):
    def __init__(self, score: Scorer, limits: Limits) -> None:
        self.cutter, self.failed = Cutter(score, limits), False

    def step(self, row):
        if not self.failed:
            try:
                yield from [(a, b, None) for a, b in self.cutter.push(row[0])]
            except OverflowError as e:
                self.failed = True
                yield None, None, str(e)

    def end(self):
        return [] if self.failed else [(a, b, None) for a, b in self.cutter.finish()]


def phrases_batch(packets: DataFrame, score: Scorer = loudness, limits: Limits = Limits()) -> DataFrame:
    """The same cuts from the stored packets of whole sessions."""
    return fold_sorted(packets, "session_id", ["packet_no"], ["samples"], lambda: _Replay(score, limits), PHRASE)


def at_rate(packets: DataFrame, rate: int = RATE) -> DataFrame:
    """Packets (``native_rate, samples``) at one rate; works on streams, as each packet is handled by itself."""
    from pyspark.sql import functions as F

    from loomline.functions.signal import resample

    return packets.withColumn("samples", resample(F.col("samples"), F.col("native_rate"), rate).cast("array<float>")).withColumn("native_rate", F.lit(rate))


def retimed(segments: DataFrame) -> DataFrame:
    """Phrase-local times (``offset_ms, phrase_ms, start_ms, end_ms``) on the recording's clock, inside the phrase, in order."""
    clamp = "least(greatest({0}, 0), phrase_ms) + offset_ms"
    return segments.selectExpr("* except (start_ms, end_ms)", f"{clamp.format('start_ms')} AS start_ms", f"greatest({clamp.format('end_ms')}, {clamp.format('start_ms')}) AS end_ms")


def debounced(events: DataFrame, key: str, time: str, value: str, quiet: str) -> DataFrame:
    """The last value before each pause of ``quiet``; works on streams with a watermark, too."""
    from pyspark.sql import functions as F

    return events.groupBy(F.col(key), F.session_window(time, quiet).alias("w")).agg(F.max_by(value, time).alias(value)).select(key, F.col("w.end").alias("at"), value)
