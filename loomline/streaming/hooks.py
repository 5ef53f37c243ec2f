"""Models as hooks: recognition, diarization, and observers of audio. No model comes with the library.

A recogniser or diarizer is a function or object the caller gives; here is how Spark runs it: over stored recordings as
a map, over live packets as a stateful operator, and with the failures they may have.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.operators.fold import cells
from loomline.operators.transcript import merge_channels

Span = tuple[int, int, int]  # speaker, start and end in ms
RANGES = "recording_id string, speaker_id int, start_ms long, end_ms long"
SEGMENTS = "recording_id string, channel string, pos int, start_ms long, end_ms long, text string"


class StreamingDiarizer(Protocol):
    """takes audio as it comes; ranges may come late. It is pickled between batches."""

    def feed(self, pcm: np.ndarray) -> list[Span]: ...

    def flush(self) -> list[Span]: ...


def diarize(recordings: DataFrame, diarizer: Callable[[np.ndarray], list[Span]]) -> DataFrame:
    """ranges of stored recordings (``recording_id, pcm``). A recording the diarizer fails on gives none and is kept as a plain transcript."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, pcm in zip(batch.column(0).to_pylist(), cells(batch.column(1))):
                try:
                    rows += [(key, *span) for span in (diarizer(np.asarray(pcm, np.float32)) if pcm is not None else ())]
                except Exception:  # noqa: BLE001  whatever a model raises
                    continue
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["recording_id", "speaker_id", "start_ms", "end_ms"])

    return recordings.select(F.col("recording_id").cast("string"), F.col("pcm").cast("array<float>")).mapInArrow(run, RANGES)


def labelled_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges with their speakers' labels, for the overlap join."""
    return ranges.select("recording_id", F.concat(F.lit("Speaker "), (F.col("speaker_id") + 1).cast("string")).alias("label"), "start_ms", "end_ms")


def transcribe(recordings: DataFrame, recognise: Callable[[np.ndarray], list[tuple[int, int, str]]]) -> DataFrame:
    """lines of stored recordings (``recording_id, channel, pcm``), numbered within each channel; a failure fails the job."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, channel, pcm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cells(batch.column(2))):
                rows += [(key, channel, n, *line) for n, line in enumerate(recognise(np.asarray(pcm, np.float32)) if pcm is not None else ())]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["recording_id", "channel", "pos", "start_ms", "end_ms", "text"])

    return recordings.select("recording_id", "channel", F.col("pcm").cast("array<float>")).mapInArrow(run, SEGMENTS)


def transcribe_both(recordings: DataFrame, recognise: Callable[[np.ndarray], list[tuple[int, int, str]]]) -> DataFrame:
    """both channels recognised and merged."""
    return merge_channels(transcribe(recordings, recognise))


def diarize_stream(packets: DataFrame, make: Callable[[], StreamingDiarizer]) -> DataFrame:
    """Ranges of live recordings from packets (``session_id, packet_no, samples, is_end``), a row a range, when the recording ends.

    The first failure of the diarizer gives the session up: it gets no ranges, the recording itself is not touched.
    """
    schema = "session_id string, speaker_id int, start_ms long, end_ms long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ranges, failed = (pickle.loads(state.get[0]), pickle.loads(state.get[1]), state.get[2]) if state.exists else (None, [], False)
        done = False
        for samples, end in pd.concat(list(frames)).sort_values("packet_no")[["samples", "is_end"]].itertuples(index=False):
            if not failed:
                try:
                    held = held if held is not None else make()
                    ranges += held.feed(np.asarray(samples, np.float32))
                    if end:
                        ranges += held.flush()
                except Exception:  # noqa: BLE001
                    failed, held, ranges = True, None, []
            done |= bool(end)
        if done:
            state.remove() if state.exists else None
            if ranges:
                yield pd.DataFrame([(key[0], *r) for r in ranges], columns=["session_id", "speaker_id", "start_ms", "end_ms"])
        else:
            state.update((cloudpickle.dumps(held), pickle.dumps(ranges), failed))

    return packets.groupBy("session_id").applyInPandasWithState(step, schema, "held binary, ranges binary, failed boolean", "append", GroupStateTimeout.NoTimeout)


def with_taps(stream: DataFrame, *taps: Callable[[DataFrame], None]):
    """a writer that gives every batch of a stream to each observer; one that fails doesn't disturb the others."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for tap in taps:
                try:
                    tap(batch)
                except Exception:  # noqa: BLE001
                    continue
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)
