"""Pairing each left record with the right record of its entity nearest in time (problem 2).

Method: a stateful streaming join. Both sides are buffered; a left row is emitted once the watermark has passed its
tolerance horizon, and right rows that no pending or future left row can reach are evicted.

Scale: rows meet in (entity, time bucket); a right row within the tolerance of a bucket's edge is sent to both buckets.
The buckets of all entities are hashed to groups, and a group is one call of the operator on Arrow batches, so an entity with
a third of all rows is spread over many groups, and many small entities share one. State lies in RocksDB with its
checkpoint in the shared folder, and the sink commits each batch once, so lost executors cost a retry.

A stored table has no arrival order, so its replay brings it into one: rows are split into slices of event time, which
arrive one after another. The watermark passes each slice before the next one comes, and what is left in the state then
is one tolerance horizon. A live source states its own ``lateness`` and holds that much.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.session import hadoop_fs, scratch

BUCKET_MS = 60_000
#: Rows a slice of the replay holds for each shuffle partition, and the fewest slices.
SLICE_ROWS, MIN_SLICES = 1_000_000, 3
#: Media times start near zero, where Spark's first watermark lies; event times are moved clear of it.
EPOCH_MS = 4 * 10**12
#: Times beyond this many ms either way share the outermost event time; matching uses the exact values.
FAR_MS = 39 * 10**11
END_MS = 9 * 10**12

EVENT = "entity string, bucket long, side int, t long, ref string"
PAIR = "entity string, left_ref string, left_t long, right_ref string, right_t long"
STATE = "held binary"
COLUMNS = ["entity", "bucket", "side", "t", "ref"]
LEFT, RIGHT, END = 0, 1, 2


def pack(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_pandas()


def nearest(lk: np.ndarray, lt: np.ndarray, rk: np.ndarray, rt: np.ndarray, tolerance: int) -> np.ndarray:
    """Index of the right row of the same key nearest in time to each left row, -1 if none is within ``tolerance``; on equal distance the earlier.

    Right rows are sorted by key and time and differ in them.
    """
    if not len(rt):
        return np.full(len(lt), -1)
    times, rank = np.unique(np.concatenate([lt, rt]), return_inverse=True)
    key = np.concatenate([lk, rk]).astype(np.int64) * len(times) + rank
    left, right = key[: len(lt)], key[len(lt) :]
    after = np.searchsorted(right, left, side="left")
    before, after = np.maximum(after - 1, 0), np.minimum(after, len(rt) - 1)
    far = np.iinfo(np.uint64).max
    gap = lambda a, b: b.astype(np.uint64) - a.astype(np.uint64)  # noqa: E731  exact even between the ends of the range
    gap_after = np.where((rk[after] == lk) & (rt[after] >= lt), gap(lt, rt[after]), far)
    gap_before = np.where((rk[before] == lk) & (rt[before] <= lt), gap(rt[before], lt), far)
    best = np.where(gap_before <= gap_after, before, after)
    return np.where(np.minimum(gap_before, gap_after) <= np.uint64(tolerance), best, -1)


def matched(lefts: pd.DataFrame, rights: pd.DataFrame, tolerance: int) -> pd.DataFrame:
    """The pairs of due left rows; repeats count once, of right rows at one time the smallest reference."""
    lefts = lefts.drop_duplicates(["entity", "bucket", "t", "ref"])
    entity = pd.factorize(pd.concat([lefts["entity"], rights["entity"]]))[0]
    bucket, buckets = pd.factorize(pd.concat([lefts["bucket"], rights["bucket"]]))
    key = entity.astype(np.int64) * len(buckets) + bucket
    n = len(lefts)
    rights = rights.assign(key=key[n:]).sort_values(["key", "t", "ref"]).drop_duplicates(["key", "t"])
    at = nearest(key[:n], lefts["t"].to_numpy(np.int64), rights["key"].to_numpy(np.int64), rights["t"].to_numpy(np.int64), tolerance)
    lefts, rights = lefts[at >= 0], rights.iloc[at[at >= 0]]
    return pd.DataFrame({"entity": lefts["entity"].to_numpy(), "left_ref": lefts["ref"].to_numpy(), "left_t": lefts["t"].to_numpy(), "right_ref": rights["ref"].to_numpy(), "right_t": rights["t"].to_numpy()})


def _matcher(tolerance: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [unpack(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            parts += [f.loc[f["side"] < END, COLUMNS] for f in frames]
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=COLUMNS)
        watermark = state.getCurrentWatermarkMs()
        event = np.clip(rows["t"].to_numpy(np.int64), -FAR_MS, FAR_MS) + EPOCH_MS
        left = rows["side"].to_numpy() == LEFT
        due = left & (event + tolerance <= watermark)
        if due.any():
            yield matched(rows[due], rows[~left], tolerance)
        # A pending or admitted left row lies less than a tolerance behind the watermark; right rows out of its reach go.
        ends = event + tolerance * np.where(left, 1, 2)
        keep = ends > watermark
        if not keep.any():
            if state.exists:
                state.remove()
            return
        if due.any() or not keep.all() or not state.hasTimedOut:
            state.update((pack(rows[keep]),))
        state.setTimeoutTimestamp(int(max(ends[keep].min(), watermark) + 1))

    return step


def events(left: DataFrame, right: DataFrame, entity: str, left_time: str, left_ref: str, right_time: str, right_ref: str, tolerance_ms: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Both sides as one table or stream of keyed events; rows without entity, time or reference can't match and are left out."""
    if bucket_ms < 2 * tolerance_ms:
        raise ValueError("a bucket must be at least twice the tolerance")
    bucket = lambda t: F.floor(t / F.lit(bucket_ms))

    def side(df: DataFrame, n: int, time: str, ref: str) -> DataFrame:
        return df.select(F.col(f"`{entity}`").cast("string").alias("entity"), F.lit(n).alias("side"), F.col(f"`{time}`").cast("long").alias("t"), F.col(f"`{ref}`").cast("string").alias("ref")).dropna()

    lines = side(left, LEFT, left_time, left_ref).withColumn("bucket", bucket(F.col("t")))
    near = F.array_distinct(F.array(bucket(F.col("t") - tolerance_ms), bucket(F.col("t") + tolerance_ms)))
    candidates = side(right, RIGHT, right_time, right_ref).withColumn("bucket", F.explode(near))
    return lines.select(*COLUMNS).unionByName(candidates.select(*COLUMNS))


def match_stream(stream: DataFrame, tolerance_ms: int, lateness: str = "0 seconds", groups: int = 64) -> DataFrame:
    """The streaming join over a stream of ``events``; rows more than ``lateness`` behind the newest are dropped, as with any watermark.

    ``groups`` is the number of state keys; it stays the same as long as a checkpoint is used.
    """
    limit = lambda t: F.greatest(F.least(t, F.lit(FAR_MS)), F.lit(-FAR_MS)) + F.lit(EPOCH_MS)
    moment = F.when(F.col("side") == END, F.lit(END_MS)).otherwise(limit(F.col("t")))
    timed = stream.select(*COLUMNS).withColumn("event_time", F.timestamp_millis(moment)).withWatermark("event_time", lateness)
    grouped = timed.withColumn("part", F.pmod(F.xxhash64("entity", "bucket"), F.lit(groups)))
    return grouped.groupBy("part").applyInPandasWithState(_matcher(tolerance_ms), PAIR, STATE, "append", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, with checkpoints of changes only."""
    wanted = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(f"spark.sql.streaming.stateStore.{k}", None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(f"spark.sql.streaming.stateStore.{k}")
            else:
                spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)


def match_tables(spark: SparkSession, left_path: str, right_path: str, entity: str, left_time: str, left_ref: str, right_time: str, right_ref: str, tolerance_ms: int, progress: list | None = None) -> DataFrame:
    """Replay two Parquet tables through the streaming join.

    Gives ``entity, left_ref, left_t, right_ref, right_t``, one row a left record with a match; references come
    out as text. Defined cases: null entity, time or reference never matches; equal distance takes the
    earlier right record, equal times the smaller reference; repeats of a record count once; an empty table
    gives no rows; other columns, whatever their names, are not read. ``progress`` gets each micro-batch's progress.
    """
    left = spark.read.parquet(left_path).select(*dict.fromkeys([entity, left_time, left_ref]))
    right = spark.read.parquet(right_path).select(*dict.fromkeys([entity, right_time, right_ref]))
    both = events(left, right, entity, left_time, left_ref, right_time, right_ref, tolerance_ms)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(MIN_SLICES, (left.count() + right.count()) // (SLICE_ROWS * partitions))
    cuts = both.agg(F.percentile_approx("t", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    cuts = sorted({c for c in cuts if -FAR_MS < c <= FAR_MS})  # times beyond share an event time and with it a slice
    slice_of = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("t"))) if cuts else F.lit(0)
    marker = spark.createDataFrame([("", -1, END, 0, "", len(cuts))], EVENT + ", slice int")
    staged, source, out, state = (scratch(spark, f"nearest-{x}") for x in ("staged", "source", "out", "state"))
    both.withColumn("slice", slice_of).unionByName(marker).hint("rebalance", "slice").write.partitionBy("slice").parquet(staged)
    fs, root = hadoop_fs(spark, source)
    fs.mkdirs(root)
    _, waiting = hadoop_fs(spark, staged)
    folders = sorted((f.getPath() for f in fs.listStatus(waiting) if f.isDirectory()), key=lambda p: int(p.getName().split("=")[1]))
    joined = match_stream(spark.readStream.schema(EVENT + ", slice int").parquet(source), tolerance_ms, groups=4 * partitions)
    with state_in_rocksdb(spark):
        for folder in folders:
            fs.rename(folder, hadoop_fs(spark, f"{source}/{folder.getName()}")[1])
            query = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            if progress is not None:
                progress += query.recentProgress
    return spark.read.schema(T._parse_datatype_string(PAIR)).parquet(out)
