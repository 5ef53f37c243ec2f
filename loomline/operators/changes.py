"""Change feeds: inserts, updates and deletes applied in sequence order (problem 1).

Method: every bucket of keys owns an embedded DuckDB table ``state`` with the key as
primary key. A batch of changes is folded to one row a key, then upserted with
``ON CONFLICT ... DO UPDATE ... WHERE`` the incoming (sequence, deleted, fingerprint) is
greater than the stored one, so arrival order and repeats do not matter. Tombstones stay in
the state, hence a late older change can't bring a deleted key back. Buckets are exported by
Spark's writer into a version folder that readers can't see, and a pointer file swapped in one
rename publishes all buckets together.

Scale: the same upsert runs before the shuffle on every input partition (a map-side combine of bounded
memory), so a key that holds a third of the feed reaches its bucket as few rows. Payload columns stay in
Arrow; DuckDB holds key, order and row number only. The number of buckets follows the feed's size and is
stored with the table; later feeds read, shuffle and write only the buckets they touch. Collected are bucket
numbers, never keys or rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.session import hadoop_fs

#: Columns the operator adds while it works; they can't clash with columns of the feed.
_KEY, _SEQ, _DEL, _FP, _BUCKET = "__cf_key", "__cf_seq", "__cf_del", "__cf_fp", "__cf_bucket"

#: A bucket holds at most about so many rows and bytes of its input files; the rows fit DuckDB's memory without spilling.
BUCKET_ROWS, BUCKET_BYTES, SMALL_BUCKET_BYTES = 2_000_000, 128 << 20, 16 << 20
#: Keys and bytes the combine before the shuffle holds before it hands them on.
COMBINE_KEYS, COMBINE_BYTES = 1_000_000, 256 << 20

#: Superseded payload rows held in Arrow before the state is compacted, as a multiple of live rows.
COMPACT_FACTOR = 2
MIN_HELD_ROWS = 65_536


class BucketState:
    """Last-writer-wins state of one bucket: ordering in DuckDB, payload rows in Arrow."""

    def __init__(self, memory_limit: str = "512MB") -> None:
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory_limit, "temp_directory": ""})
        self.db.execute("CREATE TABLE state (k VARCHAR PRIMARY KEY, seq BIGINT, del BOOLEAN, fp BIGINT, slot BIGINT)")
        self.held: list[pa.RecordBatch] = []
        self.rows = 0

    def upsert(self, batch: pa.RecordBatch) -> None:
        """Apply one batch of changes, in whatever order they come."""
        if not batch.num_rows:
            return
        incoming = pa.table({
            "k": batch.column(batch.schema.get_field_index(_KEY)),
            "seq": batch.column(batch.schema.get_field_index(_SEQ)),
            "del": batch.column(batch.schema.get_field_index(_DEL)),
            "fp": batch.column(batch.schema.get_field_index(_FP)),
            "slot": pa.array(range(self.rows, self.rows + batch.num_rows), pa.int64()),
        })
        self.db.register("incoming", incoming)
        self.db.execute(
            """
            INSERT INTO state
            SELECT k, seq, del, fp, slot FROM incoming
            QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC, del DESC, fp DESC, slot) = 1
            ON CONFLICT (k) DO UPDATE SET seq = excluded.seq, del = excluded.del, fp = excluded.fp, slot = excluded.slot
            WHERE excluded.seq > state.seq
               OR (excluded.seq = state.seq AND excluded.del AND NOT state.del)
               OR (excluded.seq = state.seq AND excluded.del = state.del AND excluded.fp > state.fp)
            """
        )
        self.db.unregister("incoming")
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows > MIN_HELD_ROWS and self.rows > COMPACT_FACTOR * self.count():
            self.compact()

    def count(self) -> int:
        return self.db.execute("SELECT count(*) FROM state").fetchall()[0][0]

    def _live(self) -> pa.Table | None:
        if not self.held:
            return None
        slots = self.db.sql("SELECT slot FROM state ORDER BY slot").to_arrow_table().column("slot")
        return pa.Table.from_batches(self.held).take(slots)

    def compact(self) -> None:
        """Drop superseded payload rows; slots keep their order, so they are renumbered by rank."""
        live = self._live()
        self.db.execute("CREATE OR REPLACE TABLE ranks AS SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS r FROM state")
        self.db.execute("UPDATE state SET slot = ranks.r FROM ranks WHERE state.slot = ranks.slot")
        self.db.execute("DROP TABLE ranks")
        self.held = live.combine_chunks().to_batches()
        self.rows = live.num_rows

    def export(self, max_rows: int = 8192) -> Iterator[pa.RecordBatch]:
        """The bucket's current rows, tombstones among them."""
        live = self._live()
        if live is not None:
            yield from live.to_batches(max_chunksize=max_rows)
        self.db.close()


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a key as far as memory allows; what is handed on early only costs shuffle."""
    state = BucketState()
    for batch in batches:
        state.upsert(batch)
        if state.rows > MIN_HELD_ROWS and (state.count() > COMBINE_KEYS or sum(b.nbytes for b in state.held) > COMBINE_BYTES):
            yield from state.export()
            state = BucketState()
    yield from state.export()


def _upsert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = BucketState()
    for batch in batches:
        state.upsert(batch)
    yield from state.export()


def buckets_for(changes: DataFrame) -> int:
    """Buckets for a feed of this size, the session's shuffle partitions at least."""
    least = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(changes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size <= least * SMALL_BUCKET_BYTES:
        return least
    rows = changes.count()
    known = size < rows << 20  # without statistics Spark assumes an endless table
    return max(least, -(-size // BUCKET_BYTES) if known else 0, -(-rows // BUCKET_ROWS))


def _bucket_of(key: str, n: int):
    return F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(n)).cast("int")


def apply_changes(changes: DataFrame, key: str = "id", seq: str = "seq", deleted: str = "deleted", buckets: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """The state after all ``changes``: one row a key, the one with the highest sequence number, tombstones kept.

    ``base`` is an earlier result of this function (same columns); the feed is applied on top of it.
    Defined cases: rows with a null key or sequence can't be ordered and are ignored; a null
    ``deleted`` means false; exact repeats count once; of different rows with equal key and sequence the
    delete wins, then the one with the larger fingerprint over all columns; an empty feed gives an
    empty state. Columns besides the three are carried along whatever their names and types.
    """
    if base is not None:
        changes = base.unionByName(changes)
    columns = changes.columns
    tagged = (
        changes.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{seq}`").isNotNull())
        .withColumn(_KEY, F.col(f"`{key}`").cast("string"))
        .withColumn(_SEQ, F.col(f"`{seq}`").cast("bigint"))
        .withColumn(_DEL, F.coalesce(F.col(f"`{deleted}`"), F.lit(False)))
        .withColumn(_FP, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    )
    n = buckets or buckets_for(changes)
    combined = tagged.mapInArrow(_combine, tagged.schema)
    bucketed = combined.repartitionById(n, _bucket_of(_KEY, n)).mapInArrow(_upsert, tagged.schema)
    return bucketed.select(*[F.col(f"`{c}`") for c in columns])


def _swap(spark: SparkSession, target: str, pointer: dict) -> None:
    """Make ``pointer`` current in one rename."""
    fs, folder = hadoop_fs(spark, target)
    jvm = spark.sparkContext._jvm
    temporary, current = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(folder, "CURRENT")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(pointer), "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, current, overwrite)


def _pointer(spark: SparkSession, target: str) -> dict | None:
    """What is current: ``schema``, and either a ``version`` folder or ``buckets``, their number, and ``places``, the version that holds each."""
    fs, pointer = hadoop_fs(spark, f"{target}/CURRENT")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def publish(state: DataFrame, target: str) -> str:
    """Write ``state`` as the next version of the table at ``target`` and make it current in one rename."""
    version = f"v-{uuid.uuid4().hex}"
    state.write.parquet(f"{target}/{version}")  # the commit protocol drops what failed or repeated tasks wrote
    _swap(state.sparkSession, target, {"schema": state.schema.json(), "version": version})
    return version


def _read(spark: SparkSession, target: str, pointer: dict, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(pointer["schema"]))
    if "version" in pointer:
        return spark.read.schema(schema).parquet(f"{target}/{pointer['version']}")
    folders = [f"{target}/{v}/{_BUCKET}={b}" for b, v in pointer["places"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The published version of the table at ``target``; None before the first one."""
    pointer = _pointer(spark, target)
    return None if pointer is None else _read(spark, target, pointer)


def merge_into(changes: DataFrame, target: str, key: str = "id", buckets: int | None = None, **names: str) -> DataFrame:
    """Apply a feed to the published table at ``target`` and publish the result; returns the new state.

    Only buckets that the feed touches are read, shuffled and written; the pointer keeps the others where they are. The
    number of buckets is stored with the table; a feed that needs more than twice as many has the table written anew.
    One writer at a time.
    """
    spark = changes.sparkSession
    before = _pointer(spark, target)
    wanted = buckets or buckets_for(changes)
    n = before["buckets"] if before and "buckets" in before else wanted
    if before is None:
        base, places = None, {}
    elif "version" in before or wanted > 2 * n:
        n, base, places = max(n, wanted), _read(spark, target, before), {}
    else:
        touched = {r.b for r in changes.select(_bucket_of(key, n).alias("b")).distinct().collect()}
        base, places = _read(spark, target, before, touched), before["places"]
    state = apply_changes(changes, key=key, buckets=n, base=base, **names)
    version = f"v-{uuid.uuid4().hex}"
    state.withColumn(_BUCKET, _bucket_of(key, n)).write.partitionBy(_BUCKET).parquet(f"{target}/{version}")
    fs, folder = hadoop_fs(spark, f"{target}/{version}")
    written = [f.getPath().getName().split("=")[1] for f in fs.listStatus(folder) if f.isDirectory()]
    pointer = {"schema": state.schema.json(), "buckets": n, "places": places | {b: version for b in written}}
    _swap(spark, target, pointer)
    return _read(spark, target, pointer)


def vacuum(spark: SparkSession, target: str) -> int:
    """Delete the folders below ``target`` that the current version doesn't use, once no reader needs them; returns their number."""
    pointer = _pointer(spark, target) or {}
    used = {pointer.get("version")} | {f"{v}/{_BUCKET}={b}" for b, v in pointer.get("places", {}).items()}
    fs, root = hadoop_fs(spark, target)
    gone = 0
    for v in (f.getPath() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName() not in used):
        parts = [f.getPath() for f in fs.listStatus(v) if f.isDirectory()]
        spare = [p for p in parts if f"{v.getName()}/{p.getName()}" not in used]
        for p in [v] if len(spare) == len(parts) else spare:
            gone += bool(fs.delete(p, True))
    return gone
