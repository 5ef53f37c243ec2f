"""Folds over ordered rows of a key in constant memory.

Rows are partitioned by key and sorted; the fold walks a partition's batches and keeps one key's state at a time, so
no group is ever collected. A key is one task's work, so callers choose keys that stay small: stretches between pauses, or
stretches of time whose effects are carried on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold:
    """State of one key. ``step`` and ``end`` yield output rows as tuples without the key."""

    def step(self, row: tuple) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def fold_sorted(df: DataFrame, key: str, order: list[str], values: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """Run a fold over each key's rows in ``order``; ``schema`` starts with the key. Rows without a key are left out."""
    rows = df.filter(F.col(key).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, *values)
    names = [f.strip().split()[0] for f in _split(schema)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, out = None, None, []

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
            out.clear()
            return done

        for batch in batches:
            for k, *row in zip(*(cells(c) for c in batch.columns)):
                if k != now:
                    if fold is not None:
                        out.extend((now, *r) for r in fold.end())
                    now, fold = k, make()
                out.extend((k, *r) for r in fold.step(tuple(row)))
            if len(out) > 4096:
                yield flush()
        if fold is not None:
            out.extend((now, *r) for r in fold.end())
        yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


def cells(column: pa.Array) -> Iterable:
    """Values of a column; lists of numbers as arrays, which spares a Python object a number."""
    if not (pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type)):
        return column.to_pylist()
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] if ok else None for a, b, ok in zip(at, at[1:], column.is_valid().to_pylist())]


def _split(schema: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            parts.append(schema[at:i])
            at = i + 1
    return [*parts, schema[at:]]
