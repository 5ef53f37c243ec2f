"""Every query with SQL against DuckDB at the smallest scale, and the driver's contract."""

import importlib
import os
import subprocess
import sys

import pytest
from helpers import same_as_sql

from loomline.plans import core_queries, list_queries, reference_queries

QUERIES = core_queries.QUERIES | reference_queries.QUERIES | list_queries.QUERIES
SQL = core_queries.SQL | reference_queries.SQL | list_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf, name):
    same_as_sql(spark, duck, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_wav_round_trip_has_every_row_and_sign(spark, tmp_path):
    """Zeros below zero, repeated and absent keys, samples out of range, NaN, null, and no vector."""
    import duckdb

    nan, inf = float("nan"), float("inf")
    vectors = [[-1e-6, -0.0, 1e-6, 0.0], [nan, None, inf, -inf], [3.0, -3.0, 1.0, -1.0], [0.5] * 4, None]
    rows = [(7, vectors[0]), (7, vectors[1]), (8, vectors[2]), (None, vectors[3]), (9, vectors[4])]
    rows = [(k, v and v * 16) for k, v in rows]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    own = [(r.vec_id, r.millis, r.pcm) for r in QUERIES["wav_round_trip"](spark, str(tmp_path)).collect()]
    # SQL gives every row 4 ms; without a vector there is no file
    want = [(k, None if p is None else m, p) for k, m, p in con.execute(SQL["wav_round_trip"]).fetchall()]
    assert sorted(map(repr, own)) == sorted(map(repr, want)) and any("-0.0, " in repr(r) for r in own)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "loomline.llm", None)
    assert set(importlib.reload(e).queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(e)


def test_a_broken_subpackage_is_an_error(monkeypatch):
    import __spark_entry__ as e

    broken = type(sys)("loomline.llm")
    monkeypatch.setitem(sys.modules, "loomline.llm", broken)
    monkeypatch.delitem(sys.modules, "loomline.llm.queries", raising=False)
    broken.__path__ = []
    monkeypatch.setattr(broken, "__getattr__", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("No module named 'other'", name="other")), raising=False)
    with pytest.raises(ImportError):
        importlib.reload(e)
    monkeypatch.undo()
    importlib.reload(e)


def test_the_library_reaches_workers_elsewhere(sf, tmp_path):
    """A driver started in another folder, on executors of their own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
from loomline.session import shared_dir, drop_scratch
s = SparkSession.builder.master("local-cluster[1,1,900]").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.executor.memory", "900m").getOrCreate()
print("ROWS", e.queries()["chunk_greedy"](s, {sf!r}).count(), len(e.queries()["p1_found"](s, {sf!r}).collect()))
drop_scratch(s)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert not list((tmp_path / "shared" / "loomline").iterdir())
