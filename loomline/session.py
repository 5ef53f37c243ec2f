"""Session settings and the shared scratch folder.

Operators never create sessions of their own; they take the caller's and read
``spark.checkpoint.dir`` from it. Only where that is unset (tests, a laptop)
is a local folder used.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
#: Scratch paths of each application that may still be there, and the applications that have the library.
_USED: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only if unset on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return str(set_by_hand.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="loomline-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
    return "file://" + _LOCAL_SCRATCH[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends or by ``drop_scratch``."""
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _USED:
        _USED[app] = []
        atexit.register(_drop, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _USED[app])
    _USED[app].append(path)
    return path


def _drop(jvm, configuration, paths: list[str]) -> None:
    while paths:
        try:
            place = jvm.org.apache.hadoop.fs.Path(paths.pop())
            place.getFileSystem(configuration).delete(place, True)
        except Exception:  # noqa: BLE001  the JVM has gone, and with it what could delete
            return


def drop_scratch(spark: SparkSession) -> None:
    """Delete what the operators have written to the shared folder so far; results not yet read are lost with it."""
    _drop(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _USED.get(spark.sparkContext.applicationId, []))


def ship_library(spark: SparkSession) -> None:
    """Give the Python workers this library, once an application: its folder on a local master, else an archive."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if sc.master.startswith("local["):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root.parent), sc.environment.get("PYTHONPATH", "")]))
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    path = scratch(spark, "library") + ".zip"
    _USED[sc.applicationId].append(path)
    fs, place = hadoop_fs(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)


def checkpointed(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path of ``path``."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
