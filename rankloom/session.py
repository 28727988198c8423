"""Session helpers: a local session for tests and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "rankloom", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the checkpoint folder that the session names, in spark.checkpoint.dir or by
    setCheckpointDir. A local session that names none gets a temporary one; any other must name one, as executors share it."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        given = sc._jsc.sc().getCheckpointDir()
        named = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        _folders[sc.applicationId] = f"{named.rstrip('/')}/rankloom-{sc.applicationId}"
        atexit.register(_delete, spark, _folders[sc.applicationId])
    return _folders[sc.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001, S110
        pass  # the session is gone; the folder's owner clears it


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from there: its lineage is cut, it is computed once, and later
    reads prune columns and row groups. The folder is deleted when the program ends, or by discard()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out), path)
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_tables: dict[int, tuple[weakref.ref, str]] = {}


def discard(table: DataFrame) -> None:
    """Delete the files of a table that cut() gave and that nothing reads any more."""
    ref, path = _tables.pop(id(table), (None, ""))
    if ref is not None and ref() is table:
        _delete(table.sparkSession, path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all cores where its files make fewer tasks than that; left alone, without a shuffle, where they make enough."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *by)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a session, so that executors need no copy of it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="rankloom-package-"))
        shutil.copytree(root, folder / "tree" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(folder / root.name), "zip", folder / "tree"))
        _shipped.add(app)
