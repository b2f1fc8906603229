"""Session helpers: settings the jobs rely on, and durable scratch folders."""

from __future__ import annotations

import functools
import os
import pathlib
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "rolemill", cores: str | int = "*", shuffle: int | None = None, shared: str | None = None
) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own. ``shared`` is its folder for written frames."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ROLEMILL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that change results: UTC days, no more."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for frames that run its Python code there."""
    sent = [p for p in spark.sparkContext._python_includes if p.startswith("rolemill-")]
    if not sent:
        spark.sparkContext.addPyFile(_zipped())


@functools.cache
def _zipped() -> str:
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="rolemill-code-")) / "rolemill-code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    return str(target)


def durable_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _one_machine_folder()


@functools.cache
def _one_machine_folder() -> str:
    """For a session of one process that names no folder, as in tests."""
    return tempfile.mkdtemp(prefix="rolemill-")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the durable root, never reused."""
    return f"{durable_root(spark)}/{purpose}-{uuid.uuid4().hex}"


#: With it, a run's shuffle files go when it ends, not when the driver happens to collect its garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, purpose: str, gone: Iterable[DataFrame] = ()) -> DataFrame:
    """The frame as a table in the durable folder: computed once, kept when executors are lost.

    For frames that several later joins read; each would otherwise compute it again. ``gone`` are
    written tables that only this frame still had to read; they are deleted afterwards.
    """
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    before = spark.conf.get(_SHUFFLES_GO, "false")
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_SHUFFLES_GO, before)
    table = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[table] = folder
    discard(*gone)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned; no frame that is still to run may read them."""
    for table in tables:
        spark, folder = table.sparkSession, _FOLDERS.pop(table)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
