"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Spark settings this package relies on. Sizes and core counts are left to
# whoever submits the job.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def build_session(app_name: str = "veclens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; keyword settings use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as ``spark.checkpoint.dir`` names it.

    A local session without that setting gets a temporary folder; a cluster
    session without it is an error, because a machine-local folder would be
    lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="veclens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"


def as_uri(path: str) -> str:
    """A path with its scheme; plain paths are local or mounted files."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def task_uri(path: str) -> str:
    """A path as Arrow names it: Spark's names for a store (``s3a``) are Arrow's (``s3``)."""
    return re.sub(r"^s3[an]://", "s3://", as_uri(path))


def task_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the place in it, for files that tasks open themselves."""
    return fs.FileSystem.from_uri(task_uri(path))


def opened_by_tasks(path: str) -> bool:
    """Whether tasks can open files under a path themselves; a store that only Spark knows is left to its writers."""
    try:
        task_filesystem(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Lets a read list many folders in a few tasks per core, not in a task per folder."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def on_store(path: str):
    """Hadoop's file system of a path and the path, on the driver; any store that Spark reads."""
    spark = SparkSession.active()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(path: str) -> bool:
    store, place = on_store(path)
    return store.exists(place)


def has_folder(pattern: str) -> bool:
    """Whether a name or a pattern of names is that of a folder."""
    store, place = on_store(pattern)
    return any(found.isDirectory() for found in store.globStatus(place) or ())


def fingerprint(path: str) -> str:
    """A name for the present state of a folder: its files with their sizes and times."""
    store, place = on_store(path)
    files = [(file.getPath().getName(), file.getLen(), file.getModificationTime()) for file in store.listStatus(place)]
    return hashlib.md5(repr((path, sorted(files))).encode()).hexdigest()


def discard(path: str) -> None:
    """Deletes a staged table that nothing reads any more."""
    if "/staged/" not in path:
        raise ValueError(f"{path} is not a staged table")
    store, place = on_store(path)
    store.delete(place, True)


def stage(df: DataFrame, name: str, *, compression: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Three effects: the work behind ``df`` runs once although several branches
    use it, a lost executor costs no recomputation, and Catalyst knows the
    table's true size, so it broadcasts the table only while it is under
    ``spark.sql.autoBroadcastJoinThreshold``. ``release`` deletes it.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def release(*staged: DataFrame) -> None:
    """Deletes tables that ``stage`` returned and that nothing reads any more."""
    for df in staged:
        discard(df.staged_at)
