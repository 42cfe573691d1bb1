"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_scope: ContextVar[str | None] = ContextVar("scratch", default=None)


def build_session(app_name: str = "propensity", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    ``master`` stays unset on a cluster, where the submitter decides it. Further settings go in ``conf``
    with dots written as double underscores: ``spark__sql__shuffle__partitions="64"``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # the train/test table has two partitions: write both at once instead of sorting rows by side
        .config("spark.sql.maxConcurrentOutputFileWriters", "8")
        # no call-site capture per column expression: it takes most of the time of building a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        named = tempfile.mkdtemp(prefix="propensity-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, in the innermost :func:`scratch` scope if there is one."""
    return f"{_scope.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system that the session knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: bytes of a staged table that a learner's task reads, and of a row group, which is not split
SPLIT_BYTES, ROW_GROUP_BYTES = 8 << 20, 4 << 20


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Scans that are planned inside have splits of ``SPLIT_BYTES`` at most, for learners whose rows take many times their bytes in the table."""
    name = "spark.sql.files.maxPartitionBytes"
    given = spark.conf.get(name)
    spark.conf.set(name, str(SPLIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, given)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables made inside, removed at the end whatever happens.

    Frames that read such tables are of no use afterwards. Threads join the scope if they run in a copy of
    the context (``contextvars.copy_context``).
    """
    folder = scratch_path(spark, "scratch")
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        remove_path(spark, folder)
