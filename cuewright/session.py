"""Session construction and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once for an application.

    Workers import the functions they run; on a cluster, or from another working directory, the package
    need not be on their path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cuewright-code-")  # the driver serves it from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/cuewright.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(f"{folder}/cuewright.zip")
    _SHIPPED.add(context.applicationId)


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with the engine's defaults."""
    builder = SparkSession.builder.appName("cuewright")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees.

    The cluster names it in ``spark.checkpoint.dir``; only where that setting is absent (tests on
    one machine) a temporary folder is made and set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        local = tempfile.mkdtemp(prefix="cuewright-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        context.setCheckpointDir("file://" + local)
        current = context.getCheckpointDir()
    return current.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage, is computed once however often it is read, and survives the loss of
    executors, as the folder is not on them.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run within leaves no shuffle files: Spark removes them as soon as a query has ended.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def release(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _remove(df.sparkSession, file.rpartition("/")[0])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)
