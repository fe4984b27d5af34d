"""Session helpers: building one for tests, reading tables, shipping the package, cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sahifa")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; pruning and pushdown happen in the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so Arrow functions import it there."""
    context = spark.sparkContext
    if getattr(context, "_sahifa_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="sahifa_"))
    archive = folder / "sahifa_dist.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, f"sahifa/{source.relative_to(_PACKAGE)}")
    context.addPyFile(str(archive))
    context._sahifa_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only where that is unset (tests)."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = "file://" + os.path.join(tempfile.gettempdir(), "sahifa_shared")
    return f"{shared.rstrip('/')}/sahifa-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage: what follows reads the table as often as it likes, and a lost executor
    costs no more than the tasks it ran. The tables of a session go when it ends, or by
    ``discard``. ``sweep``: the shuffle files of the write go with it, not when the driver next
    collects its garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = shared_folder(spark)
    if not getattr(context, "_sahifa_cleanup", False):
        context._sahifa_cleanup = True
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if sweep:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if sweep:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._sahifa_path = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table made by ``materialise`` that nothing reads any more."""
    _remove(table.sparkSession, table._sahifa_path)
