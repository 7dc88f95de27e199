"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tapeline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, unless they find it by themselves.

    They do when the project's folder is on PYTHONPATH or is the working folder.
    """
    root = Path(__file__).resolve().parents[1]
    found = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    context = spark.sparkContext
    if any(p.resolve() == root or (p / "tapeline").exists() for p in found) or getattr(context, "_tapeline_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tapeline-")) / "tapeline_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((root / "tapeline").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(path))
    context._tapeline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tapeline-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, but stays columnar, so later scans
    still prune columns and the planner knows the real size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tapeline/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _with(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside; its own value comes back afterwards."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, limit: str = "4m"):
    """What runs inside sends Python workers Arrow batches of about ``limit`` bytes, so that a few thousand long texts are not in memory at once."""
    return _with(spark, "spark.sql.execution.arrow.maxBytesPerBatch", limit)


def shuffles_dropped(spark: SparkSession):
    """What is stored inside leaves no shuffle files behind: only for tables that are read from their files afterwards."""
    return _with(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs inside shuffles to ``n`` tasks, none of them put together again."""
    with _with(spark, "spark.sql.shuffle.partitions", str(n)), _with(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        yield
