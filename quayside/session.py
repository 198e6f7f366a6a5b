"""Session helpers shared by every module: where tables may be written, and how fixed values become DataFrames."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# What a task of a step with a known number of rows gets: rows before Spark joins small partitions, shuffled bytes after.
ROWS_OF_TASK = 250_000
BYTES_OF_TASK = "8m"


def local_session(cores: str | int = "*", app: str = "quayside") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if str(cores).isdigit():
        spark.conf.set("spark.quayside.spread", str(cores))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a source with too few splits to more tasks, where ``spark.quayside.spread`` asks for it.

    A file with one row group is one task, whatever the cores. Large inputs have splits enough: leave the setting
    unset there, and no shuffle is added. Filters and column pruning still reach the scan.
    """
    tasks = df.sparkSession.conf.get("spark.quayside.spread", None)
    return df.repartition(int(tasks)) if tasks else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local path
    would lose its data together with the machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quayside-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quayside/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of what starts inside; the session gets its own back."""
    own = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in own.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut_lineage(df: DataFrame, label: str = "step", rows: int | None = None) -> DataFrame:
    """Write a step as a table in the shared folder and read it again.

    Later stages restart from the table when executors are lost, and the planner knows its size. The step's shuffle files are
    of no more use then, so Spark is asked to remove them as the step ends. ``rows``, where a task sorts what it gets, is
    how many go through the step's shuffles: the partitions then grow in number with it, not in size.
    """
    spark = df.sparkSession
    path, wanted = scratch_path(spark, label), {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if rows is not None:
        wanted["spark.sql.shuffle.partitions"] = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_TASK)))
        wanted["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = BYTES_OF_TASK
    with settings(spark, wanted):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str, parts: int, label: str = "step") -> DataFrame:
    """Write a step that ends in an aggregation by ``column`` as a table in so many buckets of it in the shared folder.

    Joins on the column read the table as it lies, without another shuffle of its rows.
    """
    spark = df.sparkSession
    path, name = scratch_path(spark, label), f"quayside_{uuid.uuid4().hex}"
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with settings(spark, wanted):  # the aggregation's partitions are the buckets, so a task writes one file
        df.write.bucketBy(parts, column).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, for the few operators that run Python in tasks."""
    context = spark.sparkContext
    if getattr(context, "_quayside_shipped", None) == context.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quayside-"), "quayside"), "zip", root, "quayside")
    context.addPyFile(archive)
    context._quayside_shipped = context.applicationId


def fixed_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table of fixed values, built inside the JVM (no Python worker, no file)."""
    literal = json.dumps(rows)
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(literal), f"array<struct<{ddl}>>")))


def fixed_dim(spark: SparkSession, rows: list[dict], ddl: str, limit: int = 10_000) -> DataFrame:
    """A fixed table as the broadcast side of a join; its size is proven here, not assumed."""
    if len(rows) > limit:
        raise ValueError(f"{len(rows)} rows is too many for a broadcast table of fixed values")
    return F.broadcast(fixed_table(spark, rows, ddl))
