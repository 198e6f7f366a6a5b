"""Continuous versions (T1-T4): file changes, debounced scans, rescans, running counters.

Every stream has bounded state: watermarks close windows and sessions, and the per-path state ends with the file.
Streams append to tables in the shared folder, keyed by micro-batch, so a replayed batch overwrites its own rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quayside.session import scratch_path, settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE_DDL = "path string, tick bigint, event string, hash string"


def read_stream(spark: SparkSession, folder: str, glob: str, schema: StructType) -> DataFrame:
    """A stream over landed parquet files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def change_event(old: str | None, new: str | None) -> str | None:
    """What one look at a path shows, given the hash of the look before."""
    if old is None:
        return None if new is None else "created"
    if new is None:
        return "deleted"
    return None if old == new else "modified"


def is_later(seq: str | None, known: str | None) -> bool:
    """Whether a look comes after the known one of its tick; a look without event id counts as the last."""
    return seq is None or (known is not None and seq > known)


def tick_events(old: str | None, looks: dict[int, tuple]) -> dict[int, tuple]:
    """(event, hash) of every tick that shows one. ``looks``: tick to (seq, hash); ``old``: the hash before the first."""
    out = {}
    for tick in sorted(looks):
        new = looks[tick][1]
        event = change_event(old, new)
        if event:
            out[tick] = (event, new)
        old = new
    return out


class ChangeDetector(StatefulProcessor):
    """Per path, the newest hash at each poll tick against the hash before.

    State: the looks of the newest tick and of the ``late_ticks`` before it, and the hash before those. A later look at one of
    these ticks, in whatever batch it comes, mends the events: a row with the same (path, tick) replaces the earlier one, and one
    without event takes it back. Looks at older ticks come too late and change nothing. A path's rows are folded to the newest
    look per tick as they stream through, so a path with very many rows needs memory for its ticks only.
    """

    def __init__(self, late_ticks: int = 1):
        self.late_ticks = late_ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "closed bigint, old string, ticks array<bigint>, seqs array<string>, hashes array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = self.state.get()
        closed, old, *kept = state if state is not None else (None, None, [], [], [])
        looks = {t: (seq, value) for t, seq, value in zip(*kept)}
        known = tick_events(old, looks)
        for row in rows:
            tick, seq = row["tick"], row["seq"]
            if tick is None:
                continue
            if (closed is None or tick > closed) and (tick not in looks or is_later(seq, looks[tick][0])):
                looks[tick] = (seq, row["hash"])
        events = tick_events(old, looks)
        none = (None, None)
        for tick in sorted(looks):
            if events.get(tick) != known.get(tick):
                yield Row(path=key[0], tick=tick, event=events.get(tick, none)[0], hash=events.get(tick, none)[1])
        ticks = sorted(looks)
        for tick in ticks:
            if tick < ticks[-1] - self.late_ticks:
                closed, old = tick, looks.pop(tick)[1]
        ticks = sorted(looks)
        self.state.update((closed, old, ticks, [looks[t][0] for t in ticks], [looks[t][1] for t in ticks]))

    def close(self) -> None:
        pass


def change_stream(rows: DataFrame, poll_seconds: int, late_ticks: int = 1) -> DataFrame:
    """Created, modified and deleted files. ``rows``: path, ts, event_id, hash (null: the file is gone).

    The output is a log of updates: ``newest_changes`` gives the events as they stand.
    """
    # the processor also starts in a worker of the driver, which does not see shipped packages
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    keyed = rows.select(
        "path", F.floor(seconds / (poll_seconds * 1_000_000)).cast("bigint").alias("tick"),
        F.concat(F.lpad(seconds.cast("string"), 20, "0"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("seq"), "hash",
    )
    return keyed.groupBy("path").transformWithState(
        statefulProcessor=ChangeDetector(late_ticks), outputStructType=CHANGE_DDL, outputMode="Append", timeMode="None",
    )


def newest_changes(log: DataFrame) -> DataFrame:
    """The events of a change log as they stand after its last batch."""
    return newest_updates(log, ["path", "tick"]).where("event IS NOT NULL")


def change_batch(rows: DataFrame, poll_seconds: int) -> DataFrame:
    """T1 as a batch: newest hash per (path, tick) by partial maximum, then each tick against the one before."""
    from pyspark.sql import Window

    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    looks = rows.withColumn("tick", F.floor(seconds / (poll_seconds * 1_000_000)).cast("bigint")).groupBy("path", "tick").agg(
        F.max_by("hash", F.struct("ts", "event_id")).alias("hash")
    )
    old = F.lag("hash").over(Window.partitionBy("path").orderBy("tick"))
    event = (
        F.when(F.col("_old").isNull() & F.col("hash").isNotNull(), "created")
        .when(F.col("_old").isNotNull() & F.col("hash").isNull(), "deleted")
        .when(F.col("_old") != F.col("hash"), "modified")
    )
    return looks.withColumn("_old", old).withColumn("event", event).where("event IS NOT NULL").select("path", "tick", "event", "hash")


def debounced(rows: DataFrame, quiet: str, max_pending: int = 10) -> DataFrame:
    """Pending changes of a project flush after a quiet gap, or whenever ``max_pending`` have gathered."""
    session = F.session_window(F.col("ts"), quiet)
    return rows.groupBy("project_id", session.alias("s")).agg(F.count(F.lit(1)).alias("changes")).select(
        "project_id", F.col("s.start").alias("started"), "changes", F.ceil(F.col("changes") / max_pending).cast("bigint").alias("flushes")
    )


def running_counters(rows: DataFrame, width: str) -> DataFrame:
    """T4: counts by severity and window."""
    return rows.groupBy(F.window("ts", width).alias("w"), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "severity", "n")


def begin_log(spark: SparkSession, schema: StructType, path: str) -> None:
    """An empty batch, so that a log without any batch can be read."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=none")


def read_log(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def append_table(stream: DataFrame, path: str, mode: str = "append", idle_batches: bool = True) -> DataFrame:
    """Run a stream over everything that has landed; batches are written by id, so a replay does not double them.

    A stream whose state lives by the clock asks for another batch for ever: run it without ``idle_batches``; what its
    watermark closes then comes with the next landing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id:08d}")

    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields]).add("batch_id", "integer")
    begin_log(spark, schema, f"{path}/data")
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_log(spark, schema, f"{path}/data")


def newest_updates(log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an update-mode log as they stand now: the last batch of each key wins."""
    rest = [c for c in log.columns if c not in [*keys, "batch_id"]]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def rescan_on_change(changes: DataFrame, scan: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Each micro-batch rescans the projects that changed in it. ``scan`` takes distinct project ids, returns rows with ``project_id``.

    The scanned projects and the results are written per batch; reading keeps, for each project, the rows of its last scan, so a
    project whose last scan finds nothing has none.
    """
    spark = changes.sparkSession
    ids = StructType([changes.schema["project_id"]])
    scanned_schema = StructType([*ids.fields]).add("batch_id", "integer")
    schema = StructType([*scan(spark.createDataFrame([], ids)).schema.fields]).add("batch_id", "integer")
    begin_log(spark, scanned_schema, f"{path}/scanned")
    begin_log(spark, schema, f"{path}/data")

    def rescan(batch: DataFrame, batch_id: int) -> None:
        scanned = f"{path}/scanned/batch={batch_id:08d}"
        batch.select("project_id").distinct().withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(scanned)
        projects = spark.read.schema(scanned_schema).parquet(scanned).select("project_id")
        scan(projects).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id:08d}")

    query = changes.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(rescan).trigger(availableNow=True).start()
    query.awaitTermination()
    log = read_log(spark, schema, f"{path}/data")
    last = read_log(spark, scanned_schema, f"{path}/scanned").groupBy("project_id").agg(F.max("batch_id").alias("batch_id"))
    return log.join(last, ["project_id", "batch_id"], "left_semi").drop("batch_id")


def stream_path(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)
