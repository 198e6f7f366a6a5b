"""Snapshots and audit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.catalogue import lists as words


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Created, modified and deleted files. A full outer match written as one aggregation over both sides."""
    keys = keys or ["path"]
    sides = before.select(*keys, F.col("hash").alias("old_hash"), F.lit(None).cast("string").alias("new_hash")).unionByName(
        after.select(*keys, F.lit(None).cast("string").alias("old_hash"), F.col("hash").alias("new_hash"))
    )
    both = sides.groupBy(*keys).agg(F.max("old_hash").alias("old_hash"), F.max("new_hash").alias("new_hash"))
    event = (
        F.when(F.col("old_hash").isNull(), "created")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    return both.withColumn("event", event).where("event IS NOT NULL")


def unexpected_new_files(changes: DataFrame) -> DataFrame:
    """Created files outside the places an install writes to."""
    expected = F.lit(False)
    for pattern in words.EXPECTED_NEW_FILES:
        expected = expected | F.col("path").contains(pattern)
    return changes.where((F.col("event") == "created") & ~expected)


def consecutive_audits(audits: DataFrame) -> DataFrame:
    """For every audit with a predecessor, each vulnerability as new, fixed or unchanged.

    Every row serves as 'after' of its own audit and as 'before' of the next one, so one aggregation compares all
    neighbouring audits at once.
    """
    rows = audits.select("project_id", "audit_year", "name").distinct()
    by = Window.partitionBy("project_id").orderBy("audit_year")
    years = rows.select("project_id", "audit_year").distinct().select(
        "project_id", "audit_year", F.lag("audit_year").over(by).alias("_prev"), F.lead("audit_year").over(by).alias("_next")
    )
    placed = rows.join(years, ["project_id", "audit_year"])
    after = placed.where("_prev IS NOT NULL").select("project_id", "audit_year", "name", F.lit(False).alias("was"), F.lit(True).alias("now"))
    before = placed.where("_next IS NOT NULL").select("project_id", F.col("_next").alias("audit_year"), "name", F.lit(True).alias("was"), F.lit(False).alias("now"))
    both = after.unionByName(before).groupBy("project_id", "audit_year", "name").agg(F.bool_or("was").alias("was"), F.bool_or("now").alias("now"))
    status = F.when(~F.col("was"), "new").when(~F.col("now"), "fixed").otherwise("unchanged")
    return both.select("project_id", "audit_year", "name", status.alias("status"))


def latest_audits(audits: DataFrame, n: int) -> DataFrame:
    """The last ``n`` audits of each project with their age rank. Spark limits each group before the shuffle."""
    runs = audits.groupBy("project_id", "audit_year").agg(F.max("audit_time").alias("audit_time"), F.count(F.lit(1)).alias("entries"))
    by = Window.partitionBy("project_id").orderBy(F.col("audit_time").desc(), F.col("audit_year").desc())
    return runs.withColumn("age", F.row_number().over(by)).where(F.col("age") <= n)


def valid_cache(entries: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """T5: the newest cache entry of each package, if it is younger than ``hours``; partial maximum, no ranking."""
    newest = entries.groupBy("package").agg(F.max_by("advisory_set", F.struct("cached_at", "advisory_set")).alias("advisory_set"), F.max("cached_at").alias("cached_at"))
    return newest.withColumn("valid", F.col("cached_at") > now - F.expr(f"INTERVAL {hours} HOURS"))
