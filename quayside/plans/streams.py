"""Registered queries: streams over the given events, run to the end of what has landed, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators.evidence import indicator_files
from quayside.plans.registry import Tables, register
from quayside.streaming import changes as s
from quayside.streaming import flushes as fl

POLL = 6 * 3600


def event_stream(t: Tables, folder: str | None = None):
    """The events table, or what has landed of it in a folder, as a stream of file changes: the expressions of the view v_changes."""
    raw = s.read_stream(t.spark, folder or t.folder, "*.parquet" if folder else "events.parquet", t.base("events").schema)
    return raw.select(
        "event_id", "ts", F.expr("concat('/p', CAST(user_id AS STRING), '/f', CAST(event_id % 5 AS STRING))").alias("path"),
        F.expr("concat('p', CAST(user_id AS STRING))").alias("project_id"),
        F.expr("CASE WHEN event_id % 11 = 10 THEN NULL ELSE md5(CAST(event_id % 3 AS STRING)) END").alias("hash"),
        F.expr("CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END").alias("severity"),
    )


def landings(t: Tables, label: str, steps: int = 3):
    """Land the events in some steps, cut anywhere in time; yields the folder after each."""
    rows = t.base("events")
    folder = s.stream_path(t.spark, label)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    part = F.least(F.lit(steps - 1), F.floor((micros - F.lit(low or 0)) / F.lit(((high or 0) - (low or 0)) / steps + 1)))
    for step in range(steps):
        rows.where(F.coalesce(part, F.lit(0)) == step).write.mode("append").parquet(folder)
        yield folder


CHANGES = f"""WITH l AS (SELECT path, CAST(floor(epoch_us(ts) / {POLL * 1_000_000}) AS BIGINT) AS tick, hash, ts, event_id FROM v_changes),
  n AS (SELECT path, tick, hash FROM (SELECT *, row_number() OVER (PARTITION BY path, tick ORDER BY ts DESC, event_id DESC) AS r FROM l) WHERE r = 1),
  o AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY tick) AS old FROM n)
  SELECT path, tick, CASE WHEN old IS NULL THEN 'created' WHEN hash IS NULL THEN 'deleted' ELSE 'modified' END AS event, hash FROM o WHERE old IS DISTINCT FROM hash"""


@register("t1_change_stream", CHANGES)
def change_stream(t: Tables):
    path = s.stream_path(t.spark, "changes")
    for folder in landings(t, "landed"):
        log = s.append_table(s.change_stream(event_stream(t, folder), POLL), path)
    return s.newest_changes(log)


@register("t1_change_batch", CHANGES)
def change_batch(t: Tables):
    return s.change_batch(t.view("v_changes"), POLL)


SESSIONS = """WITH g AS (SELECT project_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM v_changes WINDOW w AS (PARTITION BY project_id ORDER BY ts)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT project_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started_us, count(*) AS changes, CAST(ceil(count(*) / 10) AS BIGINT) AS flushes FROM i GROUP BY project_id, session"""


@register("t2_debounce", SESSIONS)
def debounce(t: Tables):
    rows = t.view("v_changes").withColumn("ts", F.col("ts").cast("timestamp"))
    return s.debounced(rows, "30 minutes").select("project_id", F.unix_micros("started").alias("started_us"), "changes", "flushes")


def land_all(t: Tables, label: str, closings: int = 1):
    """Land the events in two steps, then late events of nobody, so that the watermark passes all others; yields the folder after each."""
    for folder in landings(t, label, 2):
        yield folder
    rows = t.base("events")
    for k in range(1, closings + 1):
        late = F.col("ts") + F.expr(f"INTERVAL {10 * k} DAYS")
        closing = rows.agg(F.max("ts").alias("ts")).select(*[(late if c.name == "ts" else F.lit(None)).cast(c.dataType).alias(c.name) for c in rows.schema])
        closing.where("ts IS NOT NULL").write.mode("append").parquet(folder)
        yield folder


def watermarked(t: Tables, folder: str):
    return event_stream(t, folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


@register("t2_debounce_stream", SESSIONS)
def debounce_stream(t: Tables):
    """The same sessions as a stream; a session appears once the watermark has passed its end."""
    path = s.stream_path(t.spark, "sessions")
    for folder in land_all(t, "landed"):
        log = s.append_table(s.debounced(watermarked(t, folder), "30 minutes"), path)
    return log.where("project_id IS NOT NULL").select("project_id", F.unix_micros("started").alias("started_us"), "changes", "flushes")


FLUSHES = """WITH g AS (SELECT project_id, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS tick, event_id FROM v_changes),
  f AS (SELECT *, CASE WHEN tick - lag(tick) OVER w < 30 THEN 0 ELSE 1 END AS fresh FROM g WINDOW w AS (PARTITION BY project_id ORDER BY tick, event_id)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f),
  n AS (SELECT *, min(tick) OVER (PARTITION BY project_id, k) AS session, row_number() OVER (PARTITION BY project_id, k ORDER BY tick, event_id) - 1 AS place FROM i)
  SELECT project_id, session, place // 10 + 1 AS flush, min(tick) AS started, max(tick) AS ended, count(*) AS changes, CASE count(*) WHEN 10 THEN 'count' ELSE 'quiet' END AS reason
  FROM n GROUP BY project_id, session, place // 10"""


@register("t2_flush_batch", FLUSHES)
def flush_batch(t: Tables):
    """Flushes at the tenth pending change or after thirty quiet minutes."""
    return fl.flush_batch(t.view("v_changes"))


@register("t2_flush_stream", FLUSHES)
def flush_stream(t: Tables):
    """The same flushes as a stream over three landings, by count and by event-time timer."""
    path = s.stream_path(t.spark, "flushes")
    for folder in land_all(t, "landed"):
        log = s.append_table(fl.flush_stream(watermarked(t, folder)), path)
    return log.where("project_id IS NOT NULL").drop("batch_id")


CACHE = """WITH e AS (SELECT project_id AS package, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS tick, ts, CASE WHEN severity IN ('HIGH', 'MEDIUM') THEN hash END AS stored, severity NOT IN ('HIGH', 'MEDIUM') AS asked FROM v_changes),
  k AS (SELECT package, tick, arg_max(stored, row(ts, stored)) FILTER (stored IS NOT NULL) AS stored, bool_or(asked) AS asked FROM e GROUP BY ALL),
  c AS (SELECT *, last_value(CASE WHEN stored IS NOT NULL THEN struct_pack(tick := tick, stored := stored) END IGNORE NULLS) OVER (PARTITION BY package ORDER BY tick) AS held FROM k)
  SELECT package, tick, CASE WHEN tick - held.tick < 1440 THEN held.stored END AS advisory_set, CASE WHEN tick - held.tick < 1440 THEN 'hit' ELSE 'refetch' END AS answer FROM c WHERE asked"""


def cache_rows(changes):
    stores = F.col("severity").isin("HIGH", "MEDIUM")
    return changes.select(F.col("project_id").alias("package"), "ts", F.when(stores, F.col("hash")).alias("advisory_set"), (~stores).alias("asked"))


@register("t5_cache_batch", CACHE)
def cache_batch(t: Tables):
    """Which requests for a package's advisories a stored set still answers."""
    return fl.cache_batch(cache_rows(t.view("v_changes")))


@register("t5_cache_stream", CACHE)
def cache_stream(t: Tables):
    path = s.stream_path(t.spark, "cache")
    for folder in land_all(t, "landed", closings=2):
        log = s.append_table(fl.cache_stream(cache_rows(watermarked(t, folder))), path, idle_batches=False)
    return log.where("package IS NOT NULL").drop("batch_id")


@register("t3_rescan_on_change", """SELECT project_id, name, kind, count(*) AS n FROM (SELECT project_id, name, 'indicator_file' AS kind FROM v_project_files WHERE (folder = '' OR regexp_matches(folder, '^node_modules/([^/]+/)?$')) AND name IN ('setup_bun.js', '.truffler-cache')
    UNION ALL SELECT project_id, name, 'malicious_file' FROM v_project_files WHERE folder = '' AND name = 'setup_bun.js' UNION ALL SELECT project_id, name, 'malicious_directory' FROM v_project_files WHERE folder = '' AND name = '.truffler-cache'
    UNION ALL SELECT project_id, name, 'campaign_pattern' FROM v_project_files WHERE name IN ('setup_bun.js', '.truffler-cache')) WHERE project_id IN (SELECT project_id FROM v_changes) GROUP BY ALL""")
def rescan_on_change(t: Tables):
    files = t.view("v_project_files")

    def scan(projects):
        affected = files.join(projects, "project_id", "left_semi")
        return indicator_files(affected).groupBy("project_id", "name", "kind").agg(F.count(F.lit(1)).alias("n"))

    path = s.stream_path(t.spark, "rescan")
    for folder in landings(t, "landed"):
        found = s.rescan_on_change(event_stream(t, folder), scan, path)
    return found


@register("t4_running_counters", """SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_us, severity, count(*) AS n FROM v_changes GROUP BY 1, 2""")
def running_counters(t: Tables):
    rows = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    log = s.append_table(s.running_counters(rows, "1 day"), s.stream_path(t.spark, "counters"), mode="update")
    return s.newest_updates(log, ["window_start", "severity"]).select(F.unix_micros("window_start").alias("window_us"), "severity", "n")
