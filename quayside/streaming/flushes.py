"""Debounced flushes and cached advisories as streams (T2, T5), with their batch twins.

Both streams fold first: what falls into one tick of a key is one row, however hot the key is, and a tick goes on once the
watermark has passed it. State therefore sees each key's ticks in order, and holds a few numbers per key.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FLUSH_DDL = "project_id string, session bigint, flush bigint, started bigint, ended bigint, changes bigint, reason string"


def tick_of(ts, tick_seconds: int):
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (tick_seconds * 1_000_000)).cast("bigint")


class Debouncer(StatefulProcessor):
    """Pending changes of a project flush when ``most`` have gathered, or when ``quiet`` ticks passed without a change.

    State: the session's first tick, the changes seen in it, the first tick of what is pending, the last tick. An event-time
    timer stands behind the quiet gap; the next change moves it.
    """

    def __init__(self, tick_seconds: int, quiet: int, most: int):
        self.tick_seconds, self.quiet, self.most = tick_seconds, quiet, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "session bigint, seen bigint, started bigint, last bigint")

    def timer_of(self, state: tuple) -> int:
        """Behind the quiet gap, and one tick more: a change just inside the gap is told when its own tick ends."""
        return (state[3] + self.quiet + 1) * self.tick_seconds * 1000

    def rest(self, project: str, state: tuple) -> list[tuple]:
        session, seen, started, last = state
        pending = seen % self.most
        return [(project, session, seen // self.most + 1, started, last, pending, "quiet")] if pending else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self.open.get(), []
        timer = self.timer_of(state) if state else None
        ticks = sorted(pair for batch in rows for pair in zip(batch["tick"].tolist(), batch["n"].tolist()))
        for tick, n in ticks:
            if state is not None and tick - state[3] >= self.quiet:
                out += self.rest(key[0], state)
                state = None
            session, seen, started, _ = state or (tick, 0, tick, tick)
            while n:
                if seen % self.most == 0:
                    started = tick
                taken = min(n, self.most - seen % self.most)
                seen, n = seen + taken, n - taken
                if seen % self.most == 0:
                    out.append((key[0], session, seen // self.most, started, tick, self.most, "count"))
            state = (session, seen, started, tick)
        if state is not None:
            self.open.update(state)
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self.timer_of(state))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FLUSH_DDL.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.open.get()
        out = self.rest(key[0], state) if state else []
        self.open.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FLUSH_DDL.split(", ")])

    def close(self) -> None:
        pass


def flush_stream(rows: DataFrame, tick_seconds: int = 60, quiet_ticks: int = 30, max_pending: int = 10) -> DataFrame:
    """Flushes of a watermarked stream of (project_id, ts)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    folded = rows.groupBy("project_id", F.window("ts", f"{tick_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    ticks = folded.select("project_id", F.window_time("w").alias("ts"), tick_of(F.col("w.start"), tick_seconds).alias("tick"), "n")
    return ticks.groupBy("project_id").transformWithStateInPandas(
        statefulProcessor=Debouncer(tick_seconds, quiet_ticks, max_pending), outputStructType=FLUSH_DDL, outputMode="Append", timeMode="EventTime",
    )


def flush_batch(rows: DataFrame, tick_seconds: int = 60, quiet_ticks: int = 30, max_pending: int = 10) -> DataFrame:
    """T2 as a batch: ticks are folded first, so windows see a project's ticks and not its changes."""
    ticks = rows.groupBy("project_id", tick_of(F.col("ts"), tick_seconds).alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("project_id").orderBy("tick")
    fresh = F.coalesce(F.col("tick") - F.lag("tick").over(by) >= quiet_ticks, F.lit(True))
    sessions = ticks.withColumn("fresh", fresh).withColumn("session", F.max(F.when(F.col("fresh"), F.col("tick"))).over(by))
    before = F.sum("n").over(Window.partitionBy("project_id", "session").orderBy("tick")) - F.col("n")
    placed = sessions.withColumn("before", before)
    first, last = F.floor(F.col("before") / max_pending), F.floor((F.col("before") + F.col("n") - 1) / max_pending)
    pieces = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    part = F.least(F.col("before") + F.col("n"), (F.col("chunk") + 1) * max_pending) - F.greatest("before", F.col("chunk") * max_pending)
    flushes = pieces.groupBy("project_id", "session", (F.col("chunk") + 1).alias("flush")).agg(F.min("tick").alias("started"), F.max("tick").alias("ended"), F.sum(part).alias("changes"))
    return flushes.withColumn("reason", F.when(F.col("changes") == max_pending, "count").otherwise("quiet"))


ANSWER_DDL = "package string, tick bigint, advisory_set string, answer string"


class AdvisoryCache(StatefulProcessor):
    """T5: an advisory set answers for ``valid`` ticks after it was stored; then, or without one, a refetch is asked for.

    The state itself expires ``lifetime`` after it was written, so sets that nobody asks for do not stay.
    """

    def __init__(self, valid: int, lifetime: datetime.timedelta):
        self.valid, self.lifetime = valid, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cached = handle.getValueState("cached", "tick bigint, advisory_set string", int(self.lifetime.total_seconds() * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, stored, out = self.cached.get(), False, []
        ticks = sorted((row for batch in rows for row in zip(batch["tick"].tolist(), batch["stored"], batch["asked"])), key=lambda r: r[0])
        for tick, new, asked in ticks:
            if not pd.isna(new):
                state, stored = (tick, new), True
            if asked:
                hit = state is not None and tick - state[0] < self.valid
                out.append((key[0], tick, state[1] if hit else None, "hit" if hit else "refetch"))
        if stored:
            self.cached.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER_DDL.split(", ")])

    def close(self) -> None:
        pass


def cache_ticks(rows: DataFrame, by) -> DataFrame:
    """Per package and tick: the newest set that was stored, and whether it was asked for."""
    return rows.groupBy("package", by).agg(
        F.max_by("advisory_set", F.when(F.col("advisory_set").isNotNull(), F.struct("ts", "advisory_set"))).alias("stored"), F.bool_or("asked").alias("asked")
    )


def cache_stream(rows: DataFrame, tick_seconds: int = 60, valid_hours: int = 24, lifetime: datetime.timedelta | None = None) -> DataFrame:
    """T5: answers to a watermarked stream of (package, ts, advisory_set or null, asked)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    folded = cache_ticks(rows, F.window("ts", f"{tick_seconds} seconds").alias("w"))
    ticks = folded.select("package", tick_of(F.col("w.start"), tick_seconds).alias("tick"), "stored", "asked")
    cache = AdvisoryCache(valid_hours * 3600 // tick_seconds, lifetime or datetime.timedelta(hours=valid_hours))
    return ticks.groupBy("package").transformWithStateInPandas(statefulProcessor=cache, outputStructType=ANSWER_DDL, outputMode="Append", timeMode="ProcessingTime")


def cache_batch(rows: DataFrame, tick_seconds: int = 60, valid_hours: int = 24) -> DataFrame:
    """T5 as a batch: the last set before each asking tick, by a window over ticks."""
    ticks = cache_ticks(rows, tick_of(F.col("ts"), tick_seconds).alias("tick"))
    last = F.last(F.when(F.col("stored").isNotNull(), F.struct("tick", "stored")), ignorenulls=True).over(Window.partitionBy("package").orderBy("tick"))
    hit = F.coalesce(F.col("tick") - F.col("c.tick") < valid_hours * 3600 // tick_seconds, F.lit(False))
    asked = ticks.withColumn("c", last).where("asked")
    return asked.select("package", "tick", F.when(hit, F.col("c.stored")).alias("advisory_set"), F.when(hit, "hit").otherwise("refetch").alias("answer"))
