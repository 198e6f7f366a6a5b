"""Positions within ordered groups, for groups of any size: no task and no window ever holds a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from quayside.session import cut_lineage


def _placer(group: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to the sorted rows of a partition their place in its run of their group, the partition, and whether the run is its first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, early = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, dtype=bool)
            for name in group:
                now, old = batch.column(name).slice(1), batch.column(name).slice(0, n - 1)
                differs = pc.or_(pc.fill_null(pc.not_equal(now, old), False), pc.xor(pc.is_null(now), pc.is_null(old)))
                fresh[1:] |= differs.to_numpy(zero_copy_only=False)
            fresh[0] = last is not None and last != [batch.column(name)[0].as_py() for name in group]
            at = np.arange(n, dtype=np.int64)
            begun = np.maximum.accumulate(np.where(fresh, at, -1))
            within = np.where(begun < 0, at + seen, at - begun)
            first = (begun < 0) & early
            last, seen, early = [batch.column(name)[n - 1].as_py() for name in group], int(within[-1]) + 1, bool(first[-1])
            added = {"_in": pa.array(within), "_part": pa.array(np.full(n, part, dtype=np.int32)), "_early": pa.array(first)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    return place


def numbered(df: DataFrame, group: list[str], order: list, position: str = "position", size: str | None = None, keep: list[Column] | None = None) -> DataFrame:
    """``df`` with each row's position (from 0) in its group, by ``order`` (nulls first), and optionally the group's size.

    Rows are dealt by ranges of (group, order) and sorted inside their partition; each partition counts its rows per group,
    and the counts before it are added back. Equal rows are told apart by their place in the input, so that not even a
    third of all rows with one key sit in one partition; which of them comes first is then arbitrary.

    Without sizes, rows get their place as they stream through their partition, and only the group that a partition begins
    with has rows before it: one number per partition is added, and the rows are not shuffled again. ``keep`` are the
    columns that are wanted beside the group, made only after the shuffle.
    """
    keys = [F.col(c).asc_nulls_first() for c in group] + order
    dealt = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("_place")).sortWithinPartitions(*keys, "_place")
    if size is None:
        kept = dealt.drop("_place") if keep is None else dealt.select(*group, *keep)
        columns = kept.columns
        schema = StructType([*kept.schema.fields]).add("_in", LongType()).add("_part", IntegerType()).add("_early", BooleanType())
        # written once: ranges are drawn from a sample, so positions must not be computed twice
        table = cut_lineage(kept.mapInArrow(_placer(group), schema), "ranks")
        # a partition begins with one group: these tables have a row or two per partition, whatever the input
        begun = table.where("_early").select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.lit(1).alias("_one")).distinct()
        same = F.lit(True)
        for i, c in enumerate(group):
            same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
        runs = table.join(F.broadcast(begun), same, "left_semi").groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_early").alias("_early"))
        before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
        shifts = runs.withColumn("_shift", before).where("_early").select(F.col("_part").alias("_p"), "_shift")
        joined = table.join(F.broadcast(shifts), (F.col("_part") == F.col("_p")) & F.col("_early"), "left")
        return joined.select(*columns, (F.col("_in") + F.coalesce("_shift", F.lit(0))).alias(position))
    table = cut_lineage(dealt.withColumn("_seq", F.monotonically_increasing_id()), "ranks")
    table = table.withColumn("_part", F.shiftright("_seq", 33))
    per_part = table.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    counts = per_part.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"),
        (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_size"),
    )
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return table.join(counts, same).select(*df.columns, (F.col("_seq") + F.col("_shift")).alias(position), F.col("_size").alias(size))
