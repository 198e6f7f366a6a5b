"""Exact top-k inner-product search in three phases with a uniform threshold (operator 6).

The dimensions are dealt to ``lists`` lists; a node is a block of vectors, and holds for every query one local score list per
part of the dimensions. Phase 1 gathers the k best entries of every local list, resolves them, and takes the k-th best score
of each query as a safe cutoff. Phase 2 sends the cutoff back: a vector that reaches it must have at least cutoff / lists in
one of its lists, so every node collects the entries of its lists that do. Phase 3 resolves these exactly, and keeps those
that reach the cutoff; the k best of them, ties to the smaller id, are the answer.

Queries meet the vectors block by block: blocks are shuffled to cells, a cell's queries are held, its vectors pass, and only the
k best entries of each query leave it. Vectors that are null, empty of numbers or hold null or non-finite components, and
null ids, take no part; shorter vectors count as padded with zeros. Repeated candidate rows are ranked one by one, a repeated
query id is asked once, with its smallest vector. Scores are exact integers while they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut_lineage, ship_package, table
from quayside.llm.registry import register

BLOCK = 1_024
EXACT = 1 << 53
# Bytes of queries that a task holds while blocks of vectors pass.
HELD = 8 << 20


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    parts = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return usable.select(F.col("vec_id").cast("long"), F.transform(parts, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def in_blocks(vectors: DataFrame, width: int, kind: str = "<i8") -> DataFrame:
    """Vectors as matrices of at most ``BLOCK`` rows: n, ids and values as bytes of integers of that kind."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                some = batch.iloc[first : first + BLOCK]
                values = np.zeros((len(some), width), dtype=kind)
                for i, v in enumerate(some["v"]):
                    values[i, : len(v)] = v
                yield pd.DataFrame({"n": [len(some)], "ids": [some["vec_id"].to_numpy("<i8").tobytes()], "m": [values.tobytes()]})

    return vectors.mapInPandas(build, "n int, ids binary, m binary")


def local_scores(q: np.ndarray, x: np.ndarray, cuts: list[tuple[int, int]]) -> list[np.ndarray]:
    """One matrix of partial scores per list; in floating point where that is exact."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        q, x = q.astype("f8"), x.astype("f8")
    return [(q[:, a:b] @ x[:, a:b].T).astype("i8") for a, b in cuts]


def fitting(low: int, high: int) -> str:
    """The narrowest integers that hold all values."""
    return next((t for t in ("<i2", "<i4") if np.iinfo(t).min <= low and high <= np.iinfo(t).max), "<i8")


def best_of(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their query, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    fresh = np.concatenate(([True], query[order][1:] != query[order][:-1])) if len(order) else np.empty(0, bool)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(fresh, at, 0)) < k]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, lists: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and the integer array v."""
    spark = vectors.sparkSession
    ship_package(spark)
    sizes = vectors.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).head()
    width, kind = max(1, sizes[0] or 1), fitting(sizes[1] or 0, sizes[2] or 0)
    lists = min(lists, width)
    edges = [width * i // lists for i in range(lists + 1)]
    cuts = list(zip(edges, edges[1:]))
    blocks = cut_lineage(in_blocks(vectors, width, kind), "blocks")
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut_lineage(in_blocks(asked, width, kind).withColumn("asked", F.monotonically_increasing_id()), "asked")
    least = np.iinfo("i8").min

    def matrix(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, kind).reshape(n, width).astype("i8")

    def met(batches: Iterator[pd.DataFrame], begin, meet, end) -> Iterator[pd.DataFrame]:
        """Every block of vectors of a cell meets the cell's blocks of queries, which come first and are all that is held."""
        cell, held = None, []
        for batch in batches:
            for row in batch.itertuples():
                if row.cell != cell:
                    yield from map(end, held)
                    cell, held = row.cell, []
                ids = np.frombuffer(row.ids, "<i8")
                if row.side == 0:
                    held.append({"asked": row.asked, "ids": ids, "raw": row.m, **begin(row, ids)})
                    continue
                x = matrix(row.m, row.n)
                for one in held:
                    meet(one, ids, local_scores(matrix(one["raw"], len(one["ids"])), x, cuts), one["ids"][:, None] != ids[None, :])
        yield from map(end, held)

    def first_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def begin(row, qids):
            return {"best": np.full((len(qids), k), least)}

        def meet(one, ids, parts, other):
            chosen = np.zeros(other.shape, dtype=bool)
            for part in parts:
                seen = np.where(other, part, least)
                best = np.argpartition(-seen, min(k, seen.shape[1]) - 1, axis=1)[:, :k]
                np.put_along_axis(chosen, best, True, axis=1)
            scores = np.concatenate((one["best"], np.where(chosen & other, sum(parts), least)), axis=1)
            one["best"] = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]

        def end(one):
            i, j = np.nonzero(one["best"] > least)
            return pd.DataFrame({"asked": one["asked"], "query_id": one["ids"][i], "score": one["best"][i, j]})

        return met(batches, begin, meet, end)

    def sufficient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def begin(row, qids):
            known = {c["query_id"]: c["cutoff"] for c in row.c}
            none = np.empty(0, "i8")
            return {"cutoff": np.array([known.get(q, least) for q in qids.tolist()])[:, None], "found": (none, none, none)}

        def meet(one, ids, parts, other):
            uniform = -(-one["cutoff"] // lists)  # some list must reach the cutoff's share, rounded up
            entries = other & np.logical_or.reduce([part >= uniform for part in parts])
            i, j = np.nonzero(entries)
            scores = sum(part[i, j] for part in parts)
            keep = scores >= one["cutoff"][i, 0]
            if keep.any():
                found = [np.concatenate(both) for both in zip(one["found"], (i[keep], scores[keep], ids[j[keep]]))]
                mine = best_of(*found, k)
                one["found"] = tuple(column[mine] for column in found)

        def end(one):
            i, scores, vec = one["found"]
            return pd.DataFrame({"query_id": one["ids"][i], "vec_id": vec, "score": scores})

        return met(batches, begin, meet, end)

    # A cell is a slot of blocks of vectors and a group of blocks of queries that a task can hold; no table passes the driver.
    slots = max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism))
    held = (asked.agg(F.sum("n")).head()[0] or 0) * width * np.dtype(kind).itemsize
    groups = max(1, -(-held // HELD))
    columns = ["cell", "side", "asked", "n", "ids", "m", "c"]
    list_type = "array<struct<query_id:long,cutoff:long>>"

    def dealt(asking: DataFrame) -> DataFrame:
        each = F.sequence(F.lit(0), F.lit(slots - 1))
        sent = asking.withColumn("slot", F.explode(each)).withColumn("cell", F.pmod(F.xxhash64("asked"), F.lit(groups)) * slots + F.col("slot")).withColumn("side", F.lit(0))
        placed = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("cell", F.col("group") * slots + F.pmod(F.xxhash64("ids"), F.lit(slots)))
        placed = placed.withColumn("side", F.lit(1)).withColumn("asked", F.lit(None).cast("long")).withColumn("c", F.lit(None).cast(list_type))
        return sent.select(*columns).unionByName(placed.select(*columns)).repartition(slots * groups, "cell").sortWithinPartitions("cell", "side")

    local = dealt(asked.withColumn("c", F.lit(None).cast(list_type))).mapInPandas(first_lists, "asked long, query_id long, score long")
    by_query = Window.partitionBy("asked", "query_id")
    ranked = local.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("score")))).where(F.col("r") <= k)
    cutoffs = ranked.groupBy("asked", "query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(-(1 << 62))).alias("cutoff"))
    cutoffs = cut_lineage(cutoffs.groupBy("asked").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("c")), "cutoffs")
    entries = dealt(asked.hint("merge").join(cutoffs, "asked")).mapInPandas(sufficient, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@register("op6_exact_top_k", ORACLE)
def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = quantised(table(spark, folder, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)
