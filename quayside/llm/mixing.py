"""Mixing sources to target weights with hash-threshold histograms (operator 8).

Each document has a 60-bit hash of its id and text. Per source, words are summed by the leading bits of the hash; the bucket in which
the running sum crosses the budget is opened by the next bits, until it holds one hash value. What lies below the threshold
is in, nothing is sorted. A target above the source's size becomes whole repeats of the source plus a threshold for the
rest, so a larger budget always contains a smaller one. The crossing document itself is taken when that comes nearer.

Null texts have size 0; a null source is a source of its own, the last. Repeated rows share their hash and so their fate.
Sources without words, and empty tables, get targets of 0. The driver holds one row per source, never rows per document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut_lineage, ship_package, table, text_class, words_of
from quayside.llm.registry import register

HASH_BITS, LEVEL_BITS = 60, 12


def count_words(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(t)) for t in texts], dtype="int64")


def water_fill(sizes: list[int], weights: list[int], most: int) -> list[tuple[int, int]]:
    """Targets as fractions (numerator, denominator): the whole by weight, none above ``most`` times its size."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - most * sum(sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i, w in enumerate(weights) if i not in capped and w * rest > most * sizes[i] * weight}
        if not over:
            return [(most * sizes[i], 1) if i in capped else (w * rest, max(weight, 1)) for i, w in enumerate(weights)]
        capped |= over


def mix_sources(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, d (text class), size, source_size, target, copies (how often the mix takes the row), taken (words), one row per row.

    The hash is that of the id and the text, so texts under null and repeated ids are drawn one by one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(" ", own, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    extra = ["d"]
    sized = docs.withColumn("d", text_class()).select(*extra, "doc_id", "source", F.pandas_udf(count_words, "long")("text").alias("size"), F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"))
    sized = cut_lineage(sized, "mix")

    totals = sorted(((r.source, r.words) for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [words for _, words in totals]
    targets = water_fill(sizes, [cycle[i % len(cycle)] for i in range(len(totals))], most)
    state = {}
    for i, ((source, words), (up, down)) in enumerate(zip(totals, targets)):
        whole = min(most, up // (down * words)) if words else 0
        state[i] = {"source": source, "words": words, "target": up / down, "whole": whole, "budget": up // down - whole * words, "limit": -1}
    open_ = {i: (0, 0) for i, s in state.items() if s["budget"] > 0}  # source: (leading bits, words below them)

    shift = HASH_BITS
    while open_ and shift > 0:
        before, shift = shift, shift - LEVEL_BITS
        known = spark.createDataFrame([(state[i]["source"], prefix) for i, (prefix, _) in open_.items()], "s string, prefix long")
        inside = sized.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", before) == F.col("prefix")))
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"), (F.min("h") == F.max("h")).alias("single"), F.max("h").alias("top"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        budgets = spark.createDataFrame([(state[i]["source"], state[i]["budget"] - below) for i, (_, below) in open_.items()], "s string, room long")
        crossing = histogram.withColumn("sum", running).join(budgets, F.col("source").eqNullSafe(F.col("s"))).where((F.col("sum") > F.col("room")) & (F.col("sum") - F.col("words") <= F.col("room")))
        found = {r.source: r for r in crossing.groupBy("source").agg(F.min_by(F.struct("b", "words", "sum", "single", "top"), "b").alias("x")).select("source", "x.*").collect()}
        left = {}
        for i, (_, below) in open_.items():
            row = found.get(state[i]["source"])
            if row is None:  # the whole bucket fits; only a source smaller than its budget can do so
                state[i]["limit"] = (1 << HASH_BITS) - 1
                continue
            under = below + row["sum"] - row["words"]
            if row["single"] or shift == 0:
                nearer = below + row["sum"] - state[i]["budget"] < state[i]["budget"] - under
                state[i]["limit"] = row["top"] if nearer else (row["b"] << shift) - 1
            else:
                left[i] = (row["b"], under)
        open_ = left

    plan = spark.createDataFrame([(s["source"], s["words"], s["target"], s["whole"], s["limit"]) for s in state.values()], "s string, source_size long, target double, whole int, h_limit long")
    copies = F.col("whole") + (F.col("h") <= F.col("h_limit")).cast("int")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(*extra, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns."""
    copies = mix_sources(docs).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("d").alias("__d"), "copies").groupBy("__id", "__source", "__d").agg(F.max("copies").alias("__copies"))
    joined = docs.join(copies, (text_class() == F.col("__d")) & docs["doc_id"].eqNullSafe(F.col("__id")) & docs["source"].eqNullSafe(F.col("__source")))
    return joined.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
f AS (SELECT *, CAST(sum(words) OVER () AS BIGINT) AS total,
  coalesce(CAST(sum(3 * words) OVER o AS BIGINT), 0) AS filled, CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER o AS BIGINT), 0) AS open_weight
  FROM t WINDOW o AS (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT min(struct_pack(k := words / weight, room := total - filled, w := open_weight)) AS x FROM f WHERE weight * (total - filled) <= 3 * words * open_weight),
p AS (SELECT f.source, words, CASE WHEN weight * x.room > 3 * words * x.w THEN 3 * words ELSE weight * x.room END AS up,
  CASE WHEN weight * x.room > 3 * words * x.w THEN 1 ELSE x.w END AS down FROM f, lev),
q AS (SELECT *, up / down AS target, CASE WHEN words = 0 THEN 0 ELSE least(3, up // (down * words)) END AS whole FROM p),
b AS (SELECT *, up // down - whole * words AS budget FROM q),
c AS (SELECT d.*, b.words, b.target, b.whole, b.budget, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS cum,
  CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS own FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, words AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (whole + CASE WHEN budget > 0 AND (cum <= budget OR (cum - own <= budget AND cum - budget < budget - (cum - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@register("op8_mix_sources", ORACLE)
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
