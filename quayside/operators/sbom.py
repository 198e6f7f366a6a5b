"""Bills of materials: components, order, resolved dependencies, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import integrity_hash, purl
from quayside.operators.ranks import numbered
from quayside.session import cut_lineage


def with_directness(lock: DataFrame, manifest_deps: DataFrame) -> DataFrame:
    """Direct and dev flags by membership in the manifest's sections; flags are folded before the join."""
    flags = manifest_deps.groupBy("project_id", "package").agg(F.bool_or(F.col("section") == "devDependencies").alias("_dev"))
    joined = lock.join(flags, ["project_id", "package"], "left")
    return (
        joined.withColumn("is_direct", F.col("_dev").isNotNull())
        .withColumn("is_dev", F.coalesce("dev", F.lit(False)) | F.coalesce("_dev", F.lit(False)))
        .drop("_dev")
    )


def components(lock: DataFrame, manifest_deps: DataFrame) -> DataFrame:
    """One component per (project, name, version).

    The join and the folding sort whole entries, so the table is written with as many partitions as its rows ask for.
    """
    alg, value = integrity_hash(F.col("integrity"))
    flagged = with_directness(lock, manifest_deps)
    folded = flagged.groupBy("project_id", F.col("package").alias("name"), "version").agg(
        F.max("license").alias("license"), F.max("integrity").alias("integrity"), F.bool_or("is_direct").alias("is_direct"), F.bool_or("is_dev").alias("is_dev"),
    )
    parts = folded.select(
        "project_id", "name", "version", purl(F.col("name"), F.col("version")).alias("purl"), "license",
        alg.alias("hash_alg"), value.alias("hash_value"), "is_direct", "is_dev",
    )
    return cut_lineage(parts, "components", lock.count())


def component_order(parts: DataFrame) -> DataFrame:
    """Dense position in a project: direct first, then name, then version.

    A project may hold very many components: positions come from ranges, so no task and no window holds a project.
    """
    placed = numbered(parts, ["project_id"], [F.col("is_direct").desc(), F.col("name").asc(), F.col("version").asc()], "_place")
    return placed.withColumn("ordinal", (F.col("_place") + 1).cast("long")).drop("_place")


def resolve_dependencies(edges: DataFrame, ordered: DataFrame) -> DataFrame:
    """A dependency name resolves to the first component with that name; unknown names stay unresolved."""
    first = ordered.groupBy("project_id", "name").agg(F.min_by("version", "ordinal").alias("child_version")).withColumnRenamed("name", "child")
    return edges.join(first, ["project_id", "child"], "left")


def sbom_report(parts: DataFrame) -> DataFrame:
    """A4: totals, direct, transitive and dev components of each project."""
    return parts.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_direct").alias("direct"), F.count_if(~F.col("is_direct")).alias("transitive"), F.count_if("is_dev").alias("dev"),
    )


def license_histogram(parts: DataFrame) -> DataFrame:
    """A4: components by licence; a missing licence is UNKNOWN."""
    return parts.groupBy(F.coalesce("license", F.lit("UNKNOWN")).alias("license")).agg(F.count(F.lit(1)).alias("n"))
