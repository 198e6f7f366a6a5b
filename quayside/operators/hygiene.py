"""Dependency and lockfile hygiene.

Small word lists are conditions or constant arrays inside one projection, not joins: no shuffle, no cross product.
"""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.catalogue import lists as words
from quayside.functions.text import lookup
from quayside.session import fixed_dim, ship_package


def flatten_sections(deps: DataFrame) -> DataFrame:
    """One spec per (project, package); a later section, then a later line, overrides. Partial aggregation first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in words.SECTIONS]), F.col("section"))
    order = F.struct(rank, F.col("line_no"), F.col("spec"))
    return deps.groupBy("project_id", "package").agg(
        F.max_by("spec", order).alias("spec"), F.max_by("section", order).alias("section")
    )


def spec_risk(deps: DataFrame) -> DataFrame:
    """Wildcard and git specs."""
    spec = F.col("spec")
    risk = F.when(spec.isin(words.WILDCARD_SPECS), "wildcard").when(spec.contains("git"), "git")
    return deps.withColumn("risk", risk).where("risk IS NOT NULL")


def _contains_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def dependency_confusion(lock: DataFrame) -> DataFrame:
    """Scoped package resolved outside the public registries."""
    url = F.col("resolved_url")
    return lock.where(url.isNotNull() & (url != "") & ~_contains_any(url, words.PUBLIC_REGISTRIES) & F.col("package").startswith("@"))


def missing_integrity(lock: DataFrame) -> DataFrame:
    """Lock entry without a hash."""
    return lock.where(F.coalesce("integrity", F.lit("")) == "")


def git_resolved(lock: DataFrame) -> DataFrame:
    """Lock entry resolved from a git host."""
    return lock.where(_contains_any(F.col("resolved_url"), words.GIT_HOSTS))


def compromised(deps: DataFrame) -> DataFrame:
    """Known bad versions, or presence of a campaign package."""
    table = fixed_dim(
        deps.sparkSession, words.COMPROMISED,
        "package string, bad_versions array<string>, safe_version string, cve_id string, severity string, campaign string",
    )
    bad = F.expr("array_contains(bad_versions, version) OR (size(bad_versions) = 0 AND campaign IS NOT NULL)")
    return deps.join(table, "package").where(bad).drop("bad_versions")


def suspicious_scope(deps: DataFrame) -> DataFrame:
    """Package in a scope that a campaign used, unless it is on the allow-list."""
    starts = F.lit(False)
    for scope in words.SUSPICIOUS_SCOPES:
        starts = starts | F.col("package").startswith(scope)
    return deps.where(starts & ~F.col("package").isin(words.LEGITIMATE))


def typosquat_dictionary(names: DataFrame) -> DataFrame:
    """Known misspellings with the intended name."""
    return names.withColumn("intended", lookup(F.lower("package"), words.TYPOS)).where("intended IS NOT NULL")


def bare_name(package: str = "package") -> Column:
    """Lower-case name without its scope."""
    return F.lower(F.element_at(F.split(package, "/"), -1))


def typosquat_similarity(names: DataFrame, low: float = 0.75) -> DataFrame:
    """Popular names within an edit-distance ratio; the list is a constant array, compared inside the row."""
    ratio = "1 - levenshtein(p, _bare) / greatest(length(p), length(_bare))"
    near = f"filter(transform(_popular, p -> named_struct('popular', p, 'similarity', {ratio})), x -> x.similarity > {low} AND x.similarity < 1)"
    return (
        names.withColumn("_bare", bare_name())
        .withColumn("_popular", F.from_json(F.lit(json.dumps(words.POPULAR)), "array<string>"))
        .withColumn("_near", F.explode(F.expr(near)))
        .select(*names.columns, "_near.popular", "_near.similarity")
    )


NEAR = T.ArrayType(T.StructType([T.StructField("popular", T.StringType()), T.StructField("similarity", T.DoubleType())]))


@F.pandas_udf(NEAR)
def _matching_blocks(names: pd.Series) -> pd.Series:
    def near(name: str):
        found = []
        for popular in words.POPULAR:
            if name != popular:
                ratio = difflib.SequenceMatcher(None, popular, name).ratio()
                if 0.75 < ratio < 1.0:
                    found.append({"popular": popular, "similarity": ratio})
        return found

    return names.map(near)


def typosquat_exact_ratio(names: DataFrame) -> DataFrame:
    """J12 with the matching-blocks ratio; Python sees each distinct name once."""
    ship_package(names.sparkSession)
    distinct = names.select(bare_name().alias("name")).distinct()
    return distinct.withColumn("_near", F.explode(_matching_blocks("name"))).select("name", "_near.popular", "_near.similarity")


def problematic(deps: DataFrame) -> DataFrame:
    """Deprecated or once compromised packages, with the points they cost."""
    kind = lookup(F.col("package"), {k: v[0] for k, v in words.PROBLEMATIC.items()})
    impact = lookup(F.col("package"), {k: str(v[1]) for k, v in words.PROBLEMATIC.items()}).cast("int")
    advice = lookup(F.col("package"), {k: v[2] for k, v in words.PROBLEMATIC.items()})
    found = deps.where(F.col("package").isin(*words.PROBLEMATIC))
    return found.withColumn("kind", kind).withColumn("impact", impact).withColumn("remediation", advice)


def duplicate_versions(lock: DataFrame, more_than: int = 1) -> DataFrame:
    """A3: packages of a project with several versions. Versions are deduplicated before they are gathered."""
    versions = lock.select("project_id", "package", "version").distinct()
    return (
        versions.groupBy("project_id", "package")
        .agg(F.count(F.lit(1)).alias("n_versions"), F.sort_array(F.collect_list("version")).alias("versions"))
        .where(F.col("n_versions") > more_than)
    )


def lock_issues(lock: DataFrame, vulnerable: DataFrame | None = None) -> DataFrame:
    """All lockfile checks: the four per-entry checks in one pass, then duplicates and vulnerable versions."""
    url = F.col("resolved_url")
    intended = lookup(F.lower("package"), words.TYPOS)

    def issue(kind: str, severity: str, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))

    checks = F.array(
        F.when(intended.isNotNull(), issue("typosquatting", "CRITICAL", intended)),
        F.when(
            url.isNotNull() & (url != "") & ~_contains_any(url, words.PUBLIC_REGISTRIES) & F.col("package").startswith("@"),
            issue("dependency_confusion", "MEDIUM", url),
        ),
        F.when(F.coalesce("integrity", F.lit("")) == "", issue("missing_integrity", "LOW", F.lit(None))),
        F.when(_contains_any(url, words.GIT_HOSTS), issue("git_dependency", "INFO", url)),
    )
    each = lock.withColumn("_i", F.explode(F.array_compact(checks))).select(
        "project_id", "_i.issue_type", "_i.severity", "package", "version", "_i.detail"
    )
    many = duplicate_versions(lock, more_than=2).select(
        "project_id", F.lit("duplicate_package").alias("issue_type"), F.lit("INFO").alias("severity"), "package",
        F.array_join("versions", ", ").alias("version"), F.col("n_versions").cast("string").alias("detail"),
    )
    out = each.unionByName(many)
    if vulnerable is not None:
        found = vulnerable.select(
            "project_id", F.lit("vulnerable_version").alias("issue_type"), "severity", "package", "version", F.col("cve_id").alias("detail")
        )
        out = out.unionByName(found)
    return out


LOCK_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def lockfile_report(lock: DataFrame, issues: DataFrame) -> DataFrame:
    """Packages, issues by severity and by type of each lockfile; projects without issues stay."""
    packages = lock.groupBy("project_id").agg(F.countDistinct("package", "version").alias("total_packages"))
    kinds = ["typosquatting", "dependency_confusion", "vulnerable_version", "missing_integrity", "git_dependency", "duplicate_package"]
    counts = issues.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in LOCK_SEVERITIES],
        *[F.count_if(F.col("issue_type") == k).alias(k) for k in kinds],
    )
    names = ["total_issues", *[s.lower() for s in LOCK_SEVERITIES], *kinds]
    return packages.join(counts, "project_id", "left").select(
        "project_id", "total_packages", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in names]
    )
