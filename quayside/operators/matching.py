"""Version matching: dependencies against advisories (J1-J8, J24) and catalogue filters.

All matches are an equi-join on the package with two interval comparisons. Advisory tables are joined without a
hint: Spark broadcasts them only while their size is below its threshold, and otherwise shuffles both sides on the
package, where adaptive execution splits a package that holds very many rows. Only tables of fixed values carry a
broadcast hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.catalogue import advisories as cat
from quayside.functions.versions import (
    clean_spec,
    intervals,
    is_parsed,
    key_sql,
    parts_sql,
    version_key,
    with_interval,
    with_version_key,
)
from quayside.session import fixed_dim

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def severity_rank(severity: Column) -> Column:
    rank = F.lit(4)
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def with_version(deps: DataFrame, spec: str = "spec") -> DataFrame:
    """Add the clean version and its comparable key."""
    return with_version_key(deps.withColumn("version", clean_spec(F.col(spec))))


def match_versions(deps: DataFrame, ranges: DataFrame, conservative: bool = False, salts: int = 1) -> DataFrame:
    """Dependencies inside an affected interval; ``conservative`` keeps unparseable versions as affected.

    ``deps`` has ``package`` and ``version_key``; ``ranges`` has ``package``, ``lo``, ``hi`` (disjoint per advisory).
    ``salts`` deals the rows of each package to that many tasks, for a package that holds a large share of all rows
    while the advisories are too many to broadcast; the ranges are repeated once per salt.
    """
    if salts > 1:
        dealt = deps.withColumn("_salt", F.pmod(F.xxhash64(*deps.columns), F.lit(salts).cast("bigint")))
        repeated = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        return _match(dealt, repeated, ["package", "_salt"], conservative).drop("_salt")
    return _match(deps, ranges, ["package"], conservative)


def _match(deps: DataFrame, ranges: DataFrame, on: list[str], conservative: bool) -> DataFrame:
    inside = (F.col("version_key") >= F.col("lo")) & (F.col("version_key") < F.col("hi"))
    if not conservative:
        return deps.join(ranges, on).where(inside).drop("lo", "hi").withColumn("confidence", F.lit("exact"))
    # an unparseable version matches an advisory once: through its lowest interval only
    first = ranges.withColumn("_first", F.lit(True)) if "_first" not in ranges.columns else ranges
    unparsed = ~is_parsed()
    return (
        deps.join(first, on)
        .where(inside | (unparsed & F.col("_first")))
        .withColumn("confidence", F.when(unparsed, "unparsed").otherwise("exact"))
        .drop("lo", "hi", "_first")
    )


def first_interval_flag(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Mark the lowest interval of each advisory."""
    return ranges.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy("lo")) == 1)


def threshold_match(deps: DataFrame) -> DataFrame:
    """One finding per CVE of a package below its threshold; unparseable counts as affected."""
    table = fixed_dim(deps.sparkSession, cat.PACKAGE_THRESHOLDS, "package string, cves array<string>, affected array<string>")
    ranges = with_interval(table.withColumn("_range", F.element_at("affected", 1)), "_range").select("package", "cves", "lo", "hi")
    return match_versions(deps, F.broadcast(ranges), conservative=True).withColumn("cve_id", F.explode("cves")).drop("cves")


def runtime_line_match(versions: DataFrame, platform: str = "Linux") -> DataFrame:
    """Runtime versions inside ``[first affected, fixed)`` of their major line."""
    lines = fixed_dim(versions.sparkSession, cat.RUNTIME_LINES, "major bigint, cve_id string, first string, fixed string")
    if platform != "Windows":
        lines = lines.where(~F.col("cve_id").isin(cat.WINDOWS_ONLY_CVES))
    if platform not in ("Linux", "Darwin"):
        lines = lines.where(~F.col("cve_id").isin(cat.UNIX_ONLY_CVES))
    bounds = lines.select("major", "cve_id", "fixed", version_key("first").alias("lo"), version_key("fixed").alias("hi"))
    keyed = versions.withColumn("major", F.col("version_key.major"))
    inside = (F.col("version_key") >= F.col("lo")) & (F.col("version_key") < F.col("hi"))
    return keyed.join(F.broadcast(bounds), "major").where(inside).drop("lo", "hi", "major")


def middleware_line_match(deps: DataFrame) -> DataFrame:
    """Framework majors with an authorization bypass; a text that is no version counts as affected."""
    lines = fixed_dim(deps.sparkSession, cat.MIDDLEWARE_LINES, "major bigint, affected string, patched string")
    bounds = F.broadcast(with_interval(lines, "affected").select("major", "patched", "lo", "hi"))
    frameworks = deps.where(F.col("package") == "next")
    hit = (
        frameworks.withColumn("major", F.col("version_key.major"))
        .join(bounds, "major")
        .where((F.col("version_key") >= F.col("lo")) & (F.col("version_key") < F.col("hi")))
        .drop("lo", "hi", "major")
        .withColumn("confidence", F.lit("exact"))
    )
    unknown = frameworks.where(~is_parsed()).withColumn("patched", F.lit(None).cast("string")).withColumn("confidence", F.lit("unparsed"))
    return hit.unionByName(unknown).withColumn("cve_id", F.lit("CVE-2025-29927"))


def multi_branch_fix_match(deps: DataFrame) -> DataFrame:
    """Below the fix, unless at or above one of the alternative fixes."""
    table = fixed_dim(
        deps.sparkSession, cat.MULTI_BRANCH_FIXES,
        "package string, cve_id string, fixed string, alt_fixed array<string>, auth_required boolean",
    ).withColumn("alt_keys", F.expr(f"transform(alt_fixed, v -> {key_sql(parts_sql('v'))})")).select(
        "package", "cve_id", "fixed", "auth_required",
        version_key("fixed").alias("fixed_key"),
        F.expr("array_min(alt_keys)").alias("alt_key"),
    )
    open_branch = F.col("alt_key").isNull() | (F.col("version_key") < F.col("alt_key"))
    return (
        deps.join(F.broadcast(table), "package")
        .where(is_parsed() & (F.col("version_key") < F.col("fixed_key")) & open_branch)
        .drop("fixed_key", "alt_key")
    )


def legacy_line_match(deps: DataFrame) -> DataFrame:
    """Exact framework list, minor lines of the meta-framework, and any canary build."""
    spark = deps.sparkSession
    react = F.create_map(*[F.lit(x) for kv in cat.LEGACY_REACT.items() for x in kv])
    lines = fixed_dim(spark, cat.LEGACY_NEXT, "line string, affected string, patched string")
    bounds = F.broadcast(with_interval(lines, "affected").select("line", "patched", "lo", "hi"))
    keep = [c for c in deps.columns]
    exact = deps.where((F.col("package") == "react") & F.col("version").isin(*cat.LEGACY_REACT)).select(
        *keep, react[F.col("version")].alias("patched"), F.lit("exact").alias("rule")
    )
    canary = deps.where((F.col("package") == "next") & F.col("version").contains("canary")).select(
        *keep, F.lit(cat.LEGACY_CANARY_PATCH).alias("patched"), F.lit("canary").alias("rule")
    )
    inside = (F.col("version_key") >= F.col("lo")) & (F.col("version_key") < F.col("hi"))
    minor = (
        deps.where((F.col("package") == "next") & ~F.col("version").contains("canary"))
        .withColumn("line", F.substring_index("version", ".", 2))
        .join(bounds, "line")
        .where(~is_parsed() | inside)
        .select(*keep, "patched", F.lit("line").alias("rule"))
    )
    return exact.unionByName(canary).unionByName(minor)


def patch_table(catalogue_df: DataFrame) -> DataFrame:
    """``patched_versions`` maps as rows (package, cve_id, patch_key, patched, position)."""
    return cat.by_package(catalogue_df).select(
        "cve_id", "package", F.posexplode(F.map_entries("patched_versions")).alias("position", "_e")
    ).select("cve_id", "package", "position", F.col("_e.key").alias("patch_key"), F.col("_e.value").alias("patched"))


def patch_lookup(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """Exact key, then ``M.m.x``, then ``M.x``, then the first ``<X`` key that covers the version; else null.

    The patch rows of one advisory are folded into a small array first, so the lookup is one left join that keeps
    each finding on one row: nothing to rank or deduplicate afterwards.
    """
    bounded = with_interval(patches, "patch_key").withColumn("hi", F.when(F.col("patch_key").startswith("<"), F.col("hi")))
    folded = bounded.groupBy("cve_id", "package").agg(
        F.sort_array(F.collect_list(F.struct("position", "patch_key", "patched", "hi"))).alias("_patches")
    )
    major = F.get(F.split("version", r"\."), F.lit(0))
    minor = F.get(F.split("version", r"\."), F.lit(1))

    def pick(test) -> Column:
        return F.get(F.filter("_patches", test), F.lit(0))["patched"]

    choice = F.coalesce(
        pick(lambda p: p["patch_key"] == F.col("version")),
        pick(lambda p: p["patch_key"] == F.concat(major, F.lit("."), minor, F.lit(".x"))),
        pick(lambda p: p["patch_key"] == F.concat(major, F.lit(".x"))),
        pick(lambda p: p["hi"].isNotNull() & is_parsed() & (F.col("version_key") < p["hi"])),
    )
    safe = F.when(F.size(F.coalesce("_patches", F.array())) > 0, choice)
    return findings.join(folded, ["cve_id", "package"], "left").withColumn("patched_version", safe).drop("_patches")


def catalogue_intervals(catalogue_df: DataFrame) -> DataFrame:
    """Disjoint intervals per (advisory, package), with the advisory's attributes."""
    carry = ["title", "severity", "cvss_score", "category", "platform"]
    return intervals(cat.by_package(catalogue_df), ["cve_id", "package"], carry=carry)


def cve_hunt(deps: DataFrame, catalogue_df: DataFrame, cve_id: str) -> DataFrame:
    """Every project and package affected by one advisory."""
    return match_versions(deps, catalogue_intervals(catalogue_df.where(F.col("cve_id") == cve_id)))


def catalogue_filter(
    advisories: DataFrame, severity: str | None = None, category: str | None = None, package: str | None = None,
    cve_id: str | None = None, active: bool = False, kev: bool = False,
) -> DataFrame:
    """Advisories by severity, category, package, id, active exploitation or known-exploited listing."""
    out = advisories
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if category:
        out = out.where(F.col("category") == category)
    if package:
        out = out.where(F.array_contains("packages", package) if "packages" in out.columns else F.col("package") == package)
    if cve_id:
        out = out.where(F.col("cve_id") == cve_id)
    if active:
        out = out.where("active_exploitation")
    if kev:
        out = out.where("cisa_kev")
    return out


def bounty_targets(advisories: DataFrame) -> DataFrame:
    """Easy to exploit, severe, no login needed."""
    return advisories.where(
        F.col("difficulty").isin("Trivial", "Easy") & F.col("severity").isin("CRITICAL", "HIGH") & ~F.col("requires_auth")
    )


def bounty_worthy(advisories: DataFrame) -> DataFrame:
    """Critical, or with a public exploit, or exploited in the wild."""
    return advisories.where((F.col("severity") == "CRITICAL") | F.col("public_poc") | F.col("active_exploitation"))


def at_least(findings: DataFrame, threshold: str) -> DataFrame:
    """Findings at or above a severity threshold."""
    return findings.where(severity_rank(F.col("severity")) <= SEVERITIES.index(threshold))


def catalogue_summary(advisories: DataFrame) -> DataFrame:
    """A2: counts per category and in total (category null), by severity and flag."""
    return advisories.rollup("category").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
        F.count_if("active_exploitation").alias("active"),
        F.count_if("cisa_kev").alias("kev"),
        F.count_if("public_poc").alias("poc"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings and distinct projects per severity, in severity order."""
    return (
        findings.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project_id").alias("projects"))
        .orderBy(severity_rank(F.col("severity")))
    )
