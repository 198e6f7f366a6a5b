"""Project scores: impacts by category, weighted total, grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.catalogue import lists as words
from quayside.catalogue.rules import SECRETS
from quayside.functions.text import lookup

# Points per severity and category, weights, grades and advice.
IMPACT = {
    "vulnerabilities": {"CRITICAL": 15, "HIGH": 10, "MEDIUM": 5, "LOW": 2},
    "malware": {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3},
    "secrets": {"CRITICAL": 20, "HIGH": 12, "MEDIUM": 5, "LOW": 2},
}
WILDCARD_IMPACT = 8
GIT_IMPACT = 5
CONFIG_IMPACT = {"ignore_scripts": 5, "lockfile": 10, "no_gitignore": 3, "env_not_ignored": 5, "audit_script": 3}
WEIGHTS = {"vulnerabilities": 0.30, "malware": 0.25, "secrets": 0.20, "dependencies": 0.15, "configuration": 0.10}
GRADES = [(95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D")]
LOWEST_GRADE = "F"
ADVICE = {
    "vulnerabilities": "Run 'npm audit fix' to patch vulnerable packages",
    "malware": "Scan and remove malicious code",
    "secrets": "Remove hardcoded secrets and use environment variables",
    "dependencies": "Review and update problematic dependencies",
    "configuration": "Improve security configuration (lockfile, .gitignore, etc.)",
}
ADVICE_BELOW = 80
AUDIT_BELOW = 70
AUDIT_ADVICE = "Consider a security audit by a professional"


def severity_impact(findings: DataFrame, category: str, severity: str = "severity") -> DataFrame:
    """Findings as (project, category, points)."""
    points = lookup(F.col(severity), {k: str(v) for k, v in IMPACT[category].items()}, "0").cast("bigint")
    return findings.select("project_id", F.lit(category).alias("category"), points.alias("impact"))


def match_impact(matches: DataFrame, not_malware: list[str]) -> DataFrame:
    """Rule matches as points of two categories in one pass: secrets count as such, and as malware unless their rule is
    one of ``not_malware`` (credential fields of data files)."""

    def points(category: str) -> Column:
        value = lookup(F.col("threat_level"), {k: str(v) for k, v in IMPACT[category].items()}, "0").cast("bigint")
        return F.struct(F.lit(category).alias("category"), value.alias("impact"))

    both = F.array(
        F.when(~F.col("rule_id").isin(not_malware), points("malware")), F.when(F.col("malware_type") == SECRETS, points("secrets"))
    )
    return matches.select("project_id", F.explode(F.array_compact(both)).alias("_i")).select("project_id", "_i.category", "_i.impact")


def dependency_impact(deps: DataFrame) -> DataFrame:
    """Points of problematic names, wildcard and git specs, all in one pass over the dependencies."""
    named = lookup(F.col("package"), {k: str(v[1]) for k, v in words.PROBLEMATIC.items()}, "0").cast("bigint")
    wildcard = F.when(F.col("spec").isin(words.WILDCARD_SPECS), WILDCARD_IMPACT).otherwise(0)
    git = F.when(F.col("spec").contains("git"), GIT_IMPACT).otherwise(0)
    return deps.select("project_id", F.lit("dependencies").alias("category"), (named + wildcard + git).cast("bigint").alias("impact"))


def config_flags(files: DataFrame, scripts: DataFrame) -> DataFrame:
    """Per project, what its root files and scripts show."""
    name, content = F.col("name"), F.col("content")
    root = files.where(F.col("folder") == "").select(
        "project_id",
        ((name == ".npmrc") & content.contains("ignore-scripts=true")).alias("ignore_scripts"),
        name.isin("package-lock.json", "yarn.lock").alias("lockfile"),
        (name == ".gitignore").alias("gitignore"),
        ((name == ".gitignore") & F.lower(content).contains(".env")).alias("env_ignored"),
        (name == "package.json").alias("manifest"),
        F.lit(False).alias("audit"),
    )
    audit = scripts.select(
        "project_id", *[F.lit(False).alias(c) for c in ("ignore_scripts", "lockfile", "gitignore", "env_ignored", "manifest")],
        F.col("command").contains("audit").alias("audit"),
    )
    flags = ["ignore_scripts", "lockfile", "gitignore", "env_ignored", "manifest", "audit"]
    return root.unionByName(audit).groupBy("project_id").agg(*[F.bool_or(f).alias(f) for f in flags])


def config_impact(projects: DataFrame, flags: DataFrame) -> DataFrame:
    """Points lost through configuration, for every project."""

    def unless(flag: str, points: int) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), 0).otherwise(points)

    ignore = (
        F.when(~F.coalesce("gitignore", F.lit(False)), CONFIG_IMPACT["no_gitignore"])
        .when(~F.col("env_ignored"), CONFIG_IMPACT["env_not_ignored"])
        .otherwise(0)
    )
    audit = F.when(F.coalesce("manifest", F.lit(False)) & ~F.coalesce("audit", F.lit(False)), CONFIG_IMPACT["audit_script"]).otherwise(0)
    points = unless("ignore_scripts", CONFIG_IMPACT["ignore_scripts"]) + unless("lockfile", CONFIG_IMPACT["lockfile"]) + ignore + audit
    return projects.join(flags, "project_id", "left").select(
        "project_id", F.lit("configuration").alias("category"), points.cast("bigint").alias("impact")
    )


def category_scores(projects: DataFrame, *impacts: DataFrame) -> DataFrame:
    """100 minus the points of each category, never below 0.

    All impacts go through one aggregation with partial sums; projects enter it as rows without points, so none is
    lost and no join is needed.
    """
    rows = projects.select("project_id", F.lit("none").alias("category"), F.lit(0).cast("bigint").alias("impact"))
    for part in impacts:
        rows = rows.unionByName(part)
    return rows.groupBy("project_id").agg(
        *[
            F.greatest(F.lit(0), 100 - F.sum(F.when(F.col("category") == c, F.col("impact")).otherwise(0))).cast("int").alias(c)
            for c in WEIGHTS
        ]
    )


def weighted_grade(scores: DataFrame) -> DataFrame:
    """Weighted total, truncated; grade; advice for weak categories. The sum keeps its order: the total is a double."""
    total = None
    for category, weight in WEIGHTS.items():
        part = F.col(category).cast("double") * F.lit(float(weight))
        total = part if total is None else total + part
    grade = F.lit(LOWEST_GRADE)
    for bound, name in reversed(GRADES):
        grade = F.when(F.col("score") >= bound, name).otherwise(grade)
    advice = [F.when(F.col(c) < ADVICE_BELOW, text) for c, text in ADVICE.items()]
    advice.append(F.when(F.col("score") < AUDIT_BELOW, AUDIT_ADVICE))
    return (
        scores.withColumn("score", total.cast("int"))
        .withColumn("grade", grade)
        .withColumn("recommendations", F.array_compact(F.array(*advice)))
    )
