"""Reports over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.catalogue import lists as words
from quayside.catalogue import rules as book
from quayside.catalogue.advisories import CVE_EXPLANATIONS, LEGACY_REACT
from quayside.functions.text import lookup
from quayside.operators.matching import SEVERITIES, severity_rank
from quayside.operators.paths import path_context
from quayside.session import fixed_dim

FINDING_COLUMNS = ["scanner", "project_id", "file_path", "cve_id", "severity", "package", "version", "patched_version", "detection_method"]


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """Findings of several scanners in one table; missing columns become null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def scan_summary(findings: DataFrame) -> DataFrame:
    """A1: totals per scanner and overall (scanner null); findings in exploit data, research, archives and tests need no action."""
    outside = path_context("file_path").isin(words.NOT_ACTIONABLE_CONTEXTS)
    return findings.withColumn("_outside", outside).rollup("scanner").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
        F.count_if(F.col("patched_version").isNotNull()).alias("fixable"),
        F.count_if(~F.col("_outside")).alias("actionable"), F.count_if("_outside").alias("non_production"),
    )


def finding_context(findings: DataFrame) -> DataFrame:
    """What a finding means where it stands: kind of path, whether to act, how urgent, and what to run there.

    ``findings`` has file_path, severity, package and patched_version.
    """
    kind = path_context("file_path")
    act = ~kind.isin(words.NOT_ACTIONABLE_CONTEXTS)
    priority = F.when(act, F.col("severity")).when(kind == "exploit_data", "INFO").otherwise("LOW")
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    command = F.when(kind == "node_modules", F.concat(F.lit("cd "), F.element_at(F.split("file_path", "/node_modules"), 1), F.lit(" && npm audit fix"))).when(
        (kind == words.PRODUCTION) & F.col("patched_version").isNotNull(), F.concat(F.lit("cd "), folder, F.lit(" && npm install "), "package", F.lit("@"), "patched_version")
    )
    return findings.withColumn("context", kind).withColumn("actionable", act).withColumn("priority", priority).withColumn("fix_command", command)


def explain_cves(findings: DataFrame) -> DataFrame:
    """Why an advisory matters, what an attacker gains and how it was found, by CVE id; unknown ids stay without text."""
    rows = [{"cve_id": k, "why": w, "gain": g, "how": h} for k, (w, g, h) in CVE_EXPLANATIONS.items()]
    return findings.join(fixed_dim(findings.sparkSession, rows, "cve_id string, why string, gain string, how string"), "cve_id", "left")


def severity_sorted(findings: DataFrame) -> DataFrame:
    """By severity, then by stable tie-breakers."""
    ranked = findings.withColumn("severity_rank", severity_rank(F.col("severity")))
    return ranked.orderBy("severity_rank", "project_id", "package", "cve_id")


def top_n(findings: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """First ``n`` findings of each project. The report is a top-k: Spark keeps ``n`` rows per group before it shuffles."""
    order = Window.partitionBy(*(by or ["project_id"])).orderBy(severity_rank(F.col("severity")), "cve_id", "package", "line_no", "spec")
    return findings.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def first_per(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, keeping the first; a partial minimum, so a key with very many rows is folded before the shuffle."""
    rest = [c for c in findings.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return findings.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def safe_projects(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Scanned projects without findings."""
    return projects.select("project_id").distinct().join(findings.select("project_id"), "project_id", "left_anti")


def package_hits(files: DataFrame) -> DataFrame:
    """Per package and kind of hit, the number of files; whole texts are searched."""
    hits = F.array_compact(F.array(*[F.when(F.col("content").rlike("(?i)" + p), d) for p, d in book.PACKAGE_PATTERNS]))
    counted = files.select(F.col("project_id").alias("package"), F.explode(hits).alias("hit_type")).groupBy("package", "hit_type").agg(F.count(F.lit(1)).alias("n"))
    danger = F.lit(False)
    for word in book.DANGEROUS_WORDS:
        danger = danger | F.lower("hit_type").contains(word)
    return counted.withColumn("dangerous", danger)


def package_verdict(packages: DataFrame, hits: DataFrame, other_dangers: DataFrame) -> DataFrame:
    """Dangers and warnings of each package; ``other_dangers`` are (package, n) of scripts, files, advisories, typos."""
    rows = packages.select("package", F.lit(0).cast("bigint").alias("dangers"), F.lit(0).cast("bigint").alias("warnings"))
    rows = rows.unionByName(hits.select("package", F.col("dangerous").cast("bigint").alias("dangers"), (~F.col("dangerous")).cast("bigint").alias("warnings")))
    rows = rows.unionByName(other_dangers.select("package", F.col("n").cast("bigint").alias("dangers"), F.lit(0).cast("bigint").alias("warnings")))
    totals = rows.groupBy("package").agg(F.sum("dangers").alias("dangers"), F.sum("warnings").alias("warnings"))
    return totals.withColumn("safe", F.col("dangers") == 0)


def package_dangers(scripts: DataFrame, advisories: DataFrame, typos: DataFrame) -> DataFrame:
    """(package, n) of what else makes a package dangerous: suspicious install scripts, advisories, a name that imitates another."""
    rows = [part.select("package") for part in (scripts, advisories, typos)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("package").agg(F.count(F.lit(1)).alias("n"))


FEED_SEVERITIES = ["critical", "high", "moderate", "low", "unknown"]


def advisory_report(feed: DataFrame) -> DataFrame:
    """Advisories per package with their severities, and the total (package null)."""
    return feed.rollup("package").agg(
        F.count(F.lit(1)).alias("advisories"), *[F.count_if(F.col("severity") == s).alias(s) for s in FEED_SEVERITIES]
    )


def audit_summary(audits: DataFrame) -> DataFrame:
    """Severity counts and fixable counts of each audit."""
    return audits.groupBy("project_id", "audit_year").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "moderate", "low", "info")],
        F.count_if("fix_available").alias("fixable"), F.count_if("direct").alias("direct"),
    )


def infected_projects(projects: DataFrame, indicators: DataFrame) -> DataFrame:
    """Scanned, infected and clean projects with their indicators; one row per project first, then one total."""
    rows = projects.select("project_id", F.lit(0).alias("critical"), F.lit(0).alias("high"))
    hits = indicators.select(
        "project_id", (F.col("severity") == "CRITICAL").cast("int").alias("critical"), (F.col("severity") == "HIGH").cast("int").alias("high")
    )
    per_project = rows.unionByName(hits).groupBy("project_id").agg(F.sum("critical").alias("critical"), F.sum("high").alias("high"))
    infected = (F.col("critical") + F.col("high")) > 0
    return per_project.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(infected).alias("infected"), F.count_if(~infected).alias("clean"),
        F.sum("critical").alias("critical"), F.sum("high").alias("high"),
    )


def repo_exposure(deps: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories with a vulnerable framework version, its patch, and what else they use."""
    version = F.col("version")
    legacy = (F.col("package") == "react") & version.isin(*LEGACY_REACT)
    per_repo = deps.groupBy("project_id").agg(
        F.max_by(version, F.when(legacy, F.col("version_key"))).alias("current_version"),
        F.bool_or(F.col("package") == "next").alias("has_next"),
        F.bool_or(F.col("package") == "react-server-dom-webpack").alias("has_rsc"),
    )
    exposed = per_repo.where("current_version IS NOT NULL").withColumn("patched_version", lookup(F.col("current_version"), LEGACY_REACT))
    return exposed.join(repos, "project_id", "left")


def exposure_totals(repos: DataFrame, exposed: DataFrame) -> DataFrame:
    """Per state and version of the framework, and per state (version null): repositories, private ones, those with next."""
    rows = repos.select("project_id", "private").join(exposed.select("project_id", "current_version", "has_next"), "project_id", "left")
    told = rows.select("private", "has_next", F.coalesce("current_version", F.lit("none")).alias("version"), F.when(F.col("current_version").isNull(), "safe").otherwise("exposed").alias("state"))
    return told.groupingSets([["state", "version"], ["state"]], "state", "version").agg(
        F.count(F.lit(1)).alias("repositories"), F.count_if("private").alias("private_repositories"), F.count_if("has_next").alias("with_next"),
    )
