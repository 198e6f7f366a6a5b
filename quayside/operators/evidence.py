"""Evidence around findings: indicator files, framework use, modes, configs, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.catalogue import lists as words
from quayside.catalogue.advisories import AFFECTED_FRAMEWORKS, CAMPAIGNS, RSC_CVES, RSC_PACKAGES
from quayside.catalogue.rules import GATEWAY_NAMES


def indicator_files(files: DataFrame) -> DataFrame:
    """Campaign files, folders and workflows; ``files`` has ``folder`` ('' at the project root) and ``name``.

    The lists are conditions, so the file table is read once and nothing is shuffled.
    """
    root = F.col("folder") == ""
    in_package = F.col("folder").rlike("^node_modules/(?:[^/]+/)?$")
    indicators = sorted({i for c in CAMPAIGNS for i in c["indicators"]})
    patterns = "|".join(p for c in CAMPAIGNS for p in c["file_patterns"])
    kinds = F.array_compact(
        F.array(
            F.when((root | in_package) & F.col("name").isin(indicators), "indicator_file"),
            F.when(root & F.col("name").isin(words.MALICIOUS_FILES), "malicious_file"),
            F.when(root & F.col("name").isin(words.MALICIOUS_DIRS), "malicious_directory"),
            F.when((F.col("folder") == ".github/workflows/") & F.col("name").isin(words.MALICIOUS_WORKFLOWS), "malicious_workflow"),
            F.when(F.concat("folder", "name").rlike(patterns), "campaign_pattern"),
        )
    )
    return files.withColumn("kind", F.explode(kinds))


def rsc_evidence(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Projects that show use of server components: a bundler package, an app folder with a recent framework, or
    a 'use server' directive anywhere in a source file. Whole texts are searched."""
    packages = deps.where(F.col("package").isin(RSC_PACKAGES)).select("project_id")
    app = files.where(F.col("folder").isin(words.APP_DIRS)).select("project_id")
    recent = deps.where((F.col("package") == "next") & (F.col("version_key.major") >= 13)).select("project_id")
    directive = files.where(F.col("content").rlike("['\"]use server['\"]") & ~F.col("folder").contains("node_modules")).select("project_id")
    return packages.unionByName(recent.join(app, "project_id", "left_semi")).unionByName(directive)


def keep_with_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Server-component findings only where the project shows use; other findings stay."""
    needs = F.col("cve_id").isin(RSC_CVES) & F.col("package").isin("react", "react-dom")
    shown = findings.where(needs).join(evidence, "project_id", "left_semi")
    return findings.where(~needs).unionByName(shown)


def usage_flags(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Per project: middleware, app router, affected frameworks. Flags are folded before the shuffle."""
    path = F.concat("folder", "name")
    by_file = files.groupBy("project_id").agg(
        F.bool_or(path.isin(words.MIDDLEWARE_FILES)).alias("uses_middleware"),
        F.bool_or(F.col("folder").isin(words.APP_DIRS) & F.col("name").isin(words.APP_ROUTER_FILES)).alias("uses_app_router"),
    )
    by_dep = deps.where(F.col("package").isin(AFFECTED_FRAMEWORKS)).groupBy("project_id").agg(
        F.sort_array(F.collect_set("package")).alias("frameworks")
    )
    return by_file.join(by_dep, "project_id", "full_outer")


def annotate_usage(findings: DataFrame, flags: DataFrame) -> DataFrame:
    """Findings with the flags of their project; missing flags are false."""
    joined = findings.join(flags, "project_id", "left")
    return (
        joined.withColumn("uses_middleware", F.coalesce("uses_middleware", F.lit(False)))
        .withColumn("uses_app_router", F.coalesce("uses_app_router", F.lit(False)))
        .withColumn("frameworks", F.coalesce("frameworks", F.array().cast("array<string>")))
    )


def merge_lock_findings(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """Manifest findings, plus lock findings whose (project, advisory, package) the manifest did not show."""
    fresh = lock.join(manifest.select("project_id", "cve_id", "package"), ["project_id", "cve_id", "package"], "left_anti")
    return manifest.withColumn("detection_method", F.lit("manifest")).unionByName(fresh.withColumn("detection_method", F.lit("lockfile")))


def insecure_mode(files: DataFrame) -> DataFrame:
    """Group or world readable, or world writable credential files."""
    mode = F.col("mode")

    def has(bit: int, text: str) -> Column:
        return F.when(mode.bitwiseAND(F.lit(bit)) != 0, text)

    issues = F.array_compact(F.array(has(0o004, "world-readable (o+r)"), has(0o040, "group-readable (g+r)"), has(0o002, "world-writable (o+w)")))
    octal = F.substring(F.conv(mode.cast("string"), 10, 8), -3, 3)
    return files.withColumn("issues", issues).withColumn("octal", octal).where(F.size("issues") > 0)


CONFIG_DDL = "mcpServers map<string,struct<command:string,args:array<string>>>, projects map<string,string>"


def config_references(files: DataFrame) -> DataFrame:
    """Tool-server entries or project keys that name the gateway; bad JSON yields nothing."""
    parsed = files.withColumn("_c", F.from_json("content", CONFIG_DDL))
    servers = parsed.select("file_id", F.explode("_c.mcpServers").alias("name", "_s")).where(
        F.lower(F.concat_ws(" ", "_s.command", F.array_join("_s.args", " "))).rlike(GATEWAY_NAMES)
    )
    projects = parsed.select("file_id", F.explode("_c.projects").alias("name", "_v")).where(F.lower("name").rlike(GATEWAY_NAMES))
    return servers.select("file_id", F.lit("tool_server").alias("kind"), "name").unionByName(
        projects.select("file_id", F.lit("project").alias("kind"), "name")
    )


def http_fingerprint(responses: DataFrame) -> DataFrame:
    """Technology and version of captured responses; headers first, then the body."""
    powered, engine, body = F.col("powered_by"), F.col("engine_version"), F.col("body")
    framework = powered.contains("Next.js") | body.contains("/_next/") | body.contains("__NEXT_DATA__")
    workflow = (engine != "") | F.lower(body).contains("n8n")
    version_in_header = F.nullif(F.regexp_extract(powered, r"Next\.js\s*([0-9.]+)?", 1), F.lit(""))
    version_in_body = F.nullif(F.regexp_extract(body, r'"version":\s*"([0-9]+\.[0-9]+\.[0-9]+)"', 1), F.lit(""))
    found = F.array_compact(
        F.array(
            F.when(framework, F.struct(F.lit("next").alias("technology"), version_in_header.alias("version"))),
            F.when(workflow, F.struct(F.lit("n8n").alias("technology"), F.when(engine != "", engine).otherwise(version_in_body).alias("version"))),
            F.when(powered == "Express", F.struct(F.lit("express").alias("technology"), F.lit(None).cast("string").alias("version"))),
        )
    )
    return responses.withColumn("_f", F.explode(found)).select("page_id", "url", "_f.technology", "_f.version")


def differential_response(responses: DataFrame) -> DataFrame:
    """P20: protected baseline that a header-injected request gets past. One aggregation instead of a self-join."""
    pair = responses.groupBy("page_id", "url").agg(
        F.max(F.when(F.col("variant") == "baseline", F.col("status"))).alias("baseline"),
        F.max(F.when(F.col("variant") == "injected", F.col("status"))).alias("injected"),
    )
    guarded = F.col("baseline").isin(401, 403, 302, 307)
    opened = (F.col("injected") == 200) | (F.col("baseline").isin(302, 307) & ~F.col("injected").isin(302, 307))
    return pair.where(guarded & opened)


def open_endpoints(responses: DataFrame) -> DataFrame:
    """P20: endpoints that answer without a login."""
    return responses.where(F.col("status").isin(200, 404, 405) & (F.col("variant") == "baseline"))
