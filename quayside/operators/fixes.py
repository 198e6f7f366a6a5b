"""Fix planning: commands, buckets, spec bumps, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.catalogue import lists as words
from quayside.catalogue.advisories import NEXT_PATCH_DEFAULT, NEXT_PATCH_PREFIXES
from quayside.functions.versions import bump_spec
from quayside.operators.paths import path_context, skip_reason

RUNTIMES = ["node", "nodejs"]


def project_dir(path: str = "file_path") -> Column:
    """Folder of a file, cut before ``node_modules``."""
    parent = F.regexp_replace(path, "/[^/]*$", "")
    return F.regexp_replace(F.substring_index(parent, "node_modules", 1), "/+$", "")


def fix_command(folder: Column, package: Column, patched: Column, yarn: Column) -> Column:
    """upgrade command by lockfile kind."""
    tool = F.when(yarn, "yarn upgrade ").otherwise("npm install ")
    return F.concat(F.lit('cd "'), folder, F.lit('" && '), tool, package, F.lit("@"), patched)


def fix_plan(findings: DataFrame) -> DataFrame:
    """One fix per (project folder, package) of the actionable findings: first version and patch seen, all ids.

    ``ordinal`` gives the order in which findings were seen. The id set is bounded by the advisories of one package.
    """
    todo = findings.where(skip_reason().isNull()).withColumn("project_dir", project_dir())
    return (
        todo.groupBy("project_dir", "package")
        .agg(
            F.min_by(F.struct("version", "patched_version"), "ordinal").alias("_first"),
            F.sort_array(F.collect_set("cve_id")).alias("cve_ids"),
        )
        .select(
            "project_dir", "package", F.col("_first.version").alias("version"), F.col("_first.patched_version").alias("patched_version"),
            "cve_ids", F.when(F.col("package").isin(RUNTIMES), "runtime_upgrade").otherwise("package_fix").alias("kind"),
        )
    )


def quick_fix_rows(findings: DataFrame) -> DataFrame:
    """A10: distinct (bucket, command) rows. A bucket may hold very many commands, so they stay rows."""
    context = path_context("file_path")
    parent = F.regexp_replace("file_path", "/[^/]*$", "")
    top = F.substring_index(F.col("file_path"), "/node_modules", 1)
    install = F.concat(F.lit("cd "), parent, F.lit(" && npm install "), "package", F.lit("@"), "patched_version")
    known = F.col("patched_version").isNotNull() & (F.col("patched_version") != "")
    bucket = (
        F.when(F.col("context").isin(words.NOT_ACTIONABLE_CONTEXTS), "skip")
        .when(F.col("context") == "node_modules", "npm_audit")
        .when(F.col("context") == "vendor", "manual")
        .when(F.col("package").isin(RUNTIMES), "node_upgrade")
        .when(known, "npm_update")
        .otherwise("npm_audit")
    )
    command = (
        F.when(F.col("bucket") == "skip", F.concat_ws(": ", "cve_id", "context"))
        .when(F.col("context") == "node_modules", F.concat(F.lit("cd "), top, F.lit(" && npm audit fix")))
        .when(F.col("bucket") == "manual", F.concat_ws(": ", "file_path", "package"))
        .when(F.col("bucket") == "node_upgrade", F.concat(F.lit("nvm install "), "patched_version"))
        .when(F.col("bucket") == "npm_update", install)
        .otherwise(F.concat(F.lit("cd "), parent, F.lit(" && npm audit fix")))
    )
    staged = findings.withColumn("context", context).withColumn("bucket", bucket).withColumn("command", command)
    return staged.select("bucket", "command").distinct()


def fix_recommendations(audits: DataFrame, keys: list[str]) -> DataFrame:
    """Per audit and kind of fix: how many, with the severity breakdown; names stay one row each in the input."""
    kind = F.when(~F.col("fix_available"), "manual").when(F.col("direct"), "auto_fix").otherwise("force_fix")
    command = F.when(F.col("type") == "auto_fix", "npm audit fix").when(F.col("type") == "force_fix", "npm audit fix --force")
    return (
        audits.withColumn("type", kind)
        .groupBy(*keys, "type")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "moderate", "low")])
        .withColumn("command", command)
    )


def fix_packages(audits: DataFrame, keys: list[str]) -> DataFrame:
    """Each vulnerability of an audit with its kind of fix; what has no automatic fix carries its reason and a way out."""
    kind = F.when(~F.col("fix_available"), "manual").when(F.col("direct"), "auto_fix").otherwise("force_fix")
    manual = F.col("type") == "manual"
    return audits.withColumn("type", kind).select(
        *keys, "type", "name", "severity", F.when(manual, "No automatic fix available").alias("reason"),
        F.when(manual, F.concat(F.lit("Replace "), "name", F.lit(" by another package"))).otherwise(
            F.when(F.col("type") == "force_fix", "May install breaking changes")).alias("suggestion"),
    )


def next_minor_patch(version: Column) -> Column:
    """patched version by version prefix; the first prefix that fits decides."""
    patch = F.lit(NEXT_PATCH_DEFAULT)
    for prefix, fixed in reversed(NEXT_PATCH_PREFIXES.items()):
        patch = F.when(version.startswith(prefix), fixed).otherwise(patch)
    return patch


def fix_status(findings: DataFrame) -> DataFrame:
    """Status of each fix as a dry run: no patch, section gone, already patched, or bumped spec."""
    new = bump_spec(F.col("spec"), F.col("patched_version"))
    status = (
        F.when(F.col("patched_version").isNull(), "manual_required")
        .when(~F.col("section").isin("dependencies", "devDependencies"), "skipped")
        .when(new == F.col("spec"), "already_fixed")
        .otherwise("success")
    )
    return findings.withColumn("status", status).withColumn("new_spec", F.when(F.col("status") == "success", new))


def fix_outcome(results: DataFrame) -> DataFrame:
    """Counts by status, and the total (status null)."""
    return results.rollup("status").agg(F.count(F.lit(1)).alias("n"))


def patch_manifest(manifests: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """new manifest maps with bumped specs and dropped packages, on the manifest's own row.

    ``manifests`` has one map per section, ``patches`` (package → patched version) and ``removed`` (package names).
    """
    out = manifests
    for section in sections or ["dependencies", "devDependencies"]:
        bumped = (
            f"transform_values(map_filter({section}, (p, s) -> NOT array_contains(removed, p)), "
            f"(p, s) -> if(map_contains_key(patches, p), concat(regexp_extract(s, r'^[\\^~>=<]*', 0), element_at(patches, p)), s))"
        )
        out = out.withColumn(section, F.expr(bumped))
    return out
