"""Landed feeds (S8, S9): advisory responses, threat intelligence and audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.text import FEED_SEVERITY, lookup

FEED_DDL = (
    "nodes array<struct<advisory:struct<ghsaId:string,summary:string,description:string,severity:string,cvss:struct<score:double,vectorString:string>,"
    "cwes:struct<nodes:array<struct<cweId:string>>>,identifiers:array<struct<type:string,value:string>>,publishedAt:string,updatedAt:string,"
    "references:array<struct<url:string>>>,package:struct<name:string,ecosystem:string>,vulnerableVersionRange:string,"
    "firstPatchedVersion:struct<identifier:string>>>"
)


def read_json_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Multi-line JSON documents with a given schema; unreadable ones are dropped."""
    return spark.read.schema(ddl).json(path, multiLine=True, mode="DROPMALFORMED")


def normalise_advisories(feed: DataFrame) -> DataFrame:
    """Response nodes as advisory rows; ``feed`` has the array ``nodes``."""
    node = feed.select(F.explode("nodes").alias("n"))
    cve = F.expr("get(filter(n.advisory.identifiers, i -> i.type = 'CVE'), 0).value")
    return node.select(
        F.col("n.advisory.ghsaId").alias("ghsa_id"), cve.alias("cve_id"), F.lower("n.advisory.severity").alias("severity"),
        F.col("n.advisory.summary").alias("title"), F.col("n.advisory.cvss.score").alias("cvss_score"),
        F.expr("transform(n.advisory.cwes.nodes, c -> c.cweId)").alias("cwes"), F.col("n.package.name").alias("package"),
        F.col("n.package.ecosystem").alias("ecosystem"), F.col("n.vulnerableVersionRange").alias("vulnerable_range"),
        F.col("n.firstPatchedVersion.identifier").alias("first_patched"), F.col("n.advisory.publishedAt").alias("published_at"),
    )


def to_catalogue(advisories: DataFrame) -> DataFrame:
    """Advisory rows in catalogue form."""
    return advisories.select(
        F.coalesce("cve_id", "ghsa_id").alias("cve_id"), "ghsa_id", "title",
        F.upper(lookup(F.col("severity"), FEED_SEVERITY, "medium")).alias("severity"), "cvss_score",
        F.array("package").alias("packages"), F.array_compact(F.array(F.nullif("vulnerable_range", F.lit("")))).alias("affected_versions"),
        F.when(F.col("first_patched").isNotNull(), F.create_map("package", "first_patched")).alias("patched_versions"), "cwes",
    )


def parse_audits(reports: DataFrame, content: str = "content") -> DataFrame:
    """Vulnerabilities of audit reports of both formats, as rows.

    ``via`` entries are texts or objects; a variant tells them apart without a second schema.
    """
    keep = [c for c in reports.columns if c != content]
    doc = reports.withColumn("_v", F.try_parse_json(content)).where("_v IS NOT NULL")

    new = doc.where("try_variant_get(_v, '$.vulnerabilities', 'variant') IS NOT NULL").select(
        *keep, F.explode(F.expr("try_variant_get(_v, '$.vulnerabilities', 'map<string,variant>')")).alias("name", "e")
    )
    via = "coalesce(try_variant_get(e, '$.via', 'array<variant>'), array())"
    is_object = "schema_of_variant(x) LIKE 'OBJECT%'"
    new_rows = new.select(
        *keep, "name",
        F.expr("coalesce(try_variant_get(e, '$.severity', 'string'), 'low')").alias("severity"),
        F.expr("coalesce(try_variant_get(e, '$.range', 'string'), '*')").alias("range_affected"),
        F.expr("coalesce(try_variant_get(e, '$.fixAvailable', 'boolean'), schema_of_variant(try_variant_get(e, '$.fixAvailable', 'variant')) LIKE 'OBJECT%', false)").alias("fix_available"),
        F.expr("coalesce(try_variant_get(e, '$.isDirect', 'boolean'), false)").alias("direct"),
        F.expr(f"transform({via}, x -> if({is_object}, try_variant_get(x, '$.name', 'string'), cast(x AS string)))").alias("via"),
        F.expr(f"get(transform(filter({via}, x -> {is_object}), x -> try_variant_get(x, '$.title', 'string')), 0)").alias("title"),
        F.expr(f"get(transform(filter({via}, x -> {is_object}), x -> try_variant_get(x, '$.cvss.score', 'double')), 0)").alias("cvss_score"),
    )
    old = doc.where("try_variant_get(_v, '$.vulnerabilities', 'variant') IS NULL").select(
        *keep, F.explode(F.expr("try_variant_get(_v, '$.advisories', 'map<string,variant>')")).alias("_id", "e")
    )
    old_rows = old.select(
        *keep, F.expr("coalesce(try_variant_get(e, '$.module_name', 'string'), 'unknown')").alias("name"),
        F.expr("coalesce(try_variant_get(e, '$.severity', 'string'), 'low')").alias("severity"),
        F.expr("coalesce(try_variant_get(e, '$.vulnerable_versions', 'string'), '*')").alias("range_affected"),
        F.expr("coalesce(try_variant_get(e, '$.patched_versions', 'string'), '') <> ''").alias("fix_available"),
        F.expr("exists(coalesce(try_variant_get(e, '$.findings', 'array<variant>'), array()), x -> try_variant_get(x, '$.dev', 'boolean') = false)").alias("direct"),
        F.array().cast("array<string>").alias("via"),
        F.expr("try_variant_get(e, '$.title', 'string')").alias("title"),
        F.expr("try_variant_get(e, '$.cvss.score', 'double')").alias("cvss_score"),
    )
    rows = new_rows.unionByName(old_rows)
    known = F.col("severity").isin("critical", "high", "moderate", "low", "info")
    return rows.withColumn("severity", F.when(known, F.col("severity")).otherwise("low"))


INTEL_DDL = (
    "cves array<struct<id:string,severity:string,cvss:double,packages:array<string>,affected_versions:array<string>,"
    "patched_versions:array<string>,vulnerability_type:string,cisa_kev:boolean,public_poc:boolean>>"
)


def threat_intel(documents: DataFrame) -> DataFrame:
    """Advisories of threat-intelligence documents; ``documents`` has the array ``cves``."""
    return documents.select(F.explode("cves").alias("c")).select(
        F.col("c.id").alias("cve_id"), "c.severity", F.col("c.cvss").alias("cvss_score"), "c.packages", "c.affected_versions", "c.patched_versions",
        F.coalesce("c.cisa_kev", F.lit(False)).alias("cisa_kev"), F.coalesce("c.public_poc", F.lit(False)).alias("public_poc"),
    )
