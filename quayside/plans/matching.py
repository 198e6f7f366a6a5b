"""Registered queries of the version-matching family."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalogue import advisories as cat
from quayside.functions.versions import intervals
from quayside.operators import matching as m
from quayside.plans.registry import Tables, register, sql_clean, sql_key, sql_rows

SPAN = "^([0-9]+[.][0-9]+[.][0-9]+)-([0-9]+[.][0-9]+[.][0-9]+)$"
WILD = "^([0-9]+)[.]x$"
LO = f"""CASE WHEN affected = '*' OR affected LIKE '<%' THEN 0
  WHEN regexp_matches(affected, '{WILD}') THEN CAST(regexp_extract(affected, '{WILD}', 1) AS BIGINT) * 2000000000000
  WHEN regexp_matches(affected, '{SPAN}') THEN {sql_key(f"regexp_extract(affected, '{SPAN}', 1)")}
  ELSE {sql_key('affected')} END"""
HI = f"""CASE WHEN affected = '*' THEN 9000000000000000000
  WHEN affected LIKE '<%' THEN {sql_key("substr(affected, 2)")}
  WHEN regexp_matches(affected, '{WILD}') THEN (CAST(regexp_extract(affected, '{WILD}', 1) AS BIGINT) + 1) * 2000000000000
  WHEN regexp_matches(affected, '{SPAN}') THEN {sql_key(f"regexp_extract(affected, '{SPAN}', 2)")} + 1
  ELSE {sql_key('affected')} + 1 END"""

CTES = {
    "deps_k": f"SELECT *, {sql_clean('spec')} AS version, {sql_key(sql_clean('spec'))} AS k FROM v_deps",
    "adv_k": f"SELECT *, {LO} AS lo, {HI} AS hi FROM v_advisories",
    "stack_k": f"SELECT *, {sql_clean('spec')} AS version, {sql_key(sql_clean('spec'))} AS k FROM v_stack",
    "lock_k": f"SELECT *, {sql_key('version')} AS k FROM v_lock",
    "catalogue": sql_rows(
        ["category", "cve_id", "severity", "cvss_score", "difficulty", "cisa_kev", "public_poc", "active_exploitation",
         "requires_auth", "packages"],
        [[a["category"], a["cve_id"], a["severity"], a["cvss_score"], a["difficulty"], a["cisa_kev"], a["public_poc"],
          a["active_exploitation"], a["requires_auth"], a["packages"]] for a in cat.ADVISORIES],
    ),
    "cat_raw": sql_rows(
        ["cve_id", "severity", "package", "affected"],
        [[a["cve_id"], a["severity"], p, r] for a in cat.ADVISORIES for p in a["packages"] for r in a["affected_versions"]],
    ),
    "cat_k": f"SELECT *, {LO} AS lo, {HI} AS hi FROM cat_raw",
}


def ctes(*names: str) -> dict[str, str]:
    return {n: CTES[n] for n in names}


def advisory_ranges(t: Tables):
    """The part-derived advisories as disjoint intervals."""
    adv = t.view("v_advisories").withColumn("affected_versions", F.array("affected"))
    return intervals(adv, ["cve_id", "package"], carry=["severity", "patched"])


def dep_matches(t: Tables):
    return m.match_versions(m.with_version(t.view("v_deps")), advisory_ranges(t))


def catalogue_matches(t: Tables):
    """Dependencies with real names against the fixed catalogue."""
    ranges = F.broadcast(m.catalogue_intervals(cat.catalogue(t.spark)))
    return m.match_versions(m.with_version(t.view("v_stack")), ranges)


@register(
    "flagship_vulnerable_projects",
    """SELECT severity, count(*) AS n, count(DISTINCT project_id) AS projects
       FROM deps_k d JOIN adv_k a ON d.package = a.package AND k >= lo AND k < hi GROUP BY severity""",
    ctes("deps_k", "adv_k"),
)
def flagship(t: Tables):
    return m.severity_counts(dep_matches(t))


@register(
    "j1_vuln_match",
    """SELECT project_id, line_no, d.package, spec, version, cve_id, severity
       FROM deps_k d JOIN adv_k a ON d.package = a.package AND k >= lo AND k < hi""",
    ctes("deps_k", "adv_k"),
)
def vuln_match(t: Tables):
    return dep_matches(t).select("project_id", "line_no", "package", "spec", "version", "cve_id", "severity")


@register(
    "j1_catalogue_match",
    """SELECT DISTINCT project_id, line_no, declared, d.package, spec, section, cve_id, severity
       FROM stack_k d JOIN cat_k a ON d.package = a.package AND k >= lo AND k < hi""",
    ctes("stack_k", "cat_raw", "cat_k"),
)
def catalogue_match(t: Tables):
    return catalogue_matches(t).select("project_id", "line_no", "declared", "package", "spec", "section", "cve_id", "severity")


FEED_CTES = {
    "feed_k": """SELECT *,
      CASE WHEN vulnerable_range LIKE '>= 1%' THEN 2000000000001 WHEN vulnerable_range LIKE '> 0%' THEN 2 * CAST(split_part(split_part(vulnerable_range, '.', 2), '.', 1) AS BIGINT) * 1000000 + 2 ELSE 0 END AS lo,
      CASE WHEN vulnerable_range LIKE '>= 1%' THEN 4000000000001 + 2000000 * CAST(split_part(split_part(vulnerable_range, '< 2.', 2), '.', 1) AS BIGINT)
           WHEN vulnerable_range LIKE '< 2%' THEN 4000000000001 + 2000000 * CAST(split_part(split_part(vulnerable_range, '< 2.', 2), '.', 1) AS BIGINT)
           WHEN vulnerable_range LIKE '<= 2%' THEN 4000000000002 + 2000000 * CAST(split_part(split_part(vulnerable_range, '<= 2.', 2), '.', 1) AS BIGINT)
           ELSE 6000000000001 END AS hi
      FROM v_feed""",
    # every seventh quantity turns the declared spec into one that cannot be read
    "loose_deps": f"""SELECT *, {sql_key(sql_clean('spec'))} AS k FROM (
      SELECT l_orderkey AS project_id, l_linenumber AS line_no, concat('pkg-', CAST(l_partkey AS STRING)) AS package,
        CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN 'git+ssh://host/x'
             ELSE concat(CAST(l_linenumber % 4 AS STRING), '.', CAST(CAST(l_quantity AS INT) AS STRING), '.0') END AS spec
      FROM lineitem)""",
}


@register(
    "j2_advisory_range_match",
    """SELECT project_id, line_no, d.package, spec, ghsa_id, severity, CASE WHEN k IS NULL THEN 'unparsed' ELSE 'exact' END AS confidence
       FROM loose_deps d JOIN feed_k a ON d.package = a.package AND (k IS NULL OR (k >= lo AND k < hi))""",
    FEED_CTES,
)
def advisory_range_match(t: Tables):
    feed = t.view("v_feed").withColumn("affected_versions", F.array("vulnerable_range"))
    ranges = m.first_interval_flag(intervals(feed, ["ghsa_id", "package"], carry=["severity"]), ["ghsa_id", "package"])
    deps = t.sql(
        """SELECT l_orderkey AS project_id, l_linenumber AS line_no, concat('pkg-', CAST(l_partkey AS STRING)) AS package,
             CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN 'git+ssh://host/x'
                  ELSE concat(CAST(l_linenumber % 4 AS STRING), '.', CAST(CAST(l_quantity AS INT) AS STRING), '.0') END AS spec
           FROM lineitem"""
    )
    found = m.match_versions(m.with_version(deps), ranges, conservative=True)
    return found.select("project_id", "line_no", "package", "spec", "ghsa_id", "severity", "confidence")


@register(
    "j3_threshold_match",
    """SELECT project_id, line_no, d.package, spec, cve_id, CASE WHEN k IS NULL THEN 'unparsed' ELSE 'exact' END AS confidence
       FROM stack_k d JOIN thr_k a ON d.package = a.package AND (k IS NULL OR (k >= lo AND k < hi))""",
    ctes("stack_k") | {
        "thr": sql_rows(["package", "affected", "cve_id"], [[r["package"], r["affected"][0], c] for r in cat.PACKAGE_THRESHOLDS for c in r["cves"]]),
        "thr_k": f"SELECT *, {LO} AS lo, {HI} AS hi FROM thr",
    },
)
def threshold_match(t: Tables):
    found = m.threshold_match(m.with_version(t.view("v_stack")))
    return found.select("project_id", "line_no", "package", "spec", "cve_id", "confidence")


@register(
    "j4_runtime_line_match",
    f"""SELECT project_id, line_no, version, cve_id, fixed FROM stack_k JOIN lines
        ON major = k // 2000000000000 AND k >= {sql_key('first')} AND k < {sql_key('fixed')} WHERE package = 'node'""",
    ctes("stack_k") | {"lines": sql_rows(["major", "cve_id", "first", "fixed"], [[r["major"], r["cve_id"], r["first"], r["fixed"]] for r in cat.RUNTIME_LINES])},
)
def runtime_line_match(t: Tables):
    runtime = m.with_version(t.view("v_stack").where("package = 'node'"))
    return m.runtime_line_match(runtime).select("project_id", "line_no", "version", "cve_id", "fixed")


@register(
    "j5_middleware_line_match",
    f"""SELECT project_id, line_no, spec, patched, 'exact' AS confidence FROM stack_k JOIN lines ON major = k // 2000000000000
          AND k >= {sql_key('first')} AND k < {sql_key('below')} WHERE package = 'next'
        UNION ALL SELECT project_id, line_no, spec, NULL, 'unparsed' FROM stack_k WHERE package = 'next' AND k IS NULL""",
    ctes("stack_k") | {"lines": sql_rows(["major", "first", "below", "patched"],
        [[11, "11.1.4", "12.0.0", None], [12, "12.0.0", "12.3.5", "12.3.5"], [13, "13.0.0", "13.5.7", "13.5.7"],
         [14, "14.0.0", "14.2.25", "14.2.25"], [15, "15.0.0", "15.2.3", "15.2.3"]])},
)
def middleware_line_match(t: Tables):
    found = m.middleware_line_match(m.with_version(t.view("v_stack")))
    return found.select("project_id", "line_no", "spec", "patched", "confidence")


@register(
    "j6_multi_branch_fix_match",
    f"""SELECT project_id, line_no, version, cve_id, auth_required FROM stack_k JOIN fixes USING (package)
        WHERE k < {sql_key('fixed')} AND NOT EXISTS (SELECT 1 FROM alts WHERE alts.cve_id = fixes.cve_id AND k >= {sql_key('alt')})""",
    ctes("stack_k") | {
        "fixes": sql_rows(["package", "cve_id", "fixed", "auth_required"], [[r["package"], r["cve_id"], r["fixed"], r["auth_required"]] for r in cat.MULTI_BRANCH_FIXES]),
        "alts": sql_rows(["cve_id", "alt"], [[r["cve_id"], a] for r in cat.MULTI_BRANCH_FIXES for a in r["alt_fixed"]]),
    },
)
def multi_branch_fix_match(t: Tables):
    found = m.multi_branch_fix_match(m.with_version(t.view("v_stack")))
    return found.select("project_id", "line_no", "version", "cve_id", "auth_required")


@register(
    "j7_legacy_line_match",
    f"""SELECT project_id, line_no, package, version, patched, 'exact' AS rule FROM stack_k JOIN reacts USING (version) WHERE package = 'react'
        UNION ALL SELECT project_id, line_no, package, version, '{cat.LEGACY_CANARY_PATCH}', 'canary' FROM stack_k WHERE package = 'next' AND version LIKE '%canary%'
        UNION ALL SELECT project_id, line_no, package, version, patched, 'line' FROM stack_k JOIN lines
          ON line = split_part(version, '.', 1) || '.' || split_part(version, '.', 2) AND k >= {sql_key('first')} AND k <= {sql_key('last')}
          WHERE package = 'next' AND version NOT LIKE '%canary%'""",
    ctes("stack_k") | {
        "reacts": sql_rows(["version", "patched"], [list(kv) for kv in cat.LEGACY_REACT.items()]),
        "lines": sql_rows(["line", "first", "last", "patched"], [[r["line"], *r["affected"].split("-"), r["patched"]] for r in cat.LEGACY_NEXT]),
    },
)
def legacy_line_match(t: Tables):
    found = m.legacy_line_match(m.with_version(t.view("v_stack")))
    return found.select("project_id", "line_no", "package", "version", "patched", "rule")


@register(
    "j8_patch_lookup",
    f"""WITH f AS (SELECT DISTINCT project_id, line_no, declared, d.package, version, k, a.cve_id FROM stack_k d JOIN cat_k a ON d.package = a.package AND k >= lo AND k < hi),
        p AS (SELECT f.*, patched, CASE WHEN patch_key = version THEN 1
                 WHEN patch_key = split_part(version, '.', 1) || '.' || split_part(version, '.', 2) || '.x' THEN 2
                 WHEN patch_key = split_part(version, '.', 1) || '.x' THEN 3
                 WHEN patch_key LIKE '<%' AND k < {sql_key('substr(patch_key, 2)')} THEN 4 END AS precedence
              FROM f LEFT JOIN patches USING (cve_id, package))
        SELECT project_id, line_no, declared, package, version, cve_id, arg_min(patched, precedence) AS patched_version
        FROM p GROUP BY ALL""",
    ctes("stack_k", "cat_raw", "cat_k") | {
        "patches": sql_rows(["cve_id", "package", "patch_key", "patched"],
                            [[a["cve_id"], p, k, v] for a in cat.ADVISORIES for p in a["packages"] for k, v in a["patched_versions"].items()]),
    },
)
def patch_lookup(t: Tables):
    found = m.patch_lookup(catalogue_matches(t), F.broadcast(m.patch_table(cat.catalogue(t.spark))))
    return found.select("project_id", "line_no", "declared", "package", "version", "cve_id", "patched_version")


@register(
    "j24_cve_hunt",
    """SELECT DISTINCT project_id, d.package, version FROM stack_k d JOIN cat_k a ON d.package = a.package AND k >= lo AND k < hi
       WHERE cve_id = 'CVE-2025-48997'""",
    ctes("stack_k", "cat_raw", "cat_k"),
)
def cve_hunt(t: Tables):
    deps = m.with_version(t.view("v_stack"))
    return m.cve_hunt(deps, cat.catalogue(t.spark), "CVE-2025-48997").select("project_id", "package", "version").distinct()


@register(
    "p4_catalogue_filter",
    """SELECT 'critical' AS filter, cve_id FROM v_advisories WHERE severity = 'CRITICAL'
       UNION ALL SELECT 'category', cve_id FROM v_advisories WHERE category = 'ECONOMY'
       UNION ALL SELECT 'package', cve_id FROM v_advisories WHERE package = 'pkg-7'
       UNION ALL SELECT 'id', cve_id FROM v_advisories WHERE cve_id = 'ADV-000000011'
       UNION ALL SELECT 'active', cve_id FROM v_advisories WHERE active_exploitation
       UNION ALL SELECT 'kev', cve_id FROM v_advisories WHERE cisa_kev""",
)
def catalogue_filter(t: Tables):
    adv = t.view("v_advisories")
    parts = {
        "critical": m.catalogue_filter(adv, severity="critical"),
        "category": m.catalogue_filter(adv, category="ECONOMY"),
        "package": m.catalogue_filter(adv, package="pkg-7"),
        "id": m.catalogue_filter(adv, cve_id="ADV-000000011"),
        "active": m.catalogue_filter(adv, active=True),
        "kev": m.catalogue_filter(adv, kev=True),
    }
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("filter"), "cve_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "p5_bounty_filter",
    """SELECT 'target' AS list, cve_id, severity FROM v_advisories WHERE difficulty IN ('Trivial', 'Easy') AND severity IN ('CRITICAL', 'HIGH') AND NOT requires_auth
       UNION ALL SELECT 'worthy', cve_id, severity FROM v_advisories WHERE severity = 'CRITICAL' OR public_poc OR active_exploitation""",
)
def bounty_filter(t: Tables):
    adv = t.view("v_advisories")
    one = m.bounty_targets(adv).select(F.lit("target").alias("list"), "cve_id", "severity")
    return one.unionByName(m.bounty_worthy(adv).select(F.lit("worthy").alias("list"), "cve_id", "severity"))


@register(
    "p9_severity_threshold",
    """SELECT project_id, line_no, d.package, cve_id, severity FROM deps_k d JOIN adv_k a ON d.package = a.package AND k >= lo AND k < hi
       WHERE severity IN ('CRITICAL', 'HIGH')""",
    ctes("deps_k", "adv_k"),
)
def severity_threshold(t: Tables):
    return m.at_least(dep_matches(t), "HIGH").select("project_id", "line_no", "package", "cve_id", "severity")


SUMMARY_SQL = """SELECT category, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (active_exploitation) AS active,
  count(*) FILTER (cisa_kev) AS kev, count(*) FILTER (public_poc) AS poc FROM {src} GROUP BY ROLLUP (category)"""


@register("a2_catalogue_summary", SUMMARY_SQL.format(src="v_advisories"))
def catalogue_summary(t: Tables):
    return m.catalogue_summary(t.view("v_advisories"))


@register(
    "u1_catalogue_union",
    """WITH seen AS (SELECT package, count(*) AS deps FROM v_stack GROUP BY package),
       flat AS (SELECT category, cve_id, severity, unnest(packages) AS package FROM catalogue)
       SELECT category, cve_id, severity, package, coalesce(deps, 0) AS deps FROM flat LEFT JOIN seen USING (package)""",
    ctes("catalogue"),
)
def catalogue_union(t: Tables):
    seen = t.view("v_stack").groupBy("package").agg(F.count(F.lit(1)).alias("deps"))
    flat = cat.by_package(cat.catalogue(t.spark)).select("category", "cve_id", "severity", "package")
    return flat.join(seen, "package", "left").select("category", "cve_id", "severity", "package", F.coalesce("deps", F.lit(0).cast("bigint")).alias("deps"))
