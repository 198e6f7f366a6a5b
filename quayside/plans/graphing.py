"""Registered queries: graphs, bills of materials, documents, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalogue import advisories as cat
from quayside.catalogue import lists as words
from quayside.catalogue import rules as book
from quayside.functions.text import integrity_hash, purl
from quayside.operators import detection, graph, hygiene, registry, sbom
from quayside.operators.reports import union_findings
from quayside.plans.detection import LINES, MASK, sql_matches
from quayside.plans.hygiene import CONFUSED
from quayside.plans.matching import HI, LO, ctes
from quayside.plans.registry import Tables, register, sql_key, sql_rows, sql_text
from quayside.session import cut_lineage, scratch_path
from quayside.sources import sinks

TREE = """WITH RECURSIVE r AS (SELECT DISTINCT project_id, parent AS node FROM v_edges e WHERE NOT EXISTS (SELECT 1 FROM v_edges x WHERE x.project_id = e.project_id AND x.child = e.parent)),
  t(project_id, node, depth, path, cycle) AS (SELECT project_id, node, 0, [node], FALSE FROM r
    UNION ALL SELECT t.project_id, e.child, t.depth + 1, list_append(t.path, e.child), list_contains(t.path, e.child) FROM t JOIN v_edges e ON e.project_id = t.project_id AND e.parent = t.node WHERE NOT t.cycle)
  """


def tree(t: Tables):
    edges = t.view("v_edges")
    return graph.expand_tree(edges, graph.roots(edges))


@register("g1_dep_edges", "SELECT DISTINCT project_id, package AS parent, child, dev, optional FROM v_liblock")
def dep_edges(t: Tables):
    return graph.dep_edges(t.view("v_liblock").withColumn("requires", F.create_map("child", F.lit("^1.0.0"))))


@register("g2_tree_expand", TREE + """SELECT project_id, node, CAST(depth AS INT) AS depth, array_to_string(path, '>') AS path, cycle,
    row_number() OVER (PARTITION BY project_id, node ORDER BY depth, array_to_string(path, '>')) > 1 AS duplicate FROM t""")
def tree_expand(t: Tables):
    return graph.mark_duplicates(tree(t)).withColumn("path", F.array_join("path", ">"))


@register("g2_reachable", TREE + "SELECT project_id, node, CAST(min(depth) AS INT) AS depth FROM t GROUP BY 1, 2")
def reachable(t: Tables):
    edges = t.view("v_edges")
    return graph.reach(edges, graph.roots(edges))


@register("g3_find_paths", TREE + "SELECT project_id, node, array_to_string(path, ' -> ') AS path FROM t WHERE contains(lower(node), 'lib-7')")
def find_paths(t: Tables):
    edges = t.view("v_edges")
    return graph.find_paths(edges, graph.roots(edges), "LIB-7")


@register("g2_visible_tree", TREE.replace("WHERE NOT EXISTS", "WHERE NOT EXISTS (SELECT 1 FROM v_liblock k WHERE k.project_id = e.project_id AND k.package = e.parent HAVING bool_and(dev) OR bool_and(optional)) AND NOT EXISTS")
          + "SELECT project_id, node, CAST(depth AS INT) AS depth, array_to_string(path, '>') AS path, cycle FROM t WHERE depth <= 10")
def visible_tree(t: Tables):
    """What a display shows without dev and optional packages, ten levels deep."""
    edges = t.view("v_edges")
    chosen = graph.visible_roots(graph.roots(edges), t.view("v_liblock"), dev=False)
    return graph.shown(graph.expand_tree(edges, chosen), max_depth=10).withColumn("path", F.array_join("path", ">"))


@register("a5_tree_stats", TREE + """, n AS (SELECT project_id, node, count(*) AS k, max(depth) AS depth, count(*) FILTER (cycle) AS c FROM t GROUP BY 1, 2)
  SELECT project_id, CAST(sum(k) AS BIGINT) AS total, count(*) AS unique_packages, CAST(max(depth) AS INT) AS max_depth, count(*) FILTER (k > 1) AS repeated, CAST(sum(c) AS BIGINT) AS cycles,
    CASE WHEN sum(c) > 0 THEN 'circular' WHEN count(*) FILTER (k > 1) > 10 THEN 'many duplicates' WHEN max(depth) > 10 THEN 'deep' WHEN count(*) FILTER (k > 1) = 0 AND max(depth) < 8 THEN 'healthy' ELSE 'fair' END AS verdict
  FROM n GROUP BY project_id""")
def tree_stats(t: Tables):
    edges = cut_lineage(t.view("v_edges"), "edges")
    return graph.project_stats(edges, graph.roots(edges))


@register("k5_edge_list_sink", TREE + """, c AS (SELECT project_id, path[-2] AS parent, node AS child, bool_or(cycle) AS cycle FROM t WHERE depth > 0 GROUP BY ALL),
    f AS (SELECT project_id, parent, child, bool_and(dev) AS dev, bool_and(optional) AS optional FROM (SELECT project_id, package AS parent, child, dev, optional FROM v_liblock) GROUP BY 1, 2, 3),
    bad AS (SELECT DISTINCT project_id, package AS child FROM v_liblock WHERE version = '1.0.0')
  SELECT f.project_id, f.parent, f.child, CASE WHEN cycle THEN 'cycle' WHEN dev THEN 'dev' WHEN optional THEN 'optional' WHEN bad.child IS NOT NULL THEN 'vulnerable' ELSE 'plain' END AS class
  FROM f LEFT JOIN c ON c.project_id = f.project_id AND c.parent = f.parent AND c.child = f.child LEFT JOIN bad ON bad.project_id = f.project_id AND bad.child = f.child""")
def edge_list_sink(t: Tables):
    lock = t.view("v_liblock")
    edges = lock.groupBy("project_id", F.col("package").alias("parent"), "child").agg(F.bool_and("dev").alias("dev"), F.bool_and("optional").alias("optional"))
    views = cut_lineage(t.view("v_edges"), "edges")
    closing = graph.path_counts(views, graph.roots(views), counted=False)[1]
    classed = graph.classed_edges(edges, closing, lock.where("version = '1.0.0'"))
    path = scratch_path(t.spark, "edges")
    classed.write.parquet(path)
    return t.spark.read.parquet(path)


# ---- bills of materials ----

PARTS = {
    "man": "SELECT project_id, package, bool_or(dev) AS dev_section FROM v_liblock WHERE NOT optional GROUP BY 1, 2",
    "parts": """SELECT l.project_id, l.package AS name, version, 'pkg:npm/' || l.package || '@' || version AS purl, max(license) AS license, max(integrity) AS integrity,
        bool_or(m.package IS NOT NULL) AS is_direct, bool_or(dev OR coalesce(dev_section, FALSE)) AS is_dev FROM v_liblock l LEFT JOIN man m ON m.project_id = l.project_id AND m.package = l.package GROUP BY ALL""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY is_direct DESC, name, version) AS ordinal FROM parts",
}
HASHES = """CASE split_part(integrity, '-', 1) WHEN 'sha512' THEN 'SHA-512' WHEN 'sha256' THEN 'SHA-256' WHEN 'sha1' THEN 'SHA-1' END AS hash_alg, split_part(integrity, '-', 2) AS hash_value"""


def manifest_deps(t: Tables):
    return t.sql("SELECT project_id, package, CASE WHEN dev THEN 'devDependencies' ELSE 'dependencies' END AS section FROM v_liblock WHERE NOT optional")


def parts(t: Tables):
    return sbom.components(t.view("v_liblock"), manifest_deps(t))


@register("j21_directness_flag", "SELECT project_id, name, version, is_direct, is_dev FROM parts", PARTS)
def directness_flag(t: Tables):
    return parts(t).select("project_id", "name", "version", "is_direct", "is_dev")


@register("w6_component_order", "SELECT project_id, name, version, ordinal FROM placed", PARTS)
def component_order(t: Tables):
    return sbom.component_order(parts(t)).select("project_id", "name", "version", "ordinal")


@register("f3_purl", "SELECT DISTINCT package, version, 'pkg:npm/' || package || '@' || version AS purl FROM v_lock")
def purls(t: Tables):
    return t.view("v_lock").select("package", "version", purl(F.col("package"), F.col("version")).alias("purl")).distinct()


@register("f4_integrity_hash", f"SELECT project_id, package, version, {HASHES} FROM v_liblock")
def integrity_hashes(t: Tables):
    alg, value = integrity_hash(F.col("integrity"))
    return t.view("v_liblock").select("project_id", "package", "version", alg.alias("hash_alg"), value.alias("hash_value"))


LINKS = """SELECT DISTINCT l.project_id, l.package AS parent, l.version AS parent_version, l.child, f.version AS child_version FROM v_liblock l
  LEFT JOIN (SELECT project_id, name, min(version) AS version FROM parts GROUP BY 1, 2) f ON f.project_id = l.project_id AND f.name = l.child"""


def links(t: Tables, ordered, once: bool = True):
    """Resolved links; without ``once`` a repeated link may stay, for a caller that gathers sets."""
    edges = t.view("v_liblock").select("project_id", F.col("package").alias("parent"), F.col("version").alias("parent_version"), "child")
    return sbom.resolve_dependencies(edges.distinct() if once else edges, ordered)


@register("j20_depends_on_resolve", LINKS, PARTS)
def depends_on_resolve(t: Tables):
    return links(t, sbom.component_order(parts(t))).select("project_id", "parent", "parent_version", "child", "child_version")


@register("a4_sbom_report", "SELECT project_id, count(*) AS total, count(*) FILTER (is_direct) AS direct, count(*) FILTER (NOT is_direct) AS transitive, count(*) FILTER (is_dev) AS dev FROM parts GROUP BY 1", PARTS)
def sbom_report(t: Tables):
    return sbom.sbom_report(parts(t))


@register("a4_license_histogram", "SELECT coalesce(license, 'UNKNOWN') AS license, count(*) AS n FROM parts GROUP BY 1", PARTS)
def license_histogram(t: Tables):
    return sbom.license_histogram(parts(t))


CREATED = "2026-01-01T00:00:00Z"


def written(t: Tables, lines, keys: list[str], label: str):
    """Write the documents, then read their lines again."""
    path = scratch_path(t.spark, label)
    sinks.write_documents(lines, keys, path)
    return t.spark.read.parquet(path)


@register("k3_cyclonedx_sink", f"""WITH l AS ({LINKS}), d AS (SELECT project_id, parent AS name, parent_version AS version, string_agg(child || '@' || child_version, ',' ORDER BY child, child_version) AS depends FROM l WHERE child_version IS NOT NULL GROUP BY 1, 2, 3)
  SELECT 'project-' || p.project_id AS project, p.name, p.version, purl, license, {HASHES.replace('integrity', 'p.integrity')}, CASE WHEN is_dev THEN 'optional' END AS scope, coalesce(depends, '') AS depends
  FROM parts p LEFT JOIN d ON d.project_id = p.project_id AND d.name = p.name AND d.version = p.version""", PARTS)
def cyclonedx_sink(t: Tables):
    # the purl is its name and version: it need not travel
    ordered = cut_lineage(sbom.component_order(parts(t).drop("purl")).withColumn("purl", purl(F.col("name"), F.col("version"))))
    depends = links(t, ordered, once=False).where("child_version IS NOT NULL").groupBy("project_id", F.col("parent").alias("name"), F.col("parent_version").alias("version")).agg(
        F.sort_array(F.collect_set(F.concat("child", F.lit("@"), "child_version"))).alias("depends_on")
    )
    back = written(t, sinks.cyclonedx_documents(ordered, depends, CREATED), ["project_id"], "cyclonedx")
    parts_ddl = "name string, version string, purl string, licenses array<struct<license:struct<id:string>>>, hashes array<struct<alg:string,content:string>>, scope string"
    links_ddl = "ref string, dependsOn array<string>"
    fields = [
        "c.name", "c.version", "c.purl", F.get(F.col("c.licenses"), F.lit(0))["license"]["id"].alias("license"),
        F.get(F.col("c.hashes"), F.lit(0))["alg"].alias("hash_alg"), F.get(F.col("c.hashes"), F.lit(0))["content"].alias("hash_value"), "c.scope",
        F.array_join("d.dependsOn", ",").alias("depends"),
    ]
    paired = sinks.paired_sections(back, "]}", ["metadata", "component", "name"]).withColumnRenamed("name", "project")
    items = paired.withColumn("c", sinks.item_in(F.col("first"), parts_ddl)).withColumn("d", sinks.item_in(F.col("second"), links_ddl))
    read = cut_lineage(items.select("project_id", "section", "place", "line", "project", *fields), "pairs")
    # documents that go on in another file meet in joins
    others = read.where("section IS NOT NULL").select("project_id", "section", "place", "line")
    header = sinks.header_of(others, "]}", "metadata struct<component:struct<name:string>>").select("project_id", F.col("header.metadata.component.name").alias("project"))
    listed = sinks.items_of(others, 0, parts_ddl).withColumnRenamed("item", "c")
    linked = sinks.items_of(others, 1, links_ddl).withColumnRenamed("item", "d")
    rest = linked.join(header, "project_id").join(listed, ["project_id", "place"]).select("project", *fields)
    return read.where("section IS NULL").select(*rest.columns).unionByName(rest)


@register("k4_spdx_sink", """SELECT 'project-' || project_id AS project, 'SPDXRef-Package-' || ordinal AS spdx_id, name, version, coalesce(license, 'NOASSERTION') AS license,
    count(*) FILTER (is_direct) OVER (PARTITION BY project_id) + 1 AS relationships FROM placed""", PARTS)
def spdx_sink(t: Tables):
    back = written(t, sinks.spdx_documents(sbom.component_order(parts(t)), CREATED), ["project_id"], "spdx")
    header = sinks.header_of(back, "]}", "name string").select("project_id", F.col("header.name").alias("project"))
    relations = sinks.items_of(back, 1, "relationshipType string").groupBy("project_id").agg(F.count("item.relationshipType").alias("relationships"))
    rows = sinks.items_of(back, 0, "SPDXID string, name string, versionInfo string, licenseDeclared string").join(header, "project_id").join(relations, "project_id")
    return rows.select("project", F.col("item.SPDXID").alias("spdx_id"), "item.name", F.col("item.versionInfo").alias("version"), F.col("item.licenseDeclared").alias("license"), "relationships")


@register("k1_findings_json_sink", """SELECT scanner, project_id AS target, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
    count(*) AS listed, min(cve_id) AS first_cve FROM v_findings GROUP BY 1, 2""")
def findings_json_sink(t: Tables):
    back = written(t, sinks.findings_documents(t.view("v_findings")), ["scanner", "project_id"], "findings")
    header = sinks.header_of(back, "]}", "scanner string, target bigint, summary struct<total:bigint,critical:bigint,high:bigint>")
    listed = sinks.items_of(back, 0, "cve_id string").groupBy("scanner", "project_id").agg(F.count("item.cve_id").alias("listed"), F.min("item.cve_id").alias("first_cve"))
    return header.join(listed, ["scanner", "project_id"]).select("header.scanner", "header.target", "header.summary.*", "listed", "first_cve")


@register("k2_sarif_sink", """SELECT cve_id AS rule_id, file_path, line_no AS start_line, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
    left(sha256(cve_id || ':' || file_path || ':' || line_no || ':' || package || ' ' || version), 16) AS fingerprint FROM v_findings""")
def sarif_sink(t: Tables):
    return sarif_rows(t, sinks.sarif_findings(t.view("v_findings"))).drop("project_id")


def sarif_rows(t: Tables, findings):
    back = written(t, sinks.sarif_documents(findings), ["project_id"], "sarif")
    ddl = (
        "ruleId string, level string, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>,"
        "fingerprints struct<primary:string>"
    )
    place = F.col("item.locations")[0]["physicalLocation"]
    return sinks.items_of(back, 1, ddl).select("project_id", F.col("item.ruleId").alias("rule_id"), place["artifactLocation"]["uri"].alias("file_path"),
                                               place["region"]["startLine"].alias("start_line"), "item.level", F.col("item.fingerprints.primary").alias("fingerprint"))


SARIF_ALL = {
    "all_lines": LINES, "matches": sql_matches(book.RULES, "all_lines", "project_id, path, line_no"), "secret_hits": sql_matches(detection.secret_rules(), "all_lines", "project_id, path, line_no"),
    "advice": sql_rows(["malware_type", "explanation", "remediation"], [[k, *v] for k, v in book.ADVICE.items()]),
    "every": f"""SELECT project_id, 'MALWARE-' || rule_id AS rule_id, path AS file_path, line_no, threat_level AS severity, name || ': ' || explanation AS message FROM matches JOIN advice USING (malware_type)
      UNION ALL SELECT project_id, 'SECRET-' || upper(rule_id), path, line_no, threat_level, name || ': ' || {MASK.format(v='matched_text')} FROM secret_hits
      UNION ALL SELECT CAST(project_id AS VARCHAR), 'DEP-MISSING_INTEGRITY', 'package-lock.json', 1, 'LOW', 'missing integrity: ' || package || ' ' || version FROM v_lock WHERE integrity IS NULL
      UNION ALL SELECT CAST(project_id AS VARCHAR), 'DEP-DEPENDENCY_CONFUSION', 'package-lock.json', 1, 'MEDIUM', 'dependency confusion: ' || package || ' ' || version || ' ' || resolved_url FROM v_lock WHERE {CONFUSED}
      UNION ALL SELECT CAST(project_id AS VARCHAR), 'DEP-GIT_DEPENDENCY', 'package-lock.json', 1, 'INFO', 'git dependency: ' || package || ' ' || version || ' ' || resolved_url FROM v_lock WHERE contains(resolved_url, 'github.com')
      UNION ALL SELECT CAST(project_id AS VARCHAR), 'DEP-DUPLICATE_PACKAGE', 'package-lock.json', 1, 'INFO', 'duplicate package: ' || package || ' ' || string_agg(DISTINCT version, ', ' ORDER BY version) || ' ' || count(DISTINCT version)
        FROM v_lock GROUP BY project_id, package HAVING count(DISTINCT version) > 2""",
}


@register("k2_sarif_all_scanners", """SELECT project_id, rule_id, file_path, CAST(line_no AS INT) AS start_line, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
    left(sha256(rule_id || ':' || file_path || ':' || line_no || ':' || message), 16) AS fingerprint FROM every""", SARIF_ALL)
def sarif_all_scanners(t: Tables):
    """Malware, secret and lockfile findings as SARIF."""
    files = t.view("v_files").select("file_id", "project_id", "path", "content")
    issues = hygiene.lock_issues(t.view("v_lock")).where("issue_type <> 'typosquatting'").withColumn("project_id", F.col("project_id").cast("string")).withColumn("file_path", F.lit("package-lock.json"))
    # files are matched once for both scanners, and the documents read their findings several times
    matches = cut_lineage(detection.rule_matches(files, detection.whole_book()).drop("line"), "matches")
    malware = detection.explain(matches.where(F.col("rule_id").isin([r["rule_id"] for r in book.RULES])))
    found = sinks.sarif_findings(malware=malware, secrets=detection.secret_matches(files, matches), lock=issues)
    return sarif_rows(t, cut_lineage(found, "findings"))


LOG = """SELECT l_orderkey AS project_id, concat('ADV-', CAST(l_partkey AS STRING)) AS cve_id, CASE l_partkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity, year(l_shipdate) AS session_date FROM lineitem"""


@register("k6_findings_log_sink", f"SELECT severity, count(*) AS n, count(DISTINCT project_id) AS projects, CAST(max(session_date) AS INT) AS session_date FROM ({LOG}) WHERE session_date = (SELECT max(session_date) FROM ({LOG})) GROUP BY severity")
def findings_log_sink(t: Tables):
    path = scratch_path(t.spark, "findings-log")
    sinks.append_findings(t.sql(LOG), path)
    newest = sinks.newest_session(t.spark.read.parquet(path))
    return newest.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project_id").alias("projects"), F.max("session_date").alias("session_date"))


# ---- scanner registry ----


ALL_SCANNERS = f"""SELECT 'react' AS scanner, severity FROM stack_k d JOIN cat_k a ON d.package = a.package AND k >= lo AND k < hi
    WHERE d.package IN ('react', 'react-dom', 'react-server-dom-webpack') AND (d.package = 'react-server-dom-webpack' OR project_id IN (
      SELECT project_id FROM stack_k WHERE package = 'react-server-dom-webpack'
      UNION SELECT project_id FROM stack_k WHERE package = 'next' AND k // 2000000000000 >= 13 AND project_id IN (SELECT file_id FROM v_project_files WHERE folder IN ('app/', 'src/app/'))
      UNION SELECT file_id FROM v_project_files WHERE (contains(content, '"use server"') OR contains(content, '''use server''')) AND NOT contains(folder, 'node_modules')))
  UNION ALL SELECT 'nextjs', 'CRITICAL' FROM stack_k LEFT JOIN mid ON major = k // 2000000000000 WHERE package = 'next' AND (k IS NULL OR (k >= {sql_key('first')} AND k < {sql_key('below')}))
  UNION ALL SELECT 'npm', c.severity FROM stack_k d JOIN thr_k a ON d.package = a.package AND (k IS NULL OR (k >= lo AND k < hi)) JOIN catalogue c USING (cve_id)
  UNION ALL SELECT 'nodejs', c.severity FROM stack_k JOIN rt ON major = k // 2000000000000 AND k >= {sql_key('first')} AND k < {sql_key('fixed')} JOIN catalogue c USING (cve_id) WHERE package = 'node'
  UNION ALL SELECT 'n8n', c.severity FROM stack_k JOIN fixes USING (package) JOIN catalogue c USING (cve_id)
    WHERE k < {sql_key('fixed')} AND NOT EXISTS (SELECT 1 FROM alts WHERE alts.cve_id = fixes.cve_id AND k >= {sql_key('alt')})"""


QUICK_CTES = ctes("stack_k", "catalogue", "cat_raw", "cat_k") | {
    "mid": sql_rows(["major", "first", "below"], [[11, "11.1.4", "12.0.0"], [12, "12.0.0", "12.3.5"], [13, "13.0.0", "13.5.7"], [14, "14.0.0", "14.2.25"], [15, "15.0.0", "15.2.3"]]),
    "thr": sql_rows(["package", "affected", "cve_id"], [[r["package"], r["affected"][0], c] for r in cat.PACKAGE_THRESHOLDS for c in r["cves"]]),
    "thr_k": f"SELECT *, {LO} AS lo, {HI} AS hi FROM thr",
    "rt": sql_rows(["major", "cve_id", "first", "fixed"], [[r["major"], r["cve_id"], r["first"], r["fixed"]] for r in cat.RUNTIME_LINES]),
    "fixes": sql_rows(["package", "cve_id", "fixed"], [[r["package"], r["cve_id"], r["fixed"]] for r in cat.MULTI_BRANCH_FIXES]),
    "alts": sql_rows(["cve_id", "alt"], [[r["cve_id"], a] for r in cat.MULTI_BRANCH_FIXES for a in r["alt_fixed"]]),
}


@register("x1_scanner_registry_quick", f"SELECT scanner, severity, count(*) AS n FROM ({ALL_SCANNERS}) GROUP BY ALL", QUICK_CTES)
def scanner_registry_quick(t: Tables):
    """The quick subset: manifests and versions only."""
    return registry.run_scanners(registry.default_tables(t), quick=True).groupBy("scanner", "severity").agg(F.count(F.lit(1)).alias("n"))


# one finding per script with a suspicious pattern
SCRIPT_HITS = " OR ".join(f"regexp_matches(command, {sql_text(p)}, 'i')" for p, _ in book.SCRIPT_PATTERNS)
DEEP_SCANNERS = f"""{ALL_SCANNERS}
  UNION ALL SELECT 'supply-chain', severity FROM stack_k JOIN bad USING (package) WHERE list_contains(versions, version) OR (len(versions) = 0 AND campaign IS NOT NULL)
  UNION ALL SELECT 'supply-chain', 'HIGH' FROM v_scripts WHERE script_name IN ('preinstall', 'postinstall', 'install', 'prepare') AND ({SCRIPT_HITS})
  UNION ALL SELECT 'supply-chain', 'CRITICAL' FROM v_project_files WHERE (folder = '' OR regexp_matches(folder, '^node_modules/([^/]+/)?$')) AND name IN ('setup_bun.js', '.truffler-cache')
  UNION ALL SELECT 'supply-chain', 'CRITICAL' FROM v_project_files WHERE folder = '' AND name IN ('setup_bun.js', '.truffler-cache')
  UNION ALL SELECT 'supply-chain', 'CRITICAL' FROM v_project_files WHERE name IN ('setup_bun.js', '.truffler-cache')
  UNION ALL SELECT 'supply-chain', 'CRITICAL' FROM v_project_files WHERE name IN ('.npmrc', '.yarnrc', '.yarnrc.yml', '.env', '.env.local', '.env.production') AND contains(content, '//registry.npmjs.org/:_authToken=')
  UNION ALL SELECT 'gateway', severity FROM (SELECT DISTINCT project_id, line_no, declared, spec, cve_id, severity, d.package FROM stack_k d JOIN cat_k a ON d.package = a.package AND k >= lo AND k < hi WHERE d.package IN ('clawdbot', 'moltbot')) g
  UNION ALL SELECT 'gateway', 'CRITICAL' FROM v_project_files WHERE regexp_matches(content, '(proxy_pass|reverse_proxy).*(18789|clawdbot|moltbot)', 'i')"""


@register("x1_scanner_registry_deep", f"SELECT scanner, severity, count(*) AS n FROM ({DEEP_SCANNERS}) GROUP BY ALL", QUICK_CTES | {
    "bad": sql_rows(["package", "versions", "severity", "campaign"], [[r["package"], r["bad_versions"], r["severity"], r["campaign"]] for r in words.COMPROMISED])})
def scanner_registry_deep(t: Tables):
    """All registered scanners over the same tables, as one findings table (U2), counted."""
    return registry.run_scanners(registry.default_tables(t)).groupBy("scanner", "severity").agg(F.count(F.lit(1)).alias("n"))


@register("u2_findings_union", """SELECT scanner, severity, count(*) AS n, count(DISTINCT project_id) AS projects FROM v_findings GROUP BY ALL
  UNION ALL SELECT 'lockfile', 'LOW', count(*), count(DISTINCT project_id) FROM v_lock WHERE integrity IS NULL""")
def findings_union(t: Tables):
    landed = t.view("v_findings")
    parts = [landed.where(F.col("scanner") == name).select("scanner", "project_id", "severity", "package") for name in ("react", "npm", "nodejs", "supply-chain")]
    lock = hygiene.missing_integrity(t.view("v_lock")).select(F.lit("lockfile").alias("scanner"), "project_id", F.lit("LOW").alias("severity"))
    whole = union_findings([*parts, lock])
    return whole.groupBy("scanner", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project_id").alias("projects"))
