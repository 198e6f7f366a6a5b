"""Registered queries: sources. Documents are written by Spark from the given tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators.detection import registry_tokens
from quayside.operators.fixes import patch_manifest
from quayside.plans.registry import Tables, register
from quayside.session import scratch_path
from quayside.sources import feeds, files, manifests

FILE_PATHS = "SELECT file_id, folder || name AS rel_path, name, content FROM v_project_files"


@register("s1_manifest_scan", """SELECT file_id, folder || name AS rel_path FROM v_project_files WHERE name = 'package.json'
  AND NOT regexp_matches(folder, '(^|/)(node_modules|dist|build|coverage|[.][^/]+)/')""")
def manifest_scan(t: Tables):
    return files.manifest_scan(t.sql(FILE_PATHS)).select("file_id", "rel_path")


@register("s2_lockfile_scan", """SELECT file_id, project_id, name, CASE name WHEN 'package-lock.json' THEN 'npm' WHEN 'pnpm-lock.yaml' THEN 'pnpm'
    ELSE CASE WHEN contains(content, 'resolution:') OR starts_with(content, '__metadata:') THEN 'yarn-berry' ELSE 'yarn' END END AS lock_type
  FROM v_project_files WHERE name IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml')""")
def lockfile_scan(t: Tables):
    return files.lockfile_scan(t.view("v_project_files")).select("file_id", "project_id", "name", "lock_type")


@register("s10_runtime_version_read", """SELECT file_id, name, version FROM (SELECT file_id, name, CASE WHEN name = '.tool-versions' THEN nullif(regexp_extract(content, 'nodejs\\s+([0-9]+[.][0-9]+[.][0-9]+)', 1), '')
    WHEN regexp_matches(content, 'v?[0-9]+[.][0-9]+[.][0-9]+') THEN regexp_extract(content, 'v?([0-9]+[.][0-9]+[.][0-9]+)', 1)
    WHEN regexp_full_match(trim(content), '[0-9]+') THEN trim(content) || '.0.0' END AS version
  FROM v_project_files WHERE name IN ('.nvmrc', '.node-version', '.tool-versions')) WHERE version IS NOT NULL""")
def runtime_version_read(t: Tables):
    return files.runtime_versions(t.view("v_project_files")).select("file_id", "name", "version")


NODE = """CASE file_id % 5 WHEN 0 THEN '>=18.2 <21' WHEN 1 THEN '^20.' || CAST(file_id % 7 AS STRING) || '.1' WHEN 2 THEN '22.x || 24' WHEN 3 THEN 'lts' END"""
# projects stand in folders of some hundred, so that no task lists them all
PROJECT = "concat('s', CAST(file_id % 1000 AS STRING), '/p', CAST(file_id AS STRING), '/')"
TREE_FILES = f"""SELECT concat({PROJECT}, name) AS rel_path, content FROM v_project_files WHERE name <> 'package.json'
  UNION ALL SELECT concat({PROJECT}, 'package.json'), concat('{{"name": "a"', coalesce(concat(', "engines": {{"node": "', {NODE}, '"}}'), ''), '}}') FROM v_project_files"""


def written_projects(t: Tables):
    """Every project file in a folder of its own in the shared folder, read back: manifests, and the dotfiles beside them."""
    root = scratch_path(t.spark, "projects")
    files.write_files(t.sql(TREE_FILES), root)
    found = files.manifest_scan(files.read_files(t.spark, root, "package.json"))
    return found, files.read_dotfiles(found)


def file_id():
    return F.regexp_extract("project_dir", "/p([0-9]+)$", 1).cast("bigint").alias("file_id")


@register("s10_declared_runtimes", f"""WITH e AS (SELECT file_id, regexp_extract({NODE}, '([0-9]+)[.]?([0-9]+)?[.]?([0-9]+)?', ['a', 'b', 'c']) AS v FROM v_project_files)
  SELECT file_id, 'package.json' AS name, v.a || '.' || coalesce(nullif(v.b, ''), '0') || '.' || coalesce(nullif(v.c, ''), '0') AS version FROM e WHERE v.a <> ''
  UNION ALL SELECT file_id, name, version FROM (SELECT file_id, name, CASE WHEN name = '.tool-versions' THEN nullif(regexp_extract(content, 'nodejs\\s+([0-9]+[.][0-9]+[.][0-9]+)', 1), '')
    WHEN regexp_matches(content, 'v?[0-9]+[.][0-9]+[.][0-9]+') THEN regexp_extract(content, 'v?([0-9]+[.][0-9]+[.][0-9]+)', 1)
    WHEN regexp_full_match(trim(content), '[0-9]+') THEN trim(content) || '.0.0' END AS version
  FROM v_project_files WHERE name IN ('.nvmrc', '.node-version', '.tool-versions')) WHERE version IS NOT NULL""".replace("STRING", "VARCHAR"))
def declared_runtimes(t: Tables):
    """Runtime versions of real files: engines of manifests, and the version files that Spark's own sources skip."""
    return files.declared_runtimes(*written_projects(t)).select(file_id(), "name", "version")


@register("p16_token_files", """SELECT file_id, name FROM v_project_files
  WHERE name IN ('.npmrc', '.yarnrc', '.yarnrc.yml', '.env', '.env.local', '.env.production') AND contains(content, '//registry.npmjs.org/:_authToken=')""")
def token_files(t: Tables):
    """Registry tokens in real dotfiles of the shared folder."""
    return registry_tokens(written_projects(t)[1]).select(file_id(), "name")


@register("s12_file_snapshot", "SELECT path, md5(content) AS hash, CAST(strlen(content) AS INT) AS size FROM v_files")
def file_snapshot(t: Tables):
    return files.file_snapshot(t.view("v_files"))


# one manifest per line item; every seventh is broken, some packages stand in two sections
MANIFEST_ROWS = """SELECT l_orderkey AS project_id, l_linenumber AS line_no, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty,
  CASE WHEN l_suppkey % 7 = 6 THEN '{"name": ' ELSE concat('{"name": "app-', CAST(l_orderkey AS STRING), '", "version": "1.', CAST(l_linenumber AS STRING), '.0", "scripts": {"postinstall": "node x.js"}, ',
    '"dependencies": {"pkg-', CAST(l_partkey AS STRING), '": "^', CAST(CAST(l_quantity AS INT) AS STRING), '.0.0", "left-pad": "*"}, "devDependencies": {"pkg-', CAST(l_partkey AS STRING), '": "~',
    CAST(l_linenumber AS STRING), '.1.0"}}') END AS content FROM lineitem"""
GOOD = "FROM lineitem WHERE l_suppkey % 7 <> 6"


@register("s4_manifest_parse", f"""SELECT l_orderkey AS project_id, l_linenumber AS line_no, 'app-' || l_orderkey AS name, 'pkg-' || l_partkey AS package, '^' || CAST(l_quantity AS INT) || '.0.0' AS spec, 'dependencies' AS section {GOOD}
  UNION ALL SELECT l_orderkey, l_linenumber, 'app-' || l_orderkey, 'left-pad', '*', 'dependencies' {GOOD}
  UNION ALL SELECT l_orderkey, l_linenumber, 'app-' || l_orderkey, 'pkg-' || l_partkey, '~' || l_linenumber || '.1.0', 'devDependencies' {GOOD}""")
def manifest_parse(t: Tables):
    parsed = manifests.parse_manifests(t.sql(MANIFEST_ROWS))
    return manifests.dependency_rows(parsed, ["project_id", "line_no", "name"])


@register("f14_manifest_patch", f"""SELECT l_orderkey AS project_id, l_linenumber AS line_no,
    '{{"pkg-' || l_partkey || '":"^9.9.9"}}' AS dependencies, '{{"pkg-' || l_partkey || '":"~9.9.9"}}' AS dev_dependencies {GOOD}""")
def manifest_patch(t: Tables):
    parsed = manifests.parse_manifests(t.sql(MANIFEST_ROWS))
    planned = parsed.withColumn("patches", F.create_map(F.concat(F.lit("pkg-"), F.col("part").cast("string")), F.lit("9.9.9"))).withColumn("removed", F.array(F.lit("left-pad")))
    done = patch_manifest(planned)
    return done.select("project_id", "line_no", F.to_json("dependencies").alias("dependencies"), F.to_json("devDependencies").alias("dev_dependencies"))


LOCK2 = """SELECT l_orderkey AS project_id, l_linenumber AS line_no, concat('{"lockfileVersion": 3, "packages": {"": {"name": "root"}, "node_modules/pkg-', CAST(l_partkey AS STRING), '": {"version": "1.',
    CAST(l_linenumber AS STRING), '.0", "resolved": "https://registry.npmjs.org/x", "integrity": "sha512-abc", "dev": true, "dependencies": {"@org/dep-', CAST(l_suppkey AS STRING), '": "^2.0.0"}}, ',
    '"node_modules/pkg-', CAST(l_partkey AS STRING), '/node_modules/@org/dep-', CAST(l_suppkey AS STRING), '": {"version": "2.0.', CAST(l_linenumber AS STRING), '"}}}') AS content FROM lineitem"""
LOCK1 = """SELECT l_orderkey AS project_id, l_linenumber AS line_no, concat('{"lockfileVersion": 1, "dependencies": {"a-', CAST(l_partkey AS STRING), '": {"version": "1.0.0", "requires": {"b": "^2.0.0"}, ',
    '"dependencies": {"b": {"version": "2.0.0", "dependencies": {"c": {"version": "3.', CAST(l_linenumber AS STRING), '.0"}}}}}, "c": {"version": "1.1.1"}}}') AS content FROM lineitem"""


@register("s5_npm_lock_parse", """SELECT l_orderkey AS project_id, l_linenumber AS line_no, 'pkg-' || l_partkey AS package, '1.' || l_linenumber || '.0' AS version, TRUE AS dev, '{"@org/dep-' || l_suppkey || '":"^2.0.0"}' AS requires FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, '@org/dep-' || l_suppkey, '2.0.' || l_linenumber, FALSE, NULL FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'a-' || l_partkey, '1.0.0', FALSE, '{"b":"^2.0.0"}' FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'b', '2.0.0', FALSE, NULL FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'c', '3.' || l_linenumber || '.0', FALSE, NULL FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'c', '1.1.1', FALSE, NULL FROM lineitem""")
def npm_lock_parse(t: Tables):
    entries = manifests.parse_npm_lock(t.sql(LOCK2).unionByName(t.sql(LOCK1)))
    return entries.select("project_id", "line_no", "package", "version", "dev", F.to_json("requires").alias("requires"))


YARN = """SELECT l_orderkey AS project_id, l_linenumber AS line_no, concat('# yarn lockfile v1', chr(10), chr(10), '"@org/p', CAST(l_partkey AS STRING), '@^1.0.0", "@org/p', CAST(l_partkey AS STRING), '@~1.2.0":', chr(10), '  version "1.2.',
    CAST(l_linenumber AS STRING), '"', chr(10), '  resolved "https://registry.yarnpkg.com/p#1"', chr(10), '  integrity sha512-xyz', chr(10), '  dependencies:', chr(10), '    dep-', CAST(l_suppkey AS STRING), ' "^2.0.0"', chr(10), chr(10),
    'dep-', CAST(l_suppkey AS STRING), '@^2.0.0:', chr(10), '  version "2.0.0"', chr(10), '  dependencies:', chr(10), '    twice "^1.0.0"', chr(10), '  optionalDependencies:', chr(10), '    twice "^2.0.0"', chr(10), '  peerDependencies:', chr(10),
    '    peer "^3.0.0"', chr(10), chr(10), '"berry-', CAST(l_linenumber AS STRING), '@npm:^4.0.0":', chr(10), '  version: 4.1.0', chr(10), '  resolution: "berry@npm:4.1.0"', chr(10), '  dependencies:', chr(10), '    dep-', CAST(l_suppkey AS STRING), ': "npm:^2.0.0"', chr(10),
    '  bin:', chr(10), '    tool: bin/tool.js', chr(10), '  checksum: 10c0/abc', chr(10), '  languageName: node') AS content FROM lineitem"""


@register("s6_yarn_lock_parse", """SELECT l_orderkey AS project_id, l_linenumber AS line_no, '@org/p' || l_partkey AS package, '1.2.' || l_linenumber AS version, 'https://registry.yarnpkg.com/p#1' AS resolved_url, 'sha512-xyz' AS integrity,
    '{"dep-' || l_suppkey || '":"^2.0.0"}' AS requires FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'dep-' || l_suppkey, '2.0.0', NULL, NULL, '{"twice":"^2.0.0"}' FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'berry-' || l_linenumber, '4.1.0', NULL, '10c0/abc', '{"dep-' || l_suppkey || '":"npm:^2.0.0"}' FROM lineitem""")
def yarn_lock_parse(t: Tables):
    return manifests.parse_yarn_lock(t.sql(YARN)).withColumn("requires", F.to_json("requires"))


PNPM = """SELECT l_orderkey AS project_id, l_linenumber AS line_no, concat('lockfileVersion: 6.0', chr(10), 'packages:', chr(10), chr(10), '  /@org/p', CAST(l_partkey AS STRING), '@1.0.', CAST(l_linenumber AS STRING), '(react@18.0.0):', chr(10),
    '    resolution: {integrity: sha512-abc}', chr(10), '    dev: false', chr(10), chr(10), '  /old-', CAST(l_suppkey AS STRING), '/3.1.0:', chr(10), '    resolution: {integrity: sha512-def}', chr(10), chr(10), 'snapshots:', chr(10), chr(10), '  late@1.0.0:', chr(10), '    dev: true', chr(10)) AS content FROM lineitem"""


@register("s7_pnpm_lock_parse", """SELECT l_orderkey AS project_id, l_linenumber AS line_no, '@org/p' || l_partkey AS package, '1.0.' || l_linenumber AS version, 'sha512-abc' AS integrity FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'old-' || l_suppkey, '3.1.0', 'sha512-def' FROM lineitem""")
def pnpm_lock_parse(t: Tables):
    return manifests.parse_pnpm_lock(t.sql(PNPM))


def feed_documents(t: Tables):
    """One landed response per advisory, as JSON text."""
    return t.sql(
        """SELECT to_json(named_struct('nodes', array(named_struct(
             'advisory', named_struct('ghsaId', ghsa_id, 'summary', concat('Issue in ', package), 'severity', upper(severity), 'cvss', named_struct('score', 7.5D),
               'cwes', named_struct('nodes', array(named_struct('cweId', 'CWE-79'))),
               'identifiers', if(cve_id IS NULL, array(named_struct('type', 'GHSA', 'value', ghsa_id)), array(named_struct('type', 'GHSA', 'value', ghsa_id), named_struct('type', 'CVE', 'value', cve_id)))),
             'package', named_struct('name', package, 'ecosystem', 'NPM'), 'vulnerableVersionRange', vulnerable_range,
             'firstPatchedVersion', if(first_patched IS NULL, NULL, named_struct('identifier', first_patched)))))) AS content FROM v_feed"""
    )


@register("s8_advisory_feed_read", """SELECT coalesce(cve_id, ghsa_id) AS cve_id, ghsa_id, 'Issue in ' || package AS title, upper(CASE severity WHEN 'moderate' THEN 'medium' WHEN 'unknown' THEN 'medium' ELSE severity END) AS severity,
    7.5::DOUBLE AS cvss_score, package AS packages, vulnerable_range AS affected_versions, first_patched AS patched FROM v_feed""")
def advisory_feed_read(t: Tables):
    nodes = feed_documents(t).select(F.from_json("content", feeds.FEED_DDL).alias("d")).select("d.nodes")
    rows = feeds.to_catalogue(feeds.normalise_advisories(nodes))
    return rows.select("cve_id", "ghsa_id", "title", "severity", "cvss_score", F.array_join("packages", ",").alias("packages"),
                       F.array_join("affected_versions", ",").alias("affected_versions"), F.map_values("patched_versions")[0].alias("patched"))


@register("s8_threat_intel", "SELECT cve_id, severity, package, affected, patched, cisa_kev FROM v_advisories")
def threat_intel(t: Tables):
    documents = t.sql(
        """SELECT to_json(named_struct('cves', array(named_struct('id', cve_id, 'severity', severity, 'cvss', 7.5D, 'packages', array(package), 'affected_versions', array(affected),
             'patched_versions', array(patched), 'cisa_kev', cisa_kev)))) AS content FROM v_advisories"""
    )
    rows = feeds.threat_intel(documents.select(F.from_json("content", feeds.INTEL_DDL).alias("d")).select("d.cves"))
    return rows.select("cve_id", "severity", F.col("packages")[0].alias("package"), F.col("affected_versions")[0].alias("affected"),
                       F.col("patched_versions")[0].alias("patched"), "cisa_kev")


AUDIT_DOCS = """SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN concat('{"vulnerabilities": {"', name, '": {"severity": "', severity, '", "isDirect": ', CAST(direct AS STRING), ', "range": "<2.0.0", "fixAvailable": ', CAST(fix_available AS STRING),
    ', "via": ["dep-a", {"name": "', name, '", "title": "Bad ', name, '", "cvss": {"score": 7.5}}]}}}')
  ELSE concat('{"advisories": {"', CAST(entry_id AS STRING), '": {"module_name": "', name, '", "severity": "', severity, '", "vulnerable_versions": "<1.0.0", "title": "Old ', name, '", "patched_versions": "', CASE WHEN fix_available THEN '>=1.0.0' ELSE '' END,
    '", "findings": [{"path": "a>b", "dev": ', CASE WHEN entry_id % 3 = 0 THEN 'false' ELSE 'true' END, '}], "cvss": {"score": 5.0}}}}') END AS content FROM v_audits"""


@register("s9_audit_report_read", """SELECT entry_id, name, severity, CASE WHEN entry_id % 2 = 0 THEN '<2.0.0' ELSE '<1.0.0' END AS range_affected, fix_available, CASE WHEN entry_id % 2 = 0 THEN direct ELSE entry_id % 3 = 0 END AS direct,
    CASE WHEN entry_id % 2 = 0 THEN 'dep-a,' || name ELSE '' END AS via, CASE WHEN entry_id % 2 = 0 THEN 'Bad ' ELSE 'Old ' END || name AS title, CASE WHEN entry_id % 2 = 0 THEN 7.5 ELSE 5.0 END::DOUBLE AS cvss_score FROM v_audits""")
def audit_report_read(t: Tables):
    return feeds.parse_audits(t.sql(AUDIT_DOCS)).withColumn("via", F.array_join("via", ","))


@register("s11_repo_contents_read", "SELECT 'repo-' || p_partkey AS repo, 'repo-' || p_partkey AS name, 'react' AS package, '^19.' || p_size % 3 || '.0' AS spec FROM part")
def repo_contents_read(t: Tables):
    landed = t.sql(
        """SELECT concat('repo-', CAST(p_partkey AS STRING)) AS repo, regexp_replace(base64(encode(concat('{"name": "repo-', CAST(p_partkey AS STRING), '", "dependencies": {"react": "^19.', CAST(p_size % 3 AS STRING), '.0"}}'), 'UTF-8')), '(.{20})', '$1\n') AS content FROM part"""
    )
    parsed = manifests.parse_manifests(manifests.decode_contents(landed))
    return manifests.dependency_rows(parsed, ["repo", "name"]).select("repo", "name", "package", "spec")


@register("p1_sections_in_order", f"""SELECT l_orderkey AS project_id, l_linenumber AS line_no, package, spec FROM (
    SELECT l_orderkey, l_linenumber, 'pkg-' || l_partkey AS package, '~' || l_linenumber || '.1.0' AS spec {GOOD} UNION ALL SELECT l_orderkey, l_linenumber, 'left-pad', '*' {GOOD})""")
def sections_in_order(t: Tables):
    """P1 on parsed manifests."""
    return manifests.merged_sections(manifests.parse_manifests(t.sql(MANIFEST_ROWS)), ["project_id", "line_no"])
