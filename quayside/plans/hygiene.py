"""Registered queries: dependency hygiene, paths and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalogue import lists as words
from quayside.catalogue.advisories import RSC_CVES, RSC_PACKAGES
from quayside.functions.text import with_glob_regex
from quayside.functions.versions import clean_spec, numeric_triple, version_key
from quayside.operators import detection, evidence, hygiene, matching, paths
from quayside.plans.matching import catalogue_matches, ctes, dep_matches
from quayside.plans.registry import Tables, register, sql_key, sql_rows, sql_text


@register("p1_deps_flatten", """SELECT project_id, package, arg_max(spec, o) AS spec, arg_max(section, o) AS section FROM (
  SELECT *, row(list_position(['dependencies', 'devDependencies', 'peerDependencies', 'optionalDependencies'], section), line_no, spec) AS o FROM v_deps) GROUP BY ALL""")
def deps_flatten(t: Tables):
    return hygiene.flatten_sections(t.view("v_deps"))


@register("p2_spec_clean", r"SELECT project_id, line_no, spec, regexp_extract(spec, '^[\^~>=<\s]*([^\s|]*)', 1) AS version FROM v_specs")
def spec_clean(t: Tables):
    return t.view("v_specs").select("project_id", "line_no", "spec", clean_spec(F.col("spec")).alias("version"))


@register("p3_semver_key", f"""SELECT project_id, line_no, version, k IS NOT NULL AS parsed,
    coalesce(TRY_CAST(regexp_extract(version, '^([0-9]+)[.]([0-9]+)[.]([0-9]+)', 1) AS BIGINT), 0) AS major,
    coalesce(TRY_CAST(regexp_extract(version, '^([0-9]+)[.]([0-9]+)[.]([0-9]+)', 2) AS BIGINT), 0) AS minor,
    coalesce(TRY_CAST(regexp_extract(version, '^([0-9]+)[.]([0-9]+)[.]([0-9]+)', 3) AS BIGINT), 0) AS patch,
    coalesce(k < {sql_key("'3.10.0'")}, TRUE) AS below, coalesce(k % 2 = 0, FALSE) AS prerelease FROM stack_k""", ctes("stack_k"))
def semver_key(t: Tables):
    triple = numeric_triple("version")
    return matching.with_version(t.view("v_stack")).select(
        "project_id", "line_no", "version", (F.col("version_key.major") >= 0).alias("parsed"),
        triple["major"].alias("major"), triple["minor"].alias("minor"), triple["patch"].alias("patch"),
        (F.col("version_key") < version_key("'3.10.0'")).alias("below"),
        ((F.col("version_key.release") == 0) & (F.col("version_key.major") >= 0)).alias("prerelease"),
    )


@register("p11_spec_risk", """SELECT project_id, line_no, package, spec, CASE WHEN spec IN ('*', 'latest', '') THEN 'wildcard' ELSE 'git' END AS risk
  FROM v_specs WHERE spec IN ('*', 'latest', '') OR contains(spec, 'git')""")
def spec_risk(t: Tables):
    return hygiene.spec_risk(t.view("v_specs")).select("project_id", "line_no", "package", "spec", "risk")


CONFUSED = "resolved_url <> '' AND NOT contains(resolved_url, 'registry.npmjs.org') AND NOT contains(resolved_url, 'registry.yarnpkg.com') AND package LIKE '@%'"


@register("p12_dependency_confusion", f"SELECT project_id, package, version, resolved_url FROM v_lock WHERE {CONFUSED}")
def dependency_confusion(t: Tables):
    return hygiene.dependency_confusion(t.view("v_lock")).select("project_id", "package", "version", "resolved_url")


@register("p13_missing_integrity", "SELECT project_id, package, version FROM v_lock WHERE coalesce(integrity, '') = ''")
def missing_integrity(t: Tables):
    return hygiene.missing_integrity(t.view("v_lock")).select("project_id", "package", "version")


@register("p14_git_resolved", "SELECT project_id, package, resolved_url FROM v_lock WHERE regexp_matches(resolved_url, 'github[.]com|gitlab[.]com|bitbucket[.]org|[.]git')")
def git_resolved(t: Tables):
    return hygiene.git_resolved(t.view("v_lock")).select("project_id", "package", "resolved_url")


@register("j9_compromised_match", """SELECT project_id, line_no, package, version, cve_id, campaign FROM stack_k JOIN bad USING (package)
  WHERE list_contains(versions, version) OR (len(versions) = 0 AND campaign IS NOT NULL)""",
  ctes("stack_k") | {"bad": sql_rows(["package", "versions", "cve_id", "campaign"], [[r["package"], r["bad_versions"], r["cve_id"], r["campaign"]] for r in words.COMPROMISED])})
def compromised_match(t: Tables):
    found = hygiene.compromised(matching.with_version(t.view("v_stack")))
    return found.select("project_id", "line_no", "package", "version", "cve_id", "campaign")


@register("j10_suspicious_scope", """SELECT project_id, line_no, package FROM v_stack WHERE split_part(package, '/', 1) IN ('@postman', '@posthog', '@asyncapi', '@ensdomains', '@zapier')
  AND package NOT IN ('@postman/newman', '@postman/tunnel-agent', '@asyncapi/parser', '@asyncapi/generator')""")
def suspicious_scope(t: Tables):
    return hygiene.suspicious_scope(t.view("v_stack")).select("project_id", "line_no", "package")


@register("j11_typosquat_dictionary", "SELECT name_id, package, intended FROM v_names JOIN typos ON lower(package) = typo",
          {"typos": sql_rows(["typo", "intended"], [list(kv) for kv in words.TYPOS.items()])})
def typosquat_dictionary(t: Tables):
    return hygiene.typosquat_dictionary(t.view("v_names")).select("name_id", "package", "intended")


@register("j12_typosquat_similarity", """SELECT name_id, package, popular, round(1 - levenshtein(popular, bare) / greatest(length(popular), length(bare)), 6) AS similarity
  FROM (SELECT *, lower(split_part(package, '/', -1)) AS bare FROM v_names), popular
  WHERE 1 - levenshtein(popular, bare) / greatest(length(popular), length(bare)) > 0.75 AND popular <> bare""",
  {"popular": sql_rows(["popular"], [[p] for p in words.POPULAR])})
def typosquat_similarity(t: Tables):
    return hygiene.typosquat_similarity(t.view("v_names")).select("name_id", "package", "popular", F.round("similarity", 6).alias("similarity"))


@register("j12_typosquat_exact_ratio")
def typosquat_exact_ratio(t: Tables):
    return hygiene.typosquat_exact_ratio(t.view("v_names"))


@register("j13_problematic_dependency", "SELECT project_id, line_no, package, kind, impact::INT AS impact FROM v_specs JOIN bad USING (package)",
          {"bad": sql_rows(["package", "kind", "impact"], [[k, v[0], v[1]] for k, v in words.PROBLEMATIC.items()])})
def problematic_dependency(t: Tables):
    return hygiene.problematic(t.view("v_specs")).select("project_id", "line_no", "package", "kind", "impact")


DUPLICATES = "SELECT project_id, package, count(DISTINCT version) AS n_versions, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions FROM v_lock GROUP BY ALL"


@register("a3_duplicate_versions", f"SELECT * FROM ({DUPLICATES}) WHERE n_versions > 1")
def duplicate_versions(t: Tables):
    return hygiene.duplicate_versions(t.view("v_lock")).withColumn("versions", F.array_join("versions", ","))


ISSUES = {
    "issues": f"""SELECT project_id, 'dependency_confusion' AS issue_type, 'MEDIUM' AS severity FROM v_lock WHERE {CONFUSED}
      UNION ALL SELECT project_id, 'missing_integrity', 'LOW' FROM v_lock WHERE integrity IS NULL
      UNION ALL SELECT project_id, 'git_dependency', 'INFO' FROM v_lock WHERE contains(resolved_url, 'github.com')
      UNION ALL SELECT project_id, 'duplicate_package', 'INFO' FROM ({DUPLICATES}) WHERE n_versions > 2
      UNION ALL SELECT project_id, 'vulnerable_version', severity FROM lock_k d JOIN adv_k a ON d.package = a.package AND k >= lo AND k < hi"""
}


def lock_issue_rows(t: Tables):
    from quayside.plans.matching import advisory_ranges

    lock = t.view("v_lock")
    keyed = matching.with_version(lock, "version")
    return hygiene.lock_issues(lock, matching.match_versions(keyed, advisory_ranges(t)))


@register("u2_lock_issue_union", "SELECT project_id, issue_type, severity, count(*) AS n FROM issues GROUP BY ALL", ctes("lock_k", "adv_k") | ISSUES)
def lock_issue_union(t: Tables):
    return lock_issue_rows(t).groupBy("project_id", "issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@register("a17_lockfile_report", """WITH p AS (SELECT project_id, count(DISTINCT row(package, version)) AS total_packages FROM v_lock GROUP BY project_id)
  SELECT p.project_id, total_packages, count(issue_type) AS total_issues, """ + ", ".join(
    [f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in hygiene.LOCK_SEVERITIES]
    + [f"count(*) FILTER (issue_type = '{k}') AS {k}" for k in ("typosquatting", "dependency_confusion", "vulnerable_version", "missing_integrity", "git_dependency", "duplicate_package")]
) + " FROM p LEFT JOIN issues USING (project_id) GROUP BY ALL", ctes("lock_k", "adv_k") | ISSUES)
def lockfile_report(t: Tables):
    return hygiene.lockfile_report(t.view("v_lock"), lock_issue_rows(t))


# ---- paths ----

CONTEXT = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(path), {sql_text('|'.join(p))}) THEN '{name}'" for name, p in words.PATH_CONTEXTS.items()
) + f" ELSE '{words.PRODUCTION}' END"


@register("p6_path_context", f"SELECT file_id, path, {CONTEXT} AS context FROM v_files")
def path_context(t: Tables):
    return t.view("v_files").select("file_id", "path", paths.path_context().alias("context"))


GLOB = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(pattern, '^!', ''), '/$', ''), '^/', ''),
  '([.^$+{}\[\]|()\\])', '\\\1', 'g'), '\*\*/', chr(1), 'g'), '\*\*', chr(2), 'g'), '\*', '[^/]*', 'g'), '\?', '[^/]', 'g'), chr(1), '(?:.*/)?', 'g'), chr(2), '.*', 'g')"""
REGEX = f"""(CASE WHEN contains(regexp_replace(regexp_replace(pattern, '^!', ''), '/$', ''), '/') THEN '^' ELSE '(?:^|/)' END) || {GLOB}
  || (CASE WHEN pattern LIKE '%/' THEN '/' ELSE '(?:/|$)' END)"""
DEFAULTS = {"defaults": f"SELECT *, {REGEX} AS regex FROM ({sql_rows(['ordinal', 'pattern'], [[i, p] for i, p in enumerate(words.DEFAULT_IGNORES)])})"}
TEAM = ["*.ts", "!f1*.ts", "/srv/research/", "f?.json"]


@register("p7_ignore_filter", f"""WITH d AS (SELECT file_id, arg_min(pattern, ordinal) AS pattern FROM v_files JOIN defaults ON regexp_matches(path, regex) GROUP BY file_id),
  g AS (SELECT file_id, arg_max(pattern, ordinal) AS last FROM v_files JOIN team ON regexp_matches(path, regex) GROUP BY file_id)
  SELECT file_id, path, CASE WHEN d.pattern IS NOT NULL THEN 'default pattern: ' || d.pattern WHEN last NOT LIKE '!%' THEN 'ignore file: team' ELSE '' END AS reason
  FROM v_files LEFT JOIN d USING (file_id) LEFT JOIN g USING (file_id)""",
  DEFAULTS | {"team": f"SELECT *, {REGEX} AS regex FROM ({sql_rows(['ordinal', 'pattern'], [[i, p] for i, p in enumerate(TEAM)])})"})
def ignore_filter(t: Tables):
    return paths.ignore_filter(t.view("v_files"), {"team": TEAM}).select("file_id", "path", "reason")


@register("w5_last_match_wins", """SELECT f.file_id, f.path, coalesce(arg_max(pattern, ordinal) NOT LIKE '!%', FALSE) AS ignored FROM v_files f
  LEFT JOIN compiled c ON c.project_id = f.project_id AND regexp_matches(f.path, regex) GROUP BY ALL""", {"compiled": f"SELECT *, {REGEX} AS regex FROM v_ignore"})
def last_match_wins(t: Tables):
    return paths.last_match_wins(t.view("v_files"), t.view("v_ignore")).select("file_id", "path", "ignored")


PATTERNS = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('*.', source) WHEN 1 THEN concat('/', source, '/**/f?.js') WHEN 2 THEN concat(source, '/')
  WHEN 3 THEN concat('!', lang, '*.log') WHEN 4 THEN concat('**/', source, '/**') ELSE concat('a(b).', source) END AS pattern,
  CASE doc_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'global' ELSE 'project' END AS layer FROM documents"""


@register("f11_glob_to_regex", f"SELECT doc_id, pattern, {REGEX} AS regex, pattern LIKE '!%' AS negated, pattern LIKE '%/' AS dir_only FROM ({PATTERNS})")
def glob_to_regex(t: Tables):
    return with_glob_regex(t.sql(PATTERNS), "pattern").select("doc_id", "pattern", "regex", "negated", "dir_only")


@register("x3_ignore_patterns", f"""SELECT layer, count(*) AS patterns, count(*) FILTER (pattern LIKE '!%') AS negations, count(*) FILTER (pattern LIKE '%/') AS dir_only,
  count(*) FILTER (contains(regexp_replace(regexp_replace(pattern, '^!', ''), '/$', ''), '/')) AS rooted FROM ({PATTERNS}) GROUP BY layer""")
def ignore_patterns(t: Tables):
    return paths.layer_stats(t.sql(PATTERNS))


@register("p8_watch_filter", """SELECT file_id, path FROM v_files WHERE (regexp_matches(path, '[.](js|ts|jsx|tsx|json|mjs|cjs)$'))
  AND NOT regexp_matches(path, '[.]min[.]js$') AND NOT regexp_matches(path, '^(node_modules|[.]git|dist|build|coverage)/')""")
def watch_filter(t: Tables):
    return t.view("v_files").where(paths.watched()).select("file_id", "path")


FOUND = """SELECT file_id, path AS file_path, CASE WHEN file_id % 4 = 0 THEN NULL ELSE '9.9.9' END AS patched_version FROM v_files"""
SKIP = f"""CASE WHEN regexp_matches(lower(file_path), '{"|".join(words.NON_PRODUCTION_WORDS)}') THEN '{words.SKIP_NON_PRODUCTION}'
  WHEN patched_version IS NULL THEN '{words.SKIP_NO_PATCH}' ELSE 'actionable' END"""


@register("p10_actionable_filter", f"SELECT {SKIP} AS reason, count(*) AS n FROM ({FOUND}) GROUP BY 1")
def actionable_filter(t: Tables):
    return paths.skip_counts(t.sql(FOUND))


@register("u4_project_dedup", "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS project_dir FROM v_files")
def project_dedup(t: Tables):
    return paths.project_dirs(t.view("v_files"))


# ---- evidence ----

@register("j14_indicator_file_match", """SELECT file_id, project_id, folder || name AS path, kind FROM (
    SELECT *, 'indicator_file' AS kind FROM v_project_files WHERE (folder = '' OR regexp_matches(folder, '^node_modules/([^/]+/)?$')) AND name IN ('setup_bun.js', '.truffler-cache')
    UNION ALL SELECT *, 'malicious_file' FROM v_project_files WHERE folder = '' AND name = 'setup_bun.js'
    UNION ALL SELECT *, 'malicious_directory' FROM v_project_files WHERE folder = '' AND name = '.truffler-cache'
    UNION ALL SELECT *, 'campaign_pattern' FROM v_project_files WHERE name IN ('setup_bun.js', '.truffler-cache'))""")
def indicator_file_match(t: Tables):
    return evidence.indicator_files(t.view("v_project_files")).select("file_id", "project_id", F.concat("folder", "name").alias("path"), "kind")


def usage_files(t: Tables):
    """Project files keyed like the dependencies of v_stack."""
    return t.view("v_project_files").drop("project_id").withColumnRenamed("file_id", "project_id")


IN_CVES = ", ".join(f"'{c}'" for c in RSC_CVES)
STACK_FINDINGS = """SELECT DISTINCT project_id, line_no, declared, d.package, spec, section, version, k, cve_id FROM stack_k d JOIN cat_k a ON d.package = a.package AND k >= lo AND k < hi"""


@register("j15_usage_evidence", f"""WITH ev AS (SELECT project_id FROM stack_k WHERE package IN ({', '.join(f"'{p}'" for p in RSC_PACKAGES)})
    UNION SELECT project_id FROM stack_k WHERE package = 'next' AND k // 2000000000000 >= 13 AND project_id IN (SELECT file_id FROM v_project_files WHERE folder IN ('app/', 'src/app/'))
    UNION SELECT file_id FROM v_project_files WHERE (contains(content, '"use server"') OR contains(content, '''use server''')) AND NOT contains(folder, 'node_modules'))
  SELECT project_id, line_no, declared, package, spec, section, cve_id FROM ({STACK_FINDINGS}) f WHERE NOT (cve_id IN ({IN_CVES}) AND package IN ('react', 'react-dom')) OR project_id IN (SELECT project_id FROM ev)""",
  ctes("stack_k", "cat_raw", "cat_k"))
def usage_evidence(t: Tables):
    deps = matching.with_version(t.view("v_stack"))
    shown = evidence.keep_with_evidence(catalogue_matches(t), evidence.rsc_evidence(deps, usage_files(t)))
    return shown.select("project_id", "line_no", "declared", "package", "spec", "section", "cve_id")


@register("j16_usage_annotation", f"""WITH fl AS (SELECT file_id AS project_id, bool_or(folder || name IN ('middleware.ts', 'src/middleware.ts')) AS mw,
      bool_or(folder IN ('app/', 'src/app/') AND name = 'layout.tsx') AS ar FROM v_project_files GROUP BY file_id),
    fw AS (SELECT project_id, 'next' AS frameworks FROM v_stack WHERE package = 'next' GROUP BY project_id)
  SELECT project_id, line_no, declared, package, spec, cve_id, coalesce(mw, FALSE) AS uses_middleware, coalesce(ar, FALSE) AS uses_app_router, coalesce(frameworks, '') AS frameworks
  FROM ({STACK_FINDINGS}) f LEFT JOIN fl USING (project_id) LEFT JOIN fw USING (project_id) WHERE package = 'next'""", ctes("stack_k", "cat_raw", "cat_k"))
def usage_annotation(t: Tables):
    findings = catalogue_matches(t).where("package = 'next'")
    noted = evidence.annotate_usage(findings, evidence.usage_flags(usage_files(t), t.view("v_stack")))
    return noted.select("project_id", "line_no", "declared", "package", "spec", "cve_id", "uses_middleware", "uses_app_router",
                        F.array_join("frameworks", ",").alias("frameworks"))


@register("j17_manifest_lock_merge", """WITH man AS (SELECT project_id, cve_id, d.package FROM deps_k d JOIN adv_k a ON d.package = a.package AND k >= lo AND k < hi),
    lck AS (SELECT project_id, cve_id, d.package FROM lock_k d JOIN adv_k a ON d.package = a.package AND k >= lo AND k < hi)
  SELECT project_id, cve_id, package, 'manifest' AS detection_method FROM man
  UNION ALL SELECT project_id, cve_id, package, 'lockfile' FROM lck WHERE NOT EXISTS (SELECT 1 FROM man WHERE man.project_id = lck.project_id AND man.cve_id = lck.cve_id AND man.package = lck.package)""",
  ctes("deps_k", "adv_k", "lock_k"))
def manifest_lock_merge(t: Tables):
    from quayside.plans.matching import advisory_ranges

    lock = matching.match_versions(matching.with_version(t.view("v_lock"), "version"), advisory_ranges(t))
    keep = ["project_id", "cve_id", "package"]
    return evidence.merge_lock_findings(dep_matches(t).select(*keep), lock.select(*keep))


@register("p15_insecure_mode", """SELECT file_id, path, CASE mode WHEN 416 THEN '640' ELSE '646' END AS octal,
  CASE mode WHEN 416 THEN 'group-readable (g+r)' ELSE 'world-readable (o+r), group-readable (g+r), world-writable (o+w)' END AS issues FROM v_files WHERE mode <> 384""")
def insecure_mode(t: Tables):
    return evidence.insecure_mode(t.view("v_files")).select("file_id", "path", "octal", F.array_join("issues", ", ").alias("issues"))


CONFIGS = """SELECT doc_id AS file_id, CASE WHEN doc_id % 9 = 8 THEN '{bad' ELSE concat('{"mcpServers": {"srv-', CAST(doc_id AS STRING), '": {"command": "',
  CASE doc_id % 3 WHEN 0 THEN 'npx' ELSE '/opt/Clawdbot/run' END, '", "args": ["', CASE doc_id % 5 WHEN 0 THEN 'moltbot' ELSE 'serve' END,
  '"]}}, "projects": {"/home/', source, CASE doc_id % 4 WHEN 0 THEN '/clawdbot' ELSE '/app' END, '": "x"}}') END AS content FROM documents"""


@register("p17_config_reference", """SELECT doc_id AS file_id, 'tool_server' AS kind, 'srv-' || doc_id AS name FROM documents WHERE doc_id % 9 <> 8 AND (doc_id % 3 <> 0 OR doc_id % 5 = 0)
  UNION ALL SELECT doc_id, 'project', '/home/' || source || '/clawdbot' FROM documents WHERE doc_id % 9 <> 8 AND doc_id % 4 = 0""")
def config_reference(t: Tables):
    return evidence.config_references(t.sql(CONFIGS))


@register("p19_http_fingerprint", """SELECT page_id, url, technology, version FROM (
    SELECT page_id, url, 'next' AS technology, nullif(regexp_extract(powered_by, 'Next[.]js\\s*([0-9.]+)?', 1), '') AS version FROM v_responses
      WHERE contains(powered_by, 'Next.js') OR contains(body, '/_next/') OR contains(body, '__NEXT_DATA__')
    UNION ALL SELECT page_id, url, 'n8n', CASE WHEN engine_version <> '' THEN engine_version ELSE nullif(regexp_extract(body, '"version":\\s*"([0-9]+[.][0-9]+[.][0-9]+)"', 1), '') END FROM v_responses
      WHERE engine_version <> '' OR contains(lower(body), 'n8n')
    UNION ALL SELECT page_id, url, 'express', NULL FROM v_responses WHERE powered_by = 'Express')""")
def http_fingerprint(t: Tables):
    return evidence.http_fingerprint(t.view("v_responses"))


@register("p20_differential_response", """SELECT b.page_id, b.url, b.status AS baseline, i.status AS injected FROM v_responses b JOIN v_responses i ON b.page_id = i.page_id AND b.url = i.url
  WHERE b.variant = 'baseline' AND i.variant = 'injected' AND b.status IN (401, 403, 302, 307) AND (i.status = 200 OR (b.status IN (302, 307) AND i.status NOT IN (302, 307)))""")
def differential_response(t: Tables):
    return evidence.differential_response(t.view("v_responses"))


@register("p20_open_endpoints", "SELECT page_id, url, status FROM v_responses WHERE variant = 'baseline' AND status IN (200, 404, 405)")
def open_endpoints(t: Tables):
    return evidence.open_endpoints(t.view("v_responses")).select("page_id", "url", "status")


@register("s3_source_files", """SELECT file_id, path FROM v_files WHERE regexp_matches(path, '[.](js|mjs|cjs|ts|tsx|jsx|json)$')
  AND NOT regexp_matches(path, '/(node_modules|[.]git|[.]svn|dist|build|[.]next|__pycache__)/')""")
def source_files(t: Tables):
    return detection.source_files(t.view("v_files")).select("file_id", "path")
