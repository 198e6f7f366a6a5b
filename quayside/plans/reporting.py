"""Registered queries: scores, fix plans, reports, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalogue import lists
from quayside.catalogue import rules as book
from quayside.catalogue.advisories import CVE_EXPLANATIONS, LEGACY_REACT, NEXT_PATCH_DEFAULT, NEXT_PATCH_PREFIXES
from quayside.functions.text import FEED_SEVERITY, SARIF_LEVEL, SARIF_SCORE, lookup
from quayside.functions.versions import bump_spec, runtime_requirement
from quayside.operators import detection, diffs, fixes, hygiene, matching, paths, reports, scoring
from quayside.operators.evidence import indicator_files
from quayside.plans.detection import LINES, sql_matches, sql_script_hits
from quayside.plans.hygiene import CONTEXT, SKIP, usage_files
from quayside.plans.matching import ctes, dep_matches
from quayside.plans.registry import Tables, register, sql_rows, sql_text
from quayside.session import cut_lineage


def case_of(column: str, table: dict[str, object], default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in table.items()) + f" ELSE {default} END"


# ---- scores ----

CONFIG_SQL = """SELECT p.project_id, CAST((CASE WHEN coalesce(ign, FALSE) THEN 0 ELSE 5 END) + (CASE WHEN coalesce(lck, FALSE) THEN 0 ELSE 10 END)
    + (CASE WHEN NOT coalesce(gi, FALSE) THEN 3 WHEN NOT env THEN 5 ELSE 0 END) + (CASE WHEN coalesce(man, FALSE) AND NOT coalesce(aud, FALSE) THEN 3 ELSE 0 END) AS BIGINT) AS impact
  FROM {projects} p LEFT JOIN (SELECT {key} AS project_id, bool_or(name = '.npmrc' AND contains(content, 'ignore-scripts=true')) AS ign,
      bool_or(name IN ('package-lock.json', 'yarn.lock')) AS lck, bool_or(name = '.gitignore') AS gi,
      bool_or(name = '.gitignore' AND contains(lower(content), '.env')) AS env, bool_or(name = 'package.json') AS man FROM v_project_files WHERE folder = '' GROUP BY ALL) f USING (project_id)
  LEFT JOIN (SELECT {skey} AS project_id, bool_or(contains(command, 'audit')) AS aud FROM v_scripts GROUP BY ALL) s USING (project_id)"""


@register("a8_config_score", "SELECT project_id, CAST(greatest(0, 100 - impact) AS INT) AS configuration FROM (" + CONFIG_SQL.format(
    projects="(SELECT DISTINCT project_id FROM v_project_files)", key="project_id", skey="concat('p', CAST(project_id % 97 AS VARCHAR))") + ")")
def config_score(t: Tables):
    files = t.view("v_project_files")
    scripts = t.view("v_scripts").withColumn("project_id", F.concat(F.lit("p"), (F.col("project_id") % 97).cast("string")))
    impact = scoring.config_impact(files.select("project_id").distinct(), scoring.config_flags(files, scripts))
    return impact.select("project_id", F.greatest(F.lit(0), 100 - F.col("impact")).cast("int").alias("configuration"))


SCORE_CTES = ctes("deps_k", "adv_k") | {
    "all_lines": LINES,
    "matches": sql_matches(book.RULES, "all_lines", "file_id, line_no"),
    "secret_hits": sql_matches(detection.secret_rules(), "all_lines", "file_id, line_no"),
    "impacts": f"""SELECT project_id, 'vulnerabilities' AS category, {case_of('severity', scoring.IMPACT['vulnerabilities'], '0')} AS impact
        FROM deps_k d JOIN adv_k a ON d.package = a.package AND k >= lo AND k < hi
      UNION ALL SELECT file_id, 'malware', {case_of('threat_level', scoring.IMPACT['malware'], '0')} FROM matches
      UNION ALL SELECT file_id, 'secrets', {case_of('threat_level', scoring.IMPACT['secrets'], '0')} FROM secret_hits
      UNION ALL SELECT project_id, 'dependencies', {case_of('package', {'request': 10, 'node-uuid': 5, 'mkdirp': 3, 'event-stream': 15, 'flatmap-stream': 20, 'eslint-scope': 10}, '0')}
        + (CASE WHEN spec IN ('*', 'latest', '') THEN 8 ELSE 0 END) + (CASE WHEN contains(spec, 'git') THEN 5 ELSE 0 END) FROM v_specs
      UNION ALL SELECT project_id, 'configuration', impact FROM ({CONFIG_SQL.format(projects='(SELECT DISTINCT o_orderkey AS project_id FROM orders)', key='file_id', skey='project_id')})""",
    "scores": "SELECT p.project_id, " + ", ".join(
        f"CAST(greatest(0, 100 - coalesce(sum(impact) FILTER (category = '{c}'), 0)) AS INT) AS {c}" for c in scoring.WEIGHTS
    ) + " FROM (SELECT o_orderkey AS project_id FROM orders UNION SELECT project_id FROM impacts) p LEFT JOIN impacts USING (project_id) GROUP BY p.project_id",
}


def project_scores(t: Tables):
    projects = t.base("orders").select(F.col("o_orderkey").alias("project_id"))
    sources = t.view("v_files").select("file_id", "content")
    fields = [r for r in detection.secret_rules() if r["rule_id"].startswith("TOKEN-")]
    matches = detection.rule_matches(sources, book.RULES + fields).withColumnRenamed("file_id", "project_id")
    flags = scoring.config_flags(usage_files(t), t.view("v_scripts"))
    # the join with the advisories sorts whole dependencies: its partitions grow in number with them
    vulnerable = cut_lineage(scoring.severity_impact(dep_matches(t), "vulnerabilities"), "impacts", t.view("v_deps").count())
    return scoring.category_scores(
        projects,
        vulnerable,
        scoring.match_impact(matches, [r["rule_id"] for r in fields]),
        scoring.dependency_impact(t.view("v_specs")),
        scoring.config_impact(projects, flags),
    )


@register("a6_category_score", "SELECT * FROM scores", SCORE_CTES)
def category_score(t: Tables):
    return project_scores(t)


@register("a7_weighted_grade", """WITH s AS (SELECT *, CAST(trunc(CAST(vulnerabilities AS DOUBLE) * CAST(0.30 AS DOUBLE) + CAST(malware AS DOUBLE) * CAST(0.25 AS DOUBLE)
      + CAST(secrets AS DOUBLE) * CAST(0.20 AS DOUBLE) + CAST(dependencies AS DOUBLE) * CAST(0.15 AS DOUBLE) + CAST(configuration AS DOUBLE) * CAST(0.10 AS DOUBLE)) AS INT) AS score FROM scores)
  SELECT project_id, score, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
    concat_ws('|', """ + ", ".join(f"CASE WHEN {c} < 80 THEN {sql_text(a)} END" for c, a in scoring.ADVICE.items())
    + f", CASE WHEN score < 70 THEN {sql_text(scoring.AUDIT_ADVICE)} END) AS recommendations FROM s", SCORE_CTES)
def weighted_grade(t: Tables):
    graded = scoring.weighted_grade(project_scores(t))
    return graded.select("project_id", "score", "grade", F.array_join("recommendations", "|").alias("recommendations"))


# ---- fixes ----

DIR = "regexp_replace(split_part(regexp_replace(file_path, '/[^/]*$', ''), 'node_modules', 1), '/+$', '')"


@register("a9_fix_plan", f"""SELECT {DIR} AS project_dir, package, arg_min(version, ordinal) AS version, arg_min(patched_version, ordinal) AS patched_version,
    array_to_string(list_sort(list(DISTINCT cve_id)), ',') AS cve_ids, CASE WHEN package = 'node' THEN 'runtime_upgrade' ELSE 'package_fix' END AS kind
  FROM v_findings WHERE {SKIP} = 'actionable' GROUP BY 1, 2""")
def fix_plan(t: Tables):
    return fixes.fix_plan(t.view("v_findings")).withColumn("cve_ids", F.array_join("cve_ids", ","))


PARENT = "regexp_replace(file_path, '/[^/]*$', '')"


@register("a10_quick_fix_buckets", f"""WITH c AS (SELECT *, {CONTEXT.replace('lower(path)', 'lower(file_path)')} AS context FROM v_findings)
  SELECT DISTINCT CASE WHEN context IN ('exploit_data', 'research', 'archive', 'test_fixtures') THEN 'skip' WHEN context = 'node_modules' THEN 'npm_audit' WHEN context = 'vendor' THEN 'manual'
      WHEN package = 'node' THEN 'node_upgrade' WHEN patched_version IS NOT NULL THEN 'npm_update' ELSE 'npm_audit' END AS bucket,
    CASE WHEN context IN ('exploit_data', 'research', 'archive', 'test_fixtures') THEN cve_id || ': ' || context
      WHEN context = 'node_modules' THEN 'cd ' || split_part(file_path, '/node_modules', 1) || ' && npm audit fix'
      WHEN context = 'vendor' THEN file_path || ': ' || package WHEN package = 'node' THEN 'nvm install ' || patched_version
      WHEN patched_version IS NOT NULL THEN 'cd ' || {PARENT} || ' && npm install ' || package || '@' || patched_version
      ELSE 'cd ' || {PARENT} || ' && npm audit fix' END AS command FROM c""")
def quick_fix_buckets(t: Tables):
    return fixes.quick_fix_rows(t.view("v_findings"))


@register("f6_fix_command", f"""SELECT project_id, line_no, 'cd "' || {DIR} || '" && ' || CASE WHEN project_id % 3 = 0 THEN 'yarn upgrade ' ELSE 'npm install ' END || package || '@' || patched_version AS command
  FROM v_findings WHERE patched_version IS NOT NULL""")
def fix_command(t: Tables):
    command = fixes.fix_command(fixes.project_dir(), F.col("package"), F.col("patched_version"), F.col("project_id") % 3 == 0)
    return t.view("v_findings").where("patched_version IS NOT NULL").select("project_id", "line_no", command.alias("command"))


@register("f5_bump_spec", r"SELECT project_id, line_no, spec, regexp_extract(spec, '^[\^~>=<]*', 0) || patched_version AS new_spec FROM v_findings")
def bumped(t: Tables):
    return t.view("v_findings").select("project_id", "line_no", "spec", bump_spec(F.col("spec"), F.col("patched_version")).alias("new_spec"))


STATUS = r"""SELECT *, regexp_extract(spec, '^[\^~>=<]*', 0) || patched_version AS bumped, CASE WHEN patched_version IS NULL THEN 'manual_required' WHEN section = 'peerDependencies' THEN 'skipped'
  WHEN regexp_extract(spec, '^[\^~>=<]*', 0) || patched_version = spec THEN 'already_fixed' ELSE 'success' END AS status FROM v_findings"""


@register("f14_fix_status", f"SELECT project_id, line_no, package, spec, status, CASE WHEN status = 'success' THEN bumped END AS new_spec FROM ({STATUS})")
def fix_status(t: Tables):
    return fixes.fix_status(t.view("v_findings")).select("project_id", "line_no", "package", "spec", "status", "new_spec")


@register("a16_fix_outcome", f"SELECT status, count(*) AS n FROM ({STATUS}) GROUP BY ROLLUP (status)")
def fix_outcome(t: Tables):
    return fixes.fix_outcome(fixes.fix_status(t.view("v_findings")))


@register("f12_next_minor_patch", "SELECT project_id, line_no, version, CASE " + " ".join(
    f"WHEN starts_with(version, '{p}') THEN '{v}'" for p, v in NEXT_PATCH_PREFIXES.items()) + f" ELSE '{NEXT_PATCH_DEFAULT}' END AS patched FROM stack_k WHERE package = 'next'", ctes("stack_k"))
def next_minor_patch(t: Tables):
    deps = matching.with_version(t.view("v_stack")).where("package = 'next'")
    return deps.select("project_id", "line_no", "version", fixes.next_minor_patch(F.col("version")).alias("patched"))


ENGINES = """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN concat('>=', CAST(p_size AS STRING)) WHEN 1 THEN concat(CAST(p_size AS STRING), '.x') WHEN 2 THEN concat(CAST(p_size AS STRING), ' || 20')
  WHEN 3 THEN concat('^', CAST(p_size AS STRING), '.4.1') ELSE 'lts/*' END AS engines FROM part"""


@register("f10_runtime_requirement", f"""SELECT p_partkey, engines, CASE WHEN regexp_matches(engines, '[0-9]') THEN m[1] || '.' || coalesce(nullif(m[2], ''), '0') || '.' || coalesce(nullif(m[3], ''), '0') END AS version
  FROM (SELECT *, [regexp_extract(engines, '([0-9]+)[.]?([0-9]+)?[.]?([0-9]+)?', i) FOR i IN [1, 2, 3]] AS m FROM ({ENGINES}))""".replace(
    "[regexp_extract(engines, '([0-9]+)[.]?([0-9]+)?[.]?([0-9]+)?', i) FOR i IN [1, 2, 3]]",
    "[" + ", ".join(f"regexp_extract(engines, '([0-9]+)[.]?([0-9]+)?[.]?([0-9]+)?', {i})" for i in (1, 2, 3)) + "]"))
def engine_requirement(t: Tables):
    return t.sql(ENGINES).select("p_partkey", "engines", runtime_requirement("engines").alias("version"))


@register("f7_severity_map", f"""SELECT ghsa_id, severity, {case_of('severity', FEED_SEVERITY, "'medium'")} AS mapped, {case_of('severity', SARIF_LEVEL, "'warning'")} AS level, {case_of('severity', SARIF_SCORE, "'5.0'")} AS score FROM v_feed""")
def severity_map(t: Tables):
    s = F.col("severity")
    return t.view("v_feed").select("ghsa_id", "severity", lookup(s, FEED_SEVERITY, "medium").alias("mapped"),
                                   lookup(s, SARIF_LEVEL, "warning").alias("level"), lookup(s, SARIF_SCORE, "5.0").alias("score"))


# ---- reports ----

COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in matching.SEVERITIES)
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


FILE_CONTEXT = "(" + CONTEXT.replace("lower(path)", "lower(file_path)") + ")"
NO_ACTION = ", ".join(sql_text(c) for c in lists.NOT_ACTIONABLE_CONTEXTS)


@register("a1_scan_summary", f"""SELECT scanner, count(*) AS total, {COUNTS}, count(patched_version) AS fixable,
    count(*) FILTER ({FILE_CONTEXT} NOT IN ({NO_ACTION})) AS actionable, count(*) FILTER ({FILE_CONTEXT} IN ({NO_ACTION})) AS non_production FROM v_findings GROUP BY ROLLUP (scanner)""")
def scan_summary(t: Tables):
    return reports.scan_summary(t.view("v_findings"))


@register("w1_severity_sort", f"SELECT project_id, package, cve_id, severity, CAST({RANK} AS INT) AS severity_rank FROM v_findings ORDER BY 5, 1, 2, 3")
def severity_sort(t: Tables):
    return reports.severity_sorted(t.view("v_findings").select("project_id", "package", "cve_id", "severity"))


@register("w2_top_n", f"""SELECT project_id, cve_id, package, severity, position FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {RANK}, cve_id, package, line_no, spec)::INT AS position FROM v_findings) WHERE position <= 3""")
def top_n(t: Tables):
    return reports.top_n(t.view("v_findings"), 3).select("project_id", "cve_id", "package", "severity", "position")


@register("w8_finding_dedup", "SELECT project_id, cve_id, package, min(ordinal) AS ordinal, arg_min(version, ordinal) AS version FROM v_findings GROUP BY 1, 2, 3")
def finding_dedup(t: Tables):
    found = t.view("v_findings").select("project_id", "cve_id", "package", "ordinal", "version")
    return reports.first_per(found, ["project_id", "cve_id", "package"], ["ordinal"])


@register("u3_safe_projects", "SELECT DISTINCT o_orderkey AS project_id FROM orders WHERE o_orderkey NOT IN (SELECT project_id FROM deps_k d JOIN adv_k a ON d.package = a.package AND k >= lo AND k < hi)", ctes("deps_k", "adv_k"))
def safe_projects(t: Tables):
    return reports.safe_projects(t.base("orders").select(F.col("o_orderkey").alias("project_id")), dep_matches(t))


PACKAGE_HITS = " UNION ALL ".join(f"SELECT project_id AS package, {sql_text(d)} AS hit_type FROM v_files WHERE regexp_matches(content, {sql_text(p)}, 'i')" for p, d in book.PACKAGE_PATTERNS)
DANGER = f"regexp_matches(lower(hit_type), '{'|'.join(book.DANGEROUS_WORDS)}')"


@register("a11_package_hits", f"SELECT package, hit_type, count(*) AS n, {DANGER} AS dangerous FROM ({PACKAGE_HITS}) GROUP BY ALL")
def package_hits(t: Tables):
    return reports.package_hits(t.view("v_files"))


@register("a11_package_verdict", f"""WITH h AS (SELECT package, hit_type, {DANGER} AS dangerous FROM ({PACKAGE_HITS}) GROUP BY ALL),
    fresh AS (SELECT split_part(path, '/', 3) AS package, count(*) AS n FROM v_snapshots WHERE snapshot_id = 1 AND path NOT IN (SELECT path FROM v_snapshots WHERE snapshot_id = 0) AND NOT contains(path, 'node_modules/') GROUP BY 1),
    rows AS (SELECT DISTINCT source AS package, 0 AS d, 0 AS w FROM documents UNION ALL SELECT package, CAST(dangerous AS INT), CAST(NOT dangerous AS INT) FROM h UNION ALL SELECT package, n, 0 FROM fresh)
  SELECT package, CAST(sum(d) AS BIGINT) AS dangers, CAST(sum(w) AS BIGINT) AS warnings, sum(d) = 0 AS safe FROM rows GROUP BY package""")
def package_verdict(t: Tables):
    new_files = diffs.unexpected_new_files(snapshot_changes(t)).groupBy(F.split("path", "/")[2].alias("package")).agg(F.count(F.lit(1)).alias("n"))
    packages = t.view("v_files").select(F.col("project_id").alias("package")).distinct()
    return reports.package_verdict(packages, reports.package_hits(t.view("v_files")), new_files)


@register("a11_package_dangers", f"""WITH every AS (SELECT 'pkg-' || project_id AS package FROM ({sql_script_hits()}) UNION ALL SELECT package FROM v_advisories WHERE severity IN ('CRITICAL', 'HIGH')
      UNION ALL SELECT 'pkg-' || name_id FROM v_names JOIN typos ON lower(package) = typo),
    n AS (SELECT package, count(*) AS n FROM every GROUP BY package)
  SELECT 'pkg-' || p_partkey AS package, CAST(coalesce(n, 0) AS BIGINT) AS dangers, CAST(0 AS BIGINT) AS warnings, n IS NULL AS safe FROM part LEFT JOIN n ON n.package = 'pkg-' || p_partkey""",
  {"typos": sql_rows(["typo", "intended"], [list(kv) for kv in lists.TYPOS.items()])})
def package_dangers(t: Tables):
    """The verdict on every part as a package: its scripts, its grave advisories, its name."""
    def named(rows, key: str):
        return rows.withColumn("package", F.concat(F.lit("pkg-"), F.col(key).cast("string")))

    scripts = named(detection.script_findings(t.view("v_scripts")), "project_id")
    typos = named(hygiene.typosquat_dictionary(t.view("v_names")), "name_id")
    packages = named(t.base("part").select("p_partkey"), "p_partkey")
    others = reports.package_dangers(scripts, t.view("v_advisories").where(F.col("severity").isin("CRITICAL", "HIGH")), typos)
    none = packages.limit(0).select("package", F.lit("").alias("hit_type"), F.lit(0).alias("n"), F.lit(False).alias("dangerous"))
    return reports.package_verdict(packages, none, others)


@register("a12_advisory_report", "SELECT package, count(*) AS advisories, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in reports.FEED_SEVERITIES) + " FROM v_feed GROUP BY ROLLUP (package)")
def advisory_report(t: Tables):
    return reports.advisory_report(t.view("v_feed"))


AUDIT_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "moderate", "low"))


@register("a13_audit_summary", f"SELECT project_id, CAST(audit_year AS INT) AS audit_year, count(*) AS total, {AUDIT_COUNTS}, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (fix_available) AS fixable, count(*) FILTER (direct) AS direct FROM v_audits GROUP BY 1, 2")
def audit_summary(t: Tables):
    return reports.audit_summary(t.view("v_audits"))


@register("a14_fix_recommendations", f"""SELECT project_id, CAST(audit_year AS INT) AS audit_year, CASE WHEN NOT fix_available THEN 'manual' WHEN direct THEN 'auto_fix' ELSE 'force_fix' END AS type, count(*) AS n, {AUDIT_COUNTS},
    CASE type WHEN 'auto_fix' THEN 'npm audit fix' WHEN 'force_fix' THEN 'npm audit fix --force' END AS command FROM v_audits GROUP BY 1, 2, 3""")
def fix_recommendations(t: Tables):
    return fixes.fix_recommendations(t.view("v_audits"), ["project_id", "audit_year"])


@register("a14_fix_packages", """SELECT project_id, CAST(audit_year AS INT) AS audit_year, CASE WHEN NOT fix_available THEN 'manual' WHEN direct THEN 'auto_fix' ELSE 'force_fix' END AS type, name, severity,
    CASE WHEN NOT fix_available THEN 'No automatic fix available' END AS reason, CASE WHEN NOT fix_available THEN 'Replace ' || name || ' by another package' WHEN NOT direct THEN 'May install breaking changes' END AS suggestion FROM v_audits""")
def fix_packages(t: Tables):
    return fixes.fix_packages(t.view("v_audits"), ["project_id", "audit_year"])


INDICATORS = """SELECT project_id, 'CRITICAL' AS severity FROM v_project_files WHERE folder = '' AND name IN ('setup_bun.js', '.truffler-cache')
  UNION ALL SELECT concat('p', CAST(project_id % 97 AS VARCHAR)), 'HIGH' FROM v_scripts WHERE contains(command, 'setup_bun.js')"""


@register("a15_infected_projects", f"""WITH p AS (SELECT project_id, count(severity) AS n, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h
    FROM (SELECT project_id FROM v_project_files UNION SELECT project_id FROM ({INDICATORS})) LEFT JOIN ({INDICATORS}) USING (project_id) GROUP BY project_id)
  SELECT count(*) AS scanned, count(*) FILTER (n > 0) AS infected, count(*) FILTER (n = 0) AS clean, CAST(sum(c) AS BIGINT) AS critical, CAST(sum(h) AS BIGINT) AS high FROM p""")
def infected_projects(t: Tables):
    files = t.view("v_project_files")
    kinds = ["malicious_file", "malicious_directory", "malicious_workflow"]
    critical = indicator_files(files).where(F.col("kind").isin(kinds)).select("project_id", F.lit("CRITICAL").alias("severity"))
    scripts = t.view("v_scripts").withColumn("project_id", F.concat(F.lit("p"), (F.col("project_id") % 97).cast("string")))
    high = detection.campaign_tokens(scripts).select("project_id", F.lit("HIGH").alias("severity"))
    return reports.infected_projects(files.select("project_id"), critical.unionByName(high))


@register("a19_repo_exposure", f"""WITH d AS (SELECT project_id, arg_max(version, k) FILTER (package = 'react' AND version IN ({', '.join(f"'{v}'" for v in LEGACY_REACT)})) AS current_version,
      bool_or(package = 'next') AS has_next, bool_or(package = 'react-server-dom-webpack') AS has_rsc FROM stack_k GROUP BY project_id)
  SELECT project_id, current_version, {case_of('current_version', LEGACY_REACT)} AS patched_version, has_next, has_rsc, o_orderstatus = 'P' AS private FROM d JOIN orders ON o_orderkey = project_id WHERE current_version IS NOT NULL""", ctes("stack_k"))
def repo_exposure(t: Tables):
    repos = t.base("orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_orderstatus") == "P").alias("private"))
    exposed = reports.repo_exposure(matching.with_version(t.view("v_stack")), repos)
    return exposed.select("project_id", "current_version", "patched_version", "has_next", "has_rsc", "private")


@register("a19_exposure_totals", f"""WITH d AS (SELECT project_id, arg_max(version, k) FILTER (package = 'react' AND version IN ({', '.join(f"'{v}'" for v in LEGACY_REACT)})) AS v, bool_or(package = 'next') AS has_next FROM stack_k GROUP BY project_id),
    r AS (SELECT o_orderstatus = 'P' AS private, v, v IS NOT NULL AND has_next AS has_next FROM orders LEFT JOIN d ON project_id = o_orderkey)
  SELECT CASE WHEN v IS NULL THEN 'safe' ELSE 'exposed' END AS state, coalesce(v, 'none') AS version, count(*) AS repositories, count(*) FILTER (private) AS private_repositories, count(*) FILTER (has_next) AS with_next FROM r GROUP BY 1, 2
  UNION ALL SELECT CASE WHEN v IS NULL THEN 'safe' ELSE 'exposed' END, NULL, count(*), count(*) FILTER (private), count(*) FILTER (has_next) FROM r GROUP BY 1""", ctes("stack_k"))
def exposure_totals(t: Tables):
    repos = t.base("orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_orderstatus") == "P").alias("private"))
    return reports.exposure_totals(repos, reports.repo_exposure(matching.with_version(t.view("v_stack")), repos.drop("private")))


@register("j25_finding_context", f"""SELECT project_id, line_no, package, {FILE_CONTEXT} AS context, {FILE_CONTEXT} NOT IN ({NO_ACTION}) AS actionable,
    CASE WHEN {FILE_CONTEXT} NOT IN ({NO_ACTION}) THEN severity WHEN {FILE_CONTEXT} = 'exploit_data' THEN 'INFO' ELSE 'LOW' END AS priority,
    CASE WHEN {FILE_CONTEXT} = 'node_modules' THEN 'cd ' || split_part(file_path, '/node_modules', 1) || ' && npm audit fix'
      WHEN {FILE_CONTEXT} = 'production' AND patched_version IS NOT NULL THEN 'cd ' || regexp_extract(file_path, '^(.*)/[^/]*$', 1) || ' && npm install ' || package || '@' || patched_version END AS fix_command FROM v_findings""")
def finding_context(t: Tables):
    return reports.finding_context(t.view("v_findings")).select("project_id", "line_no", "package", "context", "actionable", "priority", "fix_command")


@register("j25_cve_explanations", "SELECT file_id, line_no, rule_id, cve_id, why, gain, how FROM (SELECT file_id, line_no, rule_id, unnest(cves) AS cve_id FROM matches JOIN rule_cves USING (rule_id)) LEFT JOIN told USING (cve_id)", {
    "all_lines": LINES, "matches": sql_matches(book.RULES, "all_lines", "file_id, line_no"),
    "rule_cves": sql_rows(["rule_id", "cves"], [[r["rule_id"], r["cve_ids"]] for r in book.RULES if r["cve_ids"]]),
    "told": sql_rows(["cve_id", "why", "gain", "how"], [[k, *v] for k, v in CVE_EXPLANATIONS.items()]),
})
def cve_explanations(t: Tables):
    """Matches of rules that name advisories, with what is told about each."""
    found = detection.rule_matches(t.view("v_files").select("file_id", "content")).select("file_id", "line_no", "rule_id", F.explode("cve_ids").alias("cve_id"))
    return reports.explain_cves(found).select("file_id", "line_no", "rule_id", "cve_id", "why", "gain", "how")


# ---- snapshots and history ----


def snapshot_changes(t: Tables):
    shots = t.view("v_snapshots")
    return diffs.snapshot_diff(shots.where("snapshot_id = 0"), shots.where("snapshot_id = 1"))


CHANGES = """SELECT coalesce(b.path, a.path) AS path, b.hash AS old_hash, a.hash AS new_hash, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS event
  FROM (SELECT * FROM v_snapshots WHERE snapshot_id = 0) b FULL OUTER JOIN (SELECT * FROM v_snapshots WHERE snapshot_id = 1) a ON a.path = b.path WHERE b.hash IS DISTINCT FROM a.hash"""


@register("j18_snapshot_diff", CHANGES)
def snapshot_diff(t: Tables):
    return snapshot_changes(t)


@register("j18_unexpected_new_files", f"SELECT path FROM ({CHANGES}) WHERE event = 'created' AND NOT contains(path, 'node_modules/')")
def unexpected_new_files(t: Tables):
    return diffs.unexpected_new_files(snapshot_changes(t)).select("path")


@register("j19_audit_diff", """WITH r AS (SELECT DISTINCT project_id, CAST(audit_year AS INT) AS audit_year, name FROM v_audits),
    y AS (SELECT project_id, audit_year, lag(audit_year) OVER (PARTITION BY project_id ORDER BY audit_year) AS prev FROM (SELECT DISTINCT project_id, audit_year FROM r))
  SELECT y.project_id, y.audit_year, r.name, CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.project_id = y.project_id AND o.audit_year = y.prev AND o.name = r.name) THEN 'unchanged' ELSE 'new' END AS status
    FROM y JOIN r ON r.project_id = y.project_id AND r.audit_year = y.audit_year WHERE prev IS NOT NULL
  UNION ALL SELECT y.project_id, y.audit_year, r.name, 'fixed' FROM y JOIN r ON r.project_id = y.project_id AND r.audit_year = y.prev
    WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.project_id = y.project_id AND o.audit_year = y.audit_year AND o.name = r.name)""")
def audit_diff(t: Tables):
    return diffs.consecutive_audits(t.view("v_audits"))


@register("w7_latest_and_history", """SELECT project_id, CAST(audit_year AS INT) AS audit_year, entries, age FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seen DESC, audit_year DESC)::INT AS age
  FROM (SELECT project_id, audit_year, max(audit_time) AS seen, count(*) AS entries FROM v_audits GROUP BY 1, 2)) WHERE age <= 3""")
def latest_and_history(t: Tables):
    return diffs.latest_audits(t.view("v_audits"), 3).select("project_id", "audit_year", "entries", "age")


@register("t5_advisory_cache_ttl", """SELECT package, arg_max(advisory_set, row(cached_at, advisory_set)) AS advisory_set, max(cached_at) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR AS valid
  FROM (SELECT concat('pkg-', CAST(user_id AS STRING)) AS package, ts AS cached_at, md5(props) AS advisory_set FROM events) GROUP BY package""")
def advisory_cache_ttl(t: Tables):
    entries = t.sql("SELECT concat('pkg-', CAST(user_id AS STRING)) AS package, ts AS cached_at, md5(props) AS advisory_set FROM events")
    return diffs.valid_cache(entries, F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).select("package", "advisory_set", "valid")


@register("p6_context_counts", f"SELECT context, count(*) AS n FROM (SELECT {CONTEXT} AS context FROM v_files) GROUP BY 1")
def context_counts(t: Tables):
    return t.view("v_files").groupBy(paths.path_context().alias("context")).agg(F.count(F.lit(1)).alias("n"))
