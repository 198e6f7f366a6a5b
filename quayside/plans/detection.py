"""Registered queries of the rule-matching family."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalogue import rules as book
from quayside.functions.text import fingerprint, mask_value, match_all, shannon_entropy
from quayside.operators import detection as d
from quayside.plans.registry import Tables, register, sql_rows, sql_text

# The SQL engine has no lookahead. The same matches without it: the group is the match, what follows it is looked at.
# White space before the look can be given back, so only a quote that stands directly behind the last sign is refused.
WITHOUT_LOOKAHEAD = {
    "XSS-001": r"""(\.innerHTML\s*=(?:[^;'"][^;]*)?(?:req\.|user|input|\+))""",
    "XSS-003": r"""(dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*)(?:[^'"\s]|$|\s['"])""",
    "TYPOSQUAT-003": r'("(?:angular-|react-native-|vue-|next-)[a-z]+-[a-z]+-[a-z]+")',
}


def sql_matches(rules: list[dict], source: str, columns: str) -> str:
    """All matches of every rule over a table of lines: one SELECT per rule keeps its pattern constant."""
    return " UNION ALL ".join(
        f"SELECT {columns}, {sql_text(r['rule_id'])} AS rule_id, {sql_text(r['name'])} AS name, {sql_text(r['threat_level'])} AS threat_level, "
        f"{sql_text(r['malware_type'])} AS malware_type, "
        f"unnest(regexp_extract_all(line, {sql_text(WITHOUT_LOOKAHEAD.get(r['rule_id'], r['pattern']))}, {int(r['rule_id'] in WITHOUT_LOOKAHEAD)}, 'i')) AS matched_text "
        f"FROM {source}"
        for r in rules
    )


LINES = "SELECT l.file_id, f.project_id, f.path, line_no, line FROM v_lines l JOIN v_files f ON l.file_id = f.file_id"
MATCHES = {"all_lines": LINES, "matches": sql_matches(book.RULES, "all_lines", "file_id, project_id, path, line_no, line")}


def files(t: Tables):
    return t.view("v_files").select("file_id", "project_id", "path", "content")


@register("s3_source_lines", """SELECT file_id, line_no, md5(line) AS line_hash FROM v_lines WHERE file_id IN (SELECT file_id FROM v_files
  WHERE regexp_matches(path, '[.](js|mjs|cjs|ts|tsx|jsx|json)$') AND NOT regexp_matches(path, '/(node_modules|dist|build)/'))""")
def source_lines(t: Tables):
    return d.source_lines(d.source_files(t.view("v_files"))).select("file_id", "line_no", F.md5("line").alias("line_hash"))


@register("j22_rule_match", "SELECT file_id, path, line_no, rule_id, threat_level, malware_type, matched_text FROM matches", MATCHES)
def rule_match(t: Tables):
    found = d.rule_matches(files(t))
    return found.select("file_id", "path", "line_no", "rule_id", "threat_level", "malware_type", "matched_text")


@register("j22_rule_match_full_book", "SELECT rule_id, threat_level, count(*) AS n FROM matches GROUP BY ALL", MATCHES)
def rule_match_full_book(t: Tables):
    """How often each of the 72 rules matches."""
    return d.rule_matches(files(t)).groupBy("rule_id", "threat_level").agg(F.count(F.lit(1)).alias("n"))


@register("j22_rule_match_conversations", "SELECT rule_id, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM said GROUP BY rule_id", {
    "said": sql_matches(book.RULES, "(SELECT conv_id, unnest(string_split(content, chr(10))) AS line FROM v_messages)", "conv_id")})
def rule_match_conversations(t: Tables):
    """Code that is pasted into conversations."""
    found = d.rule_matches(t.view("v_messages"))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"))


MASK = "CASE WHEN length({v}) <= 8 THEN repeat('*', length({v})) ELSE left({v}, 4) || repeat('*', length({v}) - 8) || right({v}, 4) END"
SECRET_LINES = """SELECT 'document' AS origin, file_id AS id, line_no, line FROM v_lines
  UNION ALL SELECT 'page', page_id, unnest(generate_series(1, len(a))), unnest(a) FROM (SELECT page_id,
  string_split(replace(replace(html, '&quot;', '"'), '&#39;', ''''), chr(10)) AS a FROM pages)"""


@register("j23_secret_match", f"SELECT origin, id, line_no, rule_id, {MASK.format(v='matched_text')} AS masked FROM s",
          {"secret_lines": SECRET_LINES, "s": sql_matches(d.secret_rules(), "secret_lines", "origin, id, line_no")})
def secret_match(t: Tables):
    documents = t.view("v_files").select(F.lit("document").alias("origin"), F.col("file_id").alias("id"), "content")
    pages = t.base("pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), d.unescape_quotes(F.col("html")).alias("content"))
    return d.secret_matches(documents.unionByName(pages)).select("origin", "id", "line_no", "rule_id", "masked")


@register("j25_explanation_enrich", "SELECT file_id, line_no, rule_id, explanation, remediation FROM matches LEFT JOIN advice USING (malware_type)",
          MATCHES | {"advice": sql_rows(["malware_type", "explanation", "remediation"], [[k, *v] for k, v in book.ADVICE.items()])})
def explanation_enrich(t: Tables):
    return d.explain(d.rule_matches(files(t))).select("file_id", "line_no", "rule_id", "explanation", "remediation")


@register("w4_context_lines", """WITH ctx AS (SELECT file_id, line_no,
    array_to_string(list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10)) AS before,
    array_to_string(list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), chr(10)) AS after FROM v_lines)
  SELECT m.file_id, m.line_no, rule_id, md5(coalesce(before, '')) AS before_hash, md5(coalesce(after, '')) AS after_hash
  FROM matches m JOIN ctx USING (file_id, line_no)""", MATCHES)
def context_lines(t: Tables):
    found = d.rule_matches(files(t), context=3)
    return found.select("file_id", "line_no", "rule_id", F.md5(F.array_join("context_before", "\n")).alias("before_hash"),
                        F.md5(F.array_join("context_after", "\n")).alias("after_hash"))


@register("a18_threat_report", """WITH per_file AS (SELECT f.project_id, f.file_id, count(rule_id) AS matches, count(*) FILTER (threat_level = 'CRITICAL') AS critical,
    count(*) FILTER (threat_level = 'HIGH') AS high, count(*) FILTER (threat_level = 'MEDIUM') AS medium
    FROM v_files f LEFT JOIN matches m ON f.file_id = m.file_id GROUP BY f.project_id, f.file_id)
  SELECT project_id, count(*) AS files_scanned, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(critical) AS BIGINT) AS critical,
    CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, count(*) FILTER (critical > 0) AS critical_files
  FROM per_file GROUP BY ROLLUP (project_id)""", MATCHES)
def threat_report(t: Tables):
    return d.threat_report(d.rule_matches(files(t)), files(t))


@register("a18_critical_files", "SELECT project_id, path, count(*) AS critical FROM matches WHERE threat_level = 'CRITICAL' GROUP BY ALL", MATCHES)
def critical_files(t: Tables):
    return d.critical_files(d.rule_matches(files(t)))


CUSTOM = {"rule_id": "CUSTOM-001", "name": "Items", "pattern": "items[.]length", "threat_level": "LOW", "malware_type": "Custom", "needles": ["items"]}


@register("x2_rule_registry", f"""SELECT rule_id, count(*) AS n FROM (
  {sql_matches([CUSTOM] + book.RULES, "v_lines", "file_id")}) GROUP BY rule_id""")
def rule_registry(t: Tables):
    return d.rule_matches(files(t), d.add_rule(book.RULES, CUSTOM)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@register("f1_match_all", """SELECT file_id, unnest(regexp_extract_all(content, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', 0)) AS address FROM v_files""")
def match_all_addresses(t: Tables):
    found = match_all(F.col("content"), "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}")
    return t.view("v_files").select("file_id", F.explode(found).alias("address"))


@register("f2_fingerprint", """SELECT file_id, line_no, rule_id, left(sha256(concat_ws(':', rule_id, path, CAST(line_no AS VARCHAR), name)), 16) AS fingerprint,
  md5(line) AS line_md5 FROM matches""", MATCHES)
def fingerprints(t: Tables):
    found = d.rule_matches(files(t))
    mark = fingerprint(F.col("rule_id"), F.col("path"), F.col("line_no").cast("string"), F.col("name"))
    return found.select("file_id", "line_no", "rule_id", mark.alias("fingerprint"), F.md5("line").alias("line_md5"))


TOKENS = "SELECT file_id, unnest(regexp_extract_all(content, '[A-Za-z0-9+/=_-]{20,}', 0)) AS token FROM v_files"


@register("f8_mask_value", f"SELECT file_id, {MASK.format(v='token')} AS masked FROM ({TOKENS})")
def masks(t: Tables):
    token = t.view("v_files").select("file_id", F.explode(match_all(F.col("content"), "[A-Za-z0-9+/=_-]{20,}")).alias("token"))
    return token.select("file_id", mask_value(F.col("token")).alias("masked"))


@register("f9_shannon_entropy", f"""WITH tok AS (SELECT DISTINCT token FROM ({TOKENS})),
  n AS (SELECT token, length(token) AS size, count(*) AS k FROM (SELECT token, unnest(string_split(token, '')) AS c FROM tok) GROUP BY token, c)
  SELECT token, round(-sum(k / size * log2(k / size)), 4) AS entropy FROM n GROUP BY token""")
def entropy(t: Tables):
    token = t.view("v_files").select(F.explode(match_all(F.col("content"), "[A-Za-z0-9+/=_-]{20,}")).alias("token")).distinct()
    return shannon_entropy(token, "token").select("token", F.round("entropy", 4).alias("entropy"))


def sql_script_hits() -> str:
    return " UNION ALL ".join(
        f"SELECT project_id, script_name, {i} AS ordinal, {sql_text(desc)} AS description FROM v_scripts "
        f"WHERE script_name IN ('preinstall', 'postinstall', 'install', 'prepare') AND regexp_matches(command, {sql_text(p)}, 'i')"
        for i, (p, desc) in enumerate(book.SCRIPT_PATTERNS)
    )


@register("p21_install_script_risk", f"SELECT * FROM ({sql_script_hits()})")
def install_script_risk(t: Tables):
    return d.script_findings(t.view("v_scripts")).select("project_id", "script_name", "ordinal", "description")


@register("p21_danger_tokens", """SELECT project_id, script_name, token, meaning FROM v_scripts, danger
  WHERE script_name IN ('preinstall', 'postinstall', 'install', 'prepare') AND contains(lower(command), lower(token))
  UNION ALL SELECT project_id, script_name, token, 'campaign' FROM v_scripts, campaign WHERE contains(command, token)""",
  {"danger": sql_rows(["token", "meaning"], [list(x) for x in book.DANGER_TOKENS]), "campaign": sql_rows(["token"], [[x] for x in book.CAMPAIGN_TOKENS])})
def script_tokens(t: Tables):
    danger = d.danger_tokens(t.view("v_scripts")).select("project_id", "script_name", "token", "meaning")
    campaign = d.campaign_tokens(t.view("v_scripts")).select("project_id", "script_name", "token", F.lit("campaign").alias("meaning"))
    return danger.unionByName(campaign)


@register("w3_first_rule_per_script", f"SELECT project_id, script_name, arg_min(description, ordinal) AS description FROM ({sql_script_hits()}) GROUP BY ALL")
def first_rule_per_script(t: Tables):
    return d.first_script_finding(t.view("v_scripts")).select("project_id", "script_name", "description")


@register("p16_registry_token_exposure", """SELECT file_id, project_id, name FROM v_project_files
  WHERE name IN ('.npmrc', '.yarnrc', '.yarnrc.yml', '.env', '.env.local', '.env.production') AND contains(content, '//registry.npmjs.org/:_authToken=')""")
def registry_token_exposure(t: Tables):
    return d.registry_tokens(t.view("v_project_files")).select("file_id", "project_id", "name")


@register("p18_proxy_exposure", "SELECT file_id, line_no FROM v_lines WHERE regexp_matches(line, '(proxy_pass|reverse_proxy).*(18789|clawdbot|moltbot)', 'i')")
def proxy_exposure(t: Tables):
    return d.proxy_exposure(d.source_lines(t.view("v_files"))).select("file_id", "line_no")


@register("f13_neutralise_lines", """WITH hit AS (SELECT DISTINCT file_id, line_no FROM matches),
  n AS (SELECT l.file_id, l.line_no, CASE WHEN h.file_id IS NULL THEN line ELSE '// [removed] ' || line END AS line, h.file_id IS NOT NULL AS marked
        FROM v_lines l LEFT JOIN hit h ON l.file_id = h.file_id AND l.line_no = h.line_no)
  SELECT file_id, count(*) FILTER (marked)::INT AS cleaned_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS content_hash FROM n GROUP BY file_id""", MATCHES)
def neutralise_lines(t: Tables):
    return d.neutralise(files(t)).select("file_id", "cleaned_lines", F.md5("new_content").alias("content_hash"))
