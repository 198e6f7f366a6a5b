"""Rule matching over source lines: malware, secrets, tokens, scripts.

A rulebook is compiled into the plan. A line is looked at once with one constant pattern that holds the needles of all rules;
only lines with a needle go on, and there each rule is one constant pattern of its own behind its own needles. Constant
patterns are compiled once per task, not per line. Lines, numbers and context come from the file's own row, so nothing is
shuffled and no window is laid over a file that may be very large.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.catalogue import rules as book
from quayside.functions.text import mask_value
from quayside.operators.matching import severity_rank
from quayside.session import fixed_dim

RULE_DDL = "array<struct<rule_id string, name string, threat_level string, malware_type string, cve_ids array<string>>>"


def needles_of(rule: dict) -> list[str]:
    return [n.lower() for n in rule.get("needles", [])]


def alternation(texts: list[str], guards: int = 6) -> str:
    """One pattern for any of several lower-case texts, as a tree of their common beginnings.

    The first letters are split into guarded groups, so that a place where nothing begins is left after a few tests
    instead of one per text.
    """

    def branch(rest: list[str]) -> str:
        if "" in rest:
            return ""
        by_first: dict[str, list[str]] = {}
        for t in rest:
            by_first.setdefault(t[0], []).append(t[1:])
        parts = [re.escape(c) + branch(more) for c, more in sorted(by_first.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    texts = sorted(set(texts))
    firsts = sorted({t[0] for t in texts})
    step = -(-len(firsts) // guards)
    groups = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    return "|".join("(?=[" + "".join(map(re.escape, g)) + "])" + branch([t for t in texts if t[0] in g]) for g in groups)


def may_match(lowered: Column, rules: list[dict]) -> Column:
    """Whether a line can match any rule at all; a rule without needles lets every line through."""
    if not rules or any(not needles_of(r) for r in rules):
        return F.lit(bool(rules))
    return lowered.rlike(alternation([n for r in rules for n in needles_of(r)]))


def has_needle(lowered: Column, rule: dict) -> Column:
    return reduce(or_, [F.contains(lowered, F.lit(n)) for n in needles_of(rule)], F.lit(not needles_of(rule)))


def rule_array(rules: list[dict]) -> Column:
    """What is told about each rule, as one constant."""
    return F.from_json(F.lit(json.dumps([{**r, "cve_ids": r.get("cve_ids", [])} for r in rules])), RULE_DDL)


def add_rule(rules: list[dict], rule: dict) -> list[dict]:
    """A rulebook with one more rule; an id replaces the rule that had it."""
    return [r for r in rules if r["rule_id"] != rule["rule_id"]] + [rule]


def source_files(files: DataFrame, path: str = "path") -> DataFrame:
    """S3: files with a scanned extension outside skipped folders."""
    ends = F.lower(F.col(path)).rlike("(" + "|".join(e.replace(".", r"\.") for e in book.SCAN_EXTENSIONS) + ")$")
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in book.SKIP_DIRS]))
    return files.where(ends & ~skipped)


def source_lines(files: DataFrame) -> DataFrame:
    """S3: numbered lines; ``files`` has ``file_id`` and ``content``."""
    numbered = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("_pos", "line"))
    return numbered.select("file_id", (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def candidate_lines(files: DataFrame, rules: list[dict], context: int = 0) -> DataFrame:
    """Lines that contain a needle of at least one rule, in lower case too, with optional context lines."""
    keep = [c for c in files.columns if c != "content"]
    lines = F.split("content", "\n")
    if not context:
        rows = files.select(*keep, F.posexplode(lines).alias("_pos", "line"))
        return rows.where(may_match(F.lower("line"), rules)).select(*keep, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line", F.lower("line").alias("_low"))
    # the same array moved by one place and more: a line's neighbours stand in its struct, without a window over the file
    near = range(1, context + 1)
    before = [F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), k), lines), F.lit(1), F.size(lines)).alias(f"b{k}") for k in near]
    after = [F.slice(lines, F.lit(k + 1), F.size(lines)).alias(f"a{k}") for k in near]
    rows = files.select(*keep, F.posexplode(F.arrays_zip(lines.alias("l"), *before, *after)).alias("_pos", "_l")).select(*keep, "_pos", "_l.*")
    below = reduce(lambda n, k: n + F.col(f"a{k}").isNotNull().cast("int"), near, F.lit(0))
    return rows.where(may_match(F.lower("l"), rules)).select(
        *keep, (F.col("_pos") + 1).cast("bigint").alias("line_no"), F.col("l").alias("line"), F.lower("l").alias("_low"),
        F.slice(F.array(*[f"b{k}" for k in near][::-1]), context + 1 - F.least(F.col("_pos"), F.lit(context)), F.least(F.col("_pos"), F.lit(context))).alias("context_before"),
        F.slice(F.array(*[f"a{k}" for k in near]), F.lit(1), below).alias("context_after"),
    )


def rule_matches(files: DataFrame, rules: list[dict] | None = None, context: int = 0) -> DataFrame:
    """One row per match of a rule on a line: all non-overlapping matches, ignoring case."""
    rules = book.RULES if rules is None else rules
    lines = candidate_lines(files, rules, context)
    keep = [c for c in lines.columns if c != "_low"]
    if not rules:
        return lines.select(*keep, F.lit(0).alias("match_no"), F.lit("").alias("matched_text"), *[F.lit("").alias(c) for c in ("rule_id", "name", "threat_level", "malware_type")], F.array(F.lit("")).alias("cve_ids"))
    texts = [F.when(has_needle(F.col("_low"), r), F.regexp_extract_all("line", F.lit("(?i)" + r["pattern"]), F.lit(0))).alias(f"_m{i}") for i, r in enumerate(rules)]
    found = lines.select(*keep, *texts)
    hits = F.array(*[F.when(F.size(f"_m{i}") > 0, F.struct(F.lit(i).alias("rule"), F.col(f"_m{i}").alias("texts"))) for i in range(len(rules))])
    pairs = found.select(*keep, F.explode(hits).alias("_h")).where("_h IS NOT NULL")
    matched = pairs.select(*keep, F.posexplode("_h.texts").alias("match_no", "matched_text"), F.element_at(rule_array(rules), F.col("_h.rule") + 1).alias("_r"))
    return matched.select(*keep, "match_no", "matched_text", "_r.rule_id", "_r.name", "_r.threat_level", "_r.malware_type", "_r.cve_ids")


def whole_book() -> list[dict]:
    """All rules, and the credential fields that only the secret scanner looks for."""
    return book.RULES + [r for r in secret_rules() if r["rule_id"].startswith("TOKEN-")]


def secret_rules() -> list[dict]:
    """Secret rules and the credential fields of JSON files."""
    rules = [r for r in book.RULES if r["malware_type"] == book.SECRETS]
    fields = [
        {"rule_id": f"TOKEN-{i + 1:03d}", "name": name, "pattern": pattern, "threat_level": "CRITICAL",
         "malware_type": book.SECRETS, "cve_ids": [], "needles": [pattern.split('"')[1].lower()]}
        for i, (pattern, name) in enumerate(book.TOKEN_FIELDS)
    ]
    return rules + fields


def unescape_quotes(text: Column) -> Column:
    """Web pages carry quotes as entities."""
    return F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'"))


def secret_matches(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Secrets with their line and a masked value; ``found`` are matches of the whole book, if the files were read before."""
    matches = rule_matches(files, secret_rules()) if found is None else found.where(F.col("rule_id").isin([r["rule_id"] for r in secret_rules()]))
    return matches.withColumn("masked", mask_value(F.col("matched_text"))).drop("matched_text")


def script_findings(scripts: DataFrame) -> DataFrame:
    """Every suspicious pattern of an install-phase script, with its order in the rulebook."""
    hits = [
        F.when(F.col("command").rlike("(?i)" + p), F.struct(F.lit(i).alias("ordinal"), F.lit(d).alias("description")))
        for i, (p, d) in enumerate(book.SCRIPT_PATTERNS)
    ]
    return (
        scripts.where(F.col("script_name").isin(book.SCRIPT_PHASES))
        .withColumn("_h", F.explode(F.array_compact(F.array(*hits))))
        .select(*scripts.columns, "_h.ordinal", "_h.description")
    )


def first_script_finding(scripts: DataFrame) -> DataFrame:
    """Only the first matching pattern of each script, without ranking: a chain of conditions stops at the first."""
    chain = F.lit(None).cast("string")
    for pattern, description in reversed(book.SCRIPT_PATTERNS):
        chain = F.when(F.col("command").rlike("(?i)" + pattern), description).otherwise(chain)
    found = scripts.where(F.col("script_name").isin(book.SCRIPT_PHASES)).withColumn("description", chain)
    return found.where("description IS NOT NULL")


def danger_tokens(scripts: DataFrame) -> DataFrame:
    """Literal danger tokens of install-phase scripts."""
    table = F.from_json(F.lit(json.dumps([{"token": t, "meaning": m} for t, m in book.DANGER_TOKENS])), "array<struct<token string, meaning string>>")
    return (
        scripts.where(F.col("script_name").isin(book.SCRIPT_PHASES))
        .withColumn("_t", table)
        .withColumn("_h", F.explode(F.expr("filter(_t, t -> contains(lower(command), lower(t.token)))")))
        .select(*scripts.columns, "_h.token", "_h.meaning")
    )


def campaign_tokens(scripts: DataFrame) -> DataFrame:
    """Literal campaign tokens in any script."""
    table = F.array(*[F.lit(t) for t in book.CAMPAIGN_TOKENS])
    return scripts.withColumn("_t", table).withColumn("token", F.explode(F.expr("filter(_t, t -> contains(command, t))"))).drop("_t")


def registry_tokens(files: DataFrame) -> DataFrame:
    """Registry tokens in configuration files; ``files`` has ``name`` and ``content``."""
    return files.where(F.col("name").isin(book.TOKEN_FILES) & F.col("content").rlike(book.REGISTRY_TOKEN))


def proxy_exposure(lines: DataFrame) -> DataFrame:
    """Proxy rules that forward to the gateway."""
    return lines.where(F.col("line").rlike("(?i)" + book.PROXY_RULE))


def explain(matches: DataFrame) -> DataFrame:
    """Explanation and advice by type."""
    rows = [{"malware_type": k, "explanation": e, "remediation": r} for k, (e, r) in book.ADVICE.items()]
    dim = fixed_dim(matches.sparkSession, rows, "malware_type string, explanation string, remediation string")
    return matches.join(dim, "malware_type", "left")


def threat_report(matches: DataFrame, files: DataFrame) -> DataFrame:
    """Per project and in total: files scanned, matches by threat level, files with a critical match."""
    counts = matches.groupBy("project_id", "file_id").agg(
        F.count(F.lit(1)).alias("matches"),
        *[F.count_if(F.col("threat_level") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM")],
    )
    scanned = files.select("project_id", "file_id").join(counts, ["project_id", "file_id"], "left")
    return scanned.rollup("project_id").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matches", "critical", "high", "medium")],
        F.count_if(F.col("critical") > 0).alias("critical_files"),
    )


def critical_files(matches: DataFrame) -> DataFrame:
    """Files to quarantine: those with a critical match."""
    return matches.groupBy("project_id", "path").agg(F.count_if(F.col("threat_level") == "CRITICAL").alias("critical")).where("critical > 0")


def neutralise(files: DataFrame, rules: list[dict] | None = None, mark: str = "// [removed] ") -> DataFrame:
    """new content with every matched line commented out; other lines stay.

    Done on the file's own row, because putting lines together again would shuffle the text. A file without any needle is
    left as it is; in the others a line meets the rules' constant patterns only if it has a needle itself.
    """
    rules = book.RULES if rules is None else rules

    def hit(line: Column) -> Column:
        low = F.lower(line)
        return may_match(low, rules) & reduce(or_, [has_needle(low, r) & line.rlike("(?i)" + r["pattern"]) for r in rules], F.lit(False))

    lines = F.split("content", "\n")
    cleaned = F.transform(lines, lambda l: F.struct(hit(l).alias("hit"), l.alias("line")))
    marked = files.withColumn("_lines", F.when(may_match(F.lower("content"), rules), cleaned))
    new = F.array_join(F.transform("_lines", lambda x: F.when(x["hit"], F.concat(F.lit(mark), x["line"])).otherwise(x["line"])), "\n")
    return (
        marked.withColumn("cleaned_lines", F.coalesce(F.size(F.filter("_lines", lambda x: x["hit"])), F.lit(0)))
        .withColumn("new_content", F.coalesce(new, "content"))
        .drop("_lines", "content")
    )


def order_by_threat(matches: DataFrame) -> DataFrame:
    return matches.orderBy(severity_rank(F.col("threat_level")), "path", "line_no", "rule_id")
