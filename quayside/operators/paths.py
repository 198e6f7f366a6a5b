"""Path logic: contexts, ignore files, watch globs, actionable findings."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.catalogue import lists as words
from quayside.functions.text import glob_regex, with_glob_regex


def path_context(path: str = "path") -> Column:
    """First context whose patterns match, one alternation per context."""
    low = F.lower(F.col(path))
    context = F.lit(words.PRODUCTION)
    for name, patterns in reversed(words.PATH_CONTEXTS.items()):
        context = F.when(low.rlike("|".join(patterns)), name).otherwise(context)
    return context


def _pattern_array(patterns: list[str]) -> Column:
    rows = [{"pattern": p, "regex": glob_regex(p)[0], "negated": glob_regex(p)[1]} for p in patterns]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<pattern string, regex string, negated boolean>>")


def _any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{glob_regex(p)[0]})" for p in patterns)


def ignore_filter(files: DataFrame, layers: dict[str, list[str]] | None = None, path: str = "path") -> DataFrame:
    """Add ``ignored`` and ``reason``.

    Default patterns come first: the first that matches decides. In each further layer the last matching pattern
    decides. One alternation per layer tells whether any pattern matches; only then is the pattern looked up.
    """
    p = F.col(path)
    out = files.withColumn("_defaults", _pattern_array(words.DEFAULT_IGNORES))
    first = F.expr(f"get(filter(_defaults, r -> {path} rlike r.regex), 0).pattern")
    reason = F.when(p.rlike(_any_of(words.DEFAULT_IGNORES)), F.concat(F.lit("default pattern: "), first))
    for name, patterns in (layers or {}).items():
        out = out.withColumn(f"_layer_{name}", _pattern_array(patterns))
        kept = F.expr(f"try_element_at(filter(_layer_{name}, r -> {path} rlike r.regex), -1).negated")
        reason = reason.when(p.rlike(_any_of(patterns)) & ~kept, f"ignore file: {name}")
    dropped = ["_defaults", *[f"_layer_{n}" for n in layers or {}]]
    return out.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("ignored", F.col("reason") != "").drop(*dropped)


def project_patterns(patterns: DataFrame) -> DataFrame:
    """The patterns of one project's ignore file as an ordered array (an ignore file is one small document)."""
    compiled = with_glob_regex(patterns, "pattern")
    return compiled.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "regex", "negated", "pattern"))).alias("_patterns"))


def last_match_wins(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """The last matching pattern of the project's ignore file decides.

    Patterns are gathered per project and joined as one row, so files are neither multiplied nor regrouped.
    """
    matched = F.expr("filter(_patterns, r -> path rlike r.regex)")
    decided = files.join(project_patterns(patterns), "project_id", "left").withColumn("_hit", matched)
    return decided.withColumn("ignored", F.coalesce(~F.try_element_at("_hit", F.lit(-1))["negated"], F.lit(False))).withColumn(
        "pattern", F.try_element_at("_hit", F.lit(-1))["pattern"]
    ).drop("_patterns", "_hit")


def layer_stats(patterns: DataFrame) -> DataFrame:
    """Pattern counts per layer."""
    compiled = with_glob_regex(patterns, "pattern")
    return compiled.groupBy("layer").agg(
        F.count(F.lit(1)).alias("patterns"), F.count_if("negated").alias("negations"), F.count_if("dir_only").alias("dir_only"), F.count_if("rooted").alias("rooted")
    )


def _file_glob(pattern: str) -> str:
    body = re.sub(r"([.+^$(){}\[\]|\\])", r"\\\1", pattern).replace("*", ".*").replace("?", ".")
    return f"^{body}$"


def watched(path: str = "path") -> Column:
    """Include and exclude globs on the whole path or its last part; excludes come first."""
    whole = F.col(path)
    last = F.element_at(F.split(path, "/"), -1)

    def any_of(globs: list[str]) -> Column:
        pattern = "|".join(_file_glob(g) for g in globs)
        return whole.rlike(pattern) | last.rlike(pattern)

    return ~any_of(words.WATCH_EXCLUDE) & any_of(words.WATCH_INCLUDE)


def skip_reason(path: str = "file_path", patched: str = "patched_version") -> Column:
    """P10: why a finding needs no action; null when it does."""
    outside = F.lower(F.col(path)).rlike("|".join(re.escape(w) for w in words.NON_PRODUCTION_WORDS))
    return F.when(outside, words.SKIP_NON_PRODUCTION).when(
        F.col(patched).isNull() | F.col(patched).isin("", "unknown"), words.SKIP_NO_PATCH
    )


def actionable(findings: DataFrame) -> DataFrame:
    return findings.where(skip_reason().isNull())


def skip_counts(findings: DataFrame) -> DataFrame:
    return findings.withColumn("reason", F.coalesce(skip_reason(), F.lit("actionable"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def project_dirs(files: DataFrame, path: str = "path") -> DataFrame:
    """U4: distinct project folders over all roots."""
    return files.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("project_dir")).distinct()
