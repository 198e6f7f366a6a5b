"""Scalar helpers over text: matches, fingerprints, masks, entropy, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity to report level and to a 0-10 score; unknown words fall back to the middle.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCORE = {"critical": "9.8", "high": "8.0", "medium": "5.0", "low": "2.0", "info": "0.0"}
FEED_SEVERITY = {"critical": "critical", "high": "high", "moderate": "medium", "low": "low", "unknown": "medium"}

# Hash prefixes of an integrity text and their names in a bill of materials.
HASH_NAMES = {"sha512": "SHA-512", "sha256": "SHA-256", "sha1": "SHA-1"}


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a small constant table."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def match_all(text: Column, pattern: str) -> Column:
    """every non-overlapping match, ignoring case."""
    return F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))


def fingerprint(*parts: Column) -> Column:
    """first 16 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def purl(name: Column, version: Column) -> Column:
    """package URL."""
    return F.concat(F.lit("pkg:npm/"), name, F.lit("@"), version)


def integrity_hash(integrity: Column) -> tuple[Column, Column]:
    """(algorithm, value) of an integrity text; nulls for other prefixes."""
    pattern = r"^(sha512|sha256|sha1)-(.*)$"
    alg = F.regexp_extract(integrity, pattern, 1)
    return lookup(alg, HASH_NAMES), F.when(alg != "", F.regexp_extract(integrity, pattern, 2))


def mask_value(value: Column) -> Column:
    """F8: first and last four characters, stars between; short values are hidden whole."""
    size = F.length(value)
    inner = F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), size - 8), F.right(value, F.lit(4)))
    return F.when(size <= 8, F.repeat(F.lit("*"), size)).otherwise(inner)


def shannon_entropy(df: DataFrame, token: str, out: str = "entropy") -> DataFrame:
    """bits per character of each token.

    The histogram is the run lengths of the token's sorted characters: it stays on the token's row, so no shuffle.
    """
    letters = df.withColumn("_chars", F.expr(f"array_sort(split({token}, ''))"))
    counts = letters.withColumn(
        "_counts", F.expr("transform(array_distinct(_chars), c -> size(_chars) - size(array_remove(_chars, c)))")
    )
    bits = "aggregate(_counts, 0D, (acc, n) -> acc - n / size(_chars) * log2(n / size(_chars)))"
    return counts.withColumn(out, F.round(F.expr(bits), 6)).drop("_chars", "_counts")


# ---- ignore-file globs (F11) ----

SPECIAL = r"([\.\^\$\+\{\}\[\]\|\(\)\\])"


def glob_body(pattern: Column) -> Column:
    """Glob text without ``!``, leading and trailing slash as a regex body."""
    escaped = F.regexp_replace(pattern, SPECIAL, r"\\$1")
    stars = F.regexp_replace(escaped, r"\*\*/", "\u0001")
    stars = F.regexp_replace(stars, r"\*\*", "\u0002")
    one = F.regexp_replace(F.regexp_replace(stars, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.regexp_replace(F.regexp_replace(one, "\u0001", "(?:.*/)?"), "\u0002", ".*")


def with_glob_regex(df: DataFrame, pattern: str) -> DataFrame:
    """add ``negated``, ``dir_only``, ``rooted`` and ``regex`` of an ignore pattern.

    A pattern with a slash before its end is anchored at the root; otherwise it may start at any level. A pattern
    that ends in a slash matches folders only, that is, it needs something below.
    """
    bare = F.regexp_replace(F.col(pattern), "^!", "")
    core = F.regexp_replace(F.regexp_replace(bare, "/$", ""), "^/", "")
    return (
        df.withColumn("negated", F.col(pattern).startswith("!"))
        .withColumn("dir_only", bare.endswith("/"))
        .withColumn("rooted", F.regexp_replace(bare, "/$", "").contains("/"))
        .withColumn(
            "regex",
            F.concat(
                F.when(F.col("rooted"), "^").otherwise("(?:^|/)"), glob_body(core), F.when(F.col("dir_only"), "/").otherwise("(?:/|$)")
            ),
        )
    )


def glob_regex(pattern: str) -> tuple[str, bool]:
    """(regex, negated) of a pattern that is known while planning; same rules as :func:`with_glob_regex`."""
    negated = pattern.startswith("!")
    bare = pattern[1:] if negated else pattern
    dir_only, bare = bare.endswith("/"), bare.removesuffix("/")
    rooted, core = "/" in bare, bare.removeprefix("/")
    body = re.sub(SPECIAL, r"\\\1", core)
    for token, mark in (("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".*")):
        body = body.replace(token, mark)
    return ("^" if rooted else "(?:^|/)") + body + ("/" if dir_only else "(?:/|$)"), negated
