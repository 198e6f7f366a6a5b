"""Version semantics as Spark SQL expressions.

A version becomes a struct ``(major, minor, patch, release, pre)`` whose ordinary struct ordering is the semver
order: ``release`` is 0 for a prerelease and 1 for a release, ``pre`` is an order-preserving text of the prerelease
identifiers. Every range kind (``<X``, ``>=X, <Y``, ``A-B``, ``N.x``, ``*``, exact) becomes half-open intervals
``[lo, hi)`` over that key, so all version matching is one equi-join with two comparisons.

The functions that end in ``_sql`` build expression text from the text of their argument; the others work on
DataFrames or Columns. A key is never null: ``major`` is -1 when the text is not a version, so it lies in no interval
and no null test has to be pushed below the projections that compute it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEMVER = r"^[vV=]?([0-9]{1,18})(?:\.([0-9]{1,18}))?(?:\.([0-9]{1,18}))?(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
COMPARATOR = r"(>=|<=|>|<|=)\s*[vV]?[0-9]+(?:\.[0-9]+){0,2}(?:-[0-9A-Za-z.-]+)?"
SPAN = r"^([0-9]+(?:\.[0-9]+){0,2})\s*-\s*([0-9]+(?:\.[0-9]+){0,2})$"
WILD = r"^([0-9]{1,17})(?:\.([0-9]{1,17}))?\.[xX*]$"
SPEC = r"^[\^~>=<\s]*((?:(?!\|\|)\S)*)"
MAX_PART = 9223372036854775807


def clean_spec(spec: Column) -> Column:
    """Strip range operators; keep the first token of the first ``||`` branch."""
    return F.regexp_extract(spec, SPEC, 1)


def parts_sql(version: str) -> str:
    """``[major, minor, patch, prerelease]`` texts from one regex pass; one element when it is no version."""
    return rf"split(regexp_replace({version}, r'{SEMVER}', '$1\u0001$2\u0001$3\u0001$4'), '\u0001')"


def _struct_sql(major: str, minor: str, patch: str, release: str, pre: str) -> str:
    return (
        f"named_struct('major', bigint({major}), 'minor', bigint({minor}), 'patch', bigint({patch}), "
        f"'release', int({release}), 'pre', {pre})"
    )


def key_sql(parts: str) -> str:
    """Comparable key of a parts array.

    Prerelease identifiers are joined by a blank (lower than any identifier character); numeric ones sort by length,
    then text, and below the others.
    """

    def number(i: int) -> str:
        return f"coalesce(try_cast(get({parts}, {i}) AS bigint), 0)"

    pre = f"coalesce(get({parts}, 3), '')"
    ordered = (
        f"if({pre} = '', '', array_join(transform(split({pre}, r'\\.'), p -> if(p rlike '^[0-9]+$', "
        f"concat('0', lpad(length(p), 3, '0'), p), concat('1', p))), ' '))"
    )
    return _struct_sql(f"if(size({parts}) = 4, {number(0)}, -1)", number(1), number(2), f"if({pre} = '', 1, 0)", ordered)


def with_version_key(df: DataFrame, version: str = "version", key: str = "version_key") -> DataFrame:
    """Add the key in two projections, so that the regex runs once per row."""
    return df.withColumn("_parts", F.expr(parts_sql(version))).withColumn(key, F.expr(key_sql("_parts"))).drop("_parts")


def version_key(version: str) -> Column:
    """Key of a named column (or SQL text) in one expression; on large tables prefer :func:`with_version_key`."""
    return F.expr(f"transform(array({parts_sql(version)}), _p -> {key_sql('_p')})[0]")


def is_parsed(key: str = "version_key") -> Column:
    return F.col(f"{key}.major") >= 0


def numeric_triple(version: str) -> Column:
    """``(major, minor, patch)`` of the leading ``N.N.N``; anything else is ``(0, 0, 0)``."""
    pattern = r"^([0-9]+)\.([0-9]+)\.([0-9]+)"
    parts = [f"coalesce(try_cast(regexp_extract({version}, r'{pattern}', {i}) AS bigint), 0)" for i in (1, 2, 3)]
    return F.expr(f"named_struct('major', {parts[0]}, 'minor', {parts[1]}, 'patch', {parts[2]})")


def above_sql(key: str) -> str:
    """The smallest key greater than ``key``; turns a closed bound into an open one."""
    return _struct_sql(
        f"{key}.major", f"{key}.minor", f"{key}.patch", f"if({key}.release = 0, 0, 2)",
        f"if({key}.release = 0, concat({key}.pre, ' '), '')",
    )


def _lowest_sql(major: str, minor: str = "0") -> str:
    return _struct_sql(major, minor, "0", "0", "''")


HIGHEST = _struct_sql(str(MAX_PART), "0", "0", "2", "''")


def with_interval(df: DataFrame, text: str) -> DataFrame:
    """Add ``lo`` and ``hi`` of one range text (without ``||``); both are null when it is no range."""
    one_key = f"transform(array({{parts}}), _p -> {key_sql('_p')})[0]"

    def key(value: str) -> str:
        return one_key.format(parts=parts_sql(value))

    bound = f"transform(array({parts_sql(r'''regexp_replace(c, r'^(>=|<=|>|<|=)\s*', '')''')}), _p -> {key_sql('_p')})[0]"
    first = df.withColumn("_r", F.trim(F.col(text)))
    shaped = first.withColumns(
        {
            "_kind": F.expr(
                f"CASE WHEN _r IN ('*', 'x', 'latest') THEN 'all' WHEN _r rlike r'{WILD}' THEN 'wild' "
                f"WHEN _r rlike r'{SPAN}' THEN 'span' WHEN _r rlike '^[<>=]' THEN 'bounds' ELSE 'exact' END"
            ),
        }
    )
    parsed = shaped.withColumns(
        {
            "_major": F.expr(f"if(_kind = 'wild', bigint(regexp_extract(_r, r'{WILD}', 1)), NULL)"),
            "_minor": F.expr(f"if(_kind = 'wild', try_cast(regexp_extract(_r, r'{WILD}', 2) AS bigint), NULL)"),
            "_one": F.expr(f"CASE _kind WHEN 'span' THEN {key(f'''regexp_extract(_r, r'{SPAN}', 1)''')} WHEN 'exact' THEN {key('_r')} END"),
            "_two": F.expr(f"CASE _kind WHEN 'span' THEN {key(f'''regexp_extract(_r, r'{SPAN}', 2)''')} WHEN 'exact' THEN {key('_r')} END"),
            "_bounds": F.expr(
                f"if(_kind = 'bounds', transform(regexp_extract_all(_r, r'{COMPARATOR}', 0), "
                f"c -> named_struct('op', regexp_extract(c, '^(>=|<=|>|<|=)', 1), 'key', {bound})), NULL)"
            ),
        }
    )
    # the tightest lower and upper bound; '>' and '<=' move just above their version
    lows = f"transform(filter(_bounds, c -> c.op IN ('>=', '>', '=')), c -> if(c.op = '>', {above_sql('c.key')}, c.key))"
    highs = f"transform(filter(_bounds, c -> c.op IN ('<=', '<', '=')), c -> if(c.op = '<', c.key, {above_sql('c.key')}))"
    lo = (
        f"CASE _kind WHEN 'all' THEN {_lowest_sql('0')} WHEN 'wild' THEN {_lowest_sql('_major', 'coalesce(_minor, 0)')} "
        f"WHEN 'bounds' THEN if(size(_bounds) > 0, coalesce(array_max({lows}), {_lowest_sql('0')}), NULL) "
        f"ELSE if(_one.major >= 0, _one, NULL) END"
    )
    hi = (
        f"CASE _kind WHEN 'all' THEN {HIGHEST} "
        f"WHEN 'wild' THEN if(_minor IS NULL, {_lowest_sql('_major + 1')}, {_lowest_sql('_major', '_minor + 1')}) "
        f"WHEN 'bounds' THEN if(size(_bounds) > 0, coalesce(array_min({highs}), {HIGHEST}), NULL) "
        f"ELSE if(_two.major >= 0, {above_sql('_two')}, NULL) END"
    )
    out = parsed.withColumns({"lo": F.expr(lo), "hi": F.expr(hi)})
    return out.drop("_r", "_kind", "_major", "_minor", "_one", "_two", "_bounds")


def merged_intervals(ranges: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Merge overlapping ``[lo, hi)`` rows of one advisory and package into disjoint ones.

    A version then falls into at most one interval, so the match needs no ``distinct`` over its findings. Columns in
    ``carry`` depend on ``keys`` and ride along. Empty and unreadable ranges are dropped last: a filter placed before
    the window would be pushed down and compute every bound a second time.
    """
    by = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranges.withColumn("_reach", F.max("hi").over(before))
        .withColumn("_island", F.sum(F.expr("if(_reach >= lo, 0, 1)")).over(upto))
        .groupBy(*keys, *(carry or []), "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
        .where("lo < hi")
    )


def intervals(advisories: DataFrame, keys: list[str], affected: str = "affected_versions", carry: list[str] | None = None) -> DataFrame:
    """Advisories with an array of range texts as disjoint intervals per ``keys``."""
    kept = [*keys, *(carry or [])]
    branch = advisories.select(*kept, F.explode(F.expr(f"flatten(transform({affected}, r -> split(r, r'\\|\\|')))")).alias("_range"))
    return merged_intervals(with_interval(branch, "_range").select(*kept, "lo", "hi"), keys, carry)


def bump_spec(spec: Column, patched: Column) -> Column:
    """New version behind the operator prefix of the old spec."""
    return F.concat(F.regexp_extract(spec, r"^[\^~>=<]*", 0), patched)


def runtime_requirement(text: str) -> Column:
    """First version number of an ``engines`` requirement, missing parts 0; null when there is none."""
    pattern = r"([0-9]+)\.?([0-9]+)?\.?([0-9]+)?"
    part = [f"regexp_extract({text}, r'{pattern}', {i})" for i in (1, 2, 3)]
    zero = ", ".join(f"coalesce(nullif({p}, ''), '0')" for p in part)
    return F.expr(f"if({part[0]} <> '', concat_ws('.', {zero}), NULL)")
