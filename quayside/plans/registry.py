"""Registered queries: each reads the given tables (or views over them) and may carry the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.plans.views import BASE_TABLES, used_views, view_text, with_views
from quayside.session import spread

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder, and the domain views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def base(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(self.path(name)))

    def sql(self, text: str) -> DataFrame:
        """Run Spark SQL that may name base tables and domain views."""
        views = used_views(text, "spark")
        everything = " ".join([text] + [view_text(v, "spark") for v in views])
        for table in BASE_TABLES:
            if table in everything:
                self.base(table).createOrReplaceTempView(table)
        ctes = ", ".join(f"{v} AS ({view_text(v, 'spark')})" for v in views)
        return self.spark.sql((f"WITH {ctes} " if ctes else "") + text)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")


def register(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB text, ``ctes`` are extra named sub-queries of it."""

    def keep(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql, ctes)
        return build

    return keep


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(sql_text(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def sql_rows(columns: list[str], rows: list) -> str:
    """A DuckDB VALUES table of the same fixed values the library uses."""
    body = ", ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def sql_key(version: str) -> str:
    """Packed version number in SQL: twice the triple, plus one for a release; null when unparseable."""
    pattern = r"^([0-9]+)[.]([0-9]+)[.]([0-9]+)(-[0-9A-Za-z.-]+)?$"

    def part(i: int) -> str:
        return f"CAST(regexp_extract({version}, '{pattern}', {i}) AS BIGINT)"

    return (
        f"CASE WHEN regexp_matches({version}, '{pattern}') THEN (({part(1)} * 1000000 + {part(2)}) * 1000000 + {part(3)}) * 2"
        f" + CASE WHEN regexp_extract({version}, '{pattern}', 4) = '' THEN 1 ELSE 0 END END"
    )


def sql_clean(spec: str) -> str:
    return f"regexp_replace({spec}, '^[\\^~>=<\\s]+', '')"
