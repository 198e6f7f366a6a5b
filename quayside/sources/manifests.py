"""Manifests and lockfiles (S4-S7, S11). A document is parsed on its own row, so no parser needs a shuffle (S5: see there)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.catalogue.lists import SECTIONS
from quayside.session import cut_lineage

MANIFEST_DDL = "name string, version string, description string, license string, scripts map<string,string>, engines map<string,string>, " + ", ".join(
    f"{s} map<string,string>" for s in SECTIONS
)
ENTRY_DDL = (
    "version string, resolved string, integrity string, license string, dev boolean, optional boolean, peer boolean, bundled boolean, "
    "requires map<string,string>"
)


def parse_manifests(files: DataFrame, content: str = "content") -> DataFrame:
    """Manifest fields; a document that is no JSON object is dropped."""
    keep = [c for c in files.columns if c != content]
    parsed = files.where(F.json_object_keys(content).isNotNull())
    return parsed.withColumn("_m", F.from_json(content, MANIFEST_DDL)).select(*keep, "_m.*")


def dependency_rows(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """Dependencies of all sections as rows, exploded once."""

    def entries_of(section: str) -> Column:
        filled = F.map_entries(F.coalesce(F.col(section), F.create_map().cast("map<string,string>")))
        return F.transform(filled, lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("package"), e["value"].alias("spec")))

    entries = F.flatten(F.array(*[entries_of(s) for s in SECTIONS]))
    return manifests.select(*keys, F.explode(entries).alias("_d")).select(*keys, "_d.package", "_d.spec", "_d.section")


def merged_sections(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """P1 on a parsed manifest: a later section overrides an earlier one, without leaving the row."""

    # entries of all sections in one array, each behind those that it overrides; of equal names the last is kept
    entries = F.flatten(F.array_compact(F.array(*[F.map_entries(s) for s in SECTIONS])))
    sections = manifests.select(*keys, entries.alias("_e")).withColumn("_names", F.col("_e.key"))
    merged = F.filter("_e", lambda e, i: ~F.array_contains(F.slice("_names", i + 2, F.size("_names")), e["key"]))
    return sections.select(*keys, F.explode(merged).alias("_d")).select(*keys, F.col("_d.key").alias("package"), F.col("_d.value").alias("spec"))


def script_rows(manifests: DataFrame, keys: list[str]) -> DataFrame:
    return manifests.select(*keys, F.explode("scripts").alias("script_name", "command"))


def parse_npm_lock(files: DataFrame, content: str = "content") -> DataFrame:
    """Entries of npm lockfiles of every version.

    Versions 2 and 3 list paths: the name is the text after the last ``node_modules/``, with its scope. Version 1 nests: its
    entries are opened level by level. What a level leaves closed is one text per entry, so every subtree is a row of its own
    and a large lockfile spreads over tasks; each level is a table in the shared folder, and the levels end with the deepest
    document.
    """
    keep = [c for c in files.columns if c != content]

    def entries(rows: DataFrame, package: Column, requires: str) -> DataFrame:
        return rows.select(
            *keep, package.alias("package"), F.coalesce("_v.version", F.lit("unknown")).alias("version"), F.col("_v.resolved").alias("resolved_url"), "_v.integrity", "_v.license",
            F.coalesce("_v.dev", F.lit(False)).alias("dev"), F.coalesce("_v.optional", F.lit(False)).alias("optional"), F.col(f"_v.{requires}").alias("requires"),
        )

    # a document is parsed once: its version, and what either kind lists
    listed, nested = f"map<string, struct<{ENTRY_DDL}, dependencies map<string,string>>>", f"map<string, struct<{ENTRY_DDL}, dependencies string>>"
    parsed = files.select(*keep, F.from_json(content, f"lockfileVersion string, packages {listed}, dependencies {nested}").alias("_d"))
    by_path = F.coalesce(F.col("_d.lockfileVersion").try_cast("int"), F.lit(1)) >= 2
    at = F.when(by_path, F.transform(F.map_entries("_d.packages"), lambda e: F.struct(e["key"].alias("k"), F.lit(True).alias("listed"), e["value"].alias("p"), F.lit(None).cast(nested[len("map<string, "):-1]).alias("v"))))
    below = F.transform(F.map_entries("_d.dependencies"), lambda e: F.struct(e["key"].alias("k"), F.lit(False).alias("listed"), F.lit(None).cast(listed[len("map<string, "):-1]).alias("p"), e["value"].alias("v")))
    first = cut_lineage(parsed.select(*keep, F.explode_outer(at.otherwise(below)).alias("_e")).where("NOT _e.listed OR _e.k <> ''").select(*keep, "_e.*"), "lock")
    paths = first.where("listed").select(*keep, F.col("k").alias("_k"), F.col("p").alias("_v"))
    found = entries(paths, F.element_at(F.split("_k", "node_modules/"), -1), "dependencies")

    opened = first.where("NOT listed").select(*keep, F.col("k").alias("_k"), F.col("v").alias("_v"))
    while True:
        found = found.unionByName(entries(opened, F.col("_k"), "requires"))
        closed = opened.where("_v.dependencies IS NOT NULL").select(*keep, F.col("_v.dependencies").alias("_j"))
        opened = cut_lineage(closed.select(*keep, F.explode(F.from_json("_j", nested)).alias("_k", "_v")), "lock")
        if opened.isEmpty():
            return found


def parse_yarn_lock(files: DataFrame, content: str = "content") -> DataFrame:
    """Blocks of a yarn lockfile, classic or berry. A block starts at a line without indent; its fields follow, indented.

    ``requires`` holds the entries of ``dependencies`` and ``optionalDependencies``; of a name named twice the later entry wins.
    Berry writes ``name: range`` and a checksum where classic writes ``name "range"`` and an integrity.
    """
    keep = [c for c in files.columns if c != content]
    block = files.select(*keep, F.explode(F.split(content, r"\n(?=[^\s])")).alias("_b"))
    header = r'^"?((?:@[^@/\s"]+/)?[^@\s"]+)@'
    fields = block.where(~F.col("_b").startswith("#")).select(
        *keep,
        F.regexp_extract("_b", header, 1).alias("package"),
        F.regexp_extract("_b", r'\n\s+version:? "?([^"\s]+)"?', 1).alias("version"),
        F.nullif(F.regexp_extract("_b", r'\n\s+resolved "?([^"\s]+)"?', 1), F.lit("")).alias("resolved_url"),
        F.nullif(F.regexp_extract("_b", r"\n  (?:integrity|checksum:) (\S+)", 1), F.lit("")).alias("integrity"),
        F.split("_b", r"\n(?=  [^\s])").alias("_sections"),
    )
    dep = r'^    "?([^"\s]+?)"?:? "?([^"]+?)"?$'
    named = F.filter("_sections", lambda s: s.startswith("  dependencies:") | s.startswith("  optionalDependencies:"))
    lines = F.filter(F.flatten(F.transform(named, lambda s: F.split(s, "\n"))), lambda d: d.rlike(dep))
    pairs = F.transform(lines, lambda d: F.struct(F.regexp_extract(d, dep, 1).alias("k"), F.regexp_extract(d, dep, 2).alias("v")))
    read = fields.where("package <> '' AND version <> ''").withColumn("_late", F.reverse(pairs)).withColumn("_names", F.col("_late.k"))
    last = F.filter("_late", lambda p, i: F.array_position("_names", p["k"]) == i + 1)
    return read.withColumn("requires", F.map_from_entries(F.reverse(last))).drop("_sections", "_late", "_names")


def parse_pnpm_lock(files: DataFrame, content: str = "content") -> DataFrame:
    """Entries ``/name@version:`` (or the older ``/name/version:``) of a pnpm lockfile; peer suffixes are dropped."""
    keep = [c for c in files.columns if c != content]
    after = F.regexp_extract(content, r"(?s)(?:^|\n)packages:[^\S\n]*\n(.*)$", 1)
    body = F.split(after, r"\n(?=\S)", 2)[0]  # the section ends at the next line without indent
    entry = files.select(*keep, F.explode(F.split(body, r"\n(?=  [/'\"@A-Za-z0-9])")).alias("_b"))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.split("_b", "\n")[0], r"\([^)]*\)", ""), r"['\"]", ""))
    at = r"^/?((?:@[^/]+/)?[^@/]+)@([^:@]+):\s*$"
    old = r"^/((?:@[^/]+/)?[^@/]+)/([0-9][^:_]*)[^:]*:\s*$"
    staged = entry.withColumn("_k", key)
    return staged.select(
        *keep,
        F.coalesce(F.nullif(F.regexp_extract("_k", at, 1), F.lit("")), F.nullif(F.regexp_extract("_k", old, 1), F.lit(""))).alias("package"),
        F.coalesce(F.nullif(F.regexp_extract("_k", at, 2), F.lit("")), F.nullif(F.regexp_extract("_k", old, 2), F.lit(""))).alias("version"),
        F.nullif(F.regexp_extract("_b", r"integrity:\s*([^\s},]+)", 1), F.lit("")).alias("integrity"),
    ).where("package IS NOT NULL")


def decode_contents(rows: DataFrame, content: str = "content") -> DataFrame:
    """Landed repository contents carry the manifest as base64, with line breaks."""
    return rows.withColumn(content, F.unbase64(F.regexp_replace(content, r"\s", "")).cast("string"))
