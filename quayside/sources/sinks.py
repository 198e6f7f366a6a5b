"""Documents and logs (K1-K6).

A document is written as ordered lines: a header, one line per item, what stands between the sections, a footer. Items get
their place from ``ranks.numbered``, lines are dealt by ranges of (document, section, place) and sorted inside a task, so a
document of any size is one valid JSON document and no task gathers one. Line by line, the part files in the order of their
names hold one document after the other; a large document goes on in the next file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from quayside.functions.text import SARIF_LEVEL, SARIF_SCORE, fingerprint, lookup
from quayside.operators.matching import severity_rank
from quayside.operators.ranks import numbered
from quayside.session import ship_package

TOOL = "quayside"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def document_lines(keys: list[str], frames: DataFrame, around: list, sections: list[DataFrame]) -> DataFrame:
    """(keys, section, place, line): ``around`` are the columns of ``frames`` (one row per document) that stand before,
    between and behind the sections; a section has (keys, place from 0, item as JSON)."""
    fixed = F.explode(F.array(*[F.struct(F.lit(2 * i).alias("section"), text.alias("line")) for i, text in enumerate(around)])).alias("_f")
    lines = frames.select(*keys, fixed).select(*keys, "_f.section", F.lit(0).cast("long").alias("place"), "_f.line")
    for i, items in enumerate(sections):
        line = F.when(F.col("place") > 0, F.concat(F.lit(","), "item")).otherwise(F.col("item"))
        lines = lines.unionByName(items.select(*keys, F.lit(2 * i + 1).alias("section"), F.col("place").cast("long").alias("place"), line.alias("line")))
    return lines


def placed_items(rows: DataFrame, keys: list[str], order: list, item: Column) -> DataFrame:
    """A section: the rows of each document in order, as JSON; rows that are equal in ``order`` have the same item."""
    return numbered(rows, keys, [(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in order], "place", keep=[F.to_json(item).alias("item")])


def write_documents(lines: DataFrame, keys: list[str], path: str, as_text: bool = False) -> None:
    """The lines of all documents in order: with their keys as a table, or only as text."""
    order = [*keys, "section", "place"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    if as_text:
        dealt.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    else:
        dealt.write.mode("overwrite").option("compression", "zstd").parquet(path)


def items_of(written: DataFrame, section: int, ddl: str) -> DataFrame:
    """The items of a section of written documents, read as JSON again."""
    return written.where(F.col("section") == 2 * section + 1).select(*[c for c in written.columns if c not in ("section", "line")], item_in(F.col("line"), ddl).alias("item"))


def header_of(written: DataFrame, closing: str, ddl: str) -> DataFrame:
    """The header line of each document, closed and read as JSON."""
    return written.where("section = 0").select(*[c for c in written.columns if c not in ("section", "place", "line")], F.from_json(F.concat("line", F.lit(closing)), ddl).alias("header"))


# Lines of documents that are looked at together, and lines of a document that a task holds.
LINES, MOST_LINES = 50_000, 200_000


def _pairer(closing: str, named: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines as they lie, in the order of a file: whole documents give a row per item of both sections, other lines come out again."""

    def column(table: pa.Table, name: str) -> pa.Array:
        found = table.column(name)
        return found.chunk(0) if found.num_chunks == 1 else pa.concat_arrays(found.chunks)

    def name_of(line: str) -> str | None:
        value = json.loads(line + closing)
        for key in named:
            value = value.get(key) if isinstance(value, dict) else None
        return value

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        project, line = column(table, "project_id"), column(table, "line")
        section, place = (column(table, c).to_numpy(zero_copy_only=False) for c in ("section", "place"))
        heads, n = np.flatnonzero(section == 0), len(section)
        whole = np.zeros(n, dtype=bool)
        if len(heads):
            of = np.cumsum(section == 0) - 1
            items = (np.diff(np.append(heads, n)) - 3) // 2  # a head, the items, what stands between, the items again, a foot
            inside = of >= 0
            w, c = np.arange(n) - heads[of], items[of]
            wanted = np.select([w == 0, w <= c, w == c + 1, w <= 2 * c + 1, w == 2 * c + 2], [0, 1, 2, 3, 4], -1)
            at = np.select([wanted == 1, wanted == 3], [w - 1, w - c - 2], 0)
            other = np.zeros(n, dtype=bool)
            other[1:] = pc.not_equal(project.slice(1), project.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            right = inside & (section == wanted) & (place == at) & ~(other & (section != 0))
            good = np.logical_and.reduceat(right, heads) & (np.diff(np.append(heads, n)) == 2 * items + 3) & (items >= 0)
            whole = inside & good[of]
            mine = np.flatnonzero(whole & (section == 1))
            names = pa.array([name_of(text) for text in line.take(pa.array(heads[good])).to_pylist()], pa.string())
            yield batch(len(mine), name=names.take(pa.array((np.cumsum(good) - 1)[of[mine]])), first=line.take(pa.array(mine)), second=line.take(pa.array(mine + items[of[mine]] + 1)))
        left = pa.array(np.flatnonzero(~whole))
        yield batch(len(left), project_id=project.take(left), section=pa.array(section).take(left), place=pa.array(place).take(left), line=line.take(left), kind=project.type)

    def batch(size: int, kind: pa.DataType | None = None, **columns) -> pa.RecordBatch:
        types = {"project_id": kind or key[0], "section": pa.int32(), "place": pa.int64(), "line": pa.string(), "name": pa.string(), "first": pa.string(), "second": pa.string()}
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(size, t) for c, t in types.items()], names=list(types))

    key: list[pa.DataType] = []

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for some in batches:
            if not some.num_rows:
                continue
            key[:] = [some.schema.field("project_id").type]
            held.append(some)
            if sum(b.num_rows for b in held) < LINES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            section = column(table, "section").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(section == 0)
            last = int(heads[-1]) if len(heads) and not (section[heads[-1] :] == 4).any() and len(section) - heads[-1] < MOST_LINES else len(section)
            held = table.slice(last).to_batches() if last < len(section) else []
            if last:
                yield from parts(table.slice(0, last).combine_chunks())
        if held:
            yield from parts(pa.Table.from_batches(held).combine_chunks())

    return pair


def paired_sections(written: DataFrame, closing: str, named: list[str]) -> DataFrame:
    """The items of both sections of written documents side by side, without a shuffle where a document lies whole in a file.

    ``written`` has (project_id, section, place, line) and as many items in one section as in the other. Rows have ``name``, found
    by its keys in the header, and the lines ``first`` and ``second``; lines of documents that go on in other files are rows
    of (project_id, section, place, line).
    """
    ship_package(written.sparkSession)
    lines = written.where("project_id IS NOT NULL").select("project_id", "section", "place", "line")
    schema = lines.select("project_id").schema.add("section", IntegerType()).add("place", LongType())
    for name in ("line", "name", "first", "second"):
        schema = schema.add(name, StringType())
    return lines.mapInArrow(_pairer(closing, named), schema)


def item_in(line: Column, ddl: str) -> Column:
    """The item of a line, read as JSON again."""
    return F.from_json(F.regexp_replace(line, "^,", ""), ddl)


def opened(struct: Column, name: str) -> Column:
    """The JSON of an object that is left open behind a new, open array."""
    return F.concat(F.regexp_replace(F.to_json(struct), r"\}$", ""), F.lit(f',"{name}":['))


# ---- K1 ----


def findings_documents(findings: DataFrame) -> DataFrame:
    """K1: scan report per scanner and project: counts and findings."""
    keys = ["scanner", "project_id"]
    fields = ["cve_id", "severity", "package", "version", "patched_version", "file_path"]
    counts = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"),
    )
    header = F.struct("scanner", F.col("project_id").alias("target"), F.struct("total", "critical", "high").alias("summary"))
    return document_lines(keys, counts, [opened(header, "findings"), F.lit("]}")], [placed_items(findings, keys, fields, F.struct(*fields))])


# ---- K2 ----


def sarif_findings(advisories: DataFrame | None = None, malware: DataFrame | None = None, secrets: DataFrame | None = None, lock: DataFrame | None = None) -> DataFrame:
    """K2: findings of every kind in one shape: project_id, rule_id, title, severity, message, file_path, line_no.

    ``advisories`` has cve_id and package facts, ``malware`` and ``secrets`` are rule matches (malware with an explanation),
    ``lock`` are lockfile issues of the file ``file_path``.
    """
    parts = []
    if advisories is not None:
        parts.append(advisories.select("project_id", F.col("cve_id").alias("rule_id"), F.concat(F.lit("Advisory "), "cve_id").alias("title"), "severity",
                                       F.concat("package", F.lit(" "), "version").alias("message"), "file_path", F.col("line_no").cast("long").alias("line_no")))
    if malware is not None:
        parts.append(malware.select("project_id", F.concat(F.lit("MALWARE-"), "rule_id").alias("rule_id"), F.col("name").alias("title"), F.col("threat_level").alias("severity"),
                                    F.concat("name", F.lit(": "), "explanation").alias("message"), F.col("path").alias("file_path"), F.col("line_no").cast("long").alias("line_no")))
    if secrets is not None:
        parts.append(secrets.select("project_id", F.concat(F.lit("SECRET-"), F.upper("rule_id")).alias("rule_id"), F.col("name").alias("title"), F.col("threat_level").alias("severity"),
                                    F.concat("name", F.lit(": "), "masked").alias("message"), F.col("path").alias("file_path"), F.col("line_no").cast("long").alias("line_no")))
    if lock is not None:
        message = F.concat_ws(" ", F.concat(F.regexp_replace("issue_type", "_", " "), F.lit(":")), "package", "version", "detail")
        parts.append(lock.select("project_id", F.concat(F.lit("DEP-"), F.upper("issue_type")).alias("rule_id"), F.regexp_replace("issue_type", "_", " ").alias("title"), "severity",
                                 message.alias("message"), "file_path", F.lit(1).cast("long").alias("line_no")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def sarif_documents(findings: DataFrame) -> DataFrame:
    """K2: SARIF 2.1.0 per project: each rule once (with its gravest severity), then all results."""
    low = F.lower("severity")
    level = lookup(low, SARIF_LEVEL, "warning")
    rules = findings.groupBy("project_id", "rule_id").agg(F.min("title").alias("title"), F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"))
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("title").alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(level.alias("level")).alias("defaultConfiguration"),
        F.create_map(F.lit("security-severity"), lookup(low, SARIF_SCORE, "5.0")).alias("properties"),
    )
    location = F.struct(
        F.struct(
            F.struct(F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(F.col("line_no").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.create_map(F.lit("primary"), fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_no").cast("string"), F.col("message"))).alias("fingerprints"),
    )
    around = [F.lit('{"$schema":"' + SARIF_SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + TOOL + '","rules":['), F.lit(']}},"results":['), F.lit("]}]}")]
    sections = [placed_items(rules, ["project_id"], ["rule_id"], rule), placed_items(findings, ["project_id"], ["rule_id", "file_path", "line_no", "message", level], result)]
    return document_lines(["project_id"], findings.select("project_id").distinct(), around, sections)


# ---- K3, K4 ----


def cyclonedx_documents(parts: DataFrame, depends: DataFrame, created: str) -> DataFrame:
    """K3: CycloneDX 1.4 per project. ``parts`` has the component order; ``depends``: project_id, name, version, depends_on (array of refs)."""
    ref = F.concat("name", F.lit("@"), "version")
    place = (F.col("ordinal") - 1).alias("place")
    component = F.struct(
        F.lit("library").alias("type"), ref.alias("bom-ref"), "name", "version", "purl",
        F.when(F.col("license").isNotNull(), F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license")))).alias("licenses"),
        F.when(F.col("hash_alg").isNotNull(), F.array(F.struct(F.col("hash_alg").alias("alg"), F.col("hash_value").alias("content")))).alias("hashes"),
        F.when(F.col("is_dev"), "optional").alias("scope"),
    )
    joined = parts.join(depends, ["project_id", "name", "version"], "left")
    link = F.struct(ref.alias("ref"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("dependsOn"))
    header = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), F.lit(1).alias("version"),
        F.concat(F.lit("urn:uuid:"), _uuid(F.col("project_id").cast("string"))).alias("serialNumber"),
        F.struct(
            F.lit(created).alias("timestamp"), F.array(F.struct(F.lit(TOOL).alias("name"))).alias("tools"),
            F.struct(F.lit("application").alias("type"), F.concat(F.lit("project-"), "project_id").alias("name")).alias("component"),
        ).alias("metadata"),
    )
    sections = [parts.select("project_id", place, F.to_json(component).alias("item")), joined.select("project_id", place, F.to_json(link).alias("item"))]
    return document_lines(["project_id"], parts.select("project_id").distinct(), [opened(header, "components"), F.lit('],"dependencies":['), F.lit("]}")], sections)


def _uuid(text: Column) -> Column:
    """A name-based id, so that a retried task writes the same document."""
    h = F.md5(text)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in cuts])


def spdx_documents(parts: DataFrame, created: str) -> DataFrame:
    """K4: SPDX 2.3 per project; package ids and places come from the component order, in which direct packages are first."""
    spdx_id = F.concat(F.lit("SPDXRef-Package-"), F.col("ordinal").cast("string"))
    licence = F.coalesce("license", F.lit("NOASSERTION"))
    package = F.struct(
        spdx_id.alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"),
        F.lit(False).alias("filesAnalyzed"),
        F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))).alias("externalRefs"),
        licence.alias("licenseConcluded"), licence.alias("licenseDeclared"),
        F.when(
            F.col("hash_alg").isNotNull(),
            F.array(F.struct(F.replace(F.col("hash_alg"), F.lit("-"), F.lit("")).alias("algorithm"), F.col("hash_value").alias("checksumValue"))),
        ).alias("checksums"),
    )

    def relation(source: Column, kind: str, target: Column) -> Column:
        return F.to_json(F.struct(source.alias("spdxElementId"), F.lit(kind).alias("relationshipType"), target.alias("relatedSpdxElement")))

    name = F.concat(F.lit("project-"), F.col("project_id").cast("string"))
    header = F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), name.alias("name"),
        F.concat(F.lit("https://example.org/sbom/"), name).alias("documentNamespace"),
        F.struct(F.lit(created).alias("created"), F.array(F.lit(f"Tool: {TOOL}")).alias("creators")).alias("creationInfo"),
    )
    projects = parts.select("project_id").distinct()
    packages = parts.select("project_id", (F.col("ordinal") - 1).alias("place"), F.to_json(package).alias("item"))
    described = projects.select("project_id", F.lit(0).alias("place"), relation(F.lit("SPDXRef-DOCUMENT"), "DESCRIBES", F.lit("SPDXRef-Package")).alias("item"))
    direct = parts.where("is_direct").select("project_id", F.col("ordinal").alias("place"), relation(F.lit("SPDXRef-Package"), "DEPENDS_ON", spdx_id).alias("item"))
    return document_lines(["project_id"], projects, [opened(header, "packages"), F.lit('],"relationships":['), F.lit("]}")], [packages, described.unionByName(direct)])


def append_findings(findings: DataFrame, path: str, session: str = "session_date") -> None:
    """K6: append findings to a log that is partitioned by session."""
    findings.write.mode("append").partitionBy(session).parquet(path)


def newest_session(log: DataFrame, session: str = "session_date") -> DataFrame:
    """K6: findings of the newest session; a scalar subquery over the partition column prunes the others before they are read."""
    newest = log.agg(F.max(session)).scalar()
    return log.where(F.col(session) == newest)
