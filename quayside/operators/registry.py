"""Scanner registry (X1, U2): named builders of findings, a quick subset, and user-defined scanners."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.catalogue import advisories as cat
from quayside.operators import detection, evidence, hygiene, matching
from quayside.operators.reports import FINDING_COLUMNS, union_findings
from quayside.session import cut_lineage

RSC = ["react", "react-dom", *cat.RSC_BUNDLERS]


@dataclass(frozen=True)
class ScanTables:
    """What scanners read. ``deps``: project_id, package, spec; ``files``: project_id, folder, name, content; ``scripts``: project_id, script_name, command."""

    deps: DataFrame
    files: DataFrame
    scripts: DataFrame
    ready: DataFrame | None = None

    def keyed(self) -> DataFrame:
        return matching.with_version(self.deps) if self.ready is None else self.ready

    def landed(self) -> ScanTables:
        """The same tables with the keyed declarations written once, for scanners that would each read and key them."""
        return replace(self, ready=cut_lineage(self.keyed(), "keyed"))


Scanner = Callable[[ScanTables], DataFrame]
SCANNERS: dict[str, Scanner] = {}
QUICK: set[str] = set()


def scanner(name: str, quick: bool = True):
    """Register a scanner; quick ones look at manifests and versions only."""

    def keep(build: Scanner) -> Scanner:
        SCANNERS[name] = build
        if quick:
            QUICK.add(name)
        return build

    return keep


def as_findings(rows: DataFrame, name: str, method: str) -> DataFrame:
    """Fill the findings schema; columns a scanner does not know are null."""
    have = set(rows.columns)
    fixed = {"scanner": F.lit(name), "detection_method": F.lit(method)}
    return rows.select(
        *[fixed.get(c, F.col(c) if c in have else F.lit(None)).cast("bigint" if c == "project_id" else "string").alias(c) for c in FINDING_COLUMNS]
    )


def _catalogue_findings(t: ScanTables, packages: list[str]) -> DataFrame:
    known = cat.catalogue(t.deps.sparkSession)
    ranges = F.broadcast(matching.catalogue_intervals(known))
    found = matching.match_versions(t.keyed().where(F.col("package").isin(packages)), ranges)
    return matching.patch_lookup(found, F.broadcast(matching.patch_table(known)))


def _with_severity(found: DataFrame) -> DataFrame:
    severity = cat.catalogue(found.sparkSession).select("cve_id", "severity")
    return found.join(F.broadcast(severity), "cve_id", "left")


@scanner("react")
def react(t: ScanTables) -> DataFrame:
    found = _catalogue_findings(t, RSC)
    shown = evidence.keep_with_evidence(found, evidence.rsc_evidence(t.keyed(), t.files))
    return as_findings(shown, "react", "manifest")


@scanner("nextjs")
def nextjs(t: ScanTables) -> DataFrame:
    return as_findings(_with_severity(matching.middleware_line_match(t.keyed())).withColumnRenamed("patched", "patched_version"), "nextjs", "manifest")


@scanner("npm")
def npm(t: ScanTables) -> DataFrame:
    return as_findings(_with_severity(matching.threshold_match(t.keyed())), "npm", "manifest")


@scanner("nodejs")
def nodejs(t: ScanTables) -> DataFrame:
    runtime = t.keyed().where("package = 'node'")
    return as_findings(_with_severity(matching.runtime_line_match(runtime)).withColumnRenamed("fixed", "patched_version"), "nodejs", "version_check")


@scanner("n8n")
def n8n(t: ScanTables) -> DataFrame:
    return as_findings(_with_severity(matching.multi_branch_fix_match(t.keyed())).withColumnRenamed("fixed", "patched_version"), "n8n", "version_check")


@scanner("supply-chain", quick=False)
def supply_chain(t: ScanTables) -> DataFrame:
    bad = hygiene.compromised(t.keyed()).withColumnRenamed("safe_version", "patched_version")
    scripts = detection.first_script_finding(t.scripts).select("project_id", F.lit("SUSPICIOUS-SCRIPT").alias("cve_id"), F.lit("HIGH").alias("severity"))
    files = evidence.indicator_files(t.files).select(
        "project_id", F.concat("folder", "name").alias("file_path"), F.lit("MALWARE-INDICATOR").alias("cve_id"), F.lit("CRITICAL").alias("severity")
    )
    tokens = detection.registry_tokens(t.files).select(
        "project_id", F.concat("folder", "name").alias("file_path"), F.lit("NPM-TOKEN-EXPOSURE").alias("cve_id"), F.lit("CRITICAL").alias("severity")
    )
    return union_findings(
        [
            as_findings(bad, "supply-chain", "compromised_package"), as_findings(scripts, "supply-chain", "script_analysis"),
            as_findings(files, "supply-chain", "indicator_file"), as_findings(tokens, "supply-chain", "token_scan"),
        ]
    )


@scanner("gateway", quick=False)
def gateway(t: ScanTables) -> DataFrame:
    found = _catalogue_findings(t, cat.GATEWAY)
    proxies = t.files.where(F.col("content").rlike("(?i)" + detection.book.PROXY_RULE)).select(
        "project_id", F.concat("folder", "name").alias("file_path"), F.lit("CLAWDBOT-AUTH-BYPASS").alias("cve_id"), F.lit("CRITICAL").alias("severity")
    )
    return union_findings([as_findings(found, "gateway", "manifest"), as_findings(proxies, "gateway", "proxy_config")])


def run_scanners(tables: ScanTables, names: list[str] | None = None, quick: bool = False) -> DataFrame:
    """Findings of the chosen scanners; ``quick`` keeps those that read manifests and versions only.

    Declarations are read and keyed once, in a table that all chosen scanners share.
    """
    chosen = list(SCANNERS) if names is None else names
    unknown = [n for n in chosen if n not in SCANNERS]
    if unknown:
        raise ValueError(f"unknown scanners {unknown}; registered: {list(SCANNERS)}")
    if quick:
        chosen = [n for n in chosen if n in QUICK]
    if len(chosen) > 1:
        tables = tables.landed()
    return union_findings([SCANNERS[n](tables) for n in chosen])


def default_tables(t) -> ScanTables:
    """The registered queries' tables: project keys are the same in all three."""
    files = t.view("v_project_files").drop("project_id").withColumnRenamed("file_id", "project_id")
    return ScanTables(t.view("v_stack"), files, t.view("v_scripts"))
