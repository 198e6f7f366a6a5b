"""The advisory catalogue. Identifiers, packages, ranges and patches that results must agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import fixed_table

RCE = "Remote Code Execution"
BYPASS = "Authorization Bypass"
TRAVERSAL = "Path Traversal"
DOS = "Denial of Service"
DISCLOSURE = "Information Disclosure"
SUPPLY_CHAIN = "Supply Chain Attack"
PERMISSION = "Permission Model Bypass"

RSC_BUNDLERS = ["react-server-dom-webpack", "react-server-dom-parcel", "react-server-dom-turbopack"]
NODE_LINES = {"20.x": "20.20.0", "22.x": "22.22.0", "24.x": "24.13.0", "25.x": "25.3.0"}
GATEWAY = ["clawdbot", "moltbot"]


def _row(category, cve_id, title, severity, cvss, vuln_type, packages, affected, patched, difficulty, **flags):
    return {
        "category": category,
        "cve_id": cve_id,
        "title": title,
        "severity": severity,
        "cvss_score": cvss,
        "vuln_type": vuln_type,
        "packages": packages,
        "affected_versions": affected,
        "patched_versions": patched,
        "difficulty": difficulty,
        "cisa_kev": flags.get("kev", False),
        "public_poc": flags.get("poc", False),
        "active_exploitation": flags.get("active", False),
        "requires_auth": flags.get("auth", False),
        "platform": flags.get("platform"),
    }


# The 32 advisories, in catalogue order.
ADVISORIES = [
    _row("react_rsc", "CVE-2025-55182", "React Server Components RCE (React2Shell)", "CRITICAL", 10.0, RCE,
         ["react", *RSC_BUNDLERS], ["19.0.0", "19.1.0", "19.1.1", "19.2.0"],
         {"19.0.0": "19.0.1", "19.1.0": "19.1.2", "19.1.1": "19.1.2", "19.2.0": "19.2.1"}, "Trivial",
         kev=True, poc=True, active=True),
    _row("react_rsc", "CVE-2025-66478", "Next.js Server Components RCE (Vercel Advisory)", "CRITICAL", 10.0, RCE,
         ["next"],
         ["15.0.0", "15.0.1", "15.0.2", "15.0.3", "15.0.4",
          "15.1.0", "15.1.1", "15.1.2", "15.1.3", "15.1.4", "15.1.5", "15.1.6", "15.1.7", "15.1.8",
          "15.2.0", "15.2.1", "15.2.2", "15.2.3", "15.2.4", "15.2.5",
          "15.3.0", "15.3.1", "15.3.2", "15.3.3", "15.3.4", "15.3.5",
          "15.4.0", "15.4.1", "15.4.2", "15.4.3", "15.4.4", "15.4.5", "15.4.6", "15.4.7",
          "15.5.0", "15.5.1", "15.5.2", "15.5.3", "15.5.4", "15.5.5", "15.5.6",
          "16.0.0", "16.0.1", "16.0.2", "16.0.3", "16.0.4", "16.0.5", "16.0.6"],
         {"15.0.x": "15.0.5", "15.1.x": "15.1.9", "15.2.x": "15.2.6", "15.3.x": "15.3.6", "15.4.x": "15.4.8",
          "15.5.x": "15.5.7", "16.0.x": "16.0.7"}, "Trivial", poc=True, active=True),
    _row("react_rsc", "CVE-2025-55183", "React Server Components Source Code Exposure", "MEDIUM", 5.3, DISCLOSURE,
         RSC_BUNDLERS, ["19.0.0-19.2.2"], {"19.0.x": "19.0.3", "19.1.x": "19.1.4", "19.2.x": "19.2.3"}, "Easy",
         poc=True),
    _row("react_rsc", "CVE-2025-55184", "React Server Components DoS (Infinite Loop)", "HIGH", 7.5, DOS,
         RSC_BUNDLERS, ["19.0.0", "19.0.1", "19.1.0", "19.1.1", "19.2.0", "19.2.1"],
         {"19.0.x": "19.0.2", "19.1.x": "19.1.2", "19.2.x": "19.2.2"}, "Easy"),
    _row("react_rsc", "CVE-2025-67779", "React Server Components DoS (Incomplete Fix)", "HIGH", 7.5, DOS,
         RSC_BUNDLERS, ["19.0.2", "19.1.3", "19.2.2"],
         {"19.0.x": "19.0.3", "19.1.x": "19.1.4", "19.2.x": "19.2.3"}, "Easy"),
    _row("nextjs", "CVE-2025-29927", "Next.js Middleware Authorization Bypass", "CRITICAL", 9.1, BYPASS, ["next"],
         ["11.1.4", "12.0.0", "12.1.0", "12.2.0", "12.3.0", "12.3.4",
          "13.0.0", "13.1.0", "13.2.0", "13.3.0", "13.4.0", "13.5.0", "13.5.6",
          "14.0.0", "14.1.0", "14.2.0", "14.2.24", "15.0.0", "15.1.0", "15.2.0", "15.2.2"],
         {"12.x": "12.3.5", "13.x": "13.5.7", "14.x": "14.2.25", "15.x": "15.2.3"}, "Trivial", poc=True),
    _row("n8n", "CVE-2026-21858", "n8n Unauthenticated RCE (Ni8mare)", "CRITICAL", 10.0, RCE, ["n8n"],
         ["<1.121.0"], {"<1.121.0": "1.121.0"}, "Trivial", poc=True),
    _row("n8n", "CVE-2025-68613", "n8n Authenticated Expression Injection RCE", "CRITICAL", 9.9, RCE,
         ["n8n-workflow", "n8n"], ["0.211.0-1.120.3", "1.121.0", "1.122.0-RC"],
         {"1.120.x": "1.120.4", "1.121.x": "1.121.1", "1.122.x": "1.122.0"}, "Easy", poc=True, auth=True),
    _row("n8n", "CVE-2025-68668", "n8n Python Code Node RCE", "HIGH", 8.0, RCE, ["@n8n/config", "n8n"],
         ["<1.120.0"], {"<1.120.0": "1.120.0"}, "Moderate", auth=True),
    _row("nodejs", "CVE-2025-59465", "Node.js HTTP/2 Server Crash", "HIGH", 7.5, DOS, ["node"],
         ["18.x", "20.x", "22.x", "24.x", "25.x"], NODE_LINES, "Easy"),
    _row("nodejs", "CVE-2025-59464", "Node.js TLS Memory Leak DoS", "MEDIUM", 6.5, DOS, ["node"],
         ["20.x", "22.x", "24.x", "25.x"], NODE_LINES, "Moderate"),
    _row("nodejs", "CVE-2025-59466", "Node.js async_hooks Stack Exhaustion", "MEDIUM", 6.5, DOS, ["node"],
         ["20.x", "22.x", "24.x", "25.x"], NODE_LINES, "Moderate"),
    _row("nodejs", "CVE-2025-27210", "Node.js Windows Path Traversal (Device Names)", "HIGH", 7.0, TRAVERSAL, ["node"],
         ["20.x", "22.x", "24.x"], {"all": "July 2025 security release"}, "Easy", platform="Windows"),
    _row("nodejs", "CVE-2025-23084", "Node.js Windows Drive Name Path Traversal", "MEDIUM", 5.6, TRAVERSAL, ["node"],
         ["18.x", "20.x", "22.x", "23.x"], {}, "Easy", platform="Windows"),
    _row("nodejs", "CVE-2024-21891", "Node.js Permission Model Bypass", "HIGH", 8.8, PERMISSION, ["node"],
         ["20.0.0-20.11.0", "21.0.0-21.6.1"], {"20.x": "20.11.1", "21.x": "21.6.2"}, "Moderate"),
    _row("nodejs", "CVE-2025-55130", "Node.js Symlink Permission Bypass", "HIGH", 7.5, PERMISSION, ["node"],
         ["20.x", "22.x", "24.x", "25.x"], NODE_LINES, "Moderate"),
    _row("nodejs", "CVE-2026-21636", "Node.js Unix Domain Socket Permission Bypass", "MEDIUM", 6.0, PERMISSION,
         ["node"], ["20.x", "22.x", "24.x", "25.x"], NODE_LINES, "Moderate", platform="Linux"),
    _row("nodejs", "CVE-2025-55132", "Node.js fs.futimes() Permission Bypass", "LOW", 3.5, PERMISSION, ["node"],
         ["20.x", "22.x", "24.x", "25.x"], NODE_LINES, "Moderate"),
    _row("npm_packages", "CVE-2024-21534", "jsonpath-plus Remote Code Execution", "CRITICAL", 9.8, RCE,
         ["jsonpath-plus"], ["<10.2.0"], {"<10.2.0": "10.2.0"}, "Trivial", poc=True),
    _row("npm_packages", "CVE-2025-1302", "jsonpath-plus RCE (Incomplete Fix)", "CRITICAL", 9.8, RCE,
         ["jsonpath-plus"], ["10.0.0", "10.1.0"], {"10.x": "10.2.0"}, "Trivial", poc=True),
    _row("npm_packages", "CVE-2024-21508", "mysql2 Remote Code Execution", "CRITICAL", 9.8, RCE, ["mysql2"],
         ["<3.9.4"], {"<3.9.4": "3.9.4"}, "Easy"),
    _row("npm_packages", "CVE-2024-45590", "body-parser Denial of Service", "HIGH", 7.5, DOS, ["body-parser"],
         ["<1.20.3"], {"<1.20.3": "1.20.3"}, "Easy"),
    _row("npm_packages", "CVE-2025-48997", "multer Denial of Service", "CRITICAL", 9.0, DOS, ["multer"],
         ["1.4.4-lts.1", "<2.0.1"], {"<2.0.1": "2.0.1"}, "Easy"),
    _row("npm_packages", "CVE-2025-47944", "multer Multiple Vulnerabilities", "HIGH", 7.5, DOS,
         ["multer", "@nestjs/platform-express"], ["1.4.4-lts.1"], {"1.4.4-lts.1": "2.0.0"}, "Moderate"),
    _row("npm_packages", "CVE-2024-34344", "Nuxt.js Test Mode RCE", "HIGH", 8.0, RCE, ["nuxt"], ["<3.12.4"],
         {"<3.12.4": "3.12.4"}, "Moderate"),
    _row("npm_packages", "CVE-2024-13059", "AnythingLLM Path Traversal to RCE", "HIGH", 7.5, TRAVERSAL,
         ["AnythingLLM"], ["<1.3.1"], {"<1.3.1": "1.3.1"}, "Moderate", auth=True),
    _row("npm_packages", "CVE-2026-21440", "AdonisJS Bodyparser Path Traversal", "CRITICAL", 9.2, TRAVERSAL,
         ["@adonisjs/bodyparser"], ["<9.0.0"], {"<9.0.0": "9.0.0"}, "Easy"),
    _row("supply_chain", "CVE-2025-54313", "eslint-config-prettier Supply Chain Attack", "HIGH", 7.5, SUPPLY_CHAIN,
         ["eslint-config-prettier", "eslint-plugin-prettier", "synckit", "@pkgr/core", "napi-postinstall"],
         ["8.10.1", "9.1.1", "10.1.6", "10.1.7"], {"8.x": "8.10.2", "9.x": "9.1.2", "10.x": "10.1.8"}, "Trivial",
         platform="Windows"),
    _row("gateway", "CLAWDBOT-AUTH-BYPASS", "Clawdbot/Moltbot Localhost Trust Auth Bypass", "CRITICAL", 9.8, BYPASS,
         GATEWAY, ["<2.0.0"], {}, "Trivial", poc=True, active=True),
    _row("gateway", "CLAWDBOT-PLAINTEXT-CREDS", "Clawdbot/Moltbot Plaintext OAuth Token Storage", "HIGH", 7.5,
         DISCLOSURE, GATEWAY, ["*"], {}, "Trivial", poc=True),
    _row("gateway", "CLAWDBOT-PROMPT-RCE", "Clawdbot/Moltbot Prompt Injection to RCE", "CRITICAL", 9.0, RCE,
         GATEWAY, ["*"], {}, "Easy", poc=True, active=True),
    _row("gateway", "CLAWDBOT-QSTRING-AUTH", "Clawdbot/Moltbot Query String Token Authentication", "MEDIUM", 5.3,
         DISCLOSURE, GATEWAY, ["*"], {}, "Easy"),
]

ADVISORY_DDL = (
    "category string, cve_id string, title string, severity string, cvss_score double, vuln_type string, "
    "packages array<string>, affected_versions array<string>, patched_versions map<string,string>, difficulty string, "
    "cisa_kev boolean, public_poc boolean, active_exploitation boolean, requires_auth boolean, platform string"
)

# Two supply-chain campaigns and their indicators.
CAMPAIGNS = [
    {
        "campaign": "Shai-Hulud",
        "severity": "CRITICAL",
        "packages": ["@postman/security-helpers", "@posthog/plugin-geoip", "@asyncapi/openapi-schema-parser",
                     "@ensdomains/content-hash", "@zapier/secret-scrubber"],
        "indicators": ["bun_environment.js", "setup_bun.js", "cloud.json", "truffleSecrets.json", ".truffler-cache",
                       ".truffler", "trufflehog"],
        "file_patterns": [r"bun_environment\.js$", r"setup_bun\.js$", r"\.truffler-cache", r"truffleSecrets\.json$"],
        "script_patterns": [r"preinstall.*curl.*\|.*sh", r"postinstall.*wget", r"preinstall.*base64.*-d",
                            r"install.*eval.*\$\(", r"npm.*token", r"github\.com.*Shai-Hulud"],
    },
    {
        "campaign": "Shai-Hulud 2.0 (The Second Coming)",
        "severity": "CRITICAL",
        "packages": [],
        "indicators": ["dead man's switch mechanism", "preinstall hook abuse"],
        "file_patterns": [],
        "script_patterns": [r"preinstall.*--ignore-scripts", r"npm.*run.*--ignore-scripts=false"],
    },
]

# Thresholds per package: every version below is affected, or the listed ones only.
PACKAGE_THRESHOLDS = [
    {"package": "mysql2", "cves": ["CVE-2024-21508"], "affected": ["<3.9.4"]},
    {"package": "jsonpath-plus", "cves": ["CVE-2024-21534", "CVE-2025-1302"], "affected": ["<10.2.0"]},
    {"package": "body-parser", "cves": ["CVE-2024-45590"], "affected": ["<1.20.3"]},
    {"package": "multer", "cves": ["CVE-2025-48997", "CVE-2025-47944"], "affected": ["<2.0.1"]},
    {"package": "nuxt", "cves": ["CVE-2024-34344"], "affected": ["<3.12.4"]},
    {"package": "@adonisjs/bodyparser", "cves": ["CVE-2026-21440"], "affected": ["<9.0.0"]},
    {"package": "@nestjs/platform-express", "cves": ["CVE-2025-47944"], "affected": ["1.4.4-lts.1"]},
]

# Runtime lines (major, first affected, fixed) and the CVEs of each line.
RUNTIME_CVES = ["CVE-2025-59465", "CVE-2025-59464", "CVE-2025-59466", "CVE-2025-55130", "CVE-2026-21636",
                "CVE-2025-55132"]
RUNTIME_LINES = [
    *[{"major": m, "cve_id": c, "first": f"{m}.0.0", "fixed": fixed}
      for m, fixed in ((20, "20.20.0"), (22, "22.22.0"), (24, "24.13.0"), (25, "25.3.0")) for c in RUNTIME_CVES],
    {"major": 20, "cve_id": "CVE-2024-21891", "first": "20.0.0", "fixed": "20.11.1"},
]
WINDOWS_ONLY_CVES = ["CVE-2025-27210", "CVE-2025-23084"]
UNIX_ONLY_CVES = ["CVE-2026-21636"]

# Middleware bypass by framework major: first affected, range, patch (none for 11).
MIDDLEWARE_LINES = [
    {"major": 11, "affected": ">=11.1.4, <=11.999.999", "patched": None},
    {"major": 12, "affected": ">=12.0.0, <12.3.5", "patched": "12.3.5"},
    {"major": 13, "affected": ">=13.0.0, <13.5.7", "patched": "13.5.7"},
    {"major": 14, "affected": ">=14.0.0, <14.2.25", "patched": "14.2.25"},
    {"major": 15, "affected": ">=15.0.0, <15.2.3", "patched": "15.2.3"},
]

# Workflow-engine fixes; a version at or above an alternative fix is not affected.
MULTI_BRANCH_FIXES = [
    {"package": "n8n", "cve_id": "CVE-2026-21858", "fixed": "1.121.0", "alt_fixed": [], "auth_required": False},
    {"package": "n8n", "cve_id": "CVE-2025-68613", "fixed": "1.120.4", "alt_fixed": ["1.121.1", "1.122.0"],
     "auth_required": True},
    {"package": "n8n", "cve_id": "CVE-2025-68668", "fixed": "1.120.0", "alt_fixed": [], "auth_required": True},
]

# First-generation lists: exact framework versions with patches, and minor lines of the meta-framework.
LEGACY_REACT = {"19.0.0": "19.0.1", "19.1.0": "19.1.2", "19.1.1": "19.1.2", "19.2.0": "19.2.1"}
LEGACY_REACT_DEFAULT = "19.1.2"
LEGACY_NEXT = [
    {"line": "15.0", "affected": "15.0.0-15.0.4", "patched": "15.0.5"},
    {"line": "15.1", "affected": "15.1.0-15.1.8", "patched": "15.1.9"},
    {"line": "15.2", "affected": "15.2.0-15.2.5", "patched": "15.2.6"},
    {"line": "15.3", "affected": "15.3.0-15.3.5", "patched": "15.3.6"},
    {"line": "15.4", "affected": "15.4.0-15.4.7", "patched": "15.4.8"},
    {"line": "15.5", "affected": "15.5.0-15.5.6", "patched": "15.5.7"},
    {"line": "16.0", "affected": "16.0.0-16.0.6", "patched": "16.0.7"},
]
LEGACY_CANARY_PATCH = "15.6.0-canary.58 or 16.1.0-canary.12+"
NEXT_PATCH_PREFIXES = {"16.": "16.0.7", "15.5.": "15.5.7", "15.4.": "15.4.8", "15.3.": "15.3.6", "15.2.": "15.2.6",
                       "15.1.": "15.1.9", "15.0.": "15.0.5"}
NEXT_PATCH_DEFAULT = "15.5.7"
SERVER_COMPONENT_PACKAGES = RSC_BUNDLERS
AFFECTED_FRAMEWORKS = ["next", "react-router", "waku", "@parcel/rsc", "@vitejs/plugin-rsc", "rwsdk"]
RSC_PACKAGES = [*RSC_BUNDLERS, "@parcel/rsc", "@vitejs/plugin-rsc"]
RSC_CVES = ["CVE-2025-55182", "CVE-2025-55183", "CVE-2025-55184", "CVE-2025-67779"]


def catalogue(spark: SparkSession) -> DataFrame:
    """All 32 advisories, every category in one table."""
    parts = [
        fixed_table(spark, [a for a in ADVISORIES if a["category"] == c], ADVISORY_DDL)
        for c in dict.fromkeys(a["category"] for a in ADVISORIES)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def by_package(catalogue_df: DataFrame) -> DataFrame:
    """One row per (advisory, package)."""
    return catalogue_df.withColumn("package", F.explode("packages")).drop("packages")

# Our own wording for the advisories that get an explanation: why it matters, what is gained, how it is found.
CVE_EXPLANATIONS = {
    "CVE-2025-29927": ("An internal header switches the middleware off.", "Pages behind the middleware open without its checks.", "Version range, middleware files and sign-in code."),
    "CVE-2025-55182": ("Image addresses end up in the cache as they come.", "Visitors get cached content of the attacker's choice.", "Version range, use of the image component and its hosts."),
    "CVE-2024-34351": ("Redirects of server actions trust the Host header.", "Internal services answer to outside requests.", "Version range, server actions and redirects."),
    "CVE-2024-47831": ("Image optimisation takes requests of any cost.", "The server runs out of time or memory.", "Version range and image settings."),
}
