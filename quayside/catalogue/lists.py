"""Word lists and small tables that results depend on."""

from __future__ import annotations

# Known misspellings and the package that was meant.
TYPOS = {
    "lodahs": "lodash", "lodashs": "lodash", "loadsh": "lodash", "axois": "axios", "axio": "axios",
    "expresss": "express", "expres": "express", "recat": "react", "recact": "react", "raect": "react",
    "angualr": "angular", "agular": "angular", "momnet": "moment", "momment": "moment",
    "underscroe": "underscore", "undersore": "underscore", "jqeury": "jquery", "jqurey": "jquery",
    "webapck": "webpack", "wepback": "webpack", "bable": "babel", "babael": "babel", "eslnt": "eslint",
    "esllint": "eslint", "typescirpt": "typescript", "typescrpt": "typescript",
}

# Popular package names.
POPULAR = [
    "react", "lodash", "express", "axios", "moment", "jquery", "vue", "angular", "webpack", "babel", "typescript",
    "eslint", "prettier", "jest", "mocha", "chai", "underscore", "async", "request", "bluebird", "chalk", "commander",
    "inquirer", "debug", "uuid", "dotenv", "cors", "body-parser", "mongoose", "sequelize", "redux", "next", "gatsby",
    "nuxt", "svelte",
]

# Problematic dependencies (kind, points, advice).
PROBLEMATIC = {
    "request": ("deprecated", 10, "Use axios or node-fetch instead"),
    "node-uuid": ("deprecated", 5, "Use uuid package instead"),
    "mkdirp": ("deprecated", 3, "Use fs.mkdir with recursive option"),
    "event-stream": ("malware-history", 15, "Package was compromised in 2018"),
    "flatmap-stream": ("malware", 20, "Known malicious package"),
    "eslint-scope": ("compromised-history", 10, "Package was compromised"),
}
WILDCARD_SPECS = ["*", "latest", ""]

# Compromised packages: bad versions (empty: presence of a campaign package is enough).
COMPROMISED = [
    {"package": "eslint-config-prettier", "bad_versions": ["8.10.1", "9.1.1", "10.1.6", "10.1.7"], "safe_version": "8.10.2",
     "cve_id": "CVE-2025-54313", "severity": "HIGH", "campaign": None},
    {"package": "eslint-plugin-prettier", "bad_versions": [], "safe_version": "latest", "cve_id": "CVE-2025-54313", "severity": "MEDIUM", "campaign": None},
    {"package": "synckit", "bad_versions": [], "safe_version": "latest", "cve_id": "CVE-2025-54313", "severity": "MEDIUM", "campaign": None},
    *[{"package": p, "bad_versions": [], "safe_version": "latest", "cve_id": "NO-CVE", "severity": "CRITICAL", "campaign": "Shai-Hulud"}
      for p in ("@postman/security-helpers", "@posthog/plugin-geoip", "@asyncapi/openapi-schema-parser",
                "@ensdomains/content-hash", "@zapier/secret-scrubber")],
]

# Scopes a campaign used, and packages in them that are legitimate.
SUSPICIOUS_SCOPES = ["@postman", "@posthog", "@asyncapi", "@ensdomains", "@zapier"]
LEGITIMATE = ["@postman/newman", "@postman/tunnel-agent", "@asyncapi/parser", "@asyncapi/generator"]

# Campaign files, folders and workflows in a project.
MALICIOUS_FILES = ["bun_environment.js", "setup_bun.js", "cloud.json", "truffleSecrets.json", "contents.json",
                   "environment.json", "trufflehog.exe", "trufflehog"]
MALICIOUS_DIRS = [".truffler-cache", ".truffler"]
MALICIOUS_WORKFLOWS = ["discussion.yaml"]

# Registries and hosts of resolved addresses.
PUBLIC_REGISTRIES = ["registry.npmjs.org", "registry.yarnpkg.com"]
GIT_HOSTS = ["github.com", "gitlab.com", "bitbucket.org", ".git"]

# Path contexts; the first group that matches wins.
PATH_CONTEXTS = {
    "exploit_data": [r"metasploit[-_]?framework", r"exploit[-_]?db", r"/exploits?/", r"/payloads?/", r"poc[-_]?",
                     r"proof[-_]?of[-_]?concept", r"cve[-_]\d{4}[-_]\d+"],
    "research": [r"/research/", r"/investigation/", r"/analysis/", r"/samples?/", r"/hackerone/programs/", r"/bugcrowd/"],
    "node_modules": [r"/node_modules/"],
    "test_fixtures": [r"/test[-_]?fixtures?/", r"/__tests__/", r"/test[-_]?data/", r"\.test\.", r"\.spec\."],
    "archive": [r"/archive/", r"/backup/", r"/old/", r"/deprecated/", r"\.bak"],
    "vendor": [r"/vendor/", r"/third[-_]?party/", r"/external/"],
}
PRODUCTION = "production"
NOT_ACTIONABLE_CONTEXTS = ["exploit_data", "research", "archive", "test_fixtures"]
NON_PRODUCTION_WORDS = ["exploit", "poc", "cve-", "research", "sample", "test", "archive", "metasploit", "nuclei", "/data/", "demo"]
SKIP_NON_PRODUCTION = "Exploit/PoC/Research data"
SKIP_NO_PATCH = "No patch available"

# Ignore patterns that always hold, in order.
DEFAULT_IGNORES = [
    "node_modules/", "vendor/", "bower_components/", ".pnpm/", ".yarn/",
    "dist/", "build/", "out/", ".next/", ".nuxt/", ".output/",
    ".cache/", ".parcel-cache/", ".turbo/",
    ".idea/", ".vscode/", "*.swp", "*.swo", "*~",
    ".git/", ".svn/", ".hg/",
    "coverage/", ".nyc_output/",
    "*.log", "npm-debug.log*", "yarn-debug.log*", "yarn-error.log*",
    ".DS_Store", "Thumbs.db",
    "*.min.js", "*.min.css", "*.map",
]

# Folders that a manifest scan never enters, and its lockfile names.
EXCLUDED_DIRS = ["node_modules", ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".mypy_cache", "dist", "build",
                 ".next", ".nuxt", "coverage", ".vscode", ".idea", "venv", ".venv", "env",
                 "Windows", "Program Files", "Program Files (x86)", "ProgramData", "$Recycle.Bin", "System Volume Information"]
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pnpm-lock.yml"]

# Watched and excluded file globs.
WATCH_INCLUDE = ["*.js", "*.ts", "*.jsx", "*.tsx", "*.json", "*.mjs", "*.cjs", "package.json", "package-lock.json", "yarn.lock"]
WATCH_EXCLUDE = ["node_modules/*", ".git/*", "dist/*", "build/*", "coverage/*", "*.min.js", "*.map"]

# Framework files that show use of middleware or of the app router.
MIDDLEWARE_FILES = ["middleware.ts", "middleware.js", "src/middleware.ts", "src/middleware.js"]
APP_DIRS = ["app/", "src/app/"]
APP_ROUTER_FILES = [f"{stem}.{ext}" for ext in ("tsx", "ts", "jsx", "js") for stem in ("layout", "page")]

# Where new files are expected after an install.
EXPECTED_NEW_FILES = ["node_modules/", ".npm-cache/", "package-lock.json", "package.json"]

# Dependency sections of a manifest; a later section overrides an earlier one.
SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
