"""Real files: trees, manifests, lockfiles, audit reports."""

import json

from pyspark.sql import functions as F

from quayside.sources import feeds, files, manifests


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, content string")


def test_file_tree(spark, tmp_path):
    for rel, text in {
        "a/package.json": '{"name": "a", "dependencies": {"x": "1.0.0"}}', "a/node_modules/x/package.json": "{}", "a/.hidden/package.json": "{}",
        "a/b/c/package.json": '{"name": "c"}', "a/yarn.lock": "__metadata:\n", "b/package-lock.json": "{}", "b/.nvmrc": "v20.10.0\n",
    }.items():
        target = tmp_path / rel
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    tree = files.read_files(spark, str(tmp_path))
    found = {r.rel_path for r in files.manifest_scan(tree).collect()}
    assert found == {"a/package.json", "a/b/c/package.json"}
    assert {r.rel_path for r in files.manifest_scan(tree, max_depth=1).collect()} == {"a/package.json"}
    assert {(r.name, r.lock_type) for r in files.lockfile_scan(tree).collect()} == {("yarn.lock", "yarn-berry"), ("package-lock.json", "npm")}
    dotfiles = files.read_dotfiles(tree.where("name IN ('package.json', 'package-lock.json')"))
    assert [(r.name, r.version) for r in files.runtime_versions(dotfiles).collect()] == [(".nvmrc", "20.10.0")]
    assert files.file_snapshot(tree).where("length(hash) = 32").count() == 5


def test_manifest(spark):
    good = '{"name": "a", "dependencies": {"x": "1", "y": "2"}, "devDependencies": {"x": "3"}, "scripts": {"postinstall": "node a"}}'
    parsed = manifests.parse_manifests(docs(spark, good, "{bad", '["list"]', '{"name": "empty"}'))
    assert {r.id for r in parsed.collect()} == {0, 3}
    assert manifests.dependency_rows(parsed, ["id"]).count() == 3
    assert {(r.package, r.spec) for r in manifests.merged_sections(parsed, ["id"]).collect()} == {("x", "3"), ("y", "2")}
    assert manifests.script_rows(parsed, ["id"]).first().command == "node a"


def test_npm_lock_versions(spark):
    v3 = {"lockfileVersion": 3, "packages": {"": {"name": "r"}, "node_modules/a": {"version": "1.0.0", "dev": True}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}
    v1 = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "requires": {"b": "^2"}, "dependencies": {
        "b": {"version": "2.0.0", "dependencies": {"c": {"version": "3.0.0", "dependencies": {"d": {"version": "4.0.0"}}}}}}}, "b": {"version": "1.9.0"}}}
    got = {(r.id, r.package, r.version) for r in manifests.parse_npm_lock(docs(spark, json.dumps(v3), json.dumps(v1), "{bad")).collect()}
    assert got == {(0, "a", "1.0.0"), (0, "@s/b", "2.0.0"), (1, "a", "1.0.0"), (1, "b", "2.0.0"), (1, "c", "3.0.0"), (1, "d", "4.0.0"), (1, "b", "1.9.0")}


def test_yarn_lock(spark):
    text = '# comment\n\n"@babel/core@^7.0.0", "@babel/core@^7.1.0":\n  version "7.2.0"\n  resolved "https://r/x#1"\n  integrity sha512-a\n  dependencies:\n    "@x/y" "^1.0.0"\n    z "~2.0.0"\n\nlodash@^4.0.0:\n  version "4.17.21"'
    rows = {r.package: r for r in manifests.parse_yarn_lock(docs(spark, text)).collect()}
    assert set(rows) == {"@babel/core", "lodash"}
    assert rows["@babel/core"].version == "7.2.0" and rows["@babel/core"].requires == {"@x/y": "^1.0.0", "z": "~2.0.0"}
    assert rows["lodash"].version == "4.17.21" and rows["lodash"].integrity is None


def test_pnpm_lock(spark):
    text = "lockfileVersion: 5\n\npackages:\n\n  /@a/b@1.2.3(react@18.0.0):\n    resolution: {integrity: sha512-q}\n    dev: false\n\n  /old/2.0.0:\n    resolution: {integrity: sha512-r}\n"
    got = {(r.package, r.version, r.integrity) for r in manifests.parse_pnpm_lock(docs(spark, text)).collect()}
    assert got == {("@a/b", "1.2.3", "sha512-q"), ("old", "2.0.0", "sha512-r")}


def test_audits(spark):
    new = {"vulnerabilities": {"a": {"severity": "high", "isDirect": True, "fixAvailable": {"name": "x"}, "via": ["b", {"name": "a", "title": "T", "cvss": {"score": 7.1}}]}}}
    old = {"advisories": {"1": {"module_name": "m", "severity": "odd", "patched_versions": ">=2", "findings": [{"dev": False}], "title": "O"}}}
    rows = {r.name: r for r in feeds.parse_audits(docs(spark, json.dumps(new), json.dumps(old), "{bad")).collect()}
    assert rows["a"].via == ["b", "a"] and rows["a"].title == "T" and rows["a"].fix_available and rows["a"].direct and rows["a"].cvss_score == 7.1
    assert rows["m"].severity == "low" and rows["m"].fix_available and rows["m"].direct


def test_base64_contents(spark):
    rows = docs(spark, '{"name": "a", "dependencies": {"x": "1"}}').withColumn("content", F.regexp_replace(F.base64(F.encode("content", "UTF-8")), "(.{8})", "$1\n"))
    assert manifests.parse_manifests(manifests.decode_contents(rows)).first().name == "a"


def test_manifest_scan_has_no_depth_limit(spark):
    deep = "/".join(f"d{i}" for i in range(15)) + "/package.json"
    tree = spark.createDataFrame([(deep,)], "rel_path string")
    assert files.manifest_scan(tree).count() == 1 and files.manifest_scan(tree, max_depth=10).count() == 0


def test_yarn_sections_and_berry(spark):
    classic = 'a@^1.0.0:\n  version "1.0.0"\n  dependencies:\n    b "^1.0.0"\n    b "^1.1.0"\n  optionalDependencies:\n    c "^1.0.0"\n    b "^2.0.0"\n  peerDependencies:\n    d "^4.0.0"\n'
    berry = (
        '__metadata:\n  version: 8\n\n"lodash@npm:^4.17.21, lodash@npm:^4.0.0":\n  version: 4.17.21\n  resolution: "lodash@npm:4.17.21"\n  dependencies:\n    "@x/y": "npm:^1.0.0"\n    z: ^2.0.0\n'
        "  bin:\n    tool: bin/tool.js\n  checksum: 10c0/abc\n  languageName: node\n  linkType: hard\n"
    )
    rows = {r.package: r for r in manifests.parse_yarn_lock(docs(spark, classic, berry)).collect()}
    assert set(rows) == {"a", "lodash"}
    assert rows["a"].requires == {"b": "^2.0.0", "c": "^1.0.0"}
    assert rows["lodash"].version == "4.17.21" and rows["lodash"].integrity == "10c0/abc"
    assert rows["lodash"].requires == {"@x/y": "npm:^1.0.0", "z": "^2.0.0"}


def test_pnpm_stops_after_packages(spark):
    text = "packages:\n\n  a@1.0.0:\n    resolution: {integrity: sha512-q}\n\nsnapshots:\n\n  a@1.0.0:\n    dependencies:\n      b: 2.0.0\n"
    assert [(r.package, r.version, r.integrity) for r in manifests.parse_pnpm_lock(docs(spark, text)).collect()] == [("a", "1.0.0", "sha512-q")]


def test_a_large_nested_lock_is_opened_in_linear_time(spark):
    import json
    import time

    def lock(n, depth=4):
        inner = {f"deep-{k}": {"version": f"{k}.0.0"} for k in range(3)}
        for level in range(depth):
            inner = {f"mid-{level}": {"version": "1.0.0", "dependencies": inner}}
        return {"lockfileVersion": 1, "dependencies": {f"pkg-{k}": {"version": f"1.{k}.0", "requires": {"x": "^1"}, **({"dependencies": inner} if k % 10 == 0 else {})} for k in range(n)}}

    def run(n):
        files = spark.createDataFrame([(1, json.dumps(lock(n))), (2, "no json"), (3, "{}"), (4, None)], "id int, content string")
        start = time.perf_counter()
        rows = manifests.parse_npm_lock(files).groupBy("package").count().collect()
        return time.perf_counter() - start, sum(r["count"] for r in rows), {r["package"]: r["count"] for r in rows}

    run(100)
    small, _, _ = run(4_000)
    large, total, counts = run(40_000)
    assert total == 40_000 + 4_000 * (4 + 3) and counts["deep-2"] == 4_000 and counts["mid-0"] == 4_000
    assert large < 10 * small + 10


def test_npm_lock_is_parsed_once(spark):
    """What either kind of lockfile lists comes from one pass over the documents, also where a file has both lists."""
    v2 = {"lockfileVersion": 2, "packages": {"": {"name": "r"}, "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "^1"}}}, "dependencies": {"a": {"version": "9.9.9"}}}
    old = {"dependencies": {"a": {"version": "1.0.0", "requires": {"b": "^1"}, "dependencies": {"b": {"dev": True}}}}}
    found = manifests.parse_npm_lock(docs(spark, json.dumps(v2), json.dumps(old), '{"lockfileVersion": 1}', '{"lockfileVersion": 3}', "{bad"))
    assert {(r.id, r.package, r.version, r.dev, str(r.requires)) for r in found.collect()} == {
        (0, "a", "1.0.0", False, "{'b': '^1'}"), (1, "a", "1.0.0", False, "{'b': '^1'}"), (1, "b", "unknown", True, "None")}
    assert "from_json" not in found._jdf.queryExecution().executedPlan().toString()


def test_later_sections_win_in_one_pass(spark):
    doc = {"dependencies": {"x": "1", "y": "1", "z": None}, "devDependencies": {"x": "2"}, "peerDependencies": {"y": "3"}, "optionalDependencies": {"x": "4"}}
    merged = manifests.merged_sections(manifests.parse_manifests(docs(spark, json.dumps(doc), '{"name": "none"}')), ["id"])
    assert {(r.id, r.package, r.spec) for r in merged.collect()} == {(0, "x", "4"), (0, "y", "3"), (0, "z", None)}
    assert "map_concat" not in merged._jdf.queryExecution().executedPlan().toString()


def test_files_are_listed_by_tasks_and_equal_those_of_sparks_source(spark, tmp_path):
    for rel, text in {"a/b/x.json": "{}", "a/b/y.js": "é", "a/empty.json": "", "a/_skip/z.json": "{}", "a/_part=1/p.json": "1", ".h/q.json": "{}", "top.json": "[]", "c d/%41.json": "s"}.items():
        target = tmp_path / rel
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
    for glob in ("*", "*.json", "{x,y}.*", "[!x]*.json"):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(str(tmp_path))
        got = files.read_files(spark, str(tmp_path), glob)
        assert not any(f.endswith(".json") for f in got.inputFiles())  # no list of them on the driver
        want = {(r.path, r.length, r.modificationTime, r.content.decode()) for r in plain.collect()}
        assert want and {(r.path, r["size"], r.mtime, r.content) for r in got.collect()} == want
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (got.select("path", "size"), files.engine_versions(got).select("version"))]
    assert [p.count("ArrowEvalPython") for p in plans] == [0, 1]  # contents are read where they are asked for, once
