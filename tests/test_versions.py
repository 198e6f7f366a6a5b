"""Version order and ranges against a plain per-row evaluator."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.catalogue import advisories as cat
from quayside.functions.versions import bump_spec, clean_spec, intervals, runtime_requirement, version_key
from quayside.operators import matching

TRUTH = [
    ("3.9.3", "<3.9.4", True), ("3.9.4", "<3.9.4", False), ("19.2.2", "19.0.0-19.2.2", True), ("20.1.0", "2.x", False),
    ("20.19.9", "20.x", True), ("1.4.4-lts.1", "1.4.4-lts.1", True), ("1.122.0", "1.122.0-RC", False), ("^19.0.0", "19.0.0", True),
    ("workspace:*", "<9.0.0", False), ("1.0.0", ">= 1.0.0, < 2.0.0", True), ("2.0.1", "<= 2.0.0", False), ("2.0.0", "<= 2.0.0", True),
    ("1.0.0", "> 1.0.0 < 2.0.0", False), ("1.0.1", "> 1.0.0 < 2.0.0", True), ("7.0.0", "<2.0.0 || >=6.0.0", True), ("3.0.0", "<2.0.0 || >=6.0.0", False),
    ("15.1.7", "15.1.x", True), ("15.10.0", "15.1.x", False), ("0.0.0", "*", True), ("20231201.0.0", ">=1.0.0", True),
    ("1.0.20231201", "<1.0.20231202", True), ("2.0.0-rc.1", "<2.0.0", True), ("2.0.0-rc.1", ">=2.0.0", False), ("1.2", "1.2.0", True),
]


def matched(spark, pairs):
    rows = [(i, v, "p", r) for i, (v, r) in enumerate(pairs)]
    deps = spark.createDataFrame([(i, "p%d" % i, v) for i, v, _, _ in rows], "id int, package string, spec string")
    adv = spark.createDataFrame([(f"A{i}", "p%d" % i, [r]) for i, _, _, r in rows], "cve_id string, package string, affected_versions array<string>")
    found = matching.match_versions(matching.with_version(deps), intervals(adv, ["cve_id", "package"]))
    return {r.id for r in found.select("id").collect()}


def test_truth_table(spark):
    hits = matched(spark, [(v, r) for v, r, _ in TRUTH])
    assert [i in hits for i in range(len(TRUTH))] == [want for _, _, want in TRUTH]


def plain_key(text):
    m = re.match(r"^[vV=]?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?", text)
    pre = m.group(4)
    parts = [] if pre is None else [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre.split(".")]
    return tuple(int(m.group(i) or 0) for i in (1, 2, 3)), pre is None, parts


def test_key_order_equals_semver(spark):
    rng = random.Random(7)
    pres = ["", "", "-alpha", "-alpha.1", "-alpha.beta", "-beta.2", "-beta.11", "-rc.1", "-1", "-10", "-alpha-b"]
    texts = sorted({f"{rng.randint(0, 3)}.{rng.randint(0, 12)}.{rng.choice([0, 9, 10, 20231201])}{rng.choice(pres)}" for _ in range(400)})
    df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("k", version_key("v"))
    got = [r.v for r in df.orderBy("k", "v").collect()]
    assert got == sorted(texts, key=lambda t: (plain_key(t), t))


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10_000))
def test_intervals_equal_a_plain_evaluator(spark, seed):
    rng = random.Random(seed)

    def version():
        return f"{rng.randint(0, 2)}.{rng.randint(0, 3)}.{rng.randint(0, 3)}"

    def plain(v, r):
        key = plain_key(v)[0]
        if r.endswith(".x"):
            return key[0] == int(r[:-2])
        if re.match(r"^[\d.]+-[\d.]+$", r):
            lo, hi = r.split("-")
            return plain_key(lo)[0] <= key <= plain_key(hi)[0]
        ops = re.findall(r"(>=|<=|>|<)\s*([\d.]+)", r)
        if not ops:
            return key == plain_key(r)[0]
        test = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
        return all(test[o](key, plain_key(b)[0]) for o, b in ops)

    shapes = [lambda: f"<{version()}", lambda: f">= {version()}, <= {version()}", lambda: f"{version()}-{version()}", lambda: f"{rng.randint(0, 2)}.x", version, lambda: f"> {version()}"]
    pairs = [(version(), rng.choice(shapes)()) for _ in range(150)]
    hits = matched(spark, pairs)
    assert hits == {i for i, (v, r) in enumerate(pairs) if plain(v, r)}


def test_overlapping_ranges_match_once(spark):
    deps = matching.with_version(spark.createDataFrame([("p", "1.5.0"), ("p", "9.0.0")], "package string, spec string"))
    adv = spark.createDataFrame([("A", "p", ["<2.0.0", "1.0.0-3.0.0", "1.x", "8.0.0", "9.x"])], "cve_id string, package string, affected_versions array<string>")
    assert matching.match_versions(deps, intervals(adv, ["cve_id", "package"])).count() == 2


def test_salted_match_is_the_same(spark):
    # one package holds most of the rows
    deps = spark.range(400).select("id", F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("package"), F.concat(F.lit("1."), F.col("id") % 7, F.lit(".0")).alias("spec"))
    adv = spark.createDataFrame([("A", "hot", ["<1.3.0"]), ("B", "hot", ["1.2.0-1.5.0"]), ("C", "cold", ["1.6.0"])], "cve_id string, package string, affected_versions array<string>")
    ranges = intervals(adv, ["cve_id", "package"])
    keyed = matching.with_version(deps)
    plain = {tuple(r) for r in matching.match_versions(keyed, ranges).select("id", "cve_id").collect()}
    salted = [tuple(r) for r in matching.match_versions(keyed, ranges, salts=8).select("id", "cve_id").collect()]
    assert len(salted) == len(set(salted)) and set(salted) == plain and plain


def test_catalogue(spark):
    known = cat.catalogue(spark)
    assert known.count() == 32
    assert known.where("category <> 'gateway'").count() == 28
    summary = {r.category: r.total for r in matching.catalogue_summary(known).collect()}
    assert summary[None] == 32 and summary["nodejs"] == 9


def test_patch_precedence(spark):
    rows = [("CVE-2025-55182", "react", "19.1.0"), ("CVE-2025-66478", "next", "15.3.1"), ("CVE-2025-29927", "next", "13.4.0"),
            ("CVE-2024-21508", "mysql2", "3.9.3"), ("CVE-2024-21508", "mysql2", "3.9.4"), ("CVE-2025-23084", "node", "18.1.0")]
    found = matching.with_version(spark.createDataFrame(rows, "cve_id string, package string, spec string"))
    got = {(r.package, r.version): r.patched_version for r in matching.patch_lookup(found, matching.patch_table(cat.catalogue(spark))).collect()}
    assert got == {("react", "19.1.0"): "19.1.2", ("next", "15.3.1"): "15.3.6", ("next", "13.4.0"): "13.5.7", ("mysql2", "3.9.3"): "3.9.4",
                   ("mysql2", "3.9.4"): None, ("node", "18.1.0"): None}


def test_specs(spark):
    df = spark.createDataFrame([("^1.2.3",), (">= 1.0.0 <2.0.0",), ("1.0.0||2.0.0",), ("",)], "s string")
    assert [r[0] for r in df.select(clean_spec(F.col("s"))).collect()] == ["1.2.3", "1.0.0", "1.0.0", ""]
    assert df.limit(1).select(bump_spec(F.col("s"), F.lit("9.9.9"))).first()[0] == "^9.9.9"
    engines = spark.createDataFrame([(">=18",), ("20.x",), ("18 || 20",), ("lts/*",), ("^20.4.1",)], "e string")
    assert [r[0] for r in engines.select(runtime_requirement("e")).collect()] == ["18.0.0", "20.0.0", "18.0.0", None, "20.4.1"]
