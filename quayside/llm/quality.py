"""Quality rules as a short-circuit cascade: cheap rules that reject much run first (operator 3).

A rule is a cost-bearing measure and a test. On a sample the cascade times every rule and counts what it rejects, then
sorts by rejections per second; a document leaves at its first failing rule. The verdict is the conjunction of all rules,
so the order changes only the work, never the answer.

Null and empty texts have no words: every measure is 0 and the base rule fails. Very long texts are measured whole. Repeated
rows are judged each for itself. Other columns are carried by ``apply_cascade`` and may have any names but its three own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quayside.llm.common import ship_package, table, words_of
from quayside.llm.registry import register

SYMBOLS = b"#*$%&|<>"


class Text:
    """A text whose measures are computed on first use and then kept."""

    def __init__(self, text: str | None):
        self.raw = text.encode("utf-8", "surrogatepass") if text else b""
        self.kept: dict[str, object] = {}

    def get(self, name: str):
        if name not in self.kept:
            self.kept[name] = MEASURES[name](self)
        return self.kept[name]


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a window of three that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def dup_lines(raw: bytes) -> tuple[int, int]:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.raw.split(),
    "n_words": lambda t: len(t.get("words")),
    "word_chars": lambda t: len(b"".join(t.get("words")).decode("utf-8", "surrogatepass")),
    "n_symbols": lambda t: len(t.raw) - len(t.raw.translate(None, SYMBOLS)),
    "lines": lambda t: dup_lines(t.raw),
    "n_dup_lines": lambda t: t.get("lines")[0],
    "n_repeat_words": lambda t: repeat_words(t.get("words")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


BASE = [
    Rule("few_words", lambda t: t.get("n_words") < 50),
    Rule("repeated_windows", lambda t: 100 * t.get("n_repeat_words") > 50 * t.get("n_words")),
]
RULES = [
    *BASE,
    Rule("symbols", lambda t: 10 * t.get("n_symbols") > t.get("n_words")),
    Rule("word_length", lambda t: not 2 * t.get("n_words") <= t.get("word_chars") <= 12 * t.get("n_words")),
    Rule("repeated_lines", lambda t: 2 * t.get("n_dup_lines") > t.get("lines")[1]),
]


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_one_in: int = 50, sample_rows: int = 2_000) -> list[Rule]:
    """Order the rules by rejections per second on a hashed sample of at most ``sample_rows`` texts.

    The texts stay in the tasks; the driver gets one row of counts per rule and task. Without a sample (an empty table) the
    order stays as given.
    """
    ship_package(docs.sparkSession)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seconds, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch["text"]:
                for k, rule in enumerate(rules):
                    fresh = Text(text)
                    began = time.perf_counter()
                    rejected[k] += bool(rule.rejects(fresh))
                    seconds[k] += time.perf_counter() - began
        yield pd.DataFrame({"k": range(len(rules)), "seconds": seconds, "rejected": rejected})

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(sample_one_in)) == 0).limit(sample_rows)
    counts = sample.mapInPandas(measure, "k int, seconds double, rejected long").groupBy("k").sum("seconds", "rejected").collect()
    gain = {r[0]: r[2] / max(r[1], 1e-9) for r in counts}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k))]


def apply_cascade(docs: DataFrame, rules: list[Rule], report: list[str] | None = None) -> DataFrame:
    """All rows with ``kept``, ``failed_rule`` (null if kept) and ``rules_run``, and the measures named in ``report``."""
    ship_package(docs.sparkSession)
    report = report or []
    own = {"kept", "failed_rule", "rules_run", *report}
    carried = [f for f in docs.schema.fields if f.name not in own]
    schema = StructType([*carried, *[StructField(m, LongType()) for m in report], StructField("kept", BooleanType()), StructField("failed_rule", StringType()), StructField("rules_run", IntegerType())])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, failed, run = [], [], []
            measures: dict[str, list] = {m: [] for m in report}
            for raw in batch["text"]:
                text = Text(raw)
                k = next((k for k, rule in enumerate(rules) if rule.rejects(text)), None)
                kept.append(k is None)
                failed.append(None if k is None else rules[k].name)
                run.append(len(rules) if k is None else k + 1)
                for m in report:
                    measures[m].append(text.get(m))
            out = batch[[f.name for f in carried]]
            yield out.assign(**measures, kept=kept, failed_rule=failed, rules_run=run)

    return docs.select(*[f"`{f.name}`" for f in carried]).mapInPandas(judge, schema)


WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, {WORDS_SQL} AS words FROM documents),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS times FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE times > 1) GROUP BY rid),
m AS (SELECT doc_id, w.rid, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON c.rid = w.rid),
b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 12 * n_words
    AND 2 * n_dup_lines <= len(lines) AS kept
FROM b
"""


@register("op3_quality_cascade", ORACLE)
def op3_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = apply_cascade(docs, plan_cascade(docs, RULES), measures)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *measures, base_failed.alias("base_failed"), "kept")
