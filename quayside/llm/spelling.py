r"""Spelling variants of one word, by asymmetric q-chunks (operator 13).

Words are counted over the whole corpus before anything else, so that a word is one row however often it occurs. Two words
are near if one inserted, deleted or replaced code point tells them apart. Of such a pair the shorter one (of two equally
long ones, the smaller) is cut into two disjoint chunks, its first half and its rest; the other one gives its positional
grams. One edit lies in at most one of the chunks, so the other one is left whole and stands at its own place (the head) or
as far from the end (the tail), which is a shift of at most one. The chunk that holds the edit has two halves in turn, of
which one is whole: a key is a whole chunk and one half of the other, so words that only begin or end alike do not meet.
Words join on the key, and the join itself verifies by edit distance, so no other pair leaves it. Keys that very many words
share are split by Spark (adaptive skew join), because the join is an inner one with nothing behind it on the same key.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is at least ``ratio`` times its
own count. Counts grow by ``ratio`` along a chain of forms, which bounds its length; roots come from pointer doubling.

Null and empty texts and texts without letters give no words; a null id counts as the empty text in the hash. Repeated rows
count as often as they stand there. An empty table gives an empty result. Further columns of the input are never read, so
none can clash. Everything here is DataFrame code without Python workers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import cut_lineage, table
from quayside.llm.registry import register

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """word, n: runs of letters, lower-cased in A-Z, of at least ``shortest`` code points that occur ``least`` times or more.

    Where ``every`` divides the hash of id and run, one code point of the run is deleted (planted misspellings).
    """
    # a shorter run can only get shorter, so it is never taken out of its text
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{shortest},}})"), 1)).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    place = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = hashed.select(F.when(F.pmod("h", F.lit(every)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def keys(word, size):
    """The four keys of ``word`` as one of a pair whose shorter word has ``size`` code points.

    The first two hold the head chunk, the others the tail chunk, each with one half of the rest. A head piece stands at
    the same place in both words, a tail piece is as far from the end in both.
    """
    head = F.floor(size / 2).cast("int")
    tail = size - head
    half, other = F.floor(tail / 2).cast("int"), F.floor(head / 2).cast("int")
    pieces = [(head + half, F.lit(0)), (head, tail - half), (other, tail), (F.lit(0), size - other)]
    return [F.xxhash64(size, F.lit(i), F.left(word, front), F.right(word, back)) for i, (front, back) in enumerate(pieces)]


def chunks(words: DataFrame) -> DataFrame:
    """key, short, short_n: each word's two disjoint chunks, each with either half of the rest."""
    return words.select(F.explode(F.array(*keys(F.col("word"), F.length("word")))).alias("key"), F.col("word").alias("short"), F.col("n").alias("short_n"))


def grams(words: DataFrame, shortest: int) -> DataFrame:
    """key, long, long_n: the grams of each word that a chunk of a word of its length, or of one less, can be.

    What stands left of the edit has shift 0, what stands right of it the difference of the lengths; no other shift is
    possible, so grams at other places are not made.
    """
    own, word = F.length("word"), F.col("word")
    shorter = [F.when(own > shortest, k) for k in keys(word, own - 1)]
    return words.select(F.explode(F.array(*keys(word, own), *shorter)).alias("key"), word.alias("long"), F.col("n").alias("long_n")).where("key IS NOT NULL")


def near_pairs(words: DataFrame, shortest: int = 7) -> DataFrame:
    """short, short_n, long, long_n: every pair of words at an edit distance of exactly one, once."""
    a, b = chunks(words), grams(words, shortest)
    ordered = (F.length("long") > F.length("short")) | (F.col("short") < F.col("long"))
    near = (a["key"] == b["key"]) & ordered & (F.levenshtein(F.col("short"), F.col("long"), 1) == 1)
    return a.join(b, near).select("short", "short_n", "long", "long_n").distinct()


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """word, root: the last form of the chain that starts at each word; ``forms`` has word, n, form, form_n."""
    most = forms.agg(F.max("form_n")).first()[0] or 0
    steps = max(1, math.ceil(math.log(max(most, 1), ratio)) + 1)
    jumps = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps))):
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = cut_lineage(jumps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return jumps


def group_variants(words: DataFrame, ratio: int = 10, shortest: int = 7) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n)."""
    words = cut_lineage(words, "words")
    pairs = cut_lineage(near_pairs(words, shortest), "near")
    sides = pairs.select(F.col("short").alias("word"), F.col("short_n").alias("n"), F.col("long").alias("other"), F.col("long_n").alias("other_n")).unionByName(
        pairs.select(F.col("long").alias("word"), F.col("long_n").alias("n"), F.col("short").alias("other"), F.col("short_n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    judged = sides.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    form_n = -F.col("best.less")
    has = form_n >= ratio * F.col("n")
    judged = cut_lineage(judged.select("word", "n", "n_near", F.when(has, F.col("best.form")).alias("form"), F.when(has, form_n).alias("form_n")), "forms")
    found = judged.join(roots(judged.where("form IS NOT NULL"), ratio), "word", "left").drop("n")
    return words.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


CRC = """crc_table AS (SELECT list(CAST(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) ORDER BY i) AS tab FROM range(256) r(i))"""


def crc_sql(codes: str) -> str:
    """Unsigned crc32 of a list of bytes, with crc_table at hand."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""
WITH RECURSIVE {CRC},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS raw FROM documents),
l AS (SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT run, k, {crc_sql("flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END))")} AS h FROM l, crc_table WHERE length(run) >= 7),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM w a JOIN d b ON a.word = b.less
  UNION SELECT b.word, b.n, a.word, a.n FROM w a JOIN d b ON a.word = b.less),
j AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, o := other)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * w.n THEN best.o END AS form, CASE WHEN -best.m >= 10 * w.n THEN -best.m END AS form_n FROM w LEFT JOIN j USING (word)),
c AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, step) AS root, f.n, n_near, form_n FROM f JOIN c ON f.word = c.word GROUP BY ALL
"""


@register("op13_spelling_variants", ORACLE)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return group_variants(count_words(table(spark, folder, "documents")))
