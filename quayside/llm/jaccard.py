"""N-gram Jaccard join on count vectors in an R-tree (operator 7).

A text's set is that of its five-word shingles. Equal sets are one class. The shingles of a class are hashed into groups;
the group counts are a point, and the sum of the coordinate minima of two points bounds the overlap of their sets from
above. Points are indexed in R-trees whose nodes keep the largest coordinates; node pairs below the needed overlap are cut,
surviving pairs are verified on the whole sets. Finer points fold to coarser ones, so each text has as many groups as its
size needs.

A tree per bucket keeps the work local: classes meet where one of ``BANDS`` keys of three min-hashes agrees, which two sets
at the threshold miss with a chance of (1 - 0.75^3)^36 < 3e-9; near pairs above it less. Before the trees, two
rounds verify one class of every component against the fullest class of the bucket it shares most; what is linked that way
is one component, and only buckets with several components reach the trees, in blocks of bounded size, where pairs within a
component are cut as well. A first pass over the blocks names the classes that have a pair left, a second one has the sets of
these and verifies inside the block, in which a pair that is connected already is passed over. So a block of any pairs gives
fewer links than it has classes.

Null and empty texts have size 0 and stand alone. Shorter texts than five words are one shingle. Repeated rows are copies.
Rows with a null id take part with their text and get the component of their text's links. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import U64, cut_lineage, hash_pieces, mix64, shingle_hashes, ship_package, table, text_class, word_hashes
from quayside.llm.registry import register

BANDS, ROWS = 36, 3
STAR_ROUNDS = 2
BLOCK = 2_000
TASK_ROWS = 10_000
LEAF = 16
_A = (mix64(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) >> U64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_B = (mix64(np.arange(5001, 5001 + BANDS * ROWS, dtype=np.uint64)) >> U64(32)).astype(np.uint32)[:, None]


def needed(a, b, num: int = 3, den: int = 4):
    """Least overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key per band of three min-hashes; the min-hashes take the upper half of a shingle's hash, in pieces that fit the cache."""
    upper = (shingles >> U64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    room = np.empty((BANDS * ROWS, min(len(upper), 1_024)), dtype=np.uint32)
    for first in range(0, len(upper), 1_024):
        part = upper[first : first + 1_024]
        values = room[:, : len(part)]
        np.bitwise_xor(part[None, :], _B, out=values)
        np.multiply(values, _A, out=values)
        np.minimum(low, values.min(axis=1), out=low)
    low = mix64(low.astype(np.uint64)).reshape(BANDS, ROWS)
    return mix64(low[:, 0] * U64(3) + low[:, 1] * U64(5) + low[:, 2] * U64(7) + np.arange(BANDS, dtype=np.uint64))


def groups_of(n: int) -> int:
    """About one to two groups per shingle, a power of two; sets of near sizes have as many, or twice as many."""
    return 1 << min(max(n, 16), 1 << 20).bit_length()


def count_vector(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by the low bits of their hash, in one byte each if they fit, else in four."""
    groups = groups_of(len(shingles))
    counts = np.bincount((shingles & U64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype("u1" if counts.max() < 1 << 7 else "<u4").tobytes()


def read_vector(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "u1" if len(raw) == groups_of(n) else "<u4")


def folded(points: list[np.ndarray], groups: int) -> np.ndarray:
    """Points with as many groups, coarser ones as sums; bytes stay bytes."""
    out = np.stack([p if len(p) == groups else p.reshape(-1, groups).sum(axis=0, dtype=np.uint32) for p in points])
    return out.astype(np.uint8) if out.dtype != np.uint8 and out.max() < 1 << 8 else out


class CountTree:
    """An R-tree over count vectors, packed from points in order of size: nodes keep the largest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((labels, sizes))
        self.points, self.sizes, self.labels = points[self.order], sizes[self.order], labels[self.order]
        width = points.shape[1]
        self.coarse = self.points.reshape(len(sizes), max(16, width // 8), -1).sum(axis=2, dtype=np.uint16 if self.points.dtype == np.uint8 else np.uint32)
        starts = np.arange(0, len(sizes), LEAF)
        tops, low, high = np.maximum.reduceat(self.points, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        first, last = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        self.levels = [(tops, low, high, first, last)]
        while len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(self.levels[-1][0]), LEAF)
            t, lo, hi, f, la = self.levels[-1]
            self.levels.append((np.maximum.reduceat(t, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.minimum.reduceat(f, starts), np.maximum.reduceat(la, starts)))


def may_link(tops_a, low_a, high_a, tops_b, low_b, high_b):
    """Which node pairs can hold a link: sizes near enough, and the summed minima reach the least overlap."""
    sized = (4 * high_a >= 3 * low_b) & (4 * high_b >= 3 * low_a)
    sized[sized] = np.minimum(tops_a[sized], tops_b[sized]).sum(axis=1, dtype=np.int64) >= needed(low_a[sized], low_b[sized])
    return sized


def tree_join(a: CountTree, b: CountTree) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the inputs of a and b of pairs with different labels that the bound cannot exclude."""
    level_a, level_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def children(nodes, total):
        kids = nodes[:, None] * LEAF + np.arange(LEAF)
        return kids, kids < total

    def keep(i, j, la, lb):
        ta, lo_a, hi_a, f_a, l_a = la
        tb, lo_b, hi_b, f_b, l_b = lb
        out = []
        for first in range(0, len(i), 4_096):
            x, y = i[first : first + 4_096], j[first : first + 4_096]
            several = ~((f_a[x] == l_a[x]) & (f_b[y] == l_b[y]) & (f_a[x] == f_b[y]))
            x, y = x[several], y[several]
            ok = may_link(ta[x], lo_a[x], hi_a[x], tb[y], lo_b[y], hi_b[y])
            out.append((x[ok], y[ok]))
        return np.concatenate([o[0] for o in out] or [i]), np.concatenate([o[1] for o in out] or [j])

    points_a = (a.points, a.sizes, a.sizes, a.labels, a.labels)
    points_b = (b.points, b.sizes, b.sizes, b.labels, b.labels)
    coarse_a = (a.coarse, *points_a[1:])
    coarse_b = (b.coarse, *points_b[1:])
    while level_a >= 0 or level_b >= 0:
        if level_a >= level_b and level_a >= 0:
            level_a -= 1
            kids, real = children(i, len(a.levels[level_a][0]) if level_a >= 0 else len(a.sizes))
            i, j = kids[real], np.repeat(j, LEAF).reshape(kids.shape)[real]
        else:
            level_b -= 1
            kids, real = children(j, len(b.levels[level_b][0]) if level_b >= 0 else len(b.sizes))
            i, j = np.repeat(i, LEAF).reshape(kids.shape)[real], kids[real]
        if level_a < 0 and level_b < 0:  # sums of neighbouring groups bound the overlap too, at an eighth of the work
            i, j = keep(i, j, coarse_a, coarse_b)
        i, j = keep(i, j, a.levels[level_a] if level_a >= 0 else points_a, b.levels[level_b] if level_b >= 0 else points_b)
    return a.order[i], b.order[j]


def bounded_pairs(keys, sizes, labels, points, side) -> set[tuple[int, int]]:
    """Pairs (smaller key first) of different labels that the trees cannot exclude; side 1 and 2 rows only meet each other, 0 all."""
    out: set[tuple[int, int]] = set()
    groups = np.array([len(p) for p in points])
    for g in np.unique(groups):
        for h in (g, 2 * g):  # near sizes have as many groups, or twice as many
            left, right = np.flatnonzero(groups == g), np.flatnonzero(groups == h)
            for s, t in ((0, 0), (1, 2), (2, 1)):
                x, y = left[side[left] == s], right[side[right] == t]
                if len(x) and len(y):
                    trees = [CountTree(folded([points[k] for k in z], int(g)), sizes[z], labels[z]) for z in (x, y)]
                    i, j = tree_join(*trees)  # a tree with itself gives both orders of a pair
                    u, v = x[i], y[j]
                    other = labels[u] != labels[v]
                    out |= {(min(p, q), max(p, q)) for p, q in zip(keys[u[other]].tolist(), keys[v[other]].tolist())}
    return out


def each_text(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Batches with the sorted distinct shingles of every text."""
    for batch in batches:
        for first, texts in hash_pieces(list(batch["text"])):
            hashes, counts, _, _ = word_hashes(texts)
            ends = np.cumsum(counts)
            yield batch.iloc[first : first + len(texts)], [np.unique(shingle_hashes(hashes[e - n : e])) for e, n in zip(ends.tolist(), counts.tolist())]


def class_key(shingles: np.ndarray) -> int:
    """One number for a set; different sets collide with a chance of about 2^-64."""
    total = mix64(shingles).sum() ^ mix64(np.array([len(shingles)], dtype=np.uint64))[0]
    return int(mix64(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def sketches(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)

    def sketch(batches):
        for rows, sets in each_text(batches):
            yield pd.DataFrame({
                "doc_id": rows["doc_id"], "d": rows["d"], "n": [len(s) for s in sets], "k": [class_key(s) for s in sets],
                "bands": [band_keys(s).view(np.int64) if len(s) else None for s in sets], "v": [count_vector(s) for s in sets],
            })

    return docs.select(F.col("doc_id").cast("long"), "text", text_class().alias("d")).mapInPandas(sketch, "doc_id long, d long, n long, k long, bands array<long>, v binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """k and the sorted set of the classes in ``wanted`` (doc_id and text class d of one member, k)."""

    def build(batches):
        for rows, sets in each_text(batches):
            match = [class_key(s) == k for s, k in zip(sets, rows["k"])]
            yield pd.DataFrame({"k": rows["k"][match], "s": [s.tobytes() for s, m in zip(sets, match) if m]})

    keyed = docs.select(F.col("doc_id").cast("long"), "text", text_class().alias("d"))
    near = keyed.join(wanted.select(F.col("doc_id").alias("__id"), F.col("d").alias("__d"), "k"), (F.col("d") == F.col("__d")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return near.select("text", "k").mapInPandas(build, "k long, s binary").groupBy("k").agg(F.first("s").alias("s"))


def reaches(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have the similarity of a link."""
    least = needed(len(x), len(y))
    if min(len(x), len(y)) < least:
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= least


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([reaches(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(left, right)], dtype=bool)

    left, right = (sets.select(F.col("k").alias(c), F.col("s").alias("s" + c)) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(F.pandas_udf(linked, "boolean")("sa", "sb")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """k and its component's smallest k, for the ends of edges (a, b): smallest neighbours and pointer jumping, to a standstill."""
    both = cut_lineage(edges.select(F.col("a").alias("k"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("k"), F.col("a").alias("o"))).distinct(), "edges")
    labels = cut_lineage(both.groupBy("k").agg(F.least(F.first("k"), F.min("o")).alias("l")), "labels")
    while True:
        around = both.join(labels.select(F.col("k").alias("o"), F.col("l").alias("n")), "o").groupBy("k").agg(F.min("n").alias("n"))
        nearer = cut_lineage(labels.join(around, "k").select("k", "l", F.least("l", "n").alias("m")), "labels")
        jumped = nearer.join(nearer.select(F.col("k").alias("m"), F.col("m").alias("j")), "m").select("k", F.col("l").alias("was"), F.least("m", "j").alias("l"))
        jumped = cut_lineage(jumped, "labels")
        labels = jumped.select("k", "l")
        if jumped.where("was <> l").isEmpty():
            return labels


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Join the components that links (a, b) connect: new labels l of k."""
    ends = [labels.select(F.col("k").alias(c), F.col("l").alias("l" + c)) for c in "ab"]
    wider = components(links.join(ends[0], "a").join(ends[1], "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    joined = labels.join(wider.select(F.col("k").alias("l"), F.col("l").alias("w")), "l", "left")
    return cut_lineage(joined.select("k", F.coalesce("w", "l").alias("l")), "labels")


def rank():
    """The order in which rows stay: smallest id first, null ids last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d")


def labelled_rows(docs: DataFrame) -> DataFrame:
    """doc_id, d (text class), n, component_id and kept (its component's first row has this id and text), one row per row."""
    known = cut_lineage(sketches(docs), "sketches")
    classes = cut_lineage(known.where("n > 0").groupBy("k").agg(F.min(rank()).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("v").alias("v")).select("k", "r.doc_id", "r.d", "n", "bands", "v"), "classes")
    keys = classes.select("k", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(keys.join(shared, "key"), "members")
    # The class with the fullest buckets is likeliest what the others are copies of.
    fullness = cut_lineage(members.groupBy("k").agg(F.sum("size").alias("full")), "fullness")
    members = cut_lineage(members.join(fullness, "k"), "members")
    sets = cut_lineage(sets_of(docs, classes.join(fullness, "k").select("doc_id", "d", "k")), "sets")

    labels = fullness.select("k", F.col("k").alias("l"))
    for _ in range(STAR_ROUNDS):
        tagged = members.join(labels, "k").groupBy("key", "l").agg(F.max(F.struct("full", "k")).alias("best"))
        head = tagged.groupBy("key").agg(F.max(F.struct("best", "l")).alias("head"), F.count("*").alias("labels")).where("labels > 1")
        stars = tagged.join(head, "key").where("l <> head.l").groupBy("l", F.col("head.l").alias("hl")).agg(F.count("*").alias("times"), F.max(F.struct(F.col("best.k").alias("k"), F.col("head.best.k").alias("h"))).alias("pair"))
        stars = stars.groupBy("l").agg(F.max_by("pair", F.struct("times", "pair")).alias("pair"))
        links = verify(stars.select(F.col("pair.h").alias("a"), F.col("pair.k").alias("b")), sets)
        labels = relabel(labels, links)

    labelled = cut_lineage(members.join(labels, "k").select("key", "k", "size", "l"), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("l").alias("x"), F.max("l").alias("y")).where("x <> y").select("key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("k", "key"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    met = placed.withColumn("o", other).select("key", "k", "l", "block", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"))
    points = cut_lineage(met.join(classes.select("k", "n", "v"), "k"), "points")
    groups = max(64, points.count() // TASK_ROWS)  # a task takes many small blocks, or a few of the largest

    def blocks_of(group: pd.DataFrame):
        """The blocks of a task, one after the other: key, p, q and the rows' places with the pairs that the trees leave."""
        block = group[["key", "p", "q"]].to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1
        k, l, n = (group[c].to_numpy(np.int64) for c in ("k", "l", "n"))
        side = np.where(block[:, 1] == block[:, 2], 0, np.where(group["block"].to_numpy() == block[:, 1], 1, 2))
        vectors = [read_vector(v, size) for v, size in zip(group["v"], n.tolist())]
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
            yield block[a].tolist(), bounded_pairs(k[a:b], n[a:b], l[a:b], vectors[a:b], side[a:b])

    def survivors(group: pd.DataFrame) -> pd.DataFrame:
        """The classes of each block that have a pair left; at most as many rows as the block."""
        out = []
        for block, found in blocks_of(group.sort_values(["key", "p", "q"])):
            out += [(*block, k) for k in {k for pair in found for k in pair}]
        return pd.DataFrame(out, columns=["key", "p", "q", "k"], dtype="int64")

    def link_blocks(group: pd.DataFrame) -> pd.DataFrame:
        """The links of each block that join two components, verified on the whole sets: fewer than the block has classes."""
        group = group.sort_values(["key", "p", "q"])
        sets = {k: np.frombuffer(s, "<u8") for k, s in zip(group["k"], group["s"])}
        label = dict(zip(group["k"].tolist(), group["l"].tolist()))
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        links = []
        for _, found in blocks_of(group):
            for a, b in sorted(found):
                one, other = top(label[a]), top(label[b])
                if one != other and reaches(sets[a], sets[b]):
                    above[one] = other
                    links.append((a, b))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    task = F.pmod(F.xxhash64("key", "p", "q"), F.lit(groups))
    left = cut_lineage(points.withColumn("task", task).groupBy("task").applyInPandas(survivors, "key long, p int, q int, k long"), "survivors")
    again = points.join(left, ["key", "p", "q", "k"]).join(sets, "k")
    links = cut_lineage(again.withColumn("task", task).groupBy("task").applyInPandas(link_blocks, "a long, b long"), "links")
    labels = relabel(labels, links)

    first = classes.select("k", "doc_id", "d").join(labels, "k", "left").select("k", "doc_id", "d", F.coalesce("l", "k").alias("w"))
    smallest = first.groupBy("w").agg(F.min(rank()).alias("r"))
    of_class = first.join(smallest, "w").select("k", "r")
    joined = known.select("doc_id", "d", "n", "k").join(of_class, "k", "left")
    kept = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d") == F.col("r.d")))
    return joined.select("doc_id", "d", "n", F.when(F.col("n") > 0, F.col("r.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), kept.alias("kept"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row."""
    return labelled_rows(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays, of repeated rows one.

    Rows are told apart by id and text, so different texts under a null or a repeated id stay."""
    found = labelled_rows(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("d").alias("__d")).distinct()
    keyed = docs.withColumn("__text", text_class())
    joined = keyed.join(found, (F.col("__text") == F.col("__d")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    return joined.dropDuplicates(["doc_id", "__text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (WITH RECURSIVE r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.x = w.doc_id
"""


@register("op7_jaccard_components", ORACLE)
def op7_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents").select("doc_id", "text"))
