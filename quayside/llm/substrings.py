"""Near-duplicate passages by compact windows (operator 9).

The tokens of a text are its five-word shingles. For each of ``HASHES`` hash functions a Cartesian tree over the tokens'
min-hashes groups all runs of ``WIDTH`` tokens or more that share a smallest token: such a group is a compact window [left,
right] around that token, and a text of n tokens has about 2n / ``WIDTH`` of them per function. Windows whose smallest token
also stands in another window are shared. Where the shared windows of at least ``ENOUGH`` functions overlap (an interval join
inside each text), a passage may be a near duplicate; only the tokens of those places go on to be verified.

A pair of passages of similarity s agrees under each function with probability s, and then both lie inside shared windows: at
0.75 a passage fails to be a candidate with a chance of 0.4 % (fewer than 3 of 8 functions agree), at 0.9 of 0.002 %.

Verification is exact. A place is repeated if its shingle also stands in an earlier candidate place. A passage is a repeat
if six sevenths of its shingles, which means a similarity of 0.75, are repeated, gaps included: a gap may be as long as a
seventh of the whole run. Runs that hold the share are reported at their longest; two may overlap where their union does not
hold it. The place with the smallest (doc_id, position) is the first and is not reported; null ids come before all others.

Whole copies are one class; each but the smallest doc_id is reported as one passage. Texts of fewer words, null and empty
texts have no passages. Repeated rows (same id, same text) are one document. Texts of any length are read whole. A token that
very many texts share is folded in every task before it is sent, so no bucket grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut_lineage, hash_pieces, mix64, shingle_hashes, ship_package, stored_by, table, text_class, word_hashes, words_of
from quayside.llm.registry import register

SHINGLE, PASSAGE = 5, 50
WIDTH = PASSAGE - SHINGLE + 1
#: A place is (number of the class << PLACE_BITS) | position; the longest text that Spark holds has fewer words.
PLACE_BITS = 30
#: Hash functions, and how many must agree on a place.
HASHES, ENOUGH = 8, 3
SEEDS = mix64(np.arange(201, 201 + HASHES, dtype=np.uint64))
#: Windows that a task holds before it sends them on, and that a bucket holds.
HELD, BUCKET = 200_000, 500_000
#: Bytes of text that a task hashes at once; the arrays of a piece take about fifty times as much memory.
PIECE = 500_000
#: Words of a stored part of the texts.
PART_WORDS = 4_000_000
#: A window: the hash of its smallest token, the class of its text, its ends, its function, and whether the task has its like.
WINDOW = np.dtype([("v", "<u8"), ("c", "<i8"), ("l", "<i4"), ("r", "<i4"), ("f", "u1"), ("m", "u1")])


def text_shingles(texts: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    hashes, counts, _, _ = word_hashes(texts)
    ends = np.cumsum(counts).tolist()
    words = [hashes[e - n : e] for e, n in zip(ends, counts.tolist())]
    return [shingle_hashes(w, SHINGLE) for w in words], counts.tolist()


def passages(at: np.ndarray) -> list[tuple[int, int]]:
    """Runs [first, last] of at least ``WIDTH`` places that begin and end at one of the repeated places ``at`` (sorted), six
    sevenths of them repeated: as few as hold every place of every such run, each the longest from its first place.

    A run from the i-th to the j-th place holds six sevenths where 7j - 6at[j] >= 7i - 6at[i] - 1.
    """
    room = 7 * np.arange(len(at)) - 6 * at
    best = np.maximum.accumulate(room[::-1])[::-1]  # falling, so the last place that reaches a bound is found by bisection
    last = np.searchsorted(-best, 1 - room, side="right") - 1
    first = np.flatnonzero(at[last] - at + 1 >= WIDTH)
    ends = last[first]
    further = np.flatnonzero(np.diff(np.maximum.accumulate(ends), prepend=-1) > 0)
    first, ends = first[further], ends[further]
    out, k = [], 0
    while k < len(first):
        out.append((int(at[first[k]]), int(at[ends[k]])))
        reach = int(np.searchsorted(first, ends[k] + 1, side="right")) - 1  # the furthest that leaves no place out
        k = max(reach, k + 1)
    return out


def smaller_neighbours(keys: list[int], owners: list[int]) -> tuple[list[int], list[int]]:
    """For each key the place of the last smaller one before it and of the first smaller one behind it with its owner, or -1."""
    before, behind, stack = [-1] * len(keys), [-1] * len(keys), []
    for i, key in enumerate(keys):
        if stack and owners[stack[-1]] != owners[i]:
            stack = []
        while stack and keys[stack[-1]] > key:
            behind[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    return before, behind


def compact_windows(texts: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """The compact windows of several texts (as arrays of tokens) for all functions; c is the number of the text.

    The smallest tokens of all runs of ``width`` tokens are the centres of the tree's subtrees of at least that size. A centre
    that is smallest from the j-th to the k-th run ends where that says, unless it leaves the runs itself; then its window
    reaches to the nearest smaller token further away, which is a centre too.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    long_ones = np.flatnonzero(sizes >= width)
    if not len(long_ones):
        return np.empty(0, WINDOW)
    tokens, sizes = np.concatenate([texts[i] for i in long_ones]), sizes[long_ones]
    n, ends = len(tokens), np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(n)
    starts = starts[starts + width <= ends[owner]]
    bits = np.uint64(n.bit_length())
    place = np.arange(n, dtype=np.uint64)
    rest = np.full(-n % width, ~np.uint64(0))
    out = []
    for f in range(HASHES):
        values = mix64(tokens + SEEDS[f])
        keys = (values >> bits << bits) | place  # equal tokens: the first is smaller
        blocks = np.concatenate((keys, rest)).reshape(-1, width)
        head = np.minimum.accumulate(blocks, axis=1).ravel()
        tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        centre = (np.minimum(tail[starts], head[starts + width - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (centre[1:] != centre[:-1]) | (starts[1:] != starts[:-1] + 1))))
        first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
        at = centre[new]
        text = owner[at]
        before, behind = (np.array(x, dtype=np.int64) for x in smaller_neighbours(keys[at].tolist(), text.tolist()))
        left = np.where(first > at - width + 1, first, np.where(before >= 0, at[before] + 1, begins[text]))
        right = np.where(last < at, last + width - 1, np.where(behind >= 0, at[behind] - 1, ends[text] - 1))
        rows = np.empty(len(at), WINDOW)
        rows["v"], rows["c"], rows["l"], rows["r"], rows["f"], rows["m"] = values[at], long_ones[text], left - begins[text], right - begins[text], f, 0
        out.append(rows)
    return np.concatenate(out)


def shared_windows(texts: DataFrame, buckets: int) -> DataFrame:
    """c, l and rf (right end and function) of the windows whose smallest token stands in another window too; ``texts``: c, text."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def dealt(rows: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            return pd.DataFrame({"bucket": names, "ws": [x.tobytes() for x in np.split(rows[order], first[1:])]})

        def flush() -> Iterator[pd.DataFrame]:
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["v"], kind="stable")]
            fresh = np.concatenate(([True], rows["v"][1:] != rows["v"][:-1]))
            several = np.repeat(*(lambda first: (np.diff(np.append(first, len(rows))) > 1, np.diff(np.append(first, len(rows)))))(np.flatnonzero(fresh)))
            sure, one = rows[several], rows[fresh].copy()
            one["m"] = several[fresh]
            yield dealt(one, (one["v"] % np.uint64(buckets)).astype(np.int64))
            if len(sure):  # known to be shared; dealt by text, so a token that all texts share fills no bucket
                yield dealt(sure, -1 - sure["c"] % buckets)

        for batch in batches:
            classes = batch["c"].to_numpy()
            for first, pieces in hash_pieces(list(batch["text"]), PIECE):
                rows = compact_windows(text_shingles(pieces)[0])
                rows["c"] = classes[first + rows["c"]]
                held.append(rows)
                size += len(rows)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def several(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(group["ws"]), WINDOW)
        if group["bucket"].iat[0] >= 0:
            rows = rows[np.argsort(rows["v"], kind="stable")]
            first = np.flatnonzero(np.concatenate(([True], rows["v"][1:] != rows["v"][:-1])))
            sizes = np.diff(np.append(first, len(rows)))
            shared = np.repeat((sizes > 1) | (np.maximum.reduceat(rows["m"], first) > 0), sizes)
            rows = rows[shared & (rows["m"] == 0)]  # the others of a task that had several are on their way already
        return pd.DataFrame({"c": rows["c"], "l": rows["l"].astype(np.int64), "rf": rows["r"].astype(np.int64) * HASHES + rows["f"]})

    return texts.mapInPandas(send, "bucket long, ws binary").groupBy("bucket").applyInPandas(several, "c long, l long, rf long")


def covered(left: np.ndarray, right: np.ndarray, function: np.ndarray, enough: int = ENOUGH) -> list[tuple[int, int]]:
    """Intervals [first, last] of at least ``WIDTH`` places that windows of at least ``enough`` different functions cover."""
    edges, steps = [], []
    for f in np.unique(function):
        a, b = left[function == f], right[function == f]
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        apart = np.concatenate(([True], a[1:] > b[:-1] + 1))  # one function counts once
        ends = b[np.concatenate((np.flatnonzero(apart)[1:], [len(a)])) - 1]
        edges += [a[apart], ends + 1]
        steps += [np.ones(apart.sum(), np.int64), -np.ones(len(ends), np.int64)]
    edge, step = np.concatenate(edges), np.concatenate(steps)
    order = np.argsort(edge, kind="stable")
    places, first = np.unique(edge[order], return_index=True)
    reached = np.cumsum(np.add.reduceat(step[order], first)) >= enough
    turns = np.flatnonzero(np.diff(np.concatenate(([False], reached, [False])).astype(np.int8)))
    return [(int(places[i]), int(places[j]) - 1) for i, j in zip(turns[0::2], turns[1::2]) if places[j] - places[i] >= WIDTH]


def candidates(windows: DataFrame) -> DataFrame:
    """c, starts, ends: the places of each text that may hold a near duplicate."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c, left, rf in zip(batch["c"], batch["l"], batch["rf"]):
                rf = np.asarray(rf, np.int64)
                found = covered(np.asarray(left, np.int64), rf // HASHES, rf % HASHES)
                if found:
                    out.append((c, [a for a, _ in found], [b for _, b in found]))
            yield pd.DataFrame(out, columns=["c", "starts", "ends"])

    packed = windows.groupBy("c").agg(F.collect_list("l").alias("l"), F.collect_list("rf").alias("rf"))
    return packed.mapInPandas(join, "c long, starts array<long>, ends array<long>")


def numbered(found: DataFrame) -> DataFrame:
    """c, d, doc_id (the smallest) and n of every class of texts; c counts from 0 in the order of (doc_id, d), null ids first."""
    classes = found.groupBy("d").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    ordered = cut_lineage(classes.orderBy("doc_id", "d").withColumn("m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("m", 33)
    before, at = [], 0
    for row in sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()):
        before.append((row.part, at))
        at += row.rows
    offsets = found.sparkSession.createDataFrame(before, "part long, before long")
    joined = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    return cut_lineage(joined.select((F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("c"), "d", "doc_id", "n"), "classes")


def find_passages(docs: DataFrame) -> DataFrame:
    """doc_id, d (class of the text), start and n_words (in words), first_doc_id, first_start, repeated (share of shingles)."""
    spark = docs.sparkSession
    ship_package(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_class().alias("d"))

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    found = cut_lineage(known.select("doc_id", "d", F.pandas_udf(count, "long")("text").alias("n")), "found")
    classes = numbered(found)
    # one text per class, whatever the number of its copies: copies are folded in the tasks that read them
    once = known.where(F.octet_length("text") >= 2 * PASSAGE - 1).groupBy("d").agg(F.first("text").alias("text"))
    total = classes.agg(F.sum("n")).head()[0] or 0
    stored = stored_by(once, "d", max(16, -(-total // PART_WORDS)), "texts")  # joins on d leave the texts where they are
    texts = stored.join(classes.where(F.col("n") >= PASSAGE).select("c", "d"), "d").select("c", "text")
    buckets = max(16, -(-2 * HASHES * total // (WIDTH * BUCKET)))
    spans = cut_lineage(candidates(cut_lineage(shared_windows(texts, buckets), "windows")), "candidates")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, pieces in hash_pieces(list(batch["text"]), PIECE):
                hashes, spots = [], []
                for k, shingles in enumerate(text_shingles(pieces)[0], first):
                    base = int(batch["c"].iat[k]) << PLACE_BITS
                    for a, b in zip(batch["starts"].iat[k], batch["ends"].iat[k]):
                        hashes.append(shingles[a : b + 1])
                        spots.append(np.arange(a, b + 1) + base)
                yield pd.DataFrame({"h": np.concatenate(hashes).view(np.int64), "p": np.concatenate(spots)})

    # every place travels once, to the others of its shingle, and meets the first of them before itself
    spots = stored.join(spans.join(classes.select("c", "d"), "c"), "d").select("c", "text", "starts", "ends").mapInPandas(places, "h long, p long")
    before = Window.partitionBy("h").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = spots.withColumn("first", F.first("p").over(before)).where("p <> first").select(F.shiftright("p", PLACE_BITS).alias("c"), F.col("p").bitwiseAND((1 << PLACE_BITS) - 1).alias("at"), "first")
    again = again.groupBy("c").agg(F.collect_list("at").alias("at"), F.collect_list("first").alias("first"))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c, at, first in zip(batch["c"], batch["at"], batch["first"]):
                at, one = np.unique(np.asarray(at, np.int64), return_index=True)
                first = np.asarray(first, np.int64)[one]
                for a, b in passages(at):
                    inside = first[np.searchsorted(at, a) : np.searchsorted(at, b, side="right")]
                    owners, counts = np.unique(inside >> PLACE_BITS, return_counts=True)
                    owner = int(owners[counts.argmax()])
                    place = int(inside[inside >> PLACE_BITS == owner].min()) & ((1 << PLACE_BITS) - 1)
                    out.append((c, a, b - a + SHINGLE, owner, place, len(inside) / (b - a + 1)))
            yield pd.DataFrame(out, columns=["c", "start", "n_words", "o", "first_start", "repeated"])

    spans = cut_lineage(again.mapInPandas(verified, "c long, start long, n_words long, o long, first_start long, repeated double"), "spans")
    own = spans.join(classes.select("c", "d", "doc_id"), "c").join(classes.select(F.col("c").alias("o"), F.col("doc_id").alias("first_doc_id")), "o")
    own = own.select("doc_id", "d", "start", "n_words", "first_doc_id", "first_start", "repeated")
    copies = found.select("doc_id", "d").distinct().join(classes.select("d", F.col("doc_id").alias("r"), "n"), "d").where(~F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("n") >= PASSAGE))
    whole = copies.select("doc_id", "d", F.lit(0).cast("long").alias("start"), F.col("n").alias("n_words"), F.col("r").alias("first_doc_id"), F.lit(0).cast("long").alias("first_start"), F.lit(1.0).alias("repeated"))
    return cut_lineage(own.unionByName(whole), "passages")


def without_passages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their texts; rows of which nothing is left go."""
    spans = find_passages(docs).groupBy("doc_id", "d").agg(F.collect_list(F.struct("start", "n_words")).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__doc"), F.col("d").alias("__d"), "__spans")
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (text_class() == F.col("__d")), "left")

    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, spans_ in zip(texts, cuts):
            if spans_ is None or not len(spans_):
                out.append(text)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            _, _, starts, ends = word_hashes([raw])
            keep, at = [], 0
            for s in sorted((s["start"], s["n_words"]) for s in spans_):
                first = int(starts[s[0]])
                if first > at:
                    keep.append(raw[at:first])
                at = max(at, int(ends[s[0] + s[1] - 1]))
            keep.append(raw[at:])
            left = b" ".join(k.strip() for k in keep if k.strip())
            out.append(left.decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    new = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.pandas_udf(cut, "string")("text", "__spans"))
    joined = joined.withColumn("__new", new).where(F.col("__spans").isNull() | (F.col("__new") != ""))
    return joined.select(*[F.col("__new").alias(c) if c == "text" else F.coalesce(F.when(F.col("__spans").isNull(), docs[c]), F.length("__new").cast("long")).alias(c) if c == "n_chars" else docs[c] for c in docs.columns])


@register("op9_substring_duplicates")
def op9_substring_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return find_passages(table(spark, folder, "documents").select("doc_id", "text")).drop("d")
