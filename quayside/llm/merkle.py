"""A Merkle manifest of a dataset as a persistent, path-copying tree (operator 12).

Each document is a leaf; leaves stand by source and ascending id; every ``ARITY`` consecutive nodes become one node above
them. A source's tree is grown in aligned blocks of ``ARITY ** depth`` nodes: one group of a shuffle holds one block whatever
the size of the source, and hands on one node, its top. The tops are nodes of the next step, until a source has one node
left; the subroots are nodes of one more tree in the same way. Positions come from ranges (``operators.ranks``), so no task
holds a source.

A tampered leaf makes a new version of the tree. Inside its block the version copies only the leaf's ancestors and shares
every other node; above the block it goes on with the path of the block's top, which is known once per block: an array of
(what stands left of the node in its run, what stands right of it) from the block to the root.

Both passes over the leaves shuffle ids and digests, never texts. Null columns are written as ``-``; a null source is a
source of its own, the first; null ids stand first in their source. Repeated ids stand by digest; equal rows are leaves side
by side. Empty texts and very long ones are leaves like others. An empty table gives an empty manifest. Only the five named
columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import cut_lineage, ship_package, table
from quayside.llm.registry import register
from quayside.llm.spelling import CRC, crc_sql
from quayside.operators.ranks import numbered

ARITY, DEPTH = 3, 7

STEPS = "steps array<struct<left: string, right: string>>"


def joined_hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Block:
    """The part of a tree above one block of aligned nodes, with versions that share what they do not change."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([joined_hash(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def steps(self, i: int) -> list[tuple[str, str]]:
        """From node ``i`` to the top: what stands left and right of the path in each run."""
        path = []
        for level in self.levels[:-1]:
            first = i - i % ARITY
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + ARITY])))
            i //= ARITY
        return path


def copied_path(node: str, steps: list[tuple[str, str]]) -> list[str]:
    """The ancestors that a version with ``node`` in that place copies, lowest first."""
    copies = []
    for left, right in steps:
        node = joined_hash(left, node, right)
        copies.append(node)
    return copies


def levels_of(size: int, depth: int) -> int:
    """Levels inside the blocks of a tree of ``size`` nodes: all of them if it is one block, else ``depth``."""
    levels = 0
    while size > 1 and levels < depth:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def block_of(rows: pa.Table, depth: int) -> tuple[pa.Table, Block]:
    rows = rows.sort_by("position")
    return rows, Block(rows["node"].to_pylist(), levels_of(rows["size"][0].as_py(), depth))


STEP_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def as_steps(paths: list[list[tuple[str, str]]]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], STEP_TYPE)


def above_of(table: pa.Table) -> list[tuple[str, str]]:
    return [(s["left"], s["right"]) for s in table["steps"][0].as_py()]


def block_steps(depth: int):
    """The three things that a task does with one block."""

    def top_of(rows: pa.Table) -> pa.Table:
        rows, block = block_of(rows, depth)
        span = ARITY**depth
        place, size = rows["position"][0].as_py() // span, -(-rows["size"][0].as_py() // span)
        return pa.table({"tree": rows["tree"].slice(0, 1), "position": pa.array([place], pa.int64()), "size": pa.array([size], pa.int64()), "node": [block.top]})

    def extend(rows: pa.Table, above: pa.Table) -> pa.Table:
        """The nodes of one block with their whole paths: the block's own, then that of its top."""
        rows, block = block_of(rows, depth)
        rest = above_of(above)
        return pa.table({"tree": rows["tree"], "position": rows["position"], "steps": as_steps([block.steps(i) + rest for i in range(len(rows))])})

    def verify(rows: pa.Table, above: pa.Table) -> pa.Table:
        """The leaves of one block with the digest of their proof and the version that their present content makes."""
        rows, block = block_of(rows, depth)
        rest, subroot, root = above_of(above), above["subroot"][0].as_py(), above["root"][0].as_py()
        proofs, copies, folded = [], [], []
        for i, (leaf, now) in enumerate(zip(rows["node"].to_pylist(), rows["present"].to_pylist())):
            steps = block.steps(i) + rest
            proofs.append(joined_hash(*[side for step in steps for side in step]))
            path = copied_path(now, steps)
            folded.append(path[-1] if path else now)
            copies.append(path if now != leaf else [])
        n = len(rows)
        return pa.table({
            "doc_id": rows["doc_id"], "source": rows["source"], "position": rows["position"], "leaf": rows["node"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs,
            "folded_root": folded, "verified": pa.array([f == root for f in folded], pa.bool_()), "copied": pa.array(copies, pa.list_(pa.string())),
        })

    return top_of, extend, verify


def leaf_hash(columns: list):
    """H of the columns: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered=None, change=None) -> DataFrame:
    """tree, doc_id, source, node, present: each row's leaf, and the leaf of its content as it is found now.

    ``tampered`` tells which rows have changed since the manifest was made and ``change`` what their text has become.
    """
    named = ["doc_id", "source", "lang", "n_chars"]
    node = leaf_hash([F.col(c) for c in named] + [F.col("text")])
    present = node if tampered is None else F.when(tampered, leaf_hash([F.col(c) for c in named] + [change])).otherwise(node)
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))  # null first, then by code point
    return docs.select(tree.alias("tree"), "doc_id", "source", node.alias("node"), present.alias("present"))


def _blocks(nodes: DataFrame, depth: int):
    return nodes.withColumn("block", F.floor(F.col("position") / ARITY**depth)).groupBy("tree", "block")


def grow(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes at the bottom of every tier of blocks; the last table has one node per tree."""
    tiers, top_of = [nodes], block_steps(depth)[0]
    while not tiers[-1].where("size > 1").isEmpty():
        tops = _blocks(tiers[-1].select("tree", "position", "size", "node"), depth).applyInArrow(top_of, "tree string, position long, size long, node string")
        tiers.append(cut_lineage(tops, "tops"))
    return tiers


def paths(tiers: list[DataFrame], above: DataFrame, depth: int) -> DataFrame:
    """tree, position, steps for the nodes of the lowest of ``tiers``; ``above`` has the steps of each tree's top node."""
    extend = block_steps(depth)[1]
    for tier in reversed(tiers[:-1]):
        own = _blocks(tier.select("tree", "position", "size", "node"), depth)
        above = cut_lineage(own.cogroup(above.withColumn("block", F.col("position")).groupBy("tree", "block")).applyInArrow(extend, f"tree string, position long, {STEPS}"), "paths")
    return above


def manifest(docs: DataFrame, tampered=None, change=None, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, source, position, leaf, subroot, root, proof_sha256, folded_root, verified, copied.

    ``copied`` are the nodes of the version that a changed leaf makes, from the lowest ancestor to its root; all others are
    shared with the first version.
    """
    ship_package(docs.sparkSession)
    placed = numbered(leaves(docs, tampered, change), ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("node").asc()], size="size")
    placed = cut_lineage(placed, "leaves")
    tiers = grow(placed, depth)
    subroots = tiers[-1].select(F.col("tree").alias("source_tree"), F.col("node"))
    ranked = cut_lineage(numbered(subroots.withColumn("tree", F.lit("")), ["tree"], [F.col("source_tree").asc()], size="size"), "subroots")
    upper = grow(ranked, depth)
    start = upper[-1].select("tree", "position", F.col("node").alias("root"))
    tops = paths(upper, start.select("tree", "position", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("steps")), depth)
    # one row per source; all have the one root
    ends = ranked.join(tops, ["tree", "position"]).join(start.select("tree", "root"), "tree")
    ends = cut_lineage(ends.select(F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("position"), "steps", F.col("node").alias("subroot"), "root"), "ends")
    above = paths(tiers[1:], ends.select("tree", "position", "steps"), depth) if len(tiers) > 1 else ends.select("tree", "position", "steps")
    above = above.join(ends.select("tree", "subroot", "root"), "tree").withColumn("block", F.col("position"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {doc_id}, source string, position long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"
    return _blocks(placed, depth).cogroup(above.groupBy("tree", "block")).applyInArrow(block_steps(depth)[2], out)


def text_bytes_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(text_bytes_sql(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


def _tree_sql(name: str, base: str) -> str:
    """{name}: all nodes (tree, level, i, n, h) above a base; {name}_side: with what stands left and right of each."""
    before, after = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    run = "PARTITION BY tree, level, i // 3 ORDER BY i"
    return f"""{name}(tree, level, i, n, h) AS (SELECT tree, 0, i, n, h FROM {base}
  UNION ALL SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3, n),
{name}_side AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} {before}), '') AS l, coalesce(string_agg(h, '') OVER ({run} {after}), '') AS r FROM {name} WHERE n > 1)"""


ORACLE = f"""
WITH RECURSIVE {CRC},
a AS (SELECT doc_id, source, {_leaf_sql('text')} AS h, {_leaf_sql("replace(text, chr(10), '')")} AS cut,
  {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 2 = 0 AS hit FROM documents, crc_table),
leaf AS (SELECT *, coalesce('s' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM a),
{_tree_sql('low', 'leaf')},
sub AS (SELECT tree AS source_tree, '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree_sql('high', 'sub')},
walk(k, tree, level, i, h, proof) AS (SELECT i || ':' || tree, tree, 0, i, CASE WHEN coalesce(hit, FALSE) THEN cut ELSE h END, '' FROM leaf
  UNION ALL SELECT k, w.tree, w.level + 1, w.i // 3, sha256(l || w.h || r), proof || l || r FROM walk w JOIN low_side s ON s.tree = w.tree AND s.level = w.level AND s.i = w.i),
at_sub AS (SELECT k, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walk GROUP BY k, tree),
climb(k, level, i, h, proof) AS (SELECT k, 0, sub.i, at_sub.h, proof FROM at_sub JOIN sub ON sub.source_tree = at_sub.tree
  UNION ALL SELECT k, w.level + 1, w.i // 3, sha256(l || w.h || r), proof || l || r FROM climb w JOIN high_side s ON s.level = w.level AND s.i = w.i),
done AS (SELECT k, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM climb GROUP BY k),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub ON sub.source_tree = leaf.tree JOIN done ON done.k = leaf.i || ':' || leaf.tree, top
"""


@register("op12_merkle_manifest", ORACLE)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    whole = manifest(docs, hit, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return whole.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
