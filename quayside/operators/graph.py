"""Dependency graphs.

A tree is grown level by level: the frontier joins the edges on (project, parent), and each level is written to the
shared folder, so a lost executor costs one level and the plan does not grow with the depth.

Only G2 itself lists every path. Figures about the tree (A5) and the class of its edges (K5) come from counts: a path passes
the strongly connected components one after the other, so what arrives at a node is summed and goes on as one row per depth,
and paths are listed only inside a component that is a cycle. Small projects come whole to a task, which walks many at once. G3 lists only paths that lead to a node it looks for.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayside.operators import trees
from quayside.session import cut_lineage, ship_package


# The first depth at which links of projects that are done are left out.
FEWER = 8


def _step(df: DataFrame, label: str = "step") -> DataFrame:
    """A step as a table whose joins shuffle: nodes and edges grow with the fleet, and a small file may hold very many of
    them, so no join of a level may send its table through the driver."""
    return cut_lineage(df, label).hint("merge")


def dep_edges(lock: DataFrame) -> DataFrame:
    """G1: (project, parent, child) with flags, from the ``requires`` maps of lock entries."""
    return lock.select("project_id", F.col("package").alias("parent"), F.explode(F.map_keys("requires")).alias("child"), "dev", "optional").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on."""
    parents = edges.select("project_id", F.col("parent").alias("node")).distinct()
    return parents.join(edges.select("project_id", F.col("child").alias("node")).hint("merge"), ["project_id", "node"], "left_anti")


def _links(edges: DataFrame) -> DataFrame:
    """Distinct edges, computed once for the joins of all levels."""
    return _step(edges.select("project_id", F.col("parent").alias("_from"), F.col("child").alias("_to")).distinct(), "edges")


def _alive(links: DataFrame, level: DataFrame, depth: int) -> DataFrame:
    """The links of the projects that a level still stands in; looked at when the depth has doubled, from ``FEWER`` on, so
    that deep graphs of a few projects do not take the links of all others along."""
    if depth < FEWER or depth & (depth - 1):
        return links
    return _step(links.join(level.select("project_id").distinct(), "project_id", "left_semi"), "alive")


def expand_tree(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Every node below the roots with its depth and path; a node already on its path closes a cycle.

    ``start`` has (project_id, node). The tree is whole: a path ends at a leaf or where it closes a cycle.
    """
    links = _links(edges)
    level = _step(start).select("project_id", "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("cycle"))
    levels = [level]
    for depth in count(1):
        grown = level.where(~F.col("cycle")).withColumnRenamed("node", "_from").join(links, ["project_id", "_from"])
        level = _step(
            grown.select(
                "project_id", F.col("_to").alias("node"), F.lit(depth).alias("depth"),
                F.concat("path", F.array("_to")).alias("path"), F.expr("array_contains(path, _to)").alias("cycle"),
            )
        )
        if level.isEmpty():
            break
        levels.append(level)
        links = _alive(links, level.where(~F.col("cycle")), depth)
    return reduce(DataFrame.unionByName, levels)


def shown(tree: DataFrame, max_depth: int | None = None, name: str | None = None) -> DataFrame:
    """The part of a tree that a display asks for: down to a depth, names that contain a text."""
    if max_depth is not None:
        tree = tree.where(F.col("depth") <= max_depth)
    return tree if name is None else tree.where(F.lower("node").contains(name.lower()))


def mark_duplicates(tree: DataFrame) -> DataFrame:
    """A node is a duplicate when a shallower (then smaller) path already shows it."""
    place = F.struct("depth", F.array_join("path", ">").alias("shown"))
    first = tree.groupBy("project_id", "node").agg(F.min(place).alias("_first"))
    return tree.join(first, ["project_id", "node"]).withColumn("duplicate", place != F.col("_first")).drop("_first")


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All reachable nodes with their shortest depth. Each link is followed once, so dense graphs do not explode.

    A level takes the links of its nodes out of those that are left, so a level costs what is left and no level meets the
    nodes that were seen before: a node that comes again finds no links. The least depths are taken once, at the end.
    """
    links = _links(edges)
    level = _step(start.select("project_id", "node", F.lit(0).alias("depth")).distinct())
    found = [level]
    for depth in count(1):
        here = level.select("project_id", F.col("node").alias("_from"), F.lit(True).alias("_followed")).distinct()
        split = _step(links.join(here, ["project_id", "_from"], "left").select("project_id", "_from", "_to", F.col("_followed").isNotNull().alias("_followed")))
        level = split.where("_followed").select("project_id", F.col("_to").alias("node"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        found.append(level)
        links = _alive(split.where("NOT _followed").drop("_followed"), level, depth)
    nameless = F.when(F.col("node").isNull(), F.col("depth"))  # a missing name is no node that could be the same
    whole = reduce(DataFrame.unionByName, found)
    return whole.groupBy("project_id", "node", nameless.alias("_nameless")).agg(F.min("depth").alias("depth")).drop("_nameless")


def visible_roots(start: DataFrame, lock: DataFrame, dev: bool = True, optional: bool = False, name: str | None = None) -> DataFrame:
    """The roots that a display asks for: without packages whose entries are all dev (all optional), names that contain a text."""
    flags = lock.groupBy("project_id", F.col("package").alias("node")).agg(F.bool_and("dev").alias("_dev"), F.bool_and("optional").alias("_optional"))
    hidden = (F.lit(not dev) & F.col("_dev")) | (F.lit(not optional) & F.col("_optional"))
    kept = start.join(flags.where(hidden), ["project_id", "node"], "left_anti")
    return kept if name is None else kept.where(F.lower("node").contains(name.lower()))


def find_paths(edges: DataFrame, start: DataFrame, text: str) -> DataFrame:
    """All root-to-package paths whose package name contains a text.

    What can reach such a package is found first, against the direction of the edges; only that is expanded.
    """
    both = edges.select("project_id", "parent", "child").distinct()
    nodes = both.select("project_id", F.explode(F.array("parent", "child")).alias("node")).unionByName(start.select("project_id", "node")).distinct()
    wanted = F.lower("node").contains(text.lower())
    useful = reach(both.select("project_id", F.col("child").alias("parent"), F.col("parent").alias("child")), nodes.where(wanted)).select("project_id", "node")
    useful = _step(useful, "useful")
    leading = both.join(useful.withColumnRenamed("node", "child"), ["project_id", "child"], "left_semi")
    tree = expand_tree(leading, start.join(useful, ["project_id", "node"], "left_semi"))
    return tree.where(wanted).select("project_id", "node", F.array_join("path", " -> ").alias("path"))


def _trim(links: DataFrame) -> DataFrame:
    """Links without those that start where nothing arrives or end where nothing goes on; what is left holds all cycles."""
    size = links.count()
    while size:
        for _ in range(2):
            entered = links.select("project_id", F.col("_to").alias("_from")).distinct()
            left = links.select("project_id", F.col("_from").alias("_to")).distinct()
            links = links.join(entered, ["project_id", "_from"], "left_semi").join(left, ["project_id", "_to"], "left_semi")
        links = _step(links.select("project_id", "_from", "_to"), "trim")
        before, size = size, links.count()
        if size == before:
            break
    return links


def components(edges: DataFrame) -> DataFrame:
    """(project, node, component) for every node on a cycle; the component is named after its smallest node.

    After trimming, every node takes the smallest name that reaches it; those that also reach the node of that name are its
    component. What is left is trimmed and named again, until nothing is left.
    """
    links, found = _trim(_links(edges)), []
    while not links.isEmpty():
        named = _step(links.select("project_id", F.explode(F.array("_from", "_to")).alias("node")).distinct().withColumn("component", F.col("node")), "names")
        while True:
            told = links.join(named.withColumnRenamed("node", "_from"), ["project_id", "_from"]).groupBy("project_id", F.col("_to").alias("node")).agg(F.min("component").alias("_told"))
            smaller = F.least("component", F.coalesce("_told", "component"))
            now = _step(named.join(told, ["project_id", "node"], "left").select("project_id", "node", smaller.alias("component"), (smaller < F.col("component")).alias("_moved")), "names")
            named = now.drop("_moved")
            if now.where("_moved").isEmpty():
                break
        same = links.join(named.withColumnRenamed("node", "_from"), ["project_id", "_from"]).join(
            named.select("project_id", F.col("node").alias("_to"), F.col("component").alias("_other")), ["project_id", "_to"]
        ).where("component = _other")
        # inside one name every path stays in that name's set, so going back from the named node finds its component
        back = same.select("project_id", F.col("_to").alias("parent"), F.col("_from").alias("child"))
        heads = named.where("node = component").select("project_id", "node")
        members = _step(reach(back, heads).select("project_id", "node").join(named, ["project_id", "node"]), "members")
        found.append(members)
        gone = members.select("project_id", "node")
        rest = links.join(gone.withColumnRenamed("node", "_from"), ["project_id", "_from"], "left_anti").join(gone.withColumnRenamed("node", "_to"), ["project_id", "_to"], "left_anti")
        links = _trim(_step(rest.select("project_id", "_from", "_to"), "rest"))
    if not found:
        return edges.select("project_id", F.col("parent").alias("node"), F.col("parent").alias("component")).limit(0)
    # a single node without a link to itself is no cycle
    whole = reduce(DataFrame.unionByName, found)
    inner = _links(edges).join(whole.withColumnRenamed("node", "_from"), ["project_id", "_from"]).join(
        whole.select("project_id", F.col("node").alias("_to"), F.col("component").alias("_other")), ["project_id", "_to"]
    ).where("component = _other")
    return _step(inner.select("project_id", F.explode(F.array("_from", "_to")).alias("node"), "component").distinct(), "components")


MOST_PATHS = 10**18


def _small_trees(edges: DataFrame, start: DataFrame, wanted: tuple[int, ...]) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """What ``trees`` finds of the projects that fit a batch, and the edges and starts of the others, if there are any.

    Projects of many rows, and rows without a project, which are no tree, keep to the joins; a list of the former has a row per
    ``trees.MOST_ROWS`` edges, whatever the input.
    """
    ship_package(edges.sparkSession)
    sizes = edges.where("project_id IS NOT NULL").groupBy("project_id").count()
    large = _step(sizes.where(F.col("count") > trees.MOST_ROWS).select("project_id"), "large")

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        few = rows.where("project_id IS NOT NULL").join(F.broadcast(large), "project_id", "left_anti")
        return few, rows.where("project_id IS NULL").unionByName(rows.join(F.broadcast(large), "project_id", "left_semi"))

    links = parted(edges.select("project_id", F.col("parent").alias("node"), "child", F.lit(False).alias("start")))
    begin = parted(start.select("project_id", "node", F.lit(None).cast("string").alias("child"), F.lit(True).alias("start")))
    schema = links[0].select("project_id").schema
    for field in _fields(trees.FIELDS):
        schema = schema.add(field)
    dealt = links[0].unionByName(begin[0]).repartition("project_id").sortWithinPartitions("project_id")
    found = cut_lineage(dealt.mapInArrow(trees.in_trees(wanted), schema), "trees", 2 * edges.count())
    handed = found.where(F.col("kind") == trees.HANDED).select("project_id", "node", "child", "start")
    rest = _step(links[1].unionByName(begin[1]).unionByName(handed), "rest")
    if rest.isEmpty():
        return found, None
    return found, (rest.where("NOT start").select("project_id", F.col("node").alias("parent"), "child"), rest.where("start").select("project_id", "node"))


def _fields(ddl: str) -> list:
    return StructType.fromDDL(ddl).fields


def path_counts(edges: DataFrame, start: DataFrame, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """How many rows the tree of G2 has for each node and depth, and which of its steps close a cycle.

    The first table has (project, node, depth, n, closings): paths that end at the node, and those of them that end there
    because the node stood on the path before; without ``counted`` it is left out where that saves work. The second one has
    (project, parent, child). A count stays at 10^18 once it is there. Small projects are walked many at a time (``trees``).
    """
    found, rest = _small_trees(edges, start, (trees.COUNTED, trees.CLOSING) if counted else (trees.CLOSING,))
    big = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("n", "closings")]
    counts = found.where(F.col("kind") == trees.COUNTED).select("project_id", "node", "depth", *big)
    closing = found.where(F.col("kind") == trees.CLOSING).select("project_id", F.col("node").alias("parent"), "child")
    if rest is None:
        return counts, closing
    more, others = large_path_counts(*rest)
    return counts.unionByName(more), closing.unionByName(others)


def large_path_counts(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path_counts`` by joins, without listing paths outside a component: for projects of any size and number of paths."""
    links = _links(edges)
    cyclic = components(edges)
    has_cycles = not cyclic.isEmpty()
    across = links
    if has_cycles:
        sides = links.join(cyclic.select("project_id", F.col("node").alias("_from"), F.col("component").alias("_a")), ["project_id", "_from"], "left").join(
            cyclic.select("project_id", F.col("node").alias("_to"), F.col("component").alias("_b")), ["project_id", "_to"], "left"
        )
        sides = _step(sides, "sides")
        across = sides.where("_a IS NULL OR _b IS NULL OR _a <> _b").select("project_id", "_from", "_to")
        within = sides.where("_a = _b").select("project_id", F.col("_from").alias("parent"), F.col("_to").alias("child"))
        entered = across.select("project_id", F.col("_to").alias("node")).unionByName(start.select("project_id", "node")).distinct()
        inside = _step(expand_tree(within, entered.join(cyclic, ["project_id", "node"], "left_semi")), "inside").withColumn("entry", F.col("path")[0])
        steps = inside.groupBy("project_id", "entry", F.col("node").alias("_node"), F.col("depth").alias("_depth")).agg(F.count_if(~F.col("cycle")).alias("_on"), F.count_if("cycle").alias("_closed"))
        steps = _step(steps, "steps").withColumnRenamed("entry", "node")

    def most(n):
        return F.least(n, F.lit(MOST_PATHS).cast("decimal(38,0)")).cast("decimal(38,0)")

    def visits(arrivals: DataFrame) -> DataFrame:
        if not has_cycles:
            return arrivals.select("project_id", "node", "depth", "n", F.lit(0).cast("decimal(38,0)").alias("closings"), F.lit(True).alias("entry"))
        on, closed = F.coalesce("_on", F.lit(1)), F.coalesce("_closed", F.lit(0))
        return arrivals.join(steps, ["project_id", "node"], "left").select(
            "project_id", F.coalesce("_node", "node").alias("node"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            most(F.col("n") * on).alias("n"), most(F.col("n") * closed).alias("closings"), (F.coalesce("_depth", F.lit(0)) == 0).alias("entry"),
        )

    first = start.select("project_id", "node").distinct().select("project_id", "node", F.lit(0).alias("depth"), F.lit(1).cast("decimal(38,0)").alias("n"))
    level = _step(visits(first), "visits")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        onward = level.where("n > 0").withColumnRenamed("node", "_from").join(across, ["project_id", "_from"])
        level = _step(visits(onward.groupBy("project_id", F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth")).agg(most(F.sum("n")).alias("n"))), "visits")
    whole = reduce(DataFrame.unionByName, levels or [level])
    counted = whole.groupBy("project_id", "node", "depth").agg(most(F.sum("n")).alias("n"), most(F.sum("closings")).alias("closings"))
    if not has_cycles:
        return counted, links.limit(0).toDF("project_id", "parent", "child")
    entries = whole.where("entry").select("project_id", F.col("node").alias("entry")).distinct()
    closing = inside.where("cycle").select("project_id", "entry", F.element_at("path", -2).alias("parent"), F.col("node").alias("child"))
    return counted, closing.join(entries, ["project_id", "entry"], "left_semi").select("project_id", "parent", "child").distinct()


def tree_stats(counts: DataFrame) -> DataFrame:
    """A5: per project: tree nodes, distinct packages, depth, repeated packages, cycles, verdict; from ``path_counts``."""
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    per_node = counts.groupBy("project_id", "node").agg(F.sum(F.col("n") + F.col("closings")).alias("n"), F.max("depth").alias("depth"), F.sum("closings").alias("cycles"))
    stats = per_node.groupBy("project_id").agg(
        F.least(F.sum("n"), most).cast("long").alias("total"), F.count(F.lit(1)).alias("unique_packages"), F.max("depth").alias("max_depth"),
        F.count_if(F.col("n") > 1).alias("repeated"), F.least(F.sum("cycles"), most).cast("long").alias("cycles"),
    )
    return _judged(stats)


def _judged(stats: DataFrame) -> DataFrame:
    verdict = (
        F.when(F.col("cycles") > 0, "circular")
        .when(F.col("repeated") > 10, "many duplicates")
        .when(F.col("max_depth") > 10, "deep")
        .when((F.col("repeated") == 0) & (F.col("max_depth") < 8), "healthy")
        .otherwise("fair")
    )
    return stats.withColumn("verdict", verdict)


def project_stats(edges: DataFrame, start: DataFrame) -> DataFrame:
    """A5: ``tree_stats`` of ``path_counts``; the figures of small projects are taken where their trees are walked."""
    found, rest = _small_trees(edges, start, (trees.FIGURES,))
    stats = _judged(found.where(F.col("kind") == trees.FIGURES).select(
        "project_id", F.col("n").alias("total"), F.col("nodes").alias("unique_packages"), F.col("depth").alias("max_depth"), "repeated", F.col("closings").alias("cycles")))
    return stats if rest is None else stats.unionByName(tree_stats(large_path_counts(*rest)[0]))


def classed_edges(edges: DataFrame, closing: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """K5: distinct edges with the class of the child: cycle, dev, optional, vulnerable, plain; ``closing`` from ``path_counts``."""
    cycles = closing.select("project_id", "parent", "child", F.lit(True).alias("cycle"))
    bad = vulnerable.select("project_id", F.col("package").alias("child"), F.lit(True).alias("vulnerable")).distinct()
    joined = edges.join(cycles.hint("merge"), ["project_id", "parent", "child"], "left").join(bad.hint("merge"), ["project_id", "child"], "left")
    kind = (
        F.when(F.col("cycle"), "cycle").when(F.col("dev"), "dev").when(F.col("optional"), "optional").when(F.col("vulnerable"), "vulnerable").otherwise("plain")
    )
    return joined.select("project_id", "parent", "child", kind.alias("class")).distinct()
