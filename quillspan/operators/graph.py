"""Graph operators over an edge table (src, dst).

Searches go level by level; HOPS levels are one job, whose result is written to the shared folder.  Where a depth-first search's result depends on its order, the set of what a breadth-first search finds at the least
depth is taken; it holds at least as much.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..storage import durable

HOPS = 4


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependencies(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("src") == F.lit(node)).select(F.col("dst").alias("node")).distinct()


def dependents(edges: DataFrame, node, own: bool = True) -> DataFrame:
    """Nodes with an edge to ``node``; itself only if ``own``."""
    found = edges.filter(F.col("dst") == F.lit(node))
    return (found if own else found.filter(F.col("src") != F.lit(node))).select(F.col("src").alias("node")).distinct()


def _counted(df: DataFrame, tag: str, **what) -> tuple[DataFrame, dict]:
    """``df`` written, and aggregates of it that the same job has summed up."""
    seen = Observation()
    return durable(df.observe(seen, *[c.alias(k) for k, c in what.items()]), tag), seen.get


def _search(start: DataFrame, out: DataFrame, key: list[str], max_depth: int | None) -> DataFrame:
    """``key``, node and the least depth of what is reached from ``start`` (key, node, depth) along ``out`` (src, next)."""
    seen = frontier = start
    depth = start.agg(F.min("depth")).first()[0] or 0
    rounds = 0
    while max_depth is None or depth < max_depth:
        hops = HOPS if max_depth is None else min(HOPS, max_depth - depth)
        step = frontier
        for d in range(depth, depth + hops):
            met = step.join(out, (step["node"] == out["src"]) & (step["depth"] == d), "left")
            here, there = F.struct("node", "depth"), F.struct(F.col("next").alias("node"), F.lit(d + 1).alias("depth"))
            step = met.select(*key, F.explode(F.when(F.col("next").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x"))
            step = step.groupBy(*key, F.col("x.node").alias("node")).agg(F.min("x.depth").alias("depth"))
        fresh = step.filter(F.col("depth") > depth).join(seen.select(*key, "node"), [*key, "node"], "left_anti")
        depth += hops
        fresh, found = _counted(fresh, "frontier", n=F.count_if(F.col("depth") == depth), every=F.count(F.lit(1)))
        if found["every"]:
            seen = seen.unionByName(fresh)
        if not found["n"]:
            break
        frontier, rounds = fresh.filter(F.col("depth") == depth), rounds + 1
        if rounds % 6 == 0:
            seen = durable(seen, "seen")
    return seen


def _plain(edges: DataFrame) -> DataFrame:
    return durable(edges.select("src", F.col("dst").alias("next")).distinct(), "edges")


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node and depth of everything reached from ``seeds`` (node), seeds at 0."""
    start = durable(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "seen")
    return _search(start, _plain(edges), [], max_depth).select("node", "depth")


def transitive_dependents(edges: DataFrame, node) -> DataFrame:
    """node and depth of dependents at one or more removes; neither ``node`` nor its direct dependents."""
    seeds = edges.sparkSession.createDataFrame([(node,)], edges.select(F.col("src").alias("node")).schema)
    return reachable(reverse(edges), seeds).filter("depth > 1")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) with a path of one edge or more; its size may be the square of the nodes', see max_depth."""
    from .reach import pairs

    return pairs(edges, max_depth)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges that lie on no cycle because nothing leads to their start or leaves their end, again and again."""
    before = None
    while True:
        for _ in range(2):
            edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        edges, now = _counted(edges, "trimmed", n=F.count(F.lit(1)))
        if now["n"] in (before, 0):
            return edges
        before = now["n"]


def strong(edges: DataFrame) -> DataFrame:
    """node and root of the strongly connected components of two nodes or more; a root is one of its component's nodes.

    What no cycle can hold is trimmed.  Then each node takes the least label that reaches it; the nodes from which such
    a label's own node is reached again, within the label, are its component.  These go, and the rest has its turn.
    """
    left, found = edges.filter("src != dst").select("src", "dst").distinct(), None
    while True:
        left = _trimmed(left)
        labels = durable(left.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
        out = left.select(F.col("src").alias("node"), F.col("dst").alias("next"))
        changed = None
        while changed != 0:
            new = labels
            for _ in range(HOPS):
                told = new.join(out, "node").select(F.explode(F.array(F.struct("node", "label"), F.struct(F.col("next").alias("node"), "label"))).alias("x"))
                new = told.groupBy(F.col("x.node").alias("node")).agg(F.min("x.label").alias("label"))
            new = new.join(labels.select("node", F.col("label").alias("old")), "node")
            new, seen = _counted(new, "labels", n=F.count_if(F.col("label") != F.col("old")))
            labels, changed = new.select("node", "label"), seen["n"]
        inside = left.join(labels.select(F.col("node").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("y")), "dst").filter("x = y")
        back = reachable(reverse(inside.select("src", "dst")), labels.filter("node = label")).select("node").join(labels, "node")
        back = durable(back, "component")
        if back.isEmpty():
            return found if found is not None else back.select("node", F.col("label").alias("root"))
        several = back.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label")
        own = back.join(several, "label", "left_semi").select("node", F.col("label").alias("root"))
        found = own if found is None else found.unionByName(own)
        left = without(left, back.select("node"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """The nodes on a cycle: those of the strongly connected components, and those with an edge to themselves."""
    return strong(edges).select("node").union(edges.filter("src = dst").select("src")).distinct()


def chains(edges: DataFrame, start, max_depth: int = 3) -> DataFrame:
    """path (array) and depth of a chain to each edge out of a node found at depth ``max_depth`` or less.

    Depths run from 1 to max_depth + 1.  Each node is expanded once, at its least depth and along the least path.
    """
    key = edges.select(F.col("src").alias("node")).schema
    frontier = edges.sparkSession.createDataFrame([(start,)], key).withColumn("path", F.array("node"))
    base = edges.select("src", F.col("dst").alias("next")).distinct()
    seen, found = frontier.select("node"), None
    for depth in range(1, max_depth + 2):
        step = durable(frontier.join(base, frontier["node"] == base["src"]).select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.lit(depth).alias("depth")), "chains")
        found = step if found is None else found.unionByName(step)
        fresh = step.join(seen, "node", "left_anti")
        first = Window.partitionBy("node").orderBy("path")
        frontier = durable(fresh.withColumn("r", F.row_number().over(first)).filter("r = 1").select("node", "path"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("node"))
    return found.select("path", "depth").dropDuplicates(["path"])


def cycles(edges: DataFrame, start, max_length: int | None = None) -> DataFrame:
    """files (closed: first = last) and severity of the simple cycles reached from ``start``, up to ``max_length`` nodes
    (None: all; their number can grow exponentially with the nodes of a component).

    A cycle starts at its least node, so each is listed once; severity is high for more than three nodes.
    """
    key = edges.select(F.col("src").alias("node")).schema
    near = reachable(edges, edges.sparkSession.createDataFrame([(start,)], key)).select("node")
    inside = edges.join(near, edges["src"] == near["node"], "left_semi").select("src", F.col("dst").alias("next")).distinct()
    on_cycle = durable(cycle_members(inside.select("src", F.col("next").alias("dst"))), "members")
    base = durable(inside.join(on_cycle, inside["src"] == on_cycle["node"], "left_semi"), "edges")
    paths = base.filter("next >= src").select(F.array("src", "next").alias("path"))
    found, length = paths.filter("path[0] = path[1]"), 1
    paths = paths.filter("path[0] < path[1]")
    while max_length is None or length < max_length:
        length += 1
        step = paths.join(base, F.element_at("path", -1) == base["src"]).filter((F.col("next") == F.col("path")[0]) | ((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next"))))
        open_ = F.element_at("path", -1) != F.col("path")[0]
        step, seen = _counted(step.select(F.concat("path", F.array("next")).alias("path")), "paths", n=F.count_if(open_))
        found = found.unionByName(step.filter(~open_))
        if not seen["n"]:
            break
        paths = step.filter(open_)
    return found.select(F.col("path").alias("files"), F.when(F.size("path") > 4, "high").otherwise("medium").alias("severity"))


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that touch none of ``nodes`` (node)."""
    kept = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti")
    return kept.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that ``without`` takes away."""
    return edges.select("src", "dst").subtract(without(edges, nodes))
