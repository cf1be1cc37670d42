"""How many nodes reach each node, and which; cycles in bounded number, and reachability kept up to date.

Only ``pairs`` makes a table of pairs, at its end.  Exact sizes come from bit sets: sources are numbered, a block of them is a row of WORDS
bigints a node, and a round ORs the rows that changed along the edges, HOPS levels a job.  Estimates come from the
``k`` least ranks among what reaches a node, passed along the same edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from .graph import HOPS, _counted, reachable, strong
from .ranking import numbered

WORDS, TOGETHER, RANKS = 4, 1024, 64


def _plain(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node), and distinct edges between different ones (src, next)."""
    edges = durable(edges.select("src", F.col("dst").alias("next")).distinct(), "edges")
    return edges.select(F.col("src").alias("node")).union(edges.select("next")).distinct(), edges.filter("src != next")


def _spread(state: DataFrame, out: DataFrame, merge: Callable[[DataFrame], DataFrame], held: list[str], hops: int = HOPS) -> DataFrame:
    """``state`` (node, ``held``, fresh) after ``hops`` levels from its fresh rows; ``merge`` sums up rows of a node."""
    step = state.filter("fresh")
    for _ in range(hops):
        met = step.join(out, step["node"] == out["src"], "left")
        here, there = F.struct("node", *held, "fresh"), F.struct(F.col("next").alias("node"), *held, F.lit(True).alias("fresh"))
        step = merge(met.select(F.explode(F.when(F.col("src").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x")).select("x.*"))
    return step


def _numbered(nodes: DataFrame, words: int) -> tuple[DataFrame, int]:
    """``nodes`` (node) with a number, its block of 64 * ``words`` and its bit in each word, and how many blocks there are."""
    nodes = durable(numbered(nodes, [F.col("node")], "i").select("node", (F.col("i") - 1).cast("long").alias("i")), "numbered")
    width = 64 * words
    word, bit = F.floor(F.col("i") % width / 64), F.expr("shiftleft(1L, cast(i % 64 AS int))")
    own = nodes.select("node", "i", F.floor(F.col("i") / width).alias("block"), *[F.when(word == j, bit).otherwise(F.lit(0).cast("long")).alias(f"w{j}") for j in range(words)])
    return own, (nodes.agg(F.max("i")).first()[0] or 0) // width + 1


def _bit_sets(start: DataFrame, out: DataFrame, blocks: int, words: int, together: int, levels: int | None = None) -> Iterator[DataFrame]:
    """``start`` (node, block, words) passed along ``out`` until nothing changes, or for ``levels``; ``together`` blocks at a time."""
    bits = [f"w{j}" for j in range(words)]

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node", "block").agg(*[F.bit_or(b).alias(b) for b in bits], F.max("fresh").alias("fresh"))

    for first in range(0, blocks, together):
        here = start.filter((F.col("block") >= first) & (F.col("block") < first + together)) if blocks > together else start
        state = durable(merge(here.withColumn("fresh", F.lit(True))), "bits")
        fresh, left = 1, levels
        while fresh and left != 0:
            hops = HOPS if left is None else min(HOPS, left)
            left = None if left is None else left - hops
            old = state.select("node", "block", *bits, *[F.col(b).alias(f"old_{b}") for b in bits])
            new = _spread(state, out, merge, ["block", *bits], hops).select("node", "block", *bits, *[F.lit(0).cast("long").alias(f"old_{b}") for b in bits])
            both = old.unionByName(new).groupBy("node", "block").agg(*[F.bit_or(b).alias(b) for b in bits], *[F.bit_or(f"old_{b}").alias(f"old_{b}") for b in bits])
            changed = F.array(*bits) != F.array(*[f"old_{b}" for b in bits])
            state, seen = _counted(both.select("node", "block", *bits, changed.alias("fresh")), "bits", n=F.count_if("fresh"))
            fresh = seen["n"]
        yield state


def sizes(edges: DataFrame, words: int = WORDS, together: int = TOGETHER) -> DataFrame:
    """node and n: how many other nodes have a path to it, exactly.

    A block holds 64 * ``words`` sources, and ``together`` blocks are searched at once; so a round writes at most
    ``together`` rows of ``words`` bigints a node, whatever the number of nodes.
    """
    nodes, out = _plain(edges)
    own, blocks = _numbered(nodes, words)
    bits = [f"w{j}" for j in range(words)]
    counted = None
    for state in _bit_sets(own.select("node", "block", *bits), out, blocks, words, together):
        n = sum((F.bit_count(b) for b in bits[1:]), F.bit_count(bits[0])).cast("long")
        part = state.groupBy("node").agg(F.sum(n).alias("n"))
        counted = part if counted is None else counted.unionByName(durable(part, "sizes"))
    return counted.groupBy("node").agg((F.sum("n") - 1).alias("n"))


def pairs(edges: DataFrame, max_depth: int | None = None, words: int = WORDS, together: int = TOGETHER) -> DataFrame:
    """Distinct pairs (a, b) with a path of one edge or more, of ``max_depth`` at most.

    Bit sets as in ``sizes``, but a node starts with those that have an edge to it, so it holds itself only if it lies on
    a cycle.  Rounds pass 256 sources a row; the pairs are made once, from the last sets.
    """
    every = durable(edges.select("src", F.col("dst").alias("next")).distinct(), "edges")
    if max_depth is not None and max_depth <= 1:
        return every.select(F.col("src").alias("a"), F.col("next").alias("b"))
    nodes = every.select(F.col("src").alias("node")).union(every.select("next")).distinct()
    own, blocks = _numbered(nodes, words)
    bits = [f"w{j}" for j in range(words)]
    start = every.join(own, every["src"].eqNullSafe(own["node"])).select(F.col("next").alias("node"), "block", *bits)
    found = None
    for state in _bit_sets(start, every.filter("NOT src <=> next"), blocks, words, together, None if max_depth is None else max_depth - 1):
        word = F.explode(F.array(*[F.struct((F.col("block") * words + j).alias("word"), F.col(b).alias("w")) for j, b in enumerate(bits)]))
        some = state.select("node", word.alias("x")).select("node", "x.*").filter("w != 0")
        part = some.select("node", "word", F.expr("explode(filter(sequence(0, 63), k -> getbit(w, k) = 1))").alias("k")).select("node", (F.col("word") * 64 + F.col("k")).cast("long").alias("i"))
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("node", "b").join(own.select(F.col("node").alias("a"), "i"), "i").select("a", "b")


def rank(node: Column) -> Column:
    """A number in [0, 1) for each node: 52 bits of the MD5 of its text."""
    return F.conv(F.substring(F.md5(node.cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def estimated_sizes(edges: DataFrame, k: int = RANKS) -> DataFrame:
    """node and n (double): how many other nodes have a path to it, exact below ``k``, else (k - 1) / the k-th least rank.

    The standard error is about 1 / sqrt(k - 2) of the size.  A node holds ``k`` ranks at most at any time, and each
    task sends at most ``k`` a node.
    """
    nodes, out = _plain(edges)
    least = Window.partitionBy("node").orderBy("rank")

    def merge(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("node", "rank").agg(F.min("fresh").alias("fresh"))
        return one.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k).drop("r")

    state = durable(merge(nodes.select("node", rank(F.col("node")).alias("rank"), F.lit(True).alias("fresh"))), "ranks")
    fresh = 1
    while fresh:
        old = state.select("node", "rank", F.lit(False).alias("fresh"))
        new = _spread(state, out, merge, ["rank"]).select("node", "rank", F.lit(True).alias("fresh"))
        state, seen = _counted(merge(old.unionByName(new)), "ranks", n=F.count_if("fresh"))
        fresh = seen["n"]
    found = state.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.max("rank").alias("last"))
    n = F.when(F.col("c") < k, F.col("c").cast("double")).otherwise(F.lit(float(k - 1)) / F.col("last"))
    return found.select("node", (n - 1).alias("n"))


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """src, dst, files (closed: first = last = dst) and severity: one shortest cycle for each closing edge src -> dst.

    In each strongly connected component a breadth-first tree grows from its least node, a node's parent being the least
    of those one level up.  An edge closes a cycle where it leads to an ancestor of its start; the tree's path between them
    is a shortest one.  So there is at most one row an edge, and at least one a component; an edge of a node to itself is a
    row too.  Severity is high for more than three nodes.
    """
    root = durable(strong(edges), "strong")
    name = lambda end, to: root.select(F.col("node").alias(end), F.col("root").alias(to))
    inside = edges.filter("src != dst").select("src", "dst").distinct().join(name("src", "x"), "src").join(name("dst", "y"), "dst").filter("x = y").select("src", "dst")
    inside = durable(inside, "inside")
    depths = durable(reachable(inside, root.filter("node = root").select("node")), "depths")
    depth = lambda end, to: depths.select(F.col("node").alias(end), F.col("depth").alias(to))
    levels = durable(inside.join(depth("src", "a"), "src").join(depth("dst", "b"), "dst"), "levels")
    tree = durable(levels.filter("b = a + 1").groupBy(F.col("dst").alias("child")).agg(F.min("src").alias("parent")), "tree")
    walks = levels.filter("b <= a").select("src", "dst", F.col("src").alias("at"), (F.col("a") - F.col("b")).alias("left"), F.array("src", "dst").alias("files"))
    found = edges.filter("src = dst").select("src", "dst", F.array("src", "dst").alias("files")).distinct()
    while True:
        for _ in range(HOPS):
            up = walks.join(tree, (walks["at"] == tree["child"]) & (walks["left"] > 0), "left")
            goes = F.col("parent").isNotNull()
            walks = up.select("src", "dst", F.coalesce("parent", "at").alias("at"), F.when(goes, F.col("left") - 1).otherwise(F.col("left")).alias("left"),
                              F.when(goes, F.concat(F.array("parent"), "files")).otherwise(F.col("files")).alias("files"))
        walks, seen = _counted(walks.filter("left > 0 OR at = dst"), "walks", n=F.count_if(F.col("left") > 0))
        found = found.unionByName(walks.filter("left = 0").select("src", "dst", "files"))
        if not seen["n"]:
            return found.select("src", "dst", "files", F.when(F.size("files") > 4, "high").otherwise("medium").alias("severity"))
        walks = walks.filter("left > 0")


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.min("depth").alias("depth"))


def refreshed(known: DataFrame, edges: DataFrame, gone: DataFrame, added: DataFrame, seeds: DataFrame) -> DataFrame:
    """node and depth of what ``seeds`` (node) reach after edges have changed, from what was ``known`` (node, depth).

    ``edges`` (src, dst) are those before; ``gone`` and ``added`` are few.  First too much is deleted: what lies behind
    a deleted edge, or a seed that is none any more, along edges that lead one level down.  All else keeps its depth.
    Then the deleted nodes are derived again from kept neighbours, and whatever an added edge brings nearer follows;
    only nodes that change, and their edges, are joined in a round.
    """
    pair = ["src", "dst"]
    known, seeds = known.select("node", "depth"), seeds.select("node").distinct().withColumn("depth", F.lit(0))
    old = edges.select(*pair).distinct()
    now = durable(old.join(gone.select(*pair).distinct(), pair, "left_anti").unionByName(added.select(*pair)).distinct(), "edges")
    at = lambda end, to: known.select(F.col("node").alias(end), F.col("depth").alias(to))
    heads = gone.select(*pair).join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter("b = a + 1").select(F.col("dst").alias("node"), F.col("b").alias("depth"))
    lost = known.filter("depth = 0").join(seeds, "node", "left_anti")
    dropped, seen = _counted(heads.unionByName(lost.select("node", "depth")).distinct(), "dropped", n=F.count(F.lit(1)))
    frontier = dropped
    while seen["n"]:
        step = frontier.join(old, frontier["node"] == old["src"]).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        step = step.join(known, ["node", "depth"]).join(dropped.select("node"), "node", "left_anti")
        frontier, seen = _counted(step, "dropped", n=F.count(F.lit(1)))
        dropped = dropped.unionByName(frontier)
    dropped = durable(dropped.select("node").distinct(), "dropped")
    kept = durable(known.join(dropped, "node", "left_anti"), "kept")
    entered = now.join(dropped.withColumnRenamed("node", "dst"), "dst", "left_semi").unionByName(added.select(*pair))
    offers = entered.join(kept, entered["src"] == kept["node"]).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).unionByName(seeds)
    found = known.limit(0)
    while True:
        best = _least(offers)
        have = _least(found.unionByName(kept.join(best.select("node"), "node", "left_semi"))).withColumnRenamed("depth", "d")
        better, seen = _counted(best.join(have, "node", "left").filter("d IS NULL OR depth < d").select("node", "depth"), "nearer", n=F.count(F.lit(1)))
        if not seen["n"]:
            return kept.join(found.select("node"), "node", "left_anti").unionByName(found)
        found = durable(_least(found.unionByName(better)), "found")
        offers = better.join(now, better["node"] == now["src"]).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
