"""Recursion over edges as loops of joins, cut by tables in the shared folder.

Loops run to their end, however many rounds that takes: each of them settles
something in every round. What former rounds found is folded into one table
every few rounds, so that no plan grows with their number.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import stage


#: Rounds after which what was found is written as one table.
FOLD = 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _folded(parts: list[DataFrame], name: str) -> list[DataFrame]:
    return [stage(_union(parts), name)] if len(parts) > FOLD else parts


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): everything reachable from ``seeds`` (node) over ``edges`` (src, dst).

    Semi-naive: each round joins only what the last one found. Depth is the
    least number of edges. Cycles end by themselves; null nodes are none.
    """
    edges = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()
    frontier = stage(seeds.select("node").where(F.col("node").isNotNull()).distinct().withColumn("depth", F.lit(0)), "reach")
    edges = stage(edges, "reach-edges")
    found = [frontier]
    for depth in count(1):
        fresh = (
            frontier.join(edges, frontier.node == edges.src)
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(_union(found).select("node"), "node", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = stage(fresh, "reach")
        if frontier.isEmpty():
            return _union(found)
        found = _folded([*found, frontier], "reach-found")


def relevant(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Nodes on some way from ``sources`` to ``sinks`` (both: node)."""
    forward = reach(edges, sources).select("node")
    backward = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sinks).select("node")
    return forward.join(backward, "node", "left_semi")


def nearest_owner(parents: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, owner, depth): the nearest of a node and its ancestors that is an owner.

    ``parents``: node, parent; ``owners``: node. A node with several parents
    takes the nearest owner, of equals the smallest. Nodes without one are
    left out. Chains are walked to their end; a node passes each ancestor
    once, so cycles end too.
    """
    parents = stage(parents.select("node", "parent").where(F.col("node").isNotNull()).distinct(), "parents")
    own = owners.select(F.col("node").alias("at")).distinct()
    nodes = parents.select("node").union(parents.select(F.col("parent").alias("node"))).where("node is not null").distinct()
    walk = stage(nodes.select("node", F.col("node").alias("at")), "walk")
    found: list[DataFrame] = []
    seen = [walk]
    for depth in count():
        hit = walk.join(own, "at", "left_semi").groupBy("node").agg(F.min("at").alias("owner"))
        hit = stage(hit.withColumn("depth", F.lit(depth)), "owner")
        found.append(hit)
        up = parents.select(F.col("node").alias("at"), F.col("parent").alias("up")).where("up is not null")
        above = walk.join(hit.select("node"), "node", "left_anti").join(up, "at").select("node", F.col("up").alias("at")).distinct()
        walk = stage(above.join(_union(seen), ["node", "at"], "left_anti"), "walk")
        if walk.isEmpty():
            return _union(found)
        found, seen = _folded(found, "owners"), _folded([*seen, walk], "walked")


def propagate_sets(edges: DataFrame, facts: DataFrame, passes: int = 8) -> DataFrame:
    """(node, fact): facts handed along ``edges`` (src, dst) for at most ``passes`` passes.

    ``facts``: node, fact. Every pass hands on only what is new, so it ends
    early when nothing is.
    """
    edges = stage(edges.select("src", "dst").distinct(), "propagate-edges")
    fresh = stage(facts.select("node", "fact").distinct(), "facts")
    found = [fresh]
    for _ in range(passes):
        moved = fresh.join(edges, fresh.node == edges.src).select(F.col("dst").alias("node"), "fact").distinct()
        fresh = stage(moved.join(_union(found), ["node", "fact"], "left_anti"), "facts")
        if fresh.isEmpty():
            break
        found = _folded([*found, fresh], "facts-found")
    return _union(found)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of ``edges`` (a, b), named by their smallest node.

    Alternating large-star and small-star steps: the rounds grow with the
    logarithm of the size, and a hub never gathers its neighbours in a task:
    each step is a minimum per node and a join.
    """
    pairs = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
    current = stage(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    while True:
        both = current.select("a", "b").union(current.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
        )
        fresh = stage(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "star")
        same = fresh.join(current, ["a", "b"], "left_anti").isEmpty() and current.join(fresh, ["a", "b"], "left_anti").isEmpty()
        current = fresh
        if same:
            own = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
            return nodes.join(own, "node", "left").select("node", F.coalesce("least", "node").alias("component"))
