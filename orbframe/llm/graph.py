"""Connected components as joins and aggregates.

Joins of nodes, keys and pairs are hinted to merge: Spark sizes a side by its files, or by
what its rows were exploded from, and as a table in the driver's memory it takes many times that.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for each node of ``edges(a, b)``.

    Every node points to its smallest neighbour, pointers are followed once, and the
    edges are rewritten to where their ends point; edges inside a node go. This halves
    the nodes that still move at least, so there are few rounds, each written to the
    shared folder. No edges give no rows.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    steps = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        onward = to.select(F.col("node").alias("to"), F.col("to").alias("onward"))
        jump = cut(to.join(onward.hint("merge"), "to").select("node", F.col("onward").alias("to")))
        steps.append(jump)
        for end in ("a", "b"):
            left = left.join(jump.withColumnRenamed("node", end).hint("merge"), end).drop(end).withColumnRenamed("to", end)
        left = cut(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return reduce(_follow, steps[1:], steps[0].withColumnRenamed("to", "component"))


def _follow(known: DataFrame, step: DataFrame) -> DataFrame:
    moved = step.select(F.col("node").alias("component"), "to")
    return known.join(moved.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


#: Keys with so many nodes at most compare all across components; larger ones are split first, so often at most.
SMALL, SPLITS = 16, 2


def linked(nodes: DataFrame, keys_of, confirm, split=None) -> DataFrame:
    """``node, component`` of the links that ``confirm`` leaves of nodes under a common key.

    ``keys_of`` gives ``key, size, node`` for ``nodes``; ``confirm`` gives those of
    ``pairs(a, b)`` that are links. Under a key, all nodes are held against the smallest
    one. Keys that still hold several components go on. Small ones compare across
    components. Large ones are split around a hub, the node with most links that one of
    theirs is linked to: ``split`` gives ``pivot, node, size, linked, heads, reach`` for
    ``members(pivot, node)``. Two links of the pivot are one component. Any other link
    has a common head, or one end reaches the other (its size is at most ``reach``).
    Heads are new keys. So a group costs about its size, and no link between components
    is lost. Without ``split``, and after ``SPLITS`` rounds, large keys compare across.
    """
    keys, tried, links, last, small, near = keys_of(nodes), None, None, split is None, [], []
    for rounds in range(SPLITS + 1):
        first = keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
        star = keys.join(first.hint("merge"), "key").where("a < node").select("a", F.col("node").alias("b")).distinct()
        star = cut(star if tried is None else star.join(tried.hint("merge"), ["a", "b"], "left_anti"))
        tried = star if tried is None else tried.union(star)
        links = cut(confirm(star) if links is None else links.union(confirm(star)))
        some = cut(_open(keys, cut(components(links))).join(first.select("key", "n").hint("merge"), "key"))
        last = last or rounds == SPLITS
        small.append((some if last else some.where(F.col("n") <= SMALL)).select(F.lit(rounds).alias("round"), "key", "node"))
        large = some.where(F.col("n") > SMALL)
        if last or large.isEmpty():
            break
        large = cut(large.join(_hubs(large, links).hint("merge"), "key"))
        made = cut(split(large.select("pivot", "node").distinct()))
        links = cut(links.union(made.where("linked and pivot <> node").select("pivot", "node")))
        ends = large.join(made.where("reach > 0").select("pivot", "node", "reach").hint("merge"), ["pivot", "node"]).select("key", "node", "c", "reach")
        other = large.select("key", F.col("node").alias("o"), F.col("c").alias("d"), F.col("size").alias("o_size"))
        ends = ends.join(other.hint("merge"), "key").where("o_size <= reach and c <> d")
        near.append(ends.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct())
        keys = cut(made.select(F.explode("heads").alias("key"), "size", "node").distinct())
    group = cut(components(links))
    some = _open(reduce(DataFrame.union, small), group, "round", "key")
    other = some.select("round", "key", F.col("node").alias("b"), F.col("c").alias("d"))
    more = some.withColumnRenamed("node", "a").join(other.hint("merge"), ["round", "key"]).where("a < b and c <> d").select("a", "b")
    rest = cut(confirm(reduce(DataFrame.union, near, more).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")))
    return group if rest.isEmpty() else components(links.union(rest))


def _open(keys: DataFrame, group: DataFrame, *by: str) -> DataFrame:
    """``keys`` that hold several components, with each node's as ``c``."""
    by = by or ("key",)
    placed = keys.join(group.hint("merge"), "node", "left").select(*keys.columns, F.coalesce("component", "node").alias("c"))
    open_ = placed.groupBy(*by).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select(*by)
    return placed.join(open_.hint("merge"), list(by))


def _hubs(large: DataFrame, links: DataFrame) -> DataFrame:
    """``key, pivot``: of the nodes under each key and those linked to them, the one with most links."""
    ways = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = ways.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("links"))
    best = ways.join(degree.hint("merge"), "other").groupBy("node").agg(F.max(F.struct("links", "other")).alias("best"))
    own = F.struct(F.lit(0).cast("long").alias("links"), F.col("node").alias("other"))
    return large.join(best.hint("merge"), "node", "left").groupBy("key").agg(F.max(F.coalesce("best", own)).alias("best")).select("key", F.col("best.other").alias("pivot"))
