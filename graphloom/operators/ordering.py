"""Dependency levels and order of a graph, by contraction of nodes that depend on one other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.components import follow, numbered
from graphloom.operators.ranking import sorted_index
from graphloom.session import stored


# share of the nodes that must hang from a single other one before their walks are followed
_SINGLE_PART = 0.1


def _levels(links: DataFrame, nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame], bool]:
    """Rounds over (source, target, steps): (node, level) rows, (node, to, steps) rows below them, and whether all is known.

    Nodes with nothing before them hang from a common root by their level. A node
    with a single edge in, from the root or from another node, is as far behind
    that one as the edge is long; chains and trees of such nodes are followed by
    pointer jumping, and their other edges start from where the walk ends. Of
    parallel edges the longest stays, so new nodes with a single edge in appear. An
    acyclic graph always has one, so a round without any meets a cycle.
    """
    edges = links
    rooted = nodes.join(links.select(F.col("target").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(0).alias("level"))
    known: list[DataFrame] = []
    below: list[DataFrame] = []
    while True:
        entering = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"), F.min("source").alias("to"), F.max("steps").alias("steps"))
        state = stored(entering.join(rooted, "node", "full").select("node", F.coalesce("n", F.lit(0)).alias("n"), "to", "steps", "level"))
        sizes = state.groupBy(F.when(F.col("n") == 0, "known").when((F.col("n") == 1) & F.col("level").isNull(), "single").otherwise("open").alias("kind")).count()
        n = {r.kind: r["count"] for r in sizes.collect()}
        known.append(state.filter("n = 0").select("node", "level"))
        if not n.get("single") and not n.get("open"):
            return known, below, True
        if not n.get("single") and not n.get("known"):
            return known, below, False
        # pointer jumping pays where many nodes have a single edge in, or nothing else is left to do
        jumping = n.get("single", 0) > (_SINGLE_PART * sum(n.values()) if n.get("known") else 0)
        moved = known[-1].select(F.col("node").alias("source"), F.lit(None).cast("bigint").alias("to"), F.col("level").alias("add"))
        left = edges
        if jumping:
            single = state.filter("n = 1 and level is null").select("node", "to", "steps")
            hops = single.join(single.select(F.col("node").alias("to"), F.lit(True).alias("open")), "to", "left")
            ended, ring = follow(hops.withColumn("open", F.coalesce("open", F.lit(False))), steps=lambda own, ahead: own + ahead)
            if not ring.isEmpty():
                return known, below, False
            below.append(ended.select("node", "to", "steps"))
            moved = moved.unionByName(ended.select(F.col("node").alias("source"), "to", F.col("steps").alias("add")))
            left = left.join(ended.select(F.col("node").alias("target")), "target", "left_anti")
        sent = left.join(moved, "source", "left").select(
            F.when(F.col("add").isNull(), F.col("source")).otherwise(F.col("to")).alias("source"), "target", (F.col("steps") + F.coalesce("add", F.lit(0))).alias("steps")
        )
        if jumping:
            # walks that ended at a known node hang from the root as well
            last = known[-1].select(F.col("node").alias("source"), "level")
            sent = sent.join(last, "source", "left").select(F.when(F.col("level").isNull(), F.col("source")).alias("source"), "target", (F.col("steps") + F.coalesce("level", F.lit(0))).alias("steps"))
        merged = sent.groupBy("source", "target").agg(F.max("steps").alias("steps"))
        waiting = state.filter("n > 0 and level is not null").select(F.lit(None).cast("bigint").alias("source"), F.col("node").alias("target"), F.col("level").alias("steps"))
        merged = stored(merged.unionByName(waiting))
        edges = merged.filter("source is not null")
        rooted = merged.filter("source is null").groupBy(F.col("target").alias("node")).agg(F.max("steps").alias("level"))


def dependency_levels(edges: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(node, level), and whether every node got a level (False: there is a cycle).

    The level is the longest distance from a node nothing points to. A self-loop
    is a cycle. Of a cyclic graph only nodes that were reached before the cycle
    was met have a row.
    """
    names, links = numbered(edges.select("source", "target"))
    links = stored(links.withColumn("steps", F.lit(1)))
    known, below, complete = _levels(links, names.select("node"))
    levels = stored(reduce(DataFrame.unionByName, known))
    for rows in reversed(below):
        levels = stored(levels.unionByName(rows.join(levels.withColumnRenamed("node", "to"), "to").select("node", (F.col("level") + F.col("steps")).alias("level"))))
    named = levels.join(names, "node").select(F.col("name").alias("node"), "level")
    if entities is not None:
        alone = entities.select(F.col("name").alias("node")).distinct().join(names.select(F.col("name").alias("node")), "node", "left_anti")
        named = named.unionByName(alone.withColumn("level", F.lit(0)))
    return named, complete


def dependency_order(edges: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(finding, node, level, position) in dependency order, or the single ``no_topological_order`` row."""
    levels, complete = dependency_levels(edges, entities)
    if complete:
        return sorted_index(levels, ["level", "node"], "position").select(
            F.lit("dependency_order").alias("finding"), "node", "level", "position"
        )
    return edges.sparkSession.range(1).select(
        F.lit("no_topological_order").alias("finding"),
        F.lit(None).cast("string").alias("node"),
        F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("bigint").alias("position"),
    )
