"""Which nodes reach which, as interval labels on a spanning forest and the intervals that the forest lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.components import follow, pairs_of, strongly_connected_components
from graphloom.operators.ranking import SLICE, over_earlier, sorted_index
from graphloom.session import stored, unsized


def _condensed(entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, node), where the names of one circular component share a node, and the (source, target) pairs of nodes."""
    names = links.select(F.explode(F.array("source", "target")).alias("name")).unionByName(entities.select("name")).distinct()
    rings = strongly_connected_components(links).select(F.col("node").alias("name"), "component")
    placed = stored(names.join(rings, "name", "left").select("name", F.coalesce("component", "name").alias("component")))
    nodes = stored(placed.select("component").distinct().select("component", F.xxhash64(F.monotonically_increasing_id()).alias("node")))
    placed = stored(placed.join(nodes, "component").select("name", "node"))
    arcs = links
    for end in ("source", "target"):
        arcs = arcs.join(placed.select(F.col("name").alias(end), F.col("node").alias(f"_{end}")), end)
    arcs = arcs.select(F.col("_source").alias("source"), F.col("_target").alias("target")).filter("source != target")
    return placed, stored(arcs.distinct())


def _labels(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, pre, last): the place of each node in a walk down a spanning forest, and the last place below it.

    The tour of the forest goes down to each node and up again; it is a linked
    list, ranked by pointer jumping, so jobs grow with the logarithm of its
    length and not with the depth of the forest. Nodes are numbered by (parent,
    node), so the next child is the next number and a hub needs no group.
    """
    parents = arcs.groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent"))
    # the roots hang from the hash of an id that no row has
    top = F.xxhash64(F.lit(-1).cast("bigint"))
    tree = nodes.join(parents, "node", "left").select("node", F.coalesce("parent", top).alias("parent"))
    placed = stored(sorted_index(tree, ["parent", "node"], "pos"))
    n = placed.count()
    first = placed.groupBy(F.col("parent").alias("node")).agg(F.min("pos").alias("child"))
    above = placed.select(F.col("node").alias("parent"), F.col("pos").alias("parent_pos"))
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("parent").alias("next_parent"))
    around = placed.join(first, "node", "left").join(above, "parent", "left").join(after, "pos", "left")
    # element 2k goes down to node k, element 2k + 1 leaves it
    down = F.struct((2 * F.col("pos")).alias("node"), F.coalesce(2 * F.col("child"), 2 * F.col("pos") + 1).alias("to"))
    up_to = F.when(F.col("next_parent") == F.col("parent"), 2 * F.col("pos") + 2).otherwise(2 * F.col("parent_pos") + 1)
    tour = stored(around.select(F.inline(F.array(down, F.struct((2 * F.col("pos") + 1).alias("node"), up_to.alias("to"))))))
    end = tour.filter("to is null").agg(F.max("node")).first()[0]
    hops = tour.filter("to is not null").select("node", "to", (F.col("to") != F.lit(end)).alias("open"), ((F.col("to") + 1) % 2).alias("steps"))
    ranked, _ = follow(hops, steps=lambda own, ahead: own + ahead)
    left = ranked.groupBy(F.floor(F.col("node") / 2).alias("pos")).agg(
        F.max(F.when(F.col("node") % 2 == 0, F.col("steps"))).alias("below_down"), F.max(F.when(F.col("node") % 2 == 1, F.col("steps"))).alias("below_up")
    )
    return stored(
        placed.join(left, "pos").select(
            "node", (F.lit(n - 1) - F.col("below_down")).alias("pre"), (F.lit(n - 1) - F.coalesce("below_up", F.lit(0))).alias("last")
        )
    )


def _widest(rows: DataFrame) -> DataFrame:
    """Of (node, lo, hi, old) those that no other interval of the node holds; intervals are nested or apart."""
    once = rows.groupBy("node", "lo").agg(F.max(F.struct("hi", "old")).alias("top")).select("node", "lo", "top.hi", "top.old")
    held = over_earlier(once, ["node"], "lo", "hi", F.max, "before", SLICE)
    return held.filter("before is null or before < hi").select("node", "lo", "hi", "old")


def _exceptions(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, lo, hi): the subtrees that a node reaches and that are not below it in the forest.

    Arcs that leave a subtree start them; what is new at a node goes on to the
    nodes before it, unless it is below those or in an interval they have.
    """
    ends = arcs.join(labels.select(F.col("node").alias("source"), F.col("pre").alias("s_lo"), F.col("last").alias("s_hi")), "source")
    ends = stored(ends)
    fresh = labels.select(F.col("node").alias("target"), F.col("pre").alias("lo"), F.col("last").alias("hi"))
    known = None
    while True:
        met = ends.join(fresh, "target").filter("lo < s_lo or lo > s_hi").select(F.col("source").alias("node"), "lo", "hi")
        news = met.distinct().withColumn("old", F.lit(0))
        merged = stored(_widest(news if known is None else known.unionByName(news)))
        known = merged.withColumn("old", F.lit(1))
        new = merged.filter("old = 0")
        if new.isEmpty():
            return known.select("node", "lo", "hi")
        fresh = new.select(F.col("node").alias("target"), "lo", "hi")


def reach_index(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reachability as ranges: entity b is reached from a if its rank is in a range of a's ``node``.

    First table: (eid, name, node, rank), one row per entity; entities of one
    circular component share a node and have neighbouring ranks. Second table:
    (node, from_rank, to_rank), disjoint: the subtree of the node in a spanning
    forest, and one for each further subtree that it reaches. Rows grow with the
    nodes and those exceptions, not with the pairs; a node in no circular
    component reaches itself in this form. Names that are no entity carry the way
    on and have no rank. Nulls in edges link nothing. Jobs grow with the longest
    way that an exception goes up.
    """
    entities = unsized(entities.select("eid", "name"))
    links = stored(pairs_of(edges).filter("source != target"))
    placed, arcs = _condensed(entities, links)
    nodes = placed.select("node").distinct()
    labels = _labels(nodes, arcs)
    members = sorted_index(entities.join(placed, "name").join(labels.select("node", "pre"), "node"), ["pre", "eid"], "rank")
    members = stored(members.select("eid", "name", "node", "rank"))
    sizes = labels.join(members.groupBy("node").agg(F.count("*").alias("n")), "node", "left").select("pre", F.coalesce("n", F.lit(0)).alias("n"))
    bounds = stored(over_earlier(sizes, [], "pre", "n", F.sum, "before", SLICE).select("pre", F.coalesce("before", F.lit(0)).alias("before"), "n"))
    reached = labels.select("node", F.col("pre").alias("lo"), F.col("last").alias("hi")).unionByName(_exceptions(arcs, labels))
    ranges = reached.join(bounds.select(F.col("pre").alias("lo"), F.col("before").alias("from_rank")), "lo").join(
        bounds.select(F.col("pre").alias("hi"), (F.col("before") + F.col("n") - 1).alias("to_rank")), "hi"
    )
    ranges = ranges.filter("from_rank <= to_rank").join(members.select("node"), "node", "left_semi")
    return members, ranges.select("node", "from_rank", "to_rank")


def gap_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(eid, gaps): how many other entities each one reaches without an edge to them; entities without any are left out."""
    members, ranges = reach_index(entities, edges)
    reached = ranges.groupBy("node").agg(F.sum(F.col("to_rank") - F.col("from_rank") + 1).alias("reached"))
    direct = pairs_of(unsized(edges)).filter("source != target").join(members.select(F.col("name").alias("target"), F.col("eid").alias("to_eid")), "target")
    direct = direct.groupBy(F.col("source").alias("name")).agg(F.count_distinct("to_eid").alias("direct"))
    counted = members.join(reached, "node").join(direct, "name", "left")
    return counted.select("eid", (F.col("reached") - 1 - F.coalesce("direct", F.lit(0))).alias("gaps")).filter("gaps > 0")
