"""Degrees, edge collapse, adjacency, roles and categories of a graph.

Tables: entities(eid, name, type, attributes), edges(rid, name, source, target).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.operators.ranking import SLICE, previous_value, running_index


def collapse_directed(edges: DataFrame, order: str = "rid") -> DataFrame:
    """One edge per (source, target), the last one."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.groupBy("source", "target").agg(F.max_by(F.struct(*rest), order).alias("_e")).select("source", "target", "_e.*")


def collapse_undirected(triples: DataFrame, order="seq") -> DataFrame:
    """One edge per unordered node pair with the last relation and confidence."""
    a, b = F.least("head", "tail"), F.greatest("head", "tail")
    return (
        triples.groupBy(a.alias("node1"), b.alias("node2"))
        .agg(F.max_by(F.struct("relation", "confidence"), order).alias("_e"))
        .select("node1", "node2", "_e.*")
    )


def directed_degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node, over distinct (source, target) pairs."""
    pairs = edges.select("source", "target").distinct()
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    return pairs.select(F.inline(ends)).groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def undirected_degrees(collapsed: DataFrame) -> DataFrame:
    """Degree over undirected edges; a self-loop counts twice."""
    return collapsed.select(F.explode(F.array("node1", "node2")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, direction, neighbour) rows; long form, since a hub can have any number of neighbours."""
    sides = F.array(
        F.struct(F.col("source").alias("node"), F.lit("successor").alias("direction"), F.col("target").alias("neighbour")),
        F.struct(F.col("target").alias("node"), F.lit("predecessor").alias("direction"), F.col("source").alias("neighbour")),
    )
    return edges.select("source", "target").distinct().select(F.inline(sides))


def neighbour_preview(collapsed: DataFrame, k: int = 3) -> DataFrame:
    """Per node its first ``k`` neighbours by name, its degree and how many neighbours are not shown."""
    n1, n2 = F.col("node1"), F.col("node2")
    # a self-loop shows the node once and counts twice in the degree
    sides = F.array(
        F.struct(n1.alias("node"), n2.alias("neighbour"), F.when(n1 == n2, 2).otherwise(1).alias("ends")),
        F.when(n1 != n2, F.struct(n2.alias("node"), n1.alias("neighbour"), F.lit(1).alias("ends"))),
    )
    rows = collapsed.select(F.inline(F.array_compact(sides)))
    w = Window.partitionBy("node").orderBy("neighbour")
    # the row_number() <= k limit is applied inside every task before the shuffle
    first = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    shown = first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("_r", "neighbour"))).alias("_s"))
    totals = rows.groupBy("node").agg(F.sum("ends").alias("degree"), F.count("*").alias("_n"))
    return shown.join(totals, "node").select(
        "node",
        "degree",
        F.array_join(F.transform("_s", lambda s: s["neighbour"]), ", ").alias("preview"),
        F.greatest(F.col("_n") - k, F.lit(0)).alias("more"),
    )


def hierarchy_roles(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Root, leaf or intermediate role of every connected entity."""
    deg = directed_degrees(edges).withColumnRenamed("node", "name")
    i, o = F.col("in_degree"), F.col("out_degree")
    role = F.when((i == 0) & (o > 0), "root_node").when((o == 0) & (i > 0), "leaf_node").otherwise("intermediate_node")
    level = F.when(i == 0, "top").when(o == 0, "bottom").otherwise("middle")
    return entities.select("eid", "name").join(deg, "name").select("name", role.alias("role"), level.alias("level"))


def process_nodes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with predecessors and successors; the lists are the rows of ``adjacency``."""
    deg = directed_degrees(edges).filter("in_degree > 0 and out_degree > 0").withColumnRenamed("node", "name")
    return entities.select("name").join(deg, "name").select(
        "name", F.col("in_degree").alias("n_predecessors"), F.col("out_degree").alias("n_successors")
    )


def category_groups(entities: DataFrame) -> DataFrame:
    """Types with more than one entity."""
    return entities.groupBy("type").agg(F.count("*").alias("members")).filter("members > 1")


def category_members(entities: DataFrame) -> DataFrame:
    """(type, name) rows of the category groups."""
    return entities.select("type", "name").join(category_groups(entities), "type")


def category_gaps(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same-type pairs without an edge either way, as rank ranges.

    The pairs of a type grow with the square of its members, so they are not
    listed. Members are ranked by ``eid`` inside their type. For each member the
    second table holds the ranges (``from_rank``..``to_rank``) of later members it
    has no edge to: the exact complement of its edges, in as many rows as there
    are members and edges. The first table maps ranks to names; joining the two
    for chosen members lists their pairs.
    """
    ranked = running_index(entities.select("eid", "name", "type"), ["type"], "eid", "rank").join(
        category_groups(entities), "type"
    )
    members = ranked.select("type", "rank", "eid", "name", "members")
    pos = members.select("name", "type", "rank")
    linked = (
        edges.select("source", "target")
        .join(pos.withColumnsRenamed({"name": "source", "type": "_t1", "rank": "_r1"}), "source")
        .join(pos.withColumnsRenamed({"name": "target", "type": "_t2", "rank": "_r2"}), "target")
        .filter("_t1 = _t2 and _r1 != _r2")
        .select(F.col("_t1").alias("type"), F.least("_r1", "_r2").alias("rank"), F.greatest("_r1", "_r2").alias("to"))
        .distinct()
    )
    # for every link the gap that ends just before it; for every member the gap that reaches the last member
    closing = members.select("type", "rank", F.col("members").alias("to"))
    stops = previous_value(linked.unionByName(closing), ["type", "rank"], "to", "_before")
    ranges = stops.select(
        "type",
        "rank",
        (F.coalesce("_before", "rank") + 1).alias("from_rank"),
        (F.col("to") - 1).alias("to_rank"),
    ).filter("from_rank <= to_rank")
    return members, ranges


def category_gap_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Per type: members and the number of same-type pairs without an edge."""
    pairs = _linked_pairs(entities, edges).groupBy("type").agg(F.count("*").alias("_linked"))
    n = F.col("members")
    return category_groups(entities).join(pairs, "type", "left").select(
        "type", "members", ((n * (n - 1) / 2).cast("bigint") - F.coalesce("_linked", F.lit(0))).alias("missing_pairs")
    )


def _linked_pairs(entities: DataFrame, edges: DataFrame) -> DataFrame:
    types = entities.select("name", "type")
    return (
        edges.select("source", "target")
        .filter("source != target")
        .join(types.withColumnsRenamed({"name": "source", "type": "_t1"}), "source")
        .join(types.withColumnsRenamed({"name": "target", "type": "_t2"}), "target")
        .filter("_t1 = _t2")
        .select(F.col("_t1").alias("type"), F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        .distinct()
    )


def missing_partners(focus: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The listed pairs for chosen entities (``focus(name)``): later same-type members without an edge."""
    members, ranges = category_gaps(entities, edges)
    chosen = members.join(focus.select("name"), "name", "left_semi").select("type", "rank", F.col("name").alias("entity1"))
    begin, end, part = F.col("from_rank"), F.col("to_rank"), F.col("_slice") * SLICE
    cut = chosen.join(ranges, ["type", "rank"]).withColumn(
        "_slice", F.explode(F.sequence(F.floor(begin / SLICE), F.floor(end / SLICE)))
    )
    steps = F.sequence(F.greatest(begin, part), F.least(end, part + SLICE - 1))
    each = cut.select("type", "entity1", F.explode(steps).alias("rank"))
    return each.join(members.select("type", "rank", F.col("name").alias("entity2")), ["type", "rank"]).select(
        "type", "entity1", "entity2"
    )
