"""Connected components of undirected links, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b), a < b: neighbours move to the smallest node that a node sees.

    The smallest neighbour is a plain minimum, so a hub is aggregated before the
    shuffle; the join back on the hub is one that AQE can split.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a"))
    else:
        # each node b with its smaller neighbours a
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        joined = edges.join(least, "b")
        moved = joined.select(F.col("a").alias("b"), F.col("m").alias("a")).unionByName(
            least.select("b", F.col("m").alias("a"))
        )
    return moved.where("a < b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node with a link; component is its smallest node.

    ``edges`` holds bigint columns a and b in any direction; nulls and loops are
    ignored. Rounds run until the edges stay as they are.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    mark = _mark(links)
    while mark[0]:
        links = cut_lineage(_star(_star(links, True), False))
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    """One row that tells two sets of edges apart."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)
