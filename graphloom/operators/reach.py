"""Entity pairs joined only through other nodes: the first ones with paths, and all of them as ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.components import pairs_of
from graphloom.session import cut_lineage


def transitive_gaps(
    entities: DataFrame, edges: DataFrame, limit: int | None = 5, first_chunk: int = 16, sources: DataFrame | None = None
) -> DataFrame:
    """The first ``limit`` entity pairs, by (eid, eid), joined only through other nodes; all of them for None.

    With ``sources(name)`` only pairs that start there. Breadth-first search: for
    a limit from a few sources at a time, in ``eid`` order, until enough pairs are
    known, else from all at once. The path named is a shortest one; going back
    from the target it takes the smallest predecessor at every step.
    """
    links = cut_lineage(pairs_of(edges).filter("source != target"))
    names = entities.select("eid", "name")
    second = links.select(F.col("source").alias("target")).distinct()
    first = links.join(second, "target", "left_semi").select(F.col("source").alias("name")).distinct()
    if sources is not None:
        first = first.join(sources.select("name"), "name", "left_semi")
    starts = cut_lineage(names.join(first, "name", "left_semi"))
    if limit is None:
        return _gaps(_search(starts, links), names)
    found: list[DataFrame] = []
    n_found, after, chunk = 0, None, first_chunk
    while n_found < limit:
        pool = starts if after is None else starts.filter(F.col("eid") > after)
        top = pool.orderBy("eid").limit(chunk).agg(F.max("eid")).first()[0]
        if top is None:
            break
        hits = _gaps(_search(pool.filter(F.col("eid") <= top), links), names)
        found.append(cut_lineage(hits.orderBy("eid1", "eid2").limit(limit - n_found)))
        n_found += found[-1].count()
        after, chunk = top, chunk * 8
    if not found:
        return _gaps(_search(starts, links), names)
    return reduce(DataFrame.unionByName, found).orderBy("eid1", "eid2")


def _search(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(eid1, start, node, dist, path) for every node reached from the starts; ``path`` holds the nodes between."""
    seen = cut_lineage(
        starts.select(
            F.col("eid").alias("eid1"), F.col("name").alias("start"), F.col("name").alias("node"), F.lit(0).alias("dist"),
            F.array().cast("array<string>").alias("path"),
        )
    )
    steps, dist = seen, 0
    while not steps.isEmpty():
        dist += 1
        front = steps.select("eid1", "start", F.col("node").alias("source"), "path")
        # the start itself is no node between
        way = F.col("path") if dist == 1 else F.concat("path", F.array("source"))
        found = (
            links.join(front, "source")
            .groupBy("eid1", "start", F.col("target").alias("node"))
            .agg(F.min(F.struct("source", way.alias("way"))).alias("best"))
            .join(seen.select("eid1", "node"), ["eid1", "node"], "left_anti")
            .select("eid1", "start", "node", F.lit(dist).alias("dist"), F.col("best.way").alias("path"))
        )
        steps = cut_lineage(found)
        # the parts are checkpoints: the union only grows by one scan per step
        seen = seen.unionByName(steps)
    return seen


def _gaps(seen: DataFrame, names: DataFrame) -> DataFrame:
    far = seen.filter("dist >= 2").join(names.select(F.col("eid").alias("eid2"), F.col("name").alias("node")), "node")
    return far.select(
        "eid1", "eid2", F.col("start").alias("source"), F.col("node").alias("target"), (F.col("dist") + 1).alias("path_length"),
        F.col("path").alias("intermediate_nodes"), F.lit(0.6).alias("confidence"),
    )
