"""Report tables of a triple set: the data behind charts, without the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom import rules as R
from graphloom.functions import scores
from graphloom.functions.classify import confidence_bin, confidence_tier, entity_class, entity_class_basic
from graphloom.operators.graph import collapse_undirected, neighbour_preview
from graphloom.operators.ranking import running_index
from graphloom.operators.triples import relation_counts, triple_ends


def confidence_histogram(triples: DataFrame, wide_labels: bool = False) -> DataFrame:
    """(bin, label, n) for all five bins, empty ones included."""
    pos = 1 if wide_labels else 0
    labels = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(b[pos]).alias("label")) for i, b in enumerate(R.HISTOGRAM_BINS)])
    frame = triples.sparkSession.range(1).select(F.inline(labels))
    counts = triples.groupBy(confidence_bin(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"))
    # five rows on either side
    return frame.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])


def confidence_summary(triples: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return triples.agg(
        F.count("*").alias("triples"),
        F.count_distinct("relation").alias("relations"),
        F.coalesce(F.avg(c), F.lit(0.0)).alias("avg_confidence"),
        F.max(c).alias("max_confidence"),
        F.min(c).alias("min_confidence"),
    )


def relation_means(collapsed: DataFrame) -> DataFrame:
    return collapsed.groupBy("relation").agg(F.avg("confidence").alias("avg_confidence"))


def type_distribution(triples: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Triple ends per class; given types win over the name rules."""
    ends = triple_ends(triples, ())
    if given is not None:
        ends = ends.join(given.select("name", F.col("type").alias("_given")), "name", "left")
    cls = entity_class(F.col("name"), F.col("_given") if given is not None else None)
    return ends.groupBy(cls.alias("type")).agg(F.count("*").alias("n"))


def confidence_trend(triples: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Running index of every triple in its document, next to its confidence."""
    return running_index(triples.select(key, seq, "confidence"), [key], seq, "idx").select(key, "idx", "confidence")


def quality_band(triples: DataFrame) -> DataFrame:
    """Mean confidence as a 0..100 score, its distance to 80, its band, and whether it reaches the alert line 90."""
    scored = confidence_summary(triples).select((F.col("avg_confidence") * 100).alias("score"))
    return scored.select(
        "score",
        (F.col("score") - 80).alias("delta"),
        scores.quality_band(F.col("score")).alias("band"),
        (F.col("score") >= 90).alias("over_line"),
    )


def node_table(collapsed: DataFrame, preview: int = 5, basic: bool = False) -> DataFrame:
    cls = entity_class_basic if basic else entity_class
    return neighbour_preview(collapsed, preview).select("node", cls(F.col("node")).alias("type"), "degree", "preview", "more")


def edge_table(collapsed: DataFrame) -> DataFrame:
    return collapsed.select("node1", "node2", "relation", "confidence", confidence_tier(F.col("confidence")).alias("tier"))


def report_tables(triples: DataFrame, preview: int = 5, order: str = "seq") -> dict[str, DataFrame]:
    """All report tables by name; write each with ``df.write``."""
    collapsed = collapse_undirected(triples, order)
    return {
        "nodes": node_table(collapsed, preview),
        "edges": edge_table(collapsed),
        "relation_means": relation_means(collapsed),
        "relation_distribution": relation_counts(triples),
        "type_distribution": type_distribution(triples),
        "histogram": confidence_histogram(triples),
        "trend": confidence_trend(triples),
        "summary": confidence_summary(triples),
        "quality": quality_band(triples),
    }
