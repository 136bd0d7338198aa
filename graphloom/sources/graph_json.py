"""Graphs as JSON, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom import schemas
from graphloom.sources.places import with_place


def read_graph_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per graph file (``multi_line``) or per line, keyed by the file and the graph's number in it."""
    return with_place(spark.read.schema(schemas.GRAPH_JSON).option("multiLine", multi_line).json(path), "graph_id")


def parse_graph_json(df: DataFrame, column: str) -> DataFrame:
    parsed = F.from_json(column, schemas.GRAPH_JSON)
    return df.withColumn("_g", parsed).select(*[c for c in df.columns if c != column], "_g.*")


def graph_entities(graphs: DataFrame, key: str = "graph_id") -> DataFrame:
    """(graph, eid, name, type, attributes, relations): first position and last definition of every name."""
    rows = graphs.select(key, F.posexplode("entities").alias("pos", "_e")).select(key, "pos", "_e.*")
    filled = rows.select(
        key,
        "pos",
        "name",
        F.struct(
            F.coalesce("type", F.lit("unknown")).alias("type"),
            F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
            F.coalesce("relations", F.array().cast("array<string>")).alias("relations"),
        ).alias("_d"),
    )
    return (
        filled.groupBy(key, "name")
        .agg(F.min("pos").cast("bigint").alias("eid"), F.max_by("_d", "pos").alias("_d"))
        .select(key, "eid", "name", "_d.*")
    )


def graph_edges(graphs: DataFrame, key: str = "graph_id") -> DataFrame:
    rows = graphs.select(key, F.posexplode("relations").alias("rid", "_r")).select(key, F.col("rid").cast("bigint").alias("rid"), "_r.*")
    return rows.select(
        key,
        "rid",
        "name",
        "source",
        "target",
        F.coalesce("type", F.lit("unknown")).alias("type"),
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
    )


def graph_as_json(entities: Column, relations: Column, triples: Column) -> Column:
    """One JSON text for a graph that fits a row: entities {id, type}, relations, triples."""
    ids = F.transform(entities, lambda e: F.struct(e["name"].alias("id"), e["type"].alias("type")))
    return F.to_json(F.struct(ids.alias("entities"), relations.alias("relations"), triples.alias("triples")))


def export_graph(graphs: DataFrame, fmt: str = "json", key: str = "doc_id") -> DataFrame:
    """(key, graph) with each row's graph as text; only ``json`` is supported."""
    _only_json(fmt)
    return graphs.select(key, graph_as_json(F.col("entities"), F.col("relations"), F.col("triples")).alias("graph"))


def write_graph(path: str, entities: DataFrame, triples: DataFrame, fmt: str = "json", mode: str = "overwrite") -> None:
    """A graph of any size as three JSON data sets: entities {id, type}, relations, triples."""
    _only_json(fmt)
    entities.select(F.col("name").alias("id"), F.coalesce("type", F.lit("Other")).alias("type")).write.mode(mode).json(f"{path}/entities")
    triples.select("relation").distinct().write.mode(mode).json(f"{path}/relations")
    triples.select("head", "relation", "tail", "confidence").write.mode(mode).json(f"{path}/triples")


def _only_json(fmt: str) -> None:
    if fmt != "json":
        raise ValueError(f"unsupported format: {fmt}")


def append_graph(path: str, triples: DataFrame) -> None:
    triples.write.mode("append").parquet(path)


def clear_graph(spark: SparkSession, path: str, schema) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
