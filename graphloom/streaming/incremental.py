"""Incremental graph: new documents extend the triple table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom import rules as R
from graphloom.operators.completion import complete_failing
from graphloom.operators.quality import assess_quality
from graphloom.operators.triples import merge_triples, rule_triples
from graphloom.rules import RulePack
from graphloom.sources.documents import reject_reason
from graphloom.sources.graph_table import GraphTable

COLUMNS = "head string, relation string, tail string, confidence double, seq bigint, batch bigint"


def stream_triples(docs: DataFrame, pack: RulePack = R.ZH, repair: bool = True, threshold: float = 0.5) -> DataFrame:
    """Scored rule triples of a document stream; stateless, the same plan as in batch.

    Texts under the quality gate are repaired first, unless ``repair`` is off.
    """
    kept = docs.filter(reject_reason(F.col("text")).isNull())
    if repair:
        done = complete_failing(assess_quality(kept, pack, threshold), pack)
        kept = done.select(*[F.col("processed_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
    return rule_triples(kept, pack)


def append_stream(triples: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write every micro-batch, merged, as its own partition of the graph table.

    A batch replaces its own partition only, so a repeated batch changes nothing
    and the earlier graph is never rewritten. Readers merge on read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        merged = merge_triples(batch, (), "seq")
        merged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return triples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_graph(spark: SparkSession, path: str) -> DataFrame:
    """The triple table over all batches: one row per triple with its highest confidence."""
    return merge_triples(spark.read.schema(COLUMNS).parquet(path), (), "seq")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged table to a new place as a single batch."""
    current_graph(spark, path).write.mode("overwrite").parquet(f"{target}/batch=0")


def stream_relation_counts(triples: DataFrame) -> DataFrame:
    """Running count and mean confidence per relation, for update or complete mode."""
    return triples.groupBy("relation").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def merge_stream(triples: DataFrame, path: str, checkpoint: str, buckets: int = 64, first_batch: int = 0, **trigger) -> StreamingQuery:
    """Merge every micro-batch into a ``GraphTable``; its statistics are those of the merged graph.

    A stream with a checkpoint of its own counts its batches from 0, so one that
    goes on with an existing table starts at a ``first_batch`` above its last.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        GraphTable(batch.sparkSession, path, buckets).merge(batch, first_batch + batch_id)

    return triples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
