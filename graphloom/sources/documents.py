"""Document sources and the split into work and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom import rules as R
from graphloom.functions import text as tx
from graphloom.session import spread
from graphloom.sources.places import with_place


def read_documents(
    spark: SparkSession, path: str, fmt: str = "parquet", key: str = "doc_id", text: str = "text", key_type: str = "bigint"
) -> DataFrame:
    """(doc_id, text) from parquet, orc, JSON lines, CSV or text files.

    Only the two columns are read; ``key_type`` is any Spark type. Text files hold
    one document per line, whose string id is the file and the line's number in it.
    """
    if fmt == "text":
        return with_place(spark.read.text(path), "doc_id").select("doc_id", F.col("value").alias("text"))
    reader = spark.read.option("header", True).option("multiLine", True) if fmt == "csv" else spark.read
    if fmt in ("csv", "json"):
        reader = reader.schema(f"`{key}` {key_type}, `{text}` string")
    return spread(reader.format(fmt).load(path).select(F.col(key).cast(key_type).alias("doc_id"), F.col(text).alias("text")))


def reject_reason(text: Column, n_entities: Column | None = None, n_triples: Column | None = None, error: Column | None = None) -> Column:
    """Why a document yields no graph, null when it does: blank text, extractor failure, nothing found."""
    reason = F.when(~tx.not_blank(text), F.lit(R.REJECT_BLANK))
    if error is not None:
        reason = reason.when(error.isNotNull(), error)
    if n_entities is not None and n_triples is not None:
        reason = reason.when((n_entities == 0) & (n_triples == 0), F.lit(R.REJECT_NOTHING_FOUND))
    return reason


def split_rejects(docs: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejects with the advice that goes with an empty result."""
    hint = F.when(F.col(reason) == R.REJECT_NOTHING_FOUND, F.lit(R.REJECT_SUGGESTION))
    return docs.filter(F.col(reason).isNull()).drop(reason), docs.filter(F.col(reason).isNotNull()).withColumn("suggestion", hint)
