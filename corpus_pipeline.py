"""From raw documents to packed sequences: clean, dedup, mix, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import line_dedup, mixing, packing, quality, simhash
from graphloom.llm.common import documents, written
from graphloom.llm.registry import query

# no SQL form: SimHash groups and tokenizer ids are beyond it; tests compare with a plain version
ORACLE_SQL = None


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality.clean(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share; every document stays."""
    kept = line_dedup.drop_shared_lines(docs, min_docs=10, min_chars=1)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return kept.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    return simhash.first_of_groups(docs, simhash.near_copies(docs, similarity=0.8, width=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The budget's documents, a row for each epoch that takes one, the last of a source cut where its budget ends."""
    mixed = mixing.mix(docs, budget_percent=100, max_epochs=2, seed=42)
    return mixed.withColumn("n_chars", F.length("text").cast("bigint"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [
    ("quality", clean_lines),
    ("lines", drop_shared_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
