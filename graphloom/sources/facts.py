"""The fact and rule dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom import rules as R, schemas


def default_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(R.FACTS), schemas.FACTS)


def read_facts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schemas.FACTS)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def conflict_rules(spark: SparkSession, rules=R.CONFLICT_RULES) -> DataFrame:
    rows = [(r.rule_id, r.subject, r.wrong_object, r.predicate, r.conflict_type, r.message) for r in rules]
    return spark.createDataFrame(rows, schemas.CONFLICT_RULES)
