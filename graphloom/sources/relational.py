"""Relational rows as triples (an extension): every foreign key column becomes an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def foreign_key_triples(df: DataFrame, key: str, key_prefix: str, links: dict[str, tuple[str, str]]) -> DataFrame:
    """(head, relation, tail) for each link column: column -> (relation, prefix of the referred key)."""
    items = [
        F.when(
            F.col(column).isNotNull(),
            F.struct(
                F.concat(F.lit(key_prefix), F.col(key)).alias("head"),
                F.lit(relation).alias("relation"),
                F.concat(F.lit(prefix), F.col(column)).alias("tail"),
            ),
        )
        for column, (relation, prefix) in links.items()
    ]
    return df.select(F.inline(F.array_compact(F.array(*items))))
