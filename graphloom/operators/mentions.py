"""Where entities stand in their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions import text as tx
from graphloom.session import merged, stored


def entity_mentions(entities: DataFrame, docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, seq, name, type, pos, len, near) for every entity.

    ``pos`` is the 1-based first position, 0 when the name does not occur; ``near``
    is the text around it. All that the detail operators need of a text is in
    these narrow rows.
    """
    t, n = F.col("text"), F.col("name")
    return entities.join(merged(docs.select("doc_id", "text")), "doc_id").select(
        "doc_id", "seq", "name", "type", F.instr(t, n).alias("pos"), F.length(t).alias("len"), tx.context_window(t, n, window).alias("near")
    )


def stored_mentions(entities: DataFrame, docs: DataFrame, window: int = 50) -> DataFrame:
    """The same as a table, written once and compressed: several operators use it and the texts are joined a single time."""
    return stored(entity_mentions(entities, docs, window))
