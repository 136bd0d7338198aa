"""Row-local parsing of extractor responses and scoring of the triples found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions import text as tx
from graphloom.session import compute_once

# fixed value: the (head, relation, tail) line format
TRIPLE_LINE = r"\(([^,]+),\s*([^,]+),\s*([^)]+)\)"


def entity_lines(response: Column) -> Column:
    """Array of (pos, name, type) for the lines ``name|type``; repeats are kept."""
    rows = F.transform(
        F.split(response, "\n"),
        lambda line, i: F.struct(
            i.cast("bigint").alias("pos"),
            tx.strip(F.get(F.split(line, r"\|"), F.lit(0))).alias("name"),
            tx.strip(F.get(F.split(line, r"\|"), F.lit(1))).alias("type"),
        ),
    )
    return F.filter(rows, lambda r: r["type"].isNotNull() & (r["name"] != ""))


def with_entities(df: DataFrame, response: str, out: str = "entities") -> DataFrame:
    """Add the response's entities as array<struct<pos,name,type>>: first position, last type per name.

    Sorting the lines by (name, pos) puts the repeats of a name side by side, so
    one pass finds the first and one the last of each, also for long responses.
    """
    arr, n = F.col("_lines"), F.size("_lines")
    by_name = F.transform(entity_lines(F.col(response)), lambda r: F.struct(r["name"], r["pos"], r["type"]))
    ordered = compute_once(df, F.array_sort(by_name).alias("_lines"))
    first = F.filter(arr, lambda r, i: (i == 0) | (F.get(arr, i - 1)["name"] != r["name"]))
    last = F.filter(arr, lambda r, i: (i == n - 1) | (F.get(arr, i + 1)["name"] != r["name"]))
    ends = ordered.withColumn("_first", first).withColumn("_last", last)
    merged = F.zip_with(
        "_first",
        "_last",
        lambda a, b: F.struct(a["pos"].alias("pos"), a["name"].alias("name"), b["type"].alias("type")),
    )
    return ends.withColumn(out, F.array_sort(merged)).drop("_lines", "_first", "_last")


def explode_triples(df: DataFrame, response: str, mode: str = "strict") -> DataFrame:
    """One row per parsed triple: ``seq``, ``head``, ``relation``, ``tail`` next to the input columns.

    ``strict`` drops triples with a blank part, ``lenient`` keeps them.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown mode: {mode}")
    lines = df.select("*", F.posexplode(F.split(response, "\n")).alias("seq", "_line")).filter(
        F.col("_line").rlike(TRIPLE_LINE)
    )
    part = lambda g: tx.strip(F.regexp_extract("_line", TRIPLE_LINE, g))
    parsed = lines.select(
        *df.columns,
        F.col("seq").cast("bigint").alias("seq"),
        part(1).alias("head"),
        part(2).alias("relation"),
        part(3).alias("tail"),
    )
    if mode == "lenient":
        return parsed
    return parsed.filter((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != ""))
