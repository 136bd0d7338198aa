"""Where a record stands in its file, as a stable id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_place(scan: DataFrame, out: str) -> DataFrame:
    """Add ``file#n``: the n-th record, from 0, of its file, however the file is split.

    ``scan`` must come straight from a file reader. A split only counts its
    records; the counts of the earlier splits of the same file are added. The
    table of counts has a row per split, so adaptive execution can broadcast it.
    """
    placed = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        # ascends by one inside a split
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = placed.join(offsets, ["_file", "_start"])
    return numbered.select(F.concat_ws("#", "_file", F.col("_row") + F.col("_shift")).alias(out), *scan.columns)
