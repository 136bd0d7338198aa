"""Row keys, shared-folder tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.session import run_dir

# words of a batch that a task turns into arrays at a time
BLOCK_WORDS = 1_000_000
# buckets for each shuffle partition, so that a task holds a part of its partition at a time
BUCKETS_PER_PARTITION = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """128 bits that stand for a row's id and text, never null.

    Rows with equal id and text share it, and every operator gives them equal
    results, so a join on it needs no position in the input.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    name = F.coalesce(as_column(doc_id).cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(name, F.lit("|"), F.coalesce(as_column(text), F.lit("")))))


def utf8(text: Column | str = "text") -> Column:
    """The text as bytes; a null text is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps never repeat its work."""
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets_of(spark: SparkSession) -> int:
    return BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a block's ``column`` holds about ``most`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: of sorted or small values the high planes are runs that compression removes."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpacked(data: bytes, kind: str = "<u8") -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def packed_ids(ids: np.ndarray) -> bytes:
    """Sorted signed 64-bit numbers, as planes of their steps."""
    return packed(np.diff(ids.astype("<i8"), prepend=np.int64(0)))


def unpacked_ids(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<i8"))


def packed_places(places: np.ndarray) -> bytes:
    """Places in a short list: a byte that tells their width, then planes."""
    wide = len(places) and int(places.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + packed(places.astype("<u4" if wide else "<u2"))


def unpacked_places(data: bytes) -> np.ndarray:
    return unpacked(data[1:], "<u4" if data[0] == 4 else "<u2").astype(np.int64)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in one of the intervals of ``length`` from ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of a mask as rows (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges.reshape(-1, 2)
