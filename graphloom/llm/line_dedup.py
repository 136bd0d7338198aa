"""Lines that many documents share, dropped by keep bitmaps.

Line hashes are range-partitioned with document and position as secondary order.
A task streams its sorted hashes: it holds the rows of one hash only until the
hash's fate is known, so a line of a third of all documents needs no memory. Since
the range is cut on (hash, document), such a line spreads over tasks; the counts
of the two hashes at each task's edges are added up first. What leaves the stream
is the position of dropped lines, gathered to one compressed bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import row_key, utf8
from graphloom.session import cut_lineage

_LINES = "doc_id bigint, row_key binary, line_hash binary, n_lines int, positions binary"
_EDGE = "task int, line_hash binary, n_docs bigint"
_DROPS = "row_key binary, n_lines int, positions binary"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _lines_of(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = text.split(b"\n")
                places: dict[bytes, list[int]] = {}
                for at, line in enumerate(lines):
                    found = line_key(line)
                    if len(found) >= min_chars and (found.isascii() or len(found.decode("utf-8", "replace")) >= min_chars):
                        places.setdefault(found, []).append(at)
                for found, at in places.items():
                    for column, value in zip(out, (doc_id, key, xxhash.xxh3_128_digest(found), len(lines), np.array(at, "<u4").tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))],
                ["doc_id", "row_key", "line_hash", "n_lines", "positions"],
            )

    return rows


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents counted for the first and the last hash of a task."""
    first = last = doc = None
    counts = {}
    for batch in batches:
        for line_hash, doc_id in zip(batch.column("line_hash").to_pylist(), batch.column("doc_id").to_pylist()):
            if line_hash != last:
                if last is not None and last != first:
                    counts.pop(last)
                first = first or line_hash
                last, doc = line_hash, None
                counts[last] = 0
            if doc_id is not None and doc_id != doc:
                counts[last] += 1
                doc = doc_id
    task = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [pa.array([task] * len(counts), pa.int32()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
        ["task", "line_hash", "n_docs"],
    )


def _stream(min_docs: int, totals: dict[bytes, int]):
    """Rows of dropped lines; a hash's rows wait only until ``min_docs`` documents hold it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = doc = None
        count, waiting = 0, []
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("line_hash", "doc_id", "row_key", "n_lines", "positions"))
            for line_hash, doc_id, key, n_lines, at in zip(*columns):
                if line_hash != last:
                    last, doc, waiting = line_hash, None, []
                    count = totals.get(line_hash, 0)
                    fresh = line_hash not in totals
                if fresh and doc_id is not None and doc_id != doc:
                    count += 1
                    doc = doc_id
                if count >= min_docs:
                    out.extend(waiting)
                    waiting = []
                    out.append((key, n_lines, at))
                else:
                    waiting.append((key, n_lines, at))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.binary()))],
                    ["row_key", "n_lines", "positions"],
                )

    return rows


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n_lines, parts in zip(batch.column("n_lines").to_pylist(), batch.column("parts").to_pylist()):
            keep = np.ones(n_lines, bool)
            keep[np.frombuffer(b"".join(parts), "<u4")] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n_lines - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_key"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            ["row_key", "n_lines", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row (row_key, n_lines, n_dropped, keep_bitmap) per document that loses lines.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. A line is
    dropped where its key holds ``min_chars`` code points and stands in lines of
    ``min_docs`` different ids. Rows without an id lose such lines but do not
    count; a null or empty text is one empty line, whose key is too short.
    Repeated rows count once. ``keep_bitmap`` is a zlib-packed bit per line.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), utf8().alias("text"))
    lines = (
        narrow.mapInArrow(_lines_of(min_chars), _LINES)
        .repartitionByRange("line_hash", "doc_id")
        .sortWithinPartitions("line_hash", "doc_id", "row_key")
    )
    lines = cut_lineage(lines)
    # two rows of each task at most
    edges = lines.select("doc_id", "line_hash").mapInArrow(_edges, _EDGE).collect()
    totals: dict[bytes, int] = {}
    for edge in edges:
        totals[bytes(edge.line_hash)] = totals.get(bytes(edge.line_hash), 0) + edge.n_docs
    drops = lines.mapInArrow(_stream(min_docs, totals), _DROPS)
    gathered = drops.groupBy("row_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("positions").alias("parts"))
    return gathered.mapInArrow(_bitmaps, "row_key binary, n_lines int, n_dropped int, keep_bitmap binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, texts = [], []
        for text, bitmap in zip(batch.column("line_text").to_pylist(), batch.column("keep_bitmap").to_pylist()):
            parts = text.split(b"\n")
            lines.append(len(parts))
            if bitmap is not None:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(parts))
                text = b"\n".join([x for x, k in zip(parts, keep) if k])
            texts.append(text)
        dropped = batch.column("n_dropped").fill_null(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(lines, pa.int64()), dropped, pa.array(texts, pa.binary()).cast(pa.string())],
            ["row", "n_lines", "n_dropped", "kept_text"],
        )


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, row: Column | None = None) -> DataFrame:
    """Rows (row, n_lines, n_dropped, kept_text), one per document; see ``keep_bitmaps``.

    ``row`` is what to carry of a document, by default a struct of all its
    columns. A document that loses all lines stays with an empty text.
    """
    bitmaps = keep_bitmaps(docs, min_docs, min_chars).drop("n_lines")
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if row is None else row
    texts = docs.select(carried.alias("row"), row_key().alias("row_key"), utf8().alias("line_text"))
    joined = texts.join(bitmaps, "row_key", "left").select("row", "line_text", "n_dropped", "keep_bitmap")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_kept, f"row {kind}, n_lines bigint, n_dropped bigint, kept_text string")
