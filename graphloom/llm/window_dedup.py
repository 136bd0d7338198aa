"""Repeated word windows, found by Rabin-Karp hashes and removed as maximal intervals.

Every window of a document is hashed by a rolling polynomial over its words' 64-bit
hashes. A task packs the windows of many documents by hash range: one row holds the
sorted hashes of a range, so the shuffle moves little more than 8 bytes a window. Of
a hash that several documents of a pack share only the smallest id goes on; the
others know already that they lose the window. A range therefore gets a hash once a
pack, however many documents share it. The smallest id of a hash decides; windows
that lose come back packed by document, and their union is cut from the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import (
    BLOCK_WORDS, blocks, buckets_of, covered, packed, packed_ids, packed_places, runs, unpacked, unpacked_ids, unpacked_places, utf8,
)

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PACKS = "bucket int, sent boolean, hashes binary, places binary, ids binary"
_LOST = "bucket int, hashes binary, places binary, ids binary"
# windows that a task packs at a time
PACK_WINDOWS = 2 * BLOCK_WORDS


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` words, from left to right."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(w) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(BASE, len(words)), dtype=np.uint64)))
        rolled = (sums[width:] - sums[:n]) * _powers(INVERSE, n)
        # spread the sum over all bits: ranges of hashes are to be even
        rolled ^= rolled >> np.uint64(32)
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(32)
    return rolled


def bucket_bounds(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def _id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document, by its id."""
    with np.errstate(over="ignore"):
        spread = (ids.astype("<i8").view(np.uint64) * BASE) >> np.uint64(32)
    return ((spread * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _table(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _pack(width: int, buckets: int, most: int):
    """Rows of packed windows by hash range, and rows of windows that lose within the pack."""
    bounds = bucket_bounds(buckets)
    types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "sent", "hashes", "places", "ids"]

    def pack(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids, owner = np.unique(np.array([f[0] for f in found], np.int64), return_inverse=True)
        hashes = np.concatenate([f[1] for f in found])
        places = np.repeat(owner, [len(f[1]) for f in found])
        order = np.lexsort((places, hashes))
        hashes, places = hashes[order], places[order]
        fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        again = ~fresh & np.concatenate(([False], places[1:] == places[:-1]))
        hashes, places, first = hashes[~again], places[~again], fresh[~again]
        out: list[list] = [[] for _ in types]

        def add(bucket: int, sent: bool, h: np.ndarray, p: np.ndarray) -> None:
            used, local = np.unique(p, return_inverse=True)
            for column, value in zip(out, (bucket, sent, packed(h), packed_places(local), packed_ids(ids[used]))):
                column.append(value)

        h, p = hashes[first], places[first]
        cuts = np.concatenate(([0], np.searchsorted(h, bounds, "left"), [len(h)]))
        for bucket in np.flatnonzero(np.diff(cuts)):
            add(int(bucket), True, h[cuts[bucket] : cuts[bucket + 1]], p[cuts[bucket] : cuts[bucket + 1]])
        if not first.all():
            # these only pass through: any bucket will do
            add(int(_id_bucket(ids[:1], buckets)[0]), False, hashes[~first], places[~first])
        return _table(out, types, names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in blocks(batches, "text", 8 * BLOCK_WORDS):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = window_hashes(text.split(), width)
                if len(found):
                    held.append((doc_id, found))
                    n += len(found)
                if n >= most:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    return rows


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch in turn: only the one at hand is copied."""
    columns = dict(zip(batch.schema.names, batch.columns))
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in columns.items()}


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows with one value of a sorted column at a time."""
    value, held = None, []
    for batch in batches:
        for row in _rows(batch):
            if row[column] != value:
                if held:
                    yield value, held
                value, held = row[column], []
            held.append(row)
    if held:
        yield value, held


def _decide(buckets: int):
    """Of each hash of a range, the entries of larger ids than its smallest, packed by document."""
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def lost(h: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        out: list[list] = [[] for _ in types]
        target = _id_bucket(ids, buckets)
        order = np.lexsort((ids, target))
        h, ids, target = h[order], ids[order], target[order]
        cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            used, local = np.unique(ids[a:b], return_inverse=True)
            for column, value in zip(out, (int(target[a]), packed(h[a:b]), packed_places(local), packed_ids(used))):
                column.append(value)
        return _table(out, types, ["bucket", "hashes", "places", "ids"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, "bucket"):
            sent: list[tuple[np.ndarray, np.ndarray]] = []
            for r in group:
                entries = unpacked(r["hashes"]), unpacked_ids(r["ids"])[unpacked_places(r["places"])]
                if r["sent"]:
                    sent.append(entries)
                else:
                    yield lost(*entries)
            if not sent:
                continue
            h, ids = (np.concatenate(x) for x in zip(*sent))
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            fresh = np.concatenate(([True], h[1:] != h[:-1]))
            loses = ids > ids[fresh][np.cumsum(fresh) - 1]
            if loses.any():
                yield lost(h[loses], ids[loses])

    return rows


def _cut(width: int):
    """Documents of a bucket after the bucket's lost windows; the windows' union leaves the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, lost = None, {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("bucket", "hashes", "places", "ids", "doc_id", "text")]
            for at, (b, hashes, places, ids, doc_id, text) in enumerate(zip(*columns)):
                if b != bucket:
                    bucket, lost = b, {}
                if hashes is not None:
                    h, p = unpacked(hashes), unpacked_places(places)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1, [len(p)]))
                    for owner, a, z in zip(unpacked_ids(ids).tolist(), cuts[:-1], cuts[1:]):
                        lost.setdefault(owner, []).append(h[a:z])
                    continue
                words = text.split()
                mask = np.zeros(len(words), bool)
                kept = words
                if doc_id in lost:
                    starts = np.flatnonzero(np.isin(window_hashes(words, width), np.concatenate(lost[doc_id])))
                    mask = covered(starts, width, len(words))
                    kept = [w for w, gone in zip(words, mask) if not gone]
                keep.append(at)
                for column, value in zip(out, (len(words), int(mask.sum()), runs(mask).tolist(), b" ".join(kept))):
                    column.append(value)
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(pa.array(keep)),
                        pa.array(out[0], pa.int64()),
                        pa.array(out[1], pa.int64()),
                        pa.array(out[2], pa.list_(pa.list_(pa.int64()))),
                        pa.array(out[3], pa.binary()).cast(pa.string()),
                    ],
                    ["row", "n_words", "n_removed", "removed", "kept_text"],
                )

    return rows


def remove_repeated_windows(docs: DataFrame, width: int = 50, row: Column | None = None, pack_windows: int = PACK_WINDOWS) -> DataFrame:
    """Rows (row, n_words, n_removed, removed, kept_text), one per document.

    Words are runs without ASCII white space. A word goes where a window of
    ``width`` words over it also starts in a document with a smaller id, judged
    on the input. ``removed`` lists the maximal intervals [start, end) of word
    positions, ``kept_text`` the other words joined by blanks. ``row`` is what to
    carry, by default a struct of all columns. Null and empty texts have no
    words. Rows without an id neither lose words nor take them from others; rows
    that repeat an id do not take words from each other.
    """
    spark = docs.sparkSession
    buckets = buckets_of(spark)
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if row is None else row
    texts = docs.select(carried.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"))
    packs = texts.where("doc_id is not null").select("doc_id", "text").mapInArrow(_pack(width, buckets, pack_windows), _PACKS)
    lost = packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_decide(buckets), _LOST)
    bucket_of = F.pandas_udf(lambda ids: pd.Series(_id_bucket(ids.to_numpy(), buckets)), "int")
    # rows without an id lose nothing: they may go anywhere
    anywhere = F.pmod(F.hash("text"), F.lit(buckets))
    texts = texts.withColumn("bucket", F.when(F.col("doc_id").isNull(), anywhere).otherwise(bucket_of(F.coalesce("doc_id", F.lit(0)))))
    nothing = lambda kind: F.lit(None).cast(kind)
    kind = texts.schema["row"].dataType
    both = lost.select(
        "bucket", "hashes", "places", "ids", nothing("bigint").alias("doc_id"), nothing("binary").alias("text"), nothing(kind).alias("row")
    ).unionByName(texts.select("bucket", *[nothing("binary").alias(c) for c in ("hashes", "places", "ids")], "doc_id", "text", "row"))
    placed = both.repartition("bucket").sortWithinPartitions("bucket", F.col("hashes").isNull())
    return placed.mapInArrow(
        _cut(width), f"row {kind.simpleString()}, n_words bigint, n_removed bigint, removed array<array<bigint>>, kept_text string"
    )
