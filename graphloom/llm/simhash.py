"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at
most 3 bits, one half differs in at most 1, so a table of halves is asked for each
half itself and for its ball of radius 1. A pair whose halves differ in one bit is
asked for from the side where the bit is 0 only, so half of the ball is enough.
Equal fingerprints are one row throughout, whatever their number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import row_key, utf8, written
from graphloom.llm.links import components

SEED = 42
HALF = 32


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the word shingles, of the whole sequence where it is shorter."""
    text = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(text))]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in spans], "<u8")


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of 64-bit lanes, lane by lane from the lowest bit."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 8_192):
        block = np.ascontiguousarray(hashes[at : at + 8_192]).view(np.uint8).reshape(-1, 8 * hashes.shape[1])
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return 2 * ones > len(hashes)


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """Bits set in over half of the hashes of the word shingles; no words: 0."""
    if not words:
        return 0
    bits = _majority(_hashes(words, width)[:, None])
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.lower().split(), width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(found, np.uint64).view(np.int64))],
                ["doc_id", "row_key", "fingerprint"],
            )

    return rows


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, row_key, fingerprint as a signed long), one per document.

    Words are runs without ASCII white space, A-Z lower-cased; a null, empty or
    blank text has fingerprint 0.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), utf8().alias("text"))
    return narrow.mapInArrow(_fingerprints(width), "doc_id bigint, row_key binary, fingerprint bigint")


def near_fingerprints(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most ``max_bits`` (3 or fewer) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves and balls of radius 1 find up to 3 bits")
    half = lambda i: F.shiftrightunsigned("fingerprint", HALF * i).bitwiseAND((1 << HALF) - 1)
    halves = distinct.select(
        "fingerprint", F.inline(F.array(*[F.struct(F.lit(i).alias("part"), half(i).alias("value")) for i in range(2)]))
    )
    # the value itself and the ball's members that add a bit
    ball = F.filter(
        F.transform(F.sequence(F.lit(-1), F.lit(HALF - 1)), lambda b: F.when(b < 0, F.col("value")).otherwise(
            F.col("value").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(b, F.lit(0))))
        )),
        lambda x, at: (at == 0) | (x != F.col("value")),
    )
    asked = halves.select(F.col("fingerprint").alias("a"), "part", F.explode(ball).alias("value"), F.col("value").alias("own"))
    table = halves.select(F.col("fingerprint").alias("b"), "part", "value")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # equal halves are met from both sides: one order is enough
    return (
        asked.join(table, ["part", "value"])
        .where((apart <= max_bits) & ((F.col("own") != F.col("value")) | (F.col("a") < F.col("b"))))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, max_bits: int = 3, width: int = 3) -> DataFrame:
    """Rows (doc_id, row_key, fingerprint, component_id), one per document.

    ``component_id`` is the smallest id reachable over fingerprints that differ
    in at most ``max_bits`` bits; null ids are passed over, so it is null where a
    component has no other. Texts without words share fingerprint 0 and are
    linked like any other.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    return _in_groups(prints, near_fingerprints(prints.select("fingerprint").distinct(), max_bits))


def _in_groups(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds to (doc_id, row_key, fingerprint) the smallest id of the component that linked fingerprints make."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    found = components(pairs)
    groups = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least_id", F.coalesce("component", "fingerprint").alias("component")
    )
    smallest = groups.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = groups.join(smallest, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "row_key", "fingerprint", "component_id")


@dataclass
class Reach:
    """Fingerprints long enough to tell texts of a shingle similarity, and segments short enough to meet them.

    Shingle sets of similarity s differ in a share p = acos(2s / (1 + s)) / pi of
    their bits. Segments have a few bits more than the number of texts, so that
    few texts meet by chance at any size; there are so many of them that a pair
    at s has, with probability ``recall``, one that differs in a bit or none. The
    distance allowed is two standard deviations above p.
    """

    n: int
    similarity: float = 0.8
    recall: float = 0.97

    def __post_init__(self):
        p = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        self.bits = min(32, max(16, math.ceil(math.log2(max(2, self.n))) + 4))
        met = (1 - p) ** self.bits + self.bits * p * (1 - p) ** (self.bits - 1)
        self.segments = math.ceil(math.log(1 - self.recall) / math.log(1 - met))
        total = self.bits * self.segments
        self.most = math.floor(total * p + 2 * math.sqrt(total * p * (1 - p)))
        # of the first 64 bits, which are looked at as soon as two texts meet
        self.most_first = math.floor(64 * p + 4 * math.sqrt(64 * p * (1 - p)))


def segments_of(words: list[bytes], reach: Reach, width: int) -> tuple[np.ndarray, int]:
    """A long fingerprint as its segments, and its first 64 bits."""
    if not words:
        return np.zeros(reach.segments, np.int64), 0
    lanes = -(-reach.bits * reach.segments // 64)
    with np.errstate(over="ignore"):
        mixed = _hashes(words, width)[:, None] + np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    bits = _majority(mixed)
    cut = bits[: reach.bits * reach.segments].reshape(reach.segments, reach.bits)
    return cut @ (1 << np.arange(reach.bits, dtype=np.int64)), int(np.packbits(bits[:64], bitorder="little").view("<i8")[0])


def _segments(reach: Reach, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments_of(t.lower().split(), reach, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([f for _, f in found], pa.int64())],
                ["doc_id", "row_key", "segments", "first_bits"],
            )

    return rows


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.97) -> DataFrame:
    """Rows (doc_id, row_key, fingerprint, component_id), one per document, over near copies.

    Texts whose sets of word shingles have that Jaccard similarity or more are
    linked by their long fingerprints, see ``Reach``. A text is compared with one
    of those that share a segment, that with the least hash, and then with all
    others there that are not yet in its group, so no pair that shares a segment
    is left out; those that one group holds already need no comparison.
    ``fingerprint`` is the hash of the long one. Other cases as in ``near_duplicates``.
    """
    reach = Reach(docs.count(), similarity, recall)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), utf8().alias("text"))
    long = written(narrow.mapInArrow(_segments(reach, width), "doc_id bigint, row_key binary, segments array<bigint>, first_bits bigint"), "segments")
    long = long.withColumn("fingerprint", F.xxhash64("segments"))
    distinct = long.groupBy("fingerprint").agg(F.first("segments").alias("segments"), F.first("first_bits").alias("first_bits"))
    distinct = written(distinct, "long-fingerprints")
    table, values = _buckets(distinct, reach)
    # a text meets one of those that have a segment, not all: a group of near copies gives links in proportion to its size
    mine = F.min(F.struct(F.col("b").alias("b"), F.col("first_b").alias("first_b")))
    leaders = table.groupBy("part", "value").agg(mine.alias("least"), (F.count("*") > 1).alias("shared"))
    leaders = written(leaders.select("part", "value", "least.b", "least.first_b", "shared"), "leaders")
    # a segment of one text asks for others only
    ball = written(_ball(leaders.select("part", "value"), reach).unionByName(leaders.where("shared").select("part", F.col("value").alias("own"), "value")), "near-segments")
    near_first = F.bit_count(F.col("first_a").bitwiseXOR(F.col("first_b"))) <= reach.most_first
    asked = values.join(ball.join(leaders, ["part", "value"]).select("part", "own", "b", "first_b"), ["part", "own"])
    met = asked.where(near_first & (F.col("a") != F.col("b")))
    led = written(_verified(met, distinct, reach), "led-links")
    # the rest of a bucket, exactly: those that the leaders' links leave in different groups meet each other;
    # of a bucket with one text that one is the leader, and all have met it
    found = components(led)
    grouped = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    grouped = written(grouped.select(*distinct.columns, F.coalesce("component", "fingerprint").alias("group")), "led-groups")
    table, values = _buckets(grouped, reach, "group")
    shared = leaders.where("shared").select("part", "value")
    table = written(table.join(shared, ["part", "value"]), "shared-buckets")
    # of a bucket's groups one is the largest; a pair of two groups has an end outside it
    sizes = table.groupBy("part", "value", "group_b").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("part", "value").agg(F.max(F.struct("n", "group_b")).alias("top"), F.count("*").alias("groups"))
    buckets = written(buckets.select("part", "value", F.col("top.group_b").alias("largest"), (F.col("groups") > 1).alias("several")), "buckets")
    outside = F.array_compact(F.array(F.when(F.col("several"), True), F.when(F.col("group_a") != F.col("largest"), False)))
    asked = values.join(ball.join(buckets, ["part", "value"]), ["part", "own"])
    asked = asked.select("a", "first_a", "group_a", "part", "value", F.explode(outside).alias("outside"))
    table = table.join(buckets, ["part", "value"]).select("b", "first_b", "group_b", "part", "value", (F.col("group_b") != F.col("largest")).alias("outside"))
    rest = asked.join(table, ["part", "value", "outside"]).where(near_first & (F.col("group_a") != F.col("group_b")))
    links = led.unionByName(_verified(rest, distinct, reach))
    return _in_groups(long.select("doc_id", "row_key", "fingerprint"), links)


def _buckets(distinct: DataFrame, reach: Reach, *more: str) -> tuple[DataFrame, DataFrame]:
    """A row for each segment of a text, as (b, first_b, part, value) and as (a, first_a, part, own)."""
    side = lambda x: [F.col("fingerprint").alias(x), F.col("first_bits").alias(f"first_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more]]
    return distinct.select(*side("b"), F.posexplode("segments").alias("part", "value")), distinct.select(*side("a"), F.posexplode("segments").alias("part", "own"))


def _ball(values: DataFrame, reach: Reach) -> DataFrame:
    """(part, own, value): each of the given segments with those among them that add one bit to it.

    Two segments that differ in one bit agree in two of three thirds, so a segment
    is three rows, keyed by the two, and not one for each bit. As the segments
    differ, a key has as many rows as a third has values, however many texts share them.
    """
    third = -(-reach.bits // 3)
    low = (1 << third) - 1
    keyed = values.select("part", "value", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("open"))
    kept = F.element_at(F.array(*[F.lit(~(low << third * i)).cast("bigint") for i in range(3)]), F.col("open") + 1)
    keyed = keyed.select("part", "open", F.col("value").bitwiseAND(kept).alias("kept"), "value")
    met = keyed.withColumnRenamed("value", "own").join(keyed.hint("merge"), ["part", "open", "kept"])
    one_more = (F.bit_count(F.col("own").bitwiseXOR(F.col("value"))) == 1) & (F.col("own") < F.col("value"))
    return met.where(one_more).select("part", "own", "value")


def _verified(met: DataFrame, distinct: DataFrame, reach: Reach) -> DataFrame:
    """(a, b), each once: those of the pairs whose long fingerprints are near enough."""
    candidates = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        candidates = candidates.join(distinct.select(F.col("fingerprint").alias(end), F.col("segments").alias(f"of_{end}")), end)
    apart = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return candidates.where(apart <= reach.most).select("a", "b")


def one_per_group(docs: DataFrame, max_bits: int = 3, width: int = 3) -> DataFrame:
    """The documents without near duplicates by ``near_duplicates``: of each component one row stays, see ``first_of_groups``."""
    return first_of_groups(docs, near_duplicates(docs, max_bits, width))


def first_of_groups(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each component the document with the smallest id, with all columns.

    Where several rows have that id, one stays. Components without any id keep
    one row as well.
    """
    near = written(grouped, "near")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    # a component is known by its smallest id; those without id by their fingerprint
    alone = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    chosen = near.groupBy("component_id", alone.alias("alone")).agg(F.min(order).alias("first")).select("first.row_key")
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("row_key"))
    return carried.join(chosen, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")
