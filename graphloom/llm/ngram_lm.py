"""Stupid-backoff scores of documents under the corpus' own bigrams.

A document's bigrams are exploded once, packed by the hash of their first word: a
range of hashes then holds every bigram of a context and so counts the bigram and
the context in one place. A bigram that no other document has backs off to the second
word's share of the corpus; those words go, packed the same way, to the range of
their own hash, where the word counts of the first step meet them. What comes back
is one partial sum per task and document, packed by group of documents and added up there.

A row's number is its task and its place in that task's input, so that lists of numbers
pack into a byte or two each; the key of the row travels once, beside its number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import (
    BLOCK_WORDS, blocks, packed, packed_ids, packed_places, row_key, unpacked, unpacked_ids, unpacked_places, utf8, written,
)
from graphloom.llm.window_dedup import BASE, _groups, _id_bucket, _rows, _table, bucket_bounds

BACKOFF = 0.4
# bits of a word's hash: words that share one count as the same word
WORD_BITS = 48
# bigrams that a task packs at a time
PACK_WORDS = BLOCK_WORDS // 2
# bytes of text whose bigrams one range takes, so that ranges follow the data and not the session's settings
RANGE_BYTES = 8 << 20
# a word is hot from this part of an even range on: at most buckets / HOT_PART words are
HOT_PART = 0.5
_ALL_WORDS = -1
_PACKS = "bucket int, contexts binary, seconds binary, counts binary, places binary, docs binary"
_NAMES = ["kind", "bucket", "words", "counts", "places", "docs"]
_TYPES = [pa.int32(), pa.int32()] + [pa.binary()] * 4
_STEP = "kind int, bucket int, words binary, counts binary, places binary, docs binary"
# a number's lower bits: the row's place in its task
PLACE_BITS = 40
# partial sums travel as whole multiples of this part
SUM_SCALE = 2.0**32
KEY_BYTES = 16
# sums by document that a task holds at a time
MOST_SUMS = 250_000


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64) >> np.uint64(64 - WORD_BITS)


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted columns starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _frequent(share: float):
    """Words that hold at least that share of a million words, and the number of all words.

    Of blocks alike in size, a word with twice the share of the whole corpus has the
    share in blocks that hold half of its places or more.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        n = 0

        def often() -> pa.RecordBatch:
            found = [(w, c) for w, c in counts.items() if c >= share * n]
            words = np.append(_hashes([w for w, _ in found]).astype(np.int64), _ALL_WORDS)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array([*(c for _, c in found), n], pa.int64())], ["word", "n"])

        for batch in blocks(batches, "text", 8 * BLOCK_WORDS):
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                counts.update(words)
                n += len(words)
                if n >= BLOCK_WORDS:
                    yield often()
                    counts.clear()
                    n = 0
        if n:
            yield often()

    return rows


def hot_words(texts: DataFrame, share: float) -> tuple[np.ndarray, int]:
    """Hashes of the words that hold a share of all words, at most 1 / share of them, and the number of all words."""
    found = written(texts.mapInArrow(_frequent(share), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = found.where(F.col("word") == _ALL_WORDS).agg(F.sum("n")).first()[0] or 0
    hot = found.where((F.col("word") != _ALL_WORDS) & (F.col("n") >= share * total)).select("word").collect()
    # 0 stands before every first word
    return np.unique(np.array([0, *(r.word for r in hot)], np.uint64)), total


def _pair_bucket(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = ((first * BASE) ^ second) * BASE
    return (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(buckets: int, most: int, hot: np.ndarray):
    """Counted bigrams of a document, by the range of the first word's hash, of hot words by the hash of both.

    Keys of rows go below 0: -1 - group of documents.
    """
    bounds = bucket_bounds(buckets) >> np.uint64(64 - WORD_BITS)
    types = [pa.int32()] + [pa.binary()] * 5
    names = ["bucket", "contexts", "seconds", "counts", "places", "docs"]

    def pack(docs: np.ndarray, keys: np.ndarray, hashes: list[np.ndarray]) -> pa.RecordBatch:
        first, second = np.concatenate([h[:-1] for h in hashes]), np.concatenate([h[1:] for h in hashes])
        places = np.repeat(np.arange(len(docs)), [len(h) - 1 for h in hashes])
        order = np.lexsort((second, places, first))
        first, second, places = first[order], second[order], places[order]
        starts = np.flatnonzero(_runs_of(first, places, second))
        counts = np.diff(np.concatenate((starts, [len(first)])))
        first, second, places = first[starts], second[starts], places[starts]
        target = np.searchsorted(bounds, first, "right")
        apart = np.isin(first, hot)
        target[apart] = _pair_bucket(first[apart], second[apart], buckets)
        order = np.argsort(target, kind="stable")
        first, second, places, counts = first[order], second[order], places[order], counts[order]
        out: list[list] = [[] for _ in types]
        cuts = np.searchsorted(target[order], np.arange(buckets + 1))
        for bucket in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[bucket], cuts[bucket + 1])
            used, local = np.unique(places[at], return_inverse=True)
            values = (int(bucket), packed(first[at]), packed(second[at]), packed(counts[at].astype("<u4")), packed_places(local), packed_ids(docs[used]))
            for column, value in zip(out, values):
                column.append(value)
        target = _id_bucket(docs, buckets)
        for bucket in np.unique(target):
            at = target == bucket
            for column, value in zip(out, (-1 - int(bucket), keys[at].tobytes(), None, None, None, packed_ids(docs[at]))):
                column.append(value)
        return _table(out, types, names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << PLACE_BITS
        keys, held, n = [], [], 0

        def block() -> pa.RecordBatch:
            docs = np.arange(number, number + len(keys), dtype=np.int64)
            return pack(docs, np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES), held)

        for batch in blocks(batches, "text", 8 * BLOCK_WORDS):
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist()):
                words = text.lower().split()
                if words:
                    # 0 stands before the first word and after the last
                    held.append(np.concatenate((np.zeros(1, np.uint64), _hashes(words), np.zeros(1, np.uint64))))
                    keys.append(key)
                    n += len(words)
                if n >= most:
                    yield block()
                    number += len(keys)
                    keys, held, n = [], [], 0
        if held:
            yield block()

    return rows


class _Sums:
    """Sums by document over a task, given out packed by group of documents (kind 2)."""

    def __init__(self, buckets: int, most: int):
        self.buckets, self.most = buckets, most
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        docs, values = (np.concatenate(x) for x in zip(*self.held))
        used, local = np.unique(docs, return_inverse=True)
        return used, np.bincount(local, values, len(used))

    def add(self, docs: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((docs, values))
        self.n += len(docs)
        if self.n > self.most:
            self.held = [self._folded()]
            self.n = len(self.held[0][0])
        if 2 * self.n > self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        docs, sums = self._folded()
        self.held, self.n = [], 0
        target = _id_bucket(docs, self.buckets)
        order = np.argsort(target, kind="stable")
        docs, sums = docs[order], np.rint(sums[order] * SUM_SCALE).astype("<i8")
        cuts = np.searchsorted(target[order], np.arange(self.buckets + 1))
        rows: list[list] = [[] for _ in _TYPES]
        for bucket in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[bucket], cuts[bucket + 1])
            for column, value in zip(rows, (2, int(bucket), None, packed(sums[at]), None, packed_ids(docs[at]))):
                column.append(value)
        yield _table(rows, _TYPES, _NAMES)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of a group: their partial sums (kind 2), by the keys of their rows (kind 3)."""
    for _, group in _groups(batches, "bucket"):
        named = [r for r in group if r["kind"] == 3]
        docs = np.concatenate([unpacked_ids(r["docs"]) for r in named])
        keys = np.concatenate([np.frombuffer(r["words"], np.uint8).reshape(-1, KEY_BYTES) for r in named])
        order = np.argsort(docs)
        docs, keys = docs[order], keys[order]
        sums = np.zeros(len(docs))
        for r in group:
            if r["kind"] == 2:
                sums[np.searchsorted(docs, unpacked_ids(r["docs"]))] += unpacked(r["counts"], "<i8") / SUM_SCALE
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(sums)], ["row_key", "log_score"])


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in _rows(batch):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(r["words"]).astype(np.int64)), pa.array(unpacked(r["counts"], "<i8"))], ["word", "n"])


def _per_word(word: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed numbers of each word and document, in that order."""
    order = np.lexsort((doc, word))
    word, doc, n = word[order], doc[order], n[order]
    starts = np.flatnonzero(_runs_of(word, doc))
    return word[starts], doc[starts], _sums(n, starts)


def _bigrams(buckets: int, backoff: float, hot: np.ndarray, most: int):
    """What a range knows, by kind.

    0: counts of its words. 1: words to back off to. 2: partial scores. 3: keys of
    rows. 4: its part of a hot word's count. 5: hot words to back off to. 6: hot
    words whose bigrams were met.
    """
    bounds = bucket_bounds(buckets) >> np.uint64(64 - WORD_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partials = _Sums(buckets, most)
        for bucket, group in _groups(batches, "bucket"):
            if bucket < 0:
                names: list[list] = [[] for _ in _TYPES]
                for r in group:
                    for column, value in zip(names, (3, -1 - bucket, r["contexts"], None, None, r["docs"])):
                        column.append(value)
                yield _table(names, _TYPES, _NAMES)
                continue
            parts = [
                (unpacked(r["contexts"]), unpacked(r["seconds"]), unpacked(r["counts"], "<u4").astype(np.int64), unpacked_ids(r["docs"])[unpacked_places(r["places"])])
                for r in group
            ]
            first, second, counts, docs = (np.concatenate(x) for x in zip(*parts))
            del parts
            group.clear()
            order = np.lexsort((second, first))
            # one after the other: no two copies of all columns
            first = first[order]
            second = second[order]
            counts = counts[order]
            docs = docs[order]
            del order
            pair, context = _runs_of(first, second), _runs_of(first)
            pair_total = _sums(counts, np.flatnonzero(pair))[np.cumsum(pair) - 1]
            totals = _sums(counts, np.flatnonzero(context))
            # what the document itself has of the bigram does not count
            others = pair_total - counts
            del pair_total
            inside = second != 0
            start = first == 0
            met = inside & (others > 0) & ~start
            apart = np.isin(first, hot)
            # a step down has its factor, and the share of the word from the next step
            partial = counts * np.log(backoff)
            partial[met] = counts[met] * np.log(others[met])
            del others
            here = met & ~apart
            partial[here] -= counts[here] * np.log(totals[np.cumsum(context) - 1][here])
            scored_here = inside & ~start
            if scored_here.any():
                yield from partials.add(*_per_doc(docs[scored_here], partial[scored_here]))
            del partial
            word, local = first[context], ~apart[context]
            out: list[list] = [[] for _ in _TYPES]
            for kind, part in ((0, local), (4, ~local & (word != 0))):
                if kind == 0 or part.any():
                    for column, value in zip(out, (kind, int(bucket), packed(word[part]), packed(totals[part]), None, None)):
                        column.append(value)

            def add(kind: int, target: int, word: np.ndarray, doc: np.ndarray, n: np.ndarray) -> None:
                used, local = np.unique(doc, return_inverse=True)
                for column, value in zip(out, (kind, target, packed(word), packed(n.astype("<u4")), packed_places(local), packed_ids(used))):
                    column.append(value)

            hot_met = met & apart
            if hot_met.any():
                add(6, int(bucket), *_per_word(first[hot_met], docs[hot_met], counts[hot_met]))
            del first
            open_ = inside & ~met
            often = np.isin(second, hot)
            if (open_ & often).any():
                add(5, int(bucket), *_per_word(second[open_ & often], docs[open_ & often], counts[open_ & often]))
            open_ &= ~often
            if open_.any():
                word, doc, n = _per_word(second[open_], docs[open_], counts[open_])
                cuts = np.concatenate(([0], np.searchsorted(word, bounds, "left"), [len(word)]))
                for target in np.flatnonzero(np.diff(cuts)):
                    at = slice(cuts[target], cuts[target + 1])
                    add(1, int(target), word[at], doc[at], n[at])
            yield _table(out, _TYPES, _NAMES)
        yield from partials.out()

    return rows


def _per_doc(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, local = np.unique(docs, return_inverse=True)
    return used, np.bincount(local, scores, len(used))


def _words(total: int, buckets: int, most: int):
    """Words to back off to, met by the counts of their range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known, counts = None, None, None
        partials = _Sums(buckets, most)
        for batch in batches:
            for r in _rows(batch):
                if r["kind"] == 0:
                    bucket, known, counts = r["bucket"], unpacked(r["words"]), unpacked(r["counts"], "<i8")
                    continue
                assert r["bucket"] == bucket, "a range's counts come before its words"
                doc = unpacked_ids(r["docs"])[unpacked_places(r["places"])]
                n = unpacked(r["counts"], "<u4").astype(np.float64)
                share = counts[np.searchsorted(known, unpacked(r["words"]))] / total
                yield from partials.add(*_per_doc(doc, n * np.log(share)))
        yield from partials.out()

    return rows


def _hot_terms(words: np.ndarray, counts: np.ndarray, total: int, buckets: int, most: int):
    """Hot words to back off to, and those whose bigrams were met, with the words' counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partials = _Sums(buckets, most)
        for batch in batches:
            for r in _rows(batch):
                doc = unpacked_ids(r["docs"])[unpacked_places(r["places"])]
                n = unpacked(r["counts"], "<u4").astype(np.float64)
                count = counts[np.searchsorted(words, unpacked(r["words"]))]
                yield from partials.add(*_per_doc(doc, n * np.log(count / total) if r["kind"] == 5 else -n * np.log(count)))
        yield from partials.out()

    return rows


def scored(docs: DataFrame, backoff: float = BACKOFF, row: Column | None = None, pack_words: int = PACK_WORDS, most_sums: int = MOST_SUMS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (row, n_words, log_score, mean_score), one per document.

    Words are runs without ASCII white space, A-Z lower-cased. The first word
    of a text scores log(count / all words). A later word w after v scores
    log(n(vw) / n(v)) where n(vw) counts the bigram in other rows and n(v) the
    word in all, and where no other row has the bigram
    log(backoff * n(w) / all words). ``log_score`` sums over the words,
    ``mean_score`` divides by their number; texts without words have 0 and null.
    Rows that repeat count each for itself and get the same score. A bigram is
    counted in one place: it has one row there for each document that holds it. Sums
    are rounded to 2^-32 for each task. ``row`` is what to carry, by default a struct
    of all columns. ``docs`` should be a table: numbers follow the order in which
    its partitions are read, and a task that runs again has to read the same.
    """
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if row is None else row
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")
    base = docs.select(carried.alias("row"), row_key().alias("row_key"), size.alias("n_words"))
    texts = docs.select(row_key().alias("row_key"), utf8().alias("text"))
    hot, total = hot_words(texts.select("text"), HOT_PART / buckets)
    packs = texts.mapInArrow(_pack(buckets, pack_words, hot), _PACKS)

    def own_range(rows: DataFrame) -> DataFrame:
        # a task for each range: by hash some tasks would hold several
        return rows.repartitionById(buckets, F.pmod("bucket", F.lit(buckets)).cast("int"))

    steps = written(own_range(packs).sortWithinPartitions("bucket").mapInArrow(_bigrams(buckets, backoff, hot, most_sums), _STEP), "bigrams")
    # a row for each hot word
    counted = steps.where("kind = 4").mapInArrow(_hot_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy("word").collect()
    ends = own_range(steps.where("kind < 2")).sortWithinPartitions("bucket", "kind")
    ends = ends.mapInArrow(_words(max(1, total), buckets, most_sums), _STEP)
    often = steps.where("kind > 4").mapInArrow(
        _hot_terms(np.array([r.word for r in counted], np.uint64), np.array([r.n for r in counted]), max(1, total), buckets, most_sums), _STEP
    )
    parts = steps.where("kind IN (2, 3)").unionByName(ends).unionByName(often)
    sums = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed, "row_key binary, log_score double")
    # rows with equal id and text share a key and a score
    joined = base.join(sums.groupBy("row_key").agg(F.max("log_score").alias("log_score")), "row_key", "left")
    score = F.coalesce("log_score", F.lit(0.0))
    return joined.select("row", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_score"))
