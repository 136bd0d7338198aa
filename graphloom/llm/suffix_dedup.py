"""Repeated byte strings, found by a distributed merge sort of suffixes.

A window of ``length`` bytes is owned by the place in it whose half-length string has the
smallest hash (the leftmost of equals). Equal windows have equal owners, so only the
suffixes at owners take part, about one in a hundred. First the owners' half-length
strings are counted: a window whose owner's string is alone in the corpus has no equal.
The suffixes that are left, with the bytes that their windows need on both sides, are
sorted in runs, front-coded, and dealt out by the hash of their first half-length bytes.
A receiving task merges the runs with a loser tree that carries common-prefix lengths and
never compares bytes known to be equal. From the prefix lengths of neighbours, forward
and backward, follows for each window whether another one equals it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import blocks, covered, packed, packed_ids, packed_places, row_key, runs, unpacked, unpacked_ids, unpacked_places, utf8
from graphloom.llm.window_dedup import BASE, INVERSE, _groups, _powers, _table, bucket_bounds

# bytes of a text that are hashed at a time
PIECE = 1 << 18
# bytes of text that one part takes, so that parts follow the data and not the session's settings
PART_BYTES = 8 << 20
# bytes of text behind a pack, and bytes of suffixes in a run
PACK_BYTES = 1 << 25
RUN_BYTES = 1 << 24
# bytes of text that are Python objects at a time, and what a key and a member take besides
READ_BYTES = 1 << 22
KEY_COST = 300
MEMBER_COST = 130
_BYTE_VALUES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    n = len(data) - width + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[data] * _powers(BASE, len(data)), dtype=np.uint64)))
        out = (sums[width:] - sums[:n]) * _powers(INVERSE, n)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the leftmost of equals."""
    n = len(values)
    place_bits = max(1, (n - 1).bit_length())
    low = np.uint64((1 << place_bits) - 1)
    ranked = (values & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.concatenate((ranked, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].reshape(-1)
    last = n - width + 1
    return (np.minimum(back[:last], ahead[width - 1 : width - 1 + last]) & low).astype(np.int64)


def owners(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners of the text's windows: place, first and last window start, hash of the half-length string."""
    half = length // 2
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(0, len(text) - length + 1), PIECE):
        data = np.frombuffer(text, np.uint8)[at : at + PIECE + length - 1]
        hashes = _gram_hashes(data, half)
        # ties are decided on bits that do not depend on where a piece starts
        place = _leftmost_min(hashes & ~np.uint64((1 << 24) - 1), length - half + 1)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        ends = np.concatenate((starts[1:], [len(place)])) - 1
        # smallest hashes crowd near 0; multiplied they spread over the whole range that is dealt out
        with np.errstate(over="ignore"):
            spread = hashes[place[starts]] * BASE
        for column, value in zip(out, (place[starts] + at, starts + at, ends + at, spread)):
            column.append(value)
    return tuple(np.concatenate(c) if c else np.empty(0, np.uint64 if i == 3 else np.int64) for i, c in enumerate(out))


def _pack(length: int, buckets: int):
    """Hashes of owners' strings by range; a document gives each twice at most."""
    bounds = bucket_bounds(buckets)

    def pack(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids, owner = np.unique(np.array([h[0] for h in held], np.int64), return_inverse=True)
        hashes = np.concatenate([h[1] for h in held])
        places = np.repeat(owner, [len(h[1]) for h in held])
        order = np.lexsort((places, hashes))
        hashes, places = hashes[order], places[order]
        same = (hashes[1:] == hashes[:-1]) & (places[1:] == places[:-1])
        third = np.concatenate(([False, False], same[1:] & same[:-1]))[: len(hashes)]
        hashes, places = hashes[~third], places[~third]
        out: list[list] = [[], [], [], []]
        cuts = np.concatenate(([0], np.searchsorted(hashes, bounds, "left"), [len(hashes)]))
        for bucket in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[bucket], cuts[bucket + 1])
            used, local = np.unique(places[at], return_inverse=True)
            for column, value in zip(out, (int(bucket), packed(hashes[at]), packed_places(local), packed_ids(ids[used]))):
                column.append(value)
        return _table(out, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "hashes", "places", "ids"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in blocks(batches, "text", PACK_BYTES):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                if len(text) >= length:
                    held.append((doc, owners(text, length)[3]))
                    n += len(text)
                if n >= PACK_BYTES:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    return rows


def _repeated(buckets: int):
    """Hashes that occur twice or more, back to the documents that have them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, "bucket"):
            hashes = np.concatenate([unpacked(r["hashes"]) for r in group])
            ids = np.concatenate([unpacked_ids(r["ids"])[unpacked_places(r["places"])] for r in group])
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            same = hashes[1:] == hashes[:-1]
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            hashes, ids = hashes[twice], ids[twice]
            target = ids % buckets
            order = np.lexsort((hashes, ids, target))
            hashes, ids, target = hashes[order], ids[order], target[order]
            out: list[list] = [[], [], [], []]
            cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True]))) if len(target) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                used, local = np.unique(ids[a:b], return_inverse=True)
                for column, value in zip(out, (int(target[a]), packed(hashes[a:b]), packed_places(local), packed_ids(used))):
                    column.append(value)
            yield _table(out, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "hashes", "places", "ids"])

    return rows


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are not compared."""
    low, high = known, min(len(a), len(b))
    while high - low > 8:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    return low


def merged(lists: list[tuple[Iterator[bytes], list[int]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merge sorted runs (keys, prefix length with the key before): yields (run, place, prefix length with the last, key).

    Each head carries its common prefix with the last key that left. Of two heads
    the one with the longer prefix is smaller, without a look at the bytes; at
    equal length comparison starts behind it. Only heads are held.
    """
    width = 1
    while width < len(lists):
        width *= 2
    at = [0] * width
    head = [next(lists[r][0], None) if r < len(lists) else None for r in range(width)]

    def play(r: int, lr: int, s: int, ls: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix with the winner."""
        if head[r] is None or head[s] is None:
            return (s, ls, r, 0) if head[r] is None else (r, lr, s, 0)
        if lr != ls:
            return (r, lr, s, ls) if lr > ls else (s, ls, r, lr)
        a, b = head[r], head[s]
        l = common_prefix(a, b, lr)  # noqa: E741
        if (a[l : l + 1], r) < (b[l : l + 1], s):
            return r, lr, s, l
        return s, ls, r, l

    losers = [(0, 0)] * width

    def build(node: int) -> tuple[int, int]:
        if node >= width:
            return node - width, 0
        left, right = build(2 * node), build(2 * node + 1)
        r, lr, s, ls = play(*left, *right)
        losers[node] = (s, ls)
        return r, lr

    winner, prefix = build(1)
    while head[winner] is not None:
        yield winner, at[winner], prefix, head[winner]
        at[winner] += 1
        keys, known = lists[winner]
        head[winner] = next(keys, None)
        prefix = known[at[winner]] if head[winner] is not None else 0
        node = (winner + width) // 2
        while node:
            winner, prefix, s, ls = play(winner, prefix, *losers[node])
            losers[node] = (s, ls)
            node //= 2


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted keys: prefix length with the key before, length, and the bytes behind the prefix."""
    known = np.zeros(len(keys), np.uint16)
    for i in range(1, len(keys)):
        known[i] = common_prefix(keys[i - 1], keys[i], 0)
    return known, np.array([len(k) for k in keys], np.uint16), b"".join([k[p:] for k, p in zip(keys, known.tolist())])


def decoded(known: np.ndarray, lengths: np.ndarray, rest: bytes) -> Iterator[bytes]:
    """The keys of a front-coded run, one at a time."""
    at, before = 0, b""
    for p, n in zip(known.tolist(), lengths.tolist()):
        before = before[:p] + rest[at : at + n - p]
        at += n - p
        yield before


_RUN = ["part", "known", "lengths", "rest", "forward", "counts", "places", "docs"]


def _suffix_runs(length: int, buckets: int):
    """Sorted front-coded runs of the suffixes whose first half is repeated, by the hash of that half.

    Equal suffixes of a run are one key with several members, as in texts that
    repeat themselves.
    """

    def dealt(held: dict[tuple[int, int, bytes], list[tuple[int, int]]]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in _RUN]
        by_part: dict[int, list] = {}
        for (part, forward, key), members in held.items():
            by_part.setdefault(part, []).append((key, forward, members))
        for part, own in by_part.items():
            own.sort(key=lambda h: h[:2])
            known, lengths, rest = front_coded([h[0] for h in own])
            forward, counts = np.array([h[1] for h in own], "<u2"), np.array([len(h[2]) for h in own], "<u4")
            places, docs = np.array([m for h in own for m in h[2]], "<i8").T
            for column, value in zip(out, (part, packed(known), packed(lengths), rest, packed(forward), packed(counts), packed(places), packed(docs))):
                column.append(value)
        return _table(out, [pa.int32()] + [pa.binary()] * 7, _RUN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, wanted = None, {}
        held: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
        n = 0
        for batch in blocks(batches, "text", READ_BYTES):
            for b, hashes, places, ids, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hashes", "places", "ids", "doc", "text"))):
                if b != bucket:
                    bucket, wanted = b, {}
                if hashes is not None:
                    h, p = unpacked(hashes), unpacked_places(places)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1, [len(p)]))
                    for owner, a, z in zip(unpacked_ids(ids).tolist(), cuts[:-1], cuts[1:]):
                        wanted.setdefault(owner, []).append(h[a:z])
                    continue
                if doc not in wanted:
                    continue
                place, first, last, found = owners(text, length)
                on = np.isin(found, np.concatenate(wanted[doc]))
                parts = ((found >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                for s, p0, p1, part in zip(place[on].tolist(), first[on].tolist(), last[on].tolist(), parts[on].tolist()):
                    # forward to the last window's end, then backward to the first window's start
                    key = text[s : p1 + length] + text[p0:s][::-1]
                    members = held.setdefault((part, p1 + length - s, key), [])
                    n += MEMBER_COST if members else len(key) + KEY_COST
                    members.append((s, doc))
                    if n >= RUN_BYTES:
                        yield dealt(held)
                        held, n = {}, 0
        if held:
            yield dealt(held)

    return rows


def _prefix_groups(known: np.ndarray, least: int) -> np.ndarray:
    return np.cumsum(known < least)


def _repeated_starts(length: int, keys: list[bytes], known: np.ndarray, forward: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For sorted distinct suffixes: which windows (by bytes before the owner) occur twice or more."""
    n, half = len(keys), length // 2
    backward = [k[f:] for k, f in zip(keys, forward.tolist())]
    most = np.array([len(b) for b in backward])
    least = length - forward  # bytes that the last window has before the owner
    order = sorted(range(n), key=backward.__getitem__)
    back_known = np.zeros(n, np.int64)
    for i in range(1, n):
        back_known[i] = common_prefix(backward[order[i - 1]], backward[order[i]], 0)
    order = np.array(order)
    out = np.zeros((n, length - half + 1), bool)
    for before in range(length - half + 1):
        valid = np.flatnonzero((least <= before) & (before <= most))
        if not len(valid):
            continue
        ahead = _prefix_groups(known, length - before)[valid]
        behind = np.empty(n, np.int64)
        behind[order] = _prefix_groups(back_known, before)
        _, same = np.unique(ahead * (n + 1) + behind[valid], return_inverse=True)
        out[valid, before] = np.bincount(same, counts[valid])[same] > 1
    return out


class _Suffixes:
    """Distinct suffixes in order, with their members."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.known: list[int] = []
        self.forward: list[int] = []
        self.members: list[list[np.ndarray]] = []
        self.counts: list[int] = []

    def add(self, key: bytes, known: int, forward: int, members: np.ndarray) -> None:
        self.keys.append(key)
        self.known.append(known)
        self.forward.append(forward)
        self.members.append([members])
        self.counts.append(members.shape[1])

    def again(self, members: np.ndarray) -> None:
        self.members[-1].append(members)
        self.counts[-1] += members.shape[1]

    def extend(self, other: _Suffixes) -> None:
        for name in ("keys", "known", "forward", "members", "counts"):
            getattr(self, name).extend(getattr(other, name))


def _resolved(length: int, buckets: int):
    """Merge the runs of a part and tell the repeated windows, packed by document."""
    names, types = ["bucket", "starts", "ends", "docs"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    half = length // 2

    def spans(members: list[np.ndarray], low: int, high: int) -> np.ndarray:
        """Windows with low to high - 1 bytes before the owner: first and last start, document."""
        place, doc = np.concatenate(members, 1)
        return np.stack((place - high + 1, place - low, doc))

    def told(found: _Suffixes) -> Iterator[np.ndarray]:
        if found.keys:
            columns = np.array(found.known), np.array(found.forward), np.array(found.counts)
            for on, members in zip(_repeated_starts(length, found.keys, *columns), found.members):
                if on.any():
                    for low, high in runs(on).tolist():
                        yield spans(members, low, high)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, "part"):
            lists, extra = [], []
            for r in group:
                known = unpacked(r["known"], "<u2")
                lists.append((decoded(known, unpacked(r["lengths"], "<u2"), r["rest"]), known.tolist()))
                ends = np.cumsum(unpacked(r["counts"], "<u4"), dtype=np.int64)
                both = np.stack((unpacked(r["places"], "<i8"), unpacked(r["docs"], "<i8")))
                extra.append((unpacked(r["forward"], "<u2").tolist(), [0, *ends.tolist()], both))
            # one block has one half-length string; blocks of several suffixes are resolved many at a time
            several, block = _Suffixes(), _Suffixes()
            out: list[np.ndarray] = []

            def close() -> None:
                if len(block.keys) == 1:
                    if block.counts[0] > 1:
                        ahead = block.forward[0]
                        out.append(spans(block.members[0], length - ahead, len(block.keys[0]) - ahead + 1))
                else:
                    several.extend(block)

            for run, at, prefix, key in merged(lists):
                forward, ends, both = extra[run]
                members = both[:, ends[at] : ends[at + 1]]
                if block.keys and prefix == len(key) == len(block.keys[-1]) and forward[at] == block.forward[-1]:
                    block.again(members)
                    continue
                if block.keys and prefix < half:
                    close()
                    block = _Suffixes()
                    if len(several.keys) >= 20_000:
                        out.extend(told(several))
                        several = _Suffixes()
                block.add(key, prefix if block.keys else 0, forward[at], members)
            close()
            out.extend(told(several))
            if out:
                starts, ends, docs = np.concatenate(out, 1)
                target = docs % buckets
                order = np.lexsort((starts, docs, target))
                docs, starts, ends, target = docs[order], starts[order], ends[order], target[order]
                cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
                table = [(int(target[a]), packed(starts[a:b]), packed(ends[a:b]), packed(docs[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
                yield _table([list(c) for c in zip(*table)], types, names)

    return rows


def _cut(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, spans = None, {}
        for batch in blocks(batches, "text", READ_BYTES):
            keep, out = [], [[], [], [], []]
            for at, (b, starts, ends, docs, doc, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "starts", "ends", "docs", "doc", "text")))):
                if b != bucket:
                    bucket, spans = b, {}
                if starts is not None:
                    for owner, a, z in zip(unpacked(docs, "<i8").tolist(), unpacked(starts, "<i8").tolist(), unpacked(ends, "<i8").tolist()):
                        spans.setdefault(owner, []).append((a, z + length))
                    continue
                removed: list[list[int]] = []
                for a, z in sorted(spans.get(doc, ())):
                    if removed and a <= removed[-1][1]:
                        removed[-1][1] = max(z, removed[-1][1])
                    else:
                        removed.append([a, z])
                kept, last = [], 0
                for a, z in removed:
                    kept.append(text[last:a])
                    last = z
                kept.append(text[last:])
                keep.append(at)
                for column, value in zip(out, (len(text), sum(z - a for a, z in removed), removed, b"".join(kept))):
                    column.append(value)
            if keep:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(keep)), *(pa.array(c, t) for c, t in zip(out, kinds))],
                    ["row", "n_bytes", "n_removed", "removed", "kept_bytes"],
                )

    return rows


def remove_repeated_bytes(docs: DataFrame, length: int = 400, row: Column | None = None) -> DataFrame:
    """Rows (row, n_bytes, n_removed, removed, kept_bytes), one per document.

    A byte of a text's UTF-8 form goes where a string of ``length`` bytes over it
    also starts at another place of the corpus, in the same row or another,
    judged on the input. ``removed`` lists the maximal runs [start, end).
    Null texts are empty. Ids are not read; rows that repeat are copies of each
    other. ``row`` is what to carry, by default a struct of all columns.
    """
    if length < 16 or length > 30_000:
        raise ValueError("length must lie between 16 and 30,000")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // PART_BYTES) + 1
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if row is None else row
    # documents by number, from their key: equal rows have equal spans
    number = F.conv(F.substring(F.hex("row_key"), 2, 15), 16, 10).cast("bigint")
    texts = docs.select(carried.alias("row"), row_key().alias("row_key"), utf8().alias("text")).select("row", number.alias("doc"), "text")
    # numbers are random, so their rest is an even deal
    placed = texts.withColumn("bucket", F.pmod("doc", F.lit(buckets)).cast("int"))
    # a task for each bucket: by hash some tasks would hold several
    packs = texts.select("doc", "text").mapInArrow(_pack(length, buckets), "bucket int, hashes binary, places binary, ids binary")
    wanted = packs.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(buckets), "bucket int, hashes binary, places binary, ids binary")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = wanted.select("bucket", "hashes", "places", "ids", nothing("bigint", "doc"), nothing("binary", "text")).unionByName(
        placed.where(F.length("text") >= length).select("bucket", *[nothing("binary", c) for c in ("hashes", "places", "ids")], "doc", "text")
    )
    suffixes = both.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", F.col("hashes").isNull()).mapInArrow(
        _suffix_runs(length, buckets), "part int, known binary, lengths binary, rest binary, forward binary, counts binary, places binary, docs binary"
    )
    spans = suffixes.repartitionById(buckets, "part").sortWithinPartitions("part").mapInArrow(_resolved(length, buckets), "bucket int, starts binary, ends binary, docs binary")
    kind = texts.schema["row"].dataType
    last = spans.select("bucket", "starts", "ends", "docs", nothing("bigint", "doc"), nothing("binary", "text"), nothing(kind, "row")).unionByName(
        placed.select("bucket", *[nothing("binary", c) for c in ("starts", "ends", "docs")], "doc", "text", "row")
    )
    return last.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", F.col("starts").isNull()).mapInArrow(
        _cut(length), f"row {kind.simpleString()}, n_bytes bigint, n_removed bigint, removed array<array<bigint>>, kept_bytes binary"
    )
