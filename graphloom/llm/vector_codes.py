"""Product codes of vectors by a dual-tree Lloyd iteration on integers.

Vectors are cut into parts, and each part position has a codebook. Vectors are gathered
into blocks; of every block and part position a balanced k-d tree is built once and written
to the shared folder with the bounds, the sums and the counts of its nodes. A round sends
the codebooks, a few kilobytes, to the blocks and descends the tree of the parts and a tree
of the entries together: an entry node goes when its least distance to a node of parts is
above the largest distance of another one. A node left with one entry is assigned whole, by
its cached sums; the leaves that are left compare integers. What leaves a task is one sum
for each part position and entry, and Spark adds those up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.llm.common import written

SCALE = 4096
# components beyond this magnitude count as this, so that squares and sums stay in 64 bits
MOST = 1 << 26
# vectors of a block, and parts of a leaf
BLOCK = 8_192
LEAF = 16
# pairs of a part and an entry that are compared at a time
PAIRS = 1 << 18
_SUMS = "part int, entry int, n bigint, sums array<bigint>"
_FAR = np.iinfo(np.int64).max


def _squares(gaps: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", gaps, gaps)


class PartTree:
    """A balanced k-d tree over the parts of one position, level by level.

    ``order`` lists the parts as the leaves hold them; level l has 2**l nodes with
    bounds, sums and counts. Nodes split at the middle of their widest component.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.order = np.arange(n)
        bounds = np.array([0, n])
        while True:
            ordered = points[self.order]
            low, high = np.minimum.reduceat(ordered, bounds[:-1]), np.maximum.reduceat(ordered, bounds[:-1])
            if np.diff(bounds).max() <= LEAF:
                break
            axis = (high - low).argmax(1)
            node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            self.order = self.order[np.lexsort((ordered[np.arange(n), axis[node]], node))]
            bounds = np.sort(np.concatenate((bounds, (bounds[:-1] + bounds[1:]) // 2)))
        self.points = points[self.order]
        self.bounds = [bounds]
        self.low, self.high = [low], [high]
        self.sums = [np.add.reduceat(self.points, bounds[:-1])]
        while len(self.bounds[0]) > 2:
            self.bounds.insert(0, self.bounds[0][::2])
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))
            self.sums.insert(0, self.sums[0][::2] + self.sums[0][1::2])

    def packed(self) -> list[bytes]:
        as_bytes = lambda arrays, kind: b"".join(np.ascontiguousarray(a, kind).tobytes() for a in arrays)
        return [
            as_bytes([self.order], "<i4"), as_bytes([self.points], "<i4"), as_bytes([self.bounds[-1]], "<i4"),
            as_bytes(self.low, "<i4"), as_bytes(self.high, "<i4"), as_bytes(self.sums, "<i8"),
        ]

    @classmethod
    def unpacked(cls, data: list[bytes], width: int) -> PartTree:
        tree = cls.__new__(cls)
        order, points, bounds, low, high, sums = (np.frombuffer(x, kind) for x, kind in zip(data, ("<i4", "<i4", "<i4", "<i4", "<i4", "<i8")))
        tree.order, tree.points = order, points.reshape(-1, width).astype(np.int64)
        depth = (len(bounds) - 1).bit_length() - 1
        cuts = np.cumsum([1 << level for level in range(depth)])
        tree.bounds = [bounds[:: 1 << (depth - level)].astype(np.int64) for level in range(depth + 1)]
        tree.low, tree.high, tree.sums = (np.split(x.reshape(-1, width).astype(np.int64), cuts) for x in (low, high, sums))
        return tree


class EntryTree:
    """The different entries of a codebook as a binary tree of boxes, level by level.

    Of equal entries only the first can be nearest, so the others are left out.
    Nodes hold runs of entries, sorted by the middle of the widest component.
    """

    def __init__(self, book: np.ndarray):
        _, first = np.unique(book, axis=0, return_index=True)
        runs = [np.sort(first)]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.children: list[np.ndarray] = []
        while True:
            self.levels.append((np.array([book[r].min(0) for r in runs]), np.array([book[r].max(0) for r in runs])))
            if all(len(r) == 1 for r in runs):
                break
            below, children = [], []
            for r in runs:
                if len(r) > 1:
                    axis = int((book[r].max(0) - book[r].min(0)).argmax())
                    r = r[np.argsort(book[r, axis], kind="stable")]
                    halves = [r[: len(r) // 2], r[len(r) // 2 :]]
                else:
                    halves = [r]
                children.append((len(below), len(below) + len(halves) - 1))
                below += halves
            self.children.append(np.array(children))
            runs = below
        self.entries = np.array([r[0] for r in runs])


def _pruned(nodes: np.ndarray, entries: np.ndarray, low, high, box_low, box_high) -> np.ndarray:
    """Of pairs (node of parts, node of entries), sorted by the first, those that can hold a nearest entry."""
    lo, hi, elo, ehi = low[nodes], high[nodes], box_low[entries], box_high[entries]
    least = _squares(np.maximum(np.maximum(elo - hi, lo - ehi), 0))
    most = _squares(np.maximum(ehi - lo, hi - elo))
    starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
    bound = np.minimum.reduceat(most, starts)
    return least <= np.repeat(bound, np.diff(np.append(starts, len(nodes))))


def assign(tree: PartTree, book: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Nodes assigned whole (level, node, entry), and the parts compared one by one with their entries.

    Parts are places in the tree's order. Equal distances go to the lower entry.
    """
    entry_tree = EntryTree(book)
    whole: list[tuple[int, int, int]] = []
    nodes, entries = np.zeros(1, np.int64), np.zeros(1, np.int64)
    entry_level = level = 0
    last, deepest = len(tree.bounds) - 1, len(entry_tree.levels) - 1
    while True:
        keep = _pruned(nodes, entries, tree.low[level], tree.high[level], *entry_tree.levels[entry_level])
        nodes, entries = nodes[keep], entries[keep]
        if entry_level == deepest:
            starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
            alone = np.diff(np.append(starts, len(nodes))) == 1
            found = starts[alone]
            whole += zip([level] * len(found), nodes[found].tolist(), entry_tree.entries[entries[found]].tolist())
            rest = np.repeat(~alone, np.diff(np.append(starts, len(nodes))))
            nodes, entries = nodes[rest], entries[rest]
            if level == last or not len(nodes):
                break
        # the finer entries first, then the finer parts
        if entry_level < deepest:
            kids = entry_tree.children[entry_level][entries]
            double = kids[:, 1] > kids[:, 0]
            nodes = np.repeat(nodes, 1 + double)
            at = np.cumsum(1 + double)
            entries = np.empty(len(nodes), np.int64)
            entries[at - 1] = kids[:, 1]
            entries[(at - 2)[double]] = kids[double, 0]
            entry_level += 1
        if level < last:
            starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
            length = np.diff(np.append(starts, len(nodes)))
            # every run of pairs once for each child
            runs = np.repeat(np.arange(len(starts)), 2)
            first = np.repeat(starts[runs], length[runs])
            step = np.arange(len(first)) - np.repeat(np.cumsum(length[runs]) - length[runs], length[runs])
            child = np.repeat(np.tile([0, 1], len(starts)), length[runs])
            nodes, entries = 2 * nodes[first] + child, entries[first + step]
            level += 1
    places, chosen = _compared(tree, book, nodes, entry_tree.entries[entries])
    return whole, places, chosen


def _compared(tree: PartTree, book: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part in uncertain leaves, in integers."""
    leaves, own = np.unique(nodes, return_inverse=True)
    allowed = np.zeros((len(leaves), len(book)), bool)
    allowed[own, entries] = True
    bounds = tree.bounds[-1]
    size = bounds[leaves + 1] - bounds[leaves]
    places = np.repeat(bounds[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())
    leaf = np.repeat(np.arange(len(leaves)), size)
    chosen = np.empty(len(places), np.int64)
    step = max(1, PAIRS // max(1, len(book)))
    for a in range(0, len(places), step):
        distance = _squares(tree.points[places[a : a + step], None, :] - book[None, :, :])
        chosen[a : a + step] = np.where(allowed[leaf[a : a + step]], distance, _FAR).argmin(1)
    return places, chosen


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as integers, short ones filled with zeros."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = np.clip(np.floor(SCALE * column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]), -MOST, MOST).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _blocks(parts: int, width: int):
    """Blocks of vectors with the trees of all part positions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                points = _integers(block.column("vector"), parts * width)
                trees = [x for p in range(parts) for x in PartTree(points[:, p * width : (p + 1) * width]).packed()]
                listed = [pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*listed, pa.array([trees], pa.list_(pa.binary()))], ["vec_ids", "labels", "trees"])

    return rows


def _trees(data: list[bytes], books: np.ndarray) -> Iterator[tuple[int, PartTree]]:
    for part in range(len(books)):
        yield part, PartTree.unpacked(data[6 * part : 6 * part + 6], books.shape[2])


def _round(books: np.ndarray):
    """Sums and counts by part position and entry, one row each for a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for data in batch.column("trees"):
                for part, tree in _trees(data.as_py(), books):
                    whole, places, chosen = assign(tree, books[part])
                    for level, node, entry in whole:
                        sums[part, entry] += tree.sums[level][node]
                        counts[part, entry] += tree.bounds[level][node + 1] - tree.bounds[level][node]
                    np.add.at(sums[part], chosen, tree.points[places])
                    counts[part] += np.bincount(chosen, minlength=books.shape[1])
        part, entry = counts.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    return rows


def _coded(books: np.ndarray):
    """A row for each vector: its entries in part order as hex digits, and its squared distances summed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, data in zip(*(batch.column(c) for c in ("vec_ids", "labels", "trees"))):
                n = len(ids)
                codes, error = np.empty((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for part, tree in _trees(data.as_py(), books):
                    whole, places, chosen = assign(tree, books[part])
                    entry = np.empty(n, np.int64)
                    for level, node, one in whole:
                        entry[tree.bounds[level][node] : tree.bounds[level][node + 1]] = one
                    entry[places] = chosen
                    codes[tree.order, part] = entry
                    error[tree.order] += _squares(tree.points - books[part][entry])
                digits = codes.tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array([digits[i * step : (i + 1) * step] for i in range(n)]), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

    return rows


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error), one per vector kept, and the codebooks (part, entry, component).

    ``vectors`` holds vec_id, embedding and label; other columns are ignored. Rows
    whose vector is null or holds a null or non-finite component are dropped. A
    component x becomes floor(4096 * x), within 2**26 on both sides. Vectors are as
    long as the longest, rounded up to a multiple of ``parts``; shorter ones are
    filled with zeros. Codebooks start as the parts of the smallest ids (nulls
    last, equal ids by vector), at most 256. Ties go to the lower entry, unused
    entries stay. Repeated rows are coded as often as they stand. No vectors: no
    rows, and codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    table = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    good = table.where(F.col("vector").isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False)))
    kinds = {c: vectors.schema[c].dataType for c in ("vec_id", "label")}
    longest = good.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    block_kind = T.StructType([T.StructField("vec_ids", T.ArrayType(kinds["vec_id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("trees", T.ArrayType(T.BinaryType()))])
    blocks = written(good.mapInArrow(_blocks(parts, width), block_kind), "blocks")
    start = good.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    books = _integers(pa.array([r.vector for r in start], pa.list_(pa.float64())), parts * width).reshape(-1, parts, width).swapaxes(0, 1)
    code_kind = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not len(start):
        return spark.createDataFrame([], code_kind), books
    for _ in range(rounds):
        sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
        moved = blocks.select("trees").mapInArrow(_round(books), _SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), sums).collect()
        books = books.copy()
        for r in moved:  # a row for each part position and entry
            books[r.part, r.entry] = [s // r.n for s in r.sums]
    return blocks.mapInArrow(_coded(books), code_kind), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of all rows with the same label summed; null labels are one group."""
    coded = written(codes, "codes")
    # written, so that both sides of the join are plain exchanges that AQE can split at a hot label
    totals = written(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    return coded.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label"))).select("c.*", "label_error")
