"""Near-duplicate vectors by an inverted multi-index.

Codebooks for the two halves of a vector, fitted apart on a bounded sample, form a
product grid; every vector lies in the cell of its two nearest centroids. A vector
visits cells in the order of summed half distances (the multi-sequence order). How
many cells it visits is set on the sample: partners at exactly the threshold must be
met with the target recall, the hardest case there is. What is met is verified by
cosine in double precision.

Equal vectors are one class with a size. Large cells are dealt out in chunks, and a
cell's links leave it as one count and one local component per vector, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import written
from graphloom.llm.links import components

# vectors that the codebooks are fitted on
SAMPLE = 20_000
CHUNK = 4_096
_CELLS = "class bigint, label bigint, size bigint, vector array<float>, cell int, visits array<int>"
_FOUND = "class bigint, n_links bigint, root bigint"


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of points to centroids."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1), 0)


def fit_codebook(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means; a centroid without points takes the point that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        distance = _nearest(points, centroids)
        own = distance.argmin(1)
        for c in range(len(centroids)):
            members = points[own == c]
            centroids[c] = members.mean(0) if len(members) else points[distance.min(1).argmax()]
    return centroids


def visiting_order(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The n cells of the grid with the smallest summed distances, nearest first.

    Of the sorted halves only ranks (i, j) with (i+1)(j+1) <= n can be among the
    n nearest: all pairs of smaller ranks come before.
    """
    a, b = np.argsort(first, 1), np.argsort(second, 1)
    k1, k2 = first.shape[1], second.shape[1]
    steps = np.array([(i, j) for i in range(k1) for j in range(min(k2, n // (i + 1)))])
    n = min(n, len(steps))
    rows = np.arange(len(first))[:, None]
    ia, jb = a[:, steps[:, 0]], b[:, steps[:, 1]]
    order = np.argsort(first[rows, ia] + second[rows, jb], 1, kind="stable")[:, :n]
    return ia[rows, order] * k2 + jb[rows, order]


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    # scaled first, so that squares neither vanish nor overflow
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


class Grid:
    """Codebooks of both halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float, seed: int):
        unit = _unit(sample)
        self.half = max(1, unit.shape[1] // 2)
        self.books = fit_codebook(unit[:, : self.half], k, seed), fit_codebook(unit[:, self.half :], k, seed + 1)
        # partners at the threshold, in random directions
        rng = np.random.default_rng(seed + 2)
        probes = unit[rng.choice(len(unit), min(2_000, len(unit)), replace=False)]
        aside = rng.normal(size=probes.shape)
        aside -= (aside * probes).sum(1, keepdims=True) * probes
        norm = np.sqrt((aside**2).sum(1, keepdims=True))
        partners = threshold * probes + np.sqrt(max(0.0, 1 - threshold**2)) * aside / np.where(norm > 0, norm, 1)
        every = len(self.books[0]) * len(self.books[1])
        order = visiting_order(*self.distances(probes), every)
        met = (order == self.cells(partners)[:, None]).argmax(1) + 1
        self.visits = int(np.sort(met)[min(len(met) - 1, int(np.ceil(recall * len(met))))])

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(unit[:, : self.half], self.books[0]), _nearest(unit[:, self.half :], self.books[1])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        first, second = self.distances(unit)
        return first.argmin(1) * len(self.books[1]) + second.argmin(1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _placed(grid: Grid):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("vector")))
            visits = visiting_order(*grid.distances(unit), grid.visits).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("class", "label", "size", "vector")), pa.array(visits[:, 0]), pa.array(list(visits), pa.list_(pa.int32()))],
                ["class", "label", "size", "vector", "cell", "visits"],
            )

    return rows


def _verified(threshold: float):
    """Links inside each (label, cell, chunk): residents come first, then visitors batch by batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = None
        held: dict = {}

        def emit() -> Iterator[pa.RecordBatch]:
            if held and held["linked"].any():
                on = held["linked"]
                yield result(held["ids"][on], held["links"][on], held["root"][on])

        def result(ids, links, root) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], ["class", "n_links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("label", "at", "chunk")], 1)
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1) | (visitor[1:] != visitor[:-1]), [True])))
            for a, z in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, z - a)
                if tuple(place[a]) != where:
                    yield from emit()
                    where, held = tuple(place[a]), {}
                ids, size = part.column("class").to_numpy(), part.column("size").to_numpy()
                cell, visits = part.column("cell").to_numpy(), _matrix(part.column("visits"))
                unit = _unit(_matrix(part.column("vector")))
                if not visitor[a]:
                    new = {"ids": ids, "size": size, "unit": unit, "visits": visits, "links": np.zeros(len(ids), np.int64), "root": ids.copy(), "linked": np.zeros(len(ids), bool)}
                    held = {k: np.concatenate((held[k], v)) for k, v in new.items()} if held else new
                    continue
                if not held:
                    continue
                found = (unit @ held["unit"].T >= threshold) & (ids[:, None] != held["ids"])
                if not found.any():
                    continue
                # the resident counts this link itself where it visits the visitor's cell
                alone = found & ~(held["visits"][None, :, :] == cell[:, None, None]).any(2)
                held["links"] += size @ alone
                held["linked"] |= found.any(0)
                root = ids.copy()
                far = np.iinfo(np.int64).max
                while True:
                    mine = np.minimum(root, np.where(found, held["root"], far).min(1))
                    theirs = np.minimum(held["root"], np.where(found, mine[:, None], far).min(0))
                    if (mine == root).all() and (theirs == held["root"]).all():
                        break
                    root, held["root"] = mine, theirs
                on = found.any(1)
                yield result(ids[on], (found @ held["size"])[on], root[on])
        yield from emit()

    return rows


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.995, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine is at least
    ``threshold``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` tells whether that is
    the row's own. Rows whose label or vector is null, whose vector is empty, of
    another length than most, zero, or holds a null or non-finite component link
    with nothing and are their own component, as are rows without an id, with a
    null component.
    """
    spark = vectors.sparkSession
    table = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<float>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.coalesce(F.forall("vector", finite), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    table = table.withColumn("usable", usable).withColumn("vector_key", F.md5(F.col("vector").cast("string")))
    good = table.where("usable")
    widths = good.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0].width if widths else 0
    table = table.withColumn("usable", F.col("usable") & (F.size("vector") == width))
    good = table.where("usable")
    classes = written(
        good.groupBy("label", "vector_key").agg(F.min("vec_id").alias("class"), F.count("*").alias("size"), F.first("vector").alias("vector")), "classes"
    )
    n = classes.count()
    none = spark.createDataFrame([], _FOUND)
    if n < 2:
        found = none
    else:
        # a bounded sample: its rows only fit the codebooks and the number of visits
        taken = classes.select("vector").orderBy(F.xxhash64("class", F.lit(seed))).limit(sample).collect()
        k = int(np.clip(np.sqrt(n / 256), 4, 64))
        grid = Grid(np.array([r.vector for r in taken], np.float64), k, threshold, recall, seed)
        cells = written(classes.select("class", "label", "size", "vector").mapInArrow(_placed(grid), _CELLS), "cells")
        chunks = cells.groupBy("label", "cell").agg(F.expr(f"cast((count(*) - 1) div {CHUNK} + 1 as int)").alias("chunks"))
        chunks = written(chunks.withColumnRenamed("cell", "at"), "chunks")
        residents = cells.withColumn("at", F.col("cell")).join(chunks, ["label", "at"])
        residents = residents.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")).withColumn("visitor", F.lit(False))
        visitors = cells.select("*", F.explode("visits").alias("at")).join(chunks, ["label", "at"])
        visitors = visitors.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).withColumn("visitor", F.lit(True))
        columns = ["class", "label", "size", "vector", "cell", "visits", "at", "chunk", "visitor"]
        both = residents.select(columns).unionByName(visitors.select(columns))
        placed = both.repartition("label", "at", "chunk").sortWithinPartitions("label", "at", "chunk", "visitor")
        found = written(placed.mapInArrow(_verified(threshold), _FOUND), "links")
    groups = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class").agg(F.sum("n_links").alias("found"))
    named = (
        classes.select("label", "vector_key", "class", "size")
        .join(counts, "class", "left")
        .join(groups.withColumnRenamed("node", "class"), "class", "left")
        .select("label", "vector_key", (F.coalesce("found", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    )
    linked = good.select("vec_id", "label", "vector_key").join(named, ["label", "vector_key"]).select("vec_id", "n_links", "component_id")
    alone = table.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
