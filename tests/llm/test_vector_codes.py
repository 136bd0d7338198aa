import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from graphloom.llm import queries, vector_codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(data, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(part, book):
        return min(range(len(book)), key=lambda e: (far(part, book[e]), e))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(cut(v, p), books[p])].append(cut(v, p))
            for e, own in members.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code))
        by_label[label] += error
        out.append((i, "".join(f"{c:02x}" for c in code), error, label))
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=repr)


def vectors(seed, n=500, dim=64):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    data = []
    for i in range(n):
        c = rng.choice(centres)
        data.append((rng.randrange(10 * n), [x + rng.gauss(0, 0.1) for x in c], rng.choice((0, 0, 0, 1, 2, None))))
    data += [(data[0][0], data[1][1], 1), data[2], data[2], (None, centres[0], None), (10 * n, [0.0] * dim, 5), (10 * n + 1, [], 1), (10 * n + 2, [1.5, -2.25], 1)]
    data += [(10 * n + 3, None, 1), (-1, [None] + [0.5] * (dim - 1), 1), (-2, [float("nan")] * dim, 1), (-3, [float("inf")] + [0.5] * (dim - 1), 1)]
    rng.shuffle(data)
    return data


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [8192, 37])
def test_query_equals_plain_lloyd(spark, tmp_path, monkeypatch, block):
    data = vectors(1)
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block))
    try:
        got = queries.op11_vector_codes(spark, str(tmp_path))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert found(got) == brute(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trees_assign_as_all_distances_do():
    rng = np.random.default_rng(3)
    for n, dim, entries, spread in ((1, 3, 1, 5), (40, 2, 7, 3), (1000, 4, 16, 200), (3000, 8, 40, 20), (9000, 3, 5, 100_000)):
        points = rng.integers(-spread, spread, (n, dim))
        if spread == 100_000:  # clusters far apart: whole nodes
            points = points // 60_000 * 60_000 + rng.integers(0, 50, (n, dim))
        book = np.concatenate((points[rng.integers(0, n, entries)], points[:1], points[:1]))
        tree = vector_codes.PartTree.unpacked(vector_codes.PartTree(points).packed(), dim)
        whole, places, chosen = vector_codes.assign(tree, book)
        got = np.full(n, -1)
        for level, node, entry in whole:
            a, z = tree.bounds[level][node : node + 2]
            assert (got[a:z] == -1).all()
            assert (tree.sums[level][node] == tree.points[a:z].sum(0)).all()
            got[a:z] = entry
        assert (got[places] == -1).all()
        got[places] = chosen
        assert (got == ((tree.points[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
        assert (tree.points == points[tree.order]).all()
        if spread == 100_000:
            assert sum(np.diff(tree.bounds[lv][n : n + 2])[0] for lv, n, _ in whole) > 0.5 * n


def test_huge_components_stand_for_the_bound(spark):
    data = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]
    codes, books = vector_codes.compressed(spark.createDataFrame(data, SCHEMA), entries=2)
    assert sorted((r.vec_id, r.code) for r in codes.collect()) == [(1, "00" * 8), (2, "01" * 8), (3, "00" * 8)]
    assert books[0].tolist() == [[vector_codes.MOST // 2], [-vector_codes.MOST]]


def test_clashing_columns(spark):
    data = vectors(2, 60, 16)
    df = spark.createDataFrame(data, SCHEMA)
    for name in ("vector", "trees", "code", "error", "label_error"):
        df = df.selectExpr("*", f"'x' AS {name}")
    codes, books = vector_codes.compressed(df)
    rows = vector_codes.with_label_error(codes)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, vector_codes.books_digest(books)) for r in rows.collect()), key=repr)
    assert got == brute(data)


def test_no_rows(spark):
    codes, books = vector_codes.compressed(spark.createDataFrame([], SCHEMA))
    assert codes.count() == 0 and books.size == 0
    assert vector_codes.with_label_error(codes).count() == 0
