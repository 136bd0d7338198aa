import numpy as np
from pyspark.sql import types as T

from graphloom.llm import embedding_dedup, queries
from test_simhash import group

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def rows(n=500, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=dims).astype(np.float32)
        if i % 3 == 1 and i > 5:
            v = (np.array(out[rng.integers(i)][1]) + rng.normal(size=dims) * 0.2).astype(np.float32)
        if i % 10 == 2 and i > 5:
            v = np.array(out[2][1], np.float32)
        out.append((i, v.tolist(), int(rng.integers(3))))
    out += [(n, None, 1), (n + 1, [0.0] * dims, 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [None] * dims, 1), (n + 4, out[2][1], None), (n + 5, [], 1)]
    return out + [(None, out[2][1], 1), (n + 6, [float("inf")] * dims, 0), (n + 7, [1.0], 0), out[8]]


def brute(data, threshold=0.93):
    usable = [i for i, (d, v, label) in enumerate(data) if d is not None and v and len(v) == 24 and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(data[i][1]) / np.linalg.norm(np.array(data[i][1], np.float64)) for i in usable}
    linked = lambda a, b: data[a][2] == data[b][2] and unit[a] @ unit[b] >= threshold
    links = {i: sum(linked(i, j) for j in usable if j != i) for i in usable}
    roots = group(usable, linked)
    least = {}
    for i in usable:
        least[roots[i]] = min(data[i][0], least.get(roots[i], data[i][0]))
    return [(d, links.get(i, 0), least[roots[i]] if i in roots else d) for i, (d, _, _) in enumerate(data)]


def test_links_against_brute_force(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op4_vector_dedup(spark, str(tmp_path)).collect()
    want = brute(data)
    assert sum(w[1] for w in want) > 200
    assert sum(r.n_links for r in got) >= 0.97 * sum(w[1] for w in want)
    best = {}
    for d, n, c in want:
        best[d] = (n, c)
    assert len(got) == len(data) and all(r.n_links <= best[r.vec_id][0] and r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert sum(r.component_id == best[r.vec_id][1] for r in got) >= 0.97 * len(got)


def test_whole_grid_is_exact(spark):
    data = rows(200)
    got = embedding_dedup.near_vectors(spark.createDataFrame(data, SCHEMA), recall=1.0)
    whole = embedding_dedup.Grid(np.array([r[1] for r in data[:200]]), 4, 0.93, 1.0, 1)
    assert whole.visits <= 16
    assert abs(sum(r.n_links for r in got.collect()) - sum(w[1] for w in brute(data))) <= 2


def test_visiting_order_is_the_nearest_first():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 7)), rng.random((20, 5))
    every = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    for n in (1, 4, 13, 35):
        order = embedding_dedup.visiting_order(a, b, n)
        assert np.allclose(np.take_along_axis(every, order, 1), np.sort(every, 1)[:, :n])


def test_no_rows(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
