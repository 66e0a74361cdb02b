"""Neighbours of vectors, against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm.neighbours import code_classes, graph_search, nearest_by_graph, nearest_exact, neighbour_graph, similar_pairs, vector_codes
from quillspark.llm.queries import recall_at


def neighbours_of(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)


def recall(graph, top, k):
    lists = {r.id: r.near for r in graph.collect()}
    assert all(len(v) == len(set(v)) for v in lists.values())
    return np.mean([len(set(lists[i][:k]) & set(top[i, :k].tolist())) / k for i in lists])


def test_similar_pairs_and_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:150] + 0.05 * rng.normal(size=(150, 16)), base[:60] + 0.05 * rng.normal(size=(60, 16))])
    rows = [(i, v.astype(float).tolist(), "a") for i, v in enumerate(x)]
    rows += [(0, rows[0][1], "a"), (900, None, "a"), (901, [1.0] * 4, "a"), (902, [0.0] * 16, "a"), (903, [float("nan")] * 16, "a"), (904, [float("inf")] + [1.0] * 15, "a")]
    rows += [(905, rows[0][1], "b"), (906, rows[0][1], None), (907, rows[0][1], None), (None, rows[0][1], "a"), (908, [None] + [1.0] * 15, "a")]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, model string").withColumns({"id": F.lit("clash"), "near": F.lit(1)})
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(unit @ unit.T, 1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= 0.9), strict=True)} | {(906, 907)}
    got = [(r.id_a, r.id_b) for r in similar_pairs(df, dims=16).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want)
    assert similar_pairs(df.limit(0), dims=16).count() == 0
    apart = similar_pairs(df, dims=16, copies_apart=True)
    assert {(r.id_a, r.id_b) for r in apart.collect()} == set(got)  # groups of two copies look the same either way


def test_more_partners_than_expected(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(4, 16)), 30, axis=0) + 0.02 * rng.normal(size=(120, 16))
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "chunk_id bigint, embedding array<float>, model string")
    got = {(r.id_a, r.id_b) for r in similar_pairs(df, partners=9, dims=16).collect()}
    assert got == {(g * 30 + a, g * 30 + b) for g in range(4) for a in range(30) for b in range(a + 1, 30)}


def test_a_hot_group_of_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "chunk_id bigint, embedding array<float>, model string")
    got = sorted((r.id_a, r.id_b) for r in similar_pairs(df, dims=16, copies_apart=True).collect())
    assert got == [(0, i) for i in range(3, 600, 3)]


def test_rounds_find_neighbours_from_arbitrary_links(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, embedding array<float>")
    nodes, _ = code_classes(vector_codes(df, "chunk_id", "embedding", None, 8))
    trace = []
    neighbour_graph(nodes, 16, 8, trees=0, sample=12, rounds=6, trace=trace)
    top = neighbours_of(x)
    by_round = [recall(g.filter("size(near) >= 10"), top, 10) if i else 0.0 for i, g in enumerate(trace)]
    assert by_round[1] < 0.3 and by_round[-1] >= 0.95


def test_blocks_bridge_and_rounds_add(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, embedding array<float>")
    nodes, _ = code_classes(vector_codes(df, "chunk_id", "embedding", None, 24))
    trace = []
    neighbour_graph(nodes, 20, 24, trees=2, block=40, sample=16, rounds=4, trace=trace)
    top = neighbours_of(x)
    first, last = (recall(trace[i].filter("size(near) >= 10"), top, 10) for i in (0, -1))
    assert last > first + 0.2 and last >= 0.8


def test_graph_search_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, embedding array<float>")
    nodes, _ = code_classes(vector_codes(df, "chunk_id", "embedding", None, 16))
    graph = neighbour_graph(nodes, 12, 16, trees=3, block=100)
    outside = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(20)], "chunk_id bigint, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for asked in (df.filter("chunk_id % 100 = 0"), outside):
        queries = vector_codes(asked, "chunk_id", "embedding", None, 16).withColumnRenamed("id", "qid")
        got = {}
        for r in graph_search(graph, nodes, queries, 10, 16, beam=64).collect():
            got.setdefault(r.qid, set()).add(r.node)
        vector = {r.chunk_id: np.array(r.embedding) for r in asked.collect()}
        assert np.mean([len(got[i] & set(np.argsort(-(unit @ v))[:10].tolist())) / 10 for i, v in vector.items()]) >= 0.9
    assert graph_search(graph, nodes, queries.limit(0), 5, 16).count() == 0


def test_searches(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[5001] = x[5000]  # equal vectors of two ids
    rows = [(i, v.tolist(), "a" if i % 6 else None) for i, v in enumerate(x)]
    rows += [rows[100], (6000, None, "a"), (6100, [0.0] * 64, "a"), (6200, [float("nan")] * 64, "a"), (6300, [1.0] * 32, "a"), (6400, [1.0] * 64, "alone")]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, model string")
    exact = nearest_exact(df, "id % 100 = 0", 10).cache()
    got = {}
    for r in exact.orderBy("place").collect():
        got.setdefault((r.id, r.model), []).append((r.near, r.place))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {}
    for i in range(0, 6000, 100):
        s = unit @ unit[i]
        s[(np.arange(6000) % 6 == 0) != (i % 6 == 0)] = -3
        s[i] = -3
        want[i, "a" if i % 6 else None] = [(n, p + 1) for p, n in enumerate(np.argsort(-s, kind="stable")[:10].tolist())]
    assert got == want
    near = nearest_by_graph(df, "id % 100 = 0", 10).cache()
    assert near.groupBy("id", "model").count().filter("count > 10").isEmpty() and near.filter("id = near").isEmpty()
    assert recall_at(near, exact).agg(F.min("recall")).first()[0] >= 0.9
    assert near.filter("id = 5000 and near = 5001 and place = 1").count() == 1
    assert nearest_by_graph(df.limit(0), "id >= 0", 10).count() == 0
