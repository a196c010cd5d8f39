"""Exact search against all products."""

import random

import numpy as np
import pandas as pd
import pytest

from specloom.llm import topk


def brute(vectors, queries, k, own=True):
    out = []
    for i, q in sorted(queries):
        scores = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for j, v in vectors if len(v) == len(q) and not (own and i == j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("spread", [3, 300, 2**28])
def test_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATES_IN_BLOCK", 40)
    monkeypatch.setattr(topk, "SAMPLE_LEAST", 30)
    rng = random.Random(spread)
    vectors = [(i, [rng.randint(-spread, spread) for _ in range(37)]) for i in range(200)]
    vectors += [(1000 + i, v) for i, v in vectors[:20]]  # ties
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id bigint, vector array<bigint>, score string, rank int")
    asked = [v for v in vectors if v[0] % 10 == 0]
    got = topk.top_k(frame, frame.filter("vec_id % 10 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute(vectors, asked, 5)
    got = topk.top_k(frame, frame.filter("vec_id = 30"), 3, own=False)
    assert sorted(map(tuple, got.collect())) == brute(vectors, [v for v in asked if v[0] == 30], 3, False)


def test_odd_rows(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, [3, None]), (2, None), (None, [1, 1]), (3, []), (4, [1, 0]), (5, [5]), (50, [7]), (6, [2, 2])]
    frame = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = topk.top_k(frame, frame.filter("vec_id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 6, 6), (0, 2, 4, 1), (50, 1, 5, 35)]
    empty = frame.filter("false")
    assert topk.top_k(empty, empty, 5).collect() == [] == topk.top_k(frame, empty, 5).collect() == topk.top_k(empty, frame, 5).collect()


def test_usable(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("-inf")]), (6, [])]
    frame = spark.createDataFrame(rows, "i int, v array<float>")
    assert [r["i"] for r in frame.filter(topk.usable(frame["v"])).orderBy("i").collect()] == [1, 6]


def test_bounds_drop_most_candidates_and_no_result():
    rng = np.random.default_rng(1)
    c = np.rint(rng.normal(0, 10, (3000, 64)) * np.exp(-np.arange(64) / 8)).astype(np.int64)
    q, ids, left = c[:20], np.arange(3000), []
    least = np.sort((q @ c.T - np.where(ids[None, :] == ids[:20, None], 10**9, 0)), axis=1)[:, -5].astype(float)
    got = topk.best(q, ids, c, ids[:20], 5, True, None, least, left)
    want = brute([(i, list(map(int, v))) for i, v in zip(ids.tolist(), c, strict=True)], [(i, list(map(int, v))) for i, v in zip(range(20), q, strict=True)], 5)
    assert [(q_, i, s) for q_, i, s in got] == [(q_, i, s) for q_, _, i, s in want]
    assert sum(n for step, n in left if step == 1) < 0.2 * 20 * 3000


def test_given_vectors_lose_a_part_after_half_of_the_dimensions(spark):
    """On sf0.1: with the axes and the bounds of the first pass, after 16, 32 and 48 of 64 dimensions."""
    raw = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    c, ids = np.floor(256 * np.stack(raw["embedding"]).astype(float)).astype(np.int64), raw["vec_id"].to_numpy()
    asked = ids % 50 == 0
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, c, strict=True)], "id bigint, v array<bigint>")
    axes = topk.axes_of(frame)[64]
    assert np.allclose(axes @ axes.T, np.eye(64))
    every = c[asked] @ c.T
    every[ids[asked][:, None] == ids[None, :]] = -(10**12)
    least, left = np.sort(every, axis=1)[:, -5].astype(float), []
    got = topk.best(c[asked], ids, c, ids[asked], 5, True, axes, least, left)
    order = np.lexsort((np.broadcast_to(ids, every.shape), -every), axis=1)[:, :5]
    assert [(i, s) for _, i, s in got] == [(int(ids[j]), int(every[r, j])) for r in range(len(every)) for j in order[r]]
    alive = [sum(n for step, n in left if step == i) / every.size for i in (1, 2, 3)]
    print("alive after 16, 32, 48 dimensions:", alive)
    assert alive[1] < 0.8 and alive[2] < 0.2
