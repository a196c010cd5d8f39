"""Centroid clustering against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from specloom.llm import centroids


def plain(vectors, k, rounds, seed="1:"):
    """Rows (id, cluster, distance, cluster inertia, inertia, centroid) by every distance."""
    name = lambda i: hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest()
    middle = [v for _, v in sorted((name(i), v) for i, v in vectors)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middle)) for _, v in vectors]

    for _ in range(rounds):
        found = assign()
        for c in range(len(middle)):
            mine = [v for (_, v), (_, d) in zip(vectors, found, strict=True) if d == c]
            if mine:
                middle[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    inertia = [sum(d for d, c in found if c == j) for j in range(len(middle))]
    return [(i, c, d, inertia[c], sum(inertia), middle[c]) for (i, _), (d, c) in zip(vectors, found, strict=True)]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("spread", "width"), [(3, 64), (60, 64), (2**27, 4), (40, 5)])
def test_every_distance(spark, spread, width):
    rng = random.Random(spread)
    vectors = [(i, [rng.randint(-spread, spread) for _ in range(width)]) for i in range(300)]
    vectors += [(i + 1000, v) for i, v in vectors[:30]] + vectors[30:60] + [(None, vectors[0][1]), (None, vectors[1][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id bigint, vector array<bigint>, cluster int, inertia string").repartition(5)
    got = centroids.cluster(frame, k=7, width=width)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert order(map(tuple, got.collect())) == order(plain(vectors, 7, 3))


def test_odd_rows(spark):
    rows = [("a", [1, 2]), ("a", [1, 2]), ("b", [3, None]), ("c", None), (None, [1, 1]), ("d", []), ("e", [9, 0]), ("f", [5])]
    frame = spark.createDataFrame(rows, "name string, v array<int>")
    kept = [(i, v) for i, v in rows if v and len(v) == 2 and None not in v]
    got = centroids.cluster(frame, key="name", vector="v", width=2).collect()  # fewer vectors than centroids
    assert order(map(tuple, got)) == order(plain(kept, 16, 3))
    assert centroids.cluster(frame.filter("false"), key="name", vector="v", width=2).collect() == []


def test_a_distance_beyond_64_bits_fails(spark):
    frame = spark.createDataFrame([(1, [2**40]), (2, [-(2**40)]), (3, [0])], "vec_id int, vector array<bigint>")
    with pytest.raises(Exception, match="(?i)int64|overflow|too (large|big)|long"):
        centroids.cluster(frame, k=1, width=1).collect()


def test_transform_is_exact_and_ordered():
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, (50, 64))
    spectrum = centroids.transform(x)
    assert ((spectrum**2).sum(1) == 64 * (x**2).sum(1)).all()
    assert (spectrum[:, 0] == x.sum(1)).all()
    basis = centroids.transform(np.eye(64, dtype=np.int64))  # a column is a basis vector
    assert [int((basis[1:, j] != basis[:-1, j]).sum()) for j in range(64)] == list(range(64))


def test_steps_drop_centroids_and_no_result():
    rng = np.random.default_rng(4)
    middle = np.rint(np.cumsum(rng.normal(0, 20, (16, 64)), axis=1)).astype(np.int64)
    x = middle[rng.integers(0, 16, 2000)] + rng.integers(-6, 7, (2000, 64))
    left = []
    found, distance = centroids.nearest(x, middle, left)
    every = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert left[0] < 0.5 * 16 * 2000 and left[1] < 0.2 * 16 * 2000  # after 1 and 4 of 64 coefficients
