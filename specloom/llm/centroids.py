"""Clustering of integer vectors round centroids, the nearest found in the Walsh-Hadamard domain.

Vectors and centroids go through the exact integer Walsh-Hadamard transform, coefficients in order of
sequency, coarse to fine. Squared differences of coefficients add up to the width times the squared
distance, so a sum over the first ones is a lower bound. After each step the centroid that leads gets its
whole distance; centroids whose sum is strictly above that are dropped, and the next coefficients are
added for the others alone. What is left after the last coefficient has its exact distance; ties go to the
smaller number.

Vectors stay where they are: each task returns count and sums of its clusters, at most k rows for each
component. Only centroids, k rows of the width, meet the driver. A round reads the vectors once and
writes nothing.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.llm.common import ship
from specloom.workspace import materialize

CENTROIDS, ROUNDS, SEED = 16, 3, "1:"
#: Shares of the coefficients after which centroids are dropped.
STEPS = (1 / 64, 1 / 16, 1 / 4, 1)
#: Components up to which 64 bits hold sums over a batch; larger ones are added as Python's integers.
NARROW = 1 << 48
#: Vectors that are searched at once.
AT_ONCE = 4096


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, by order of sequency; the width is a power of two."""
    n, width = rows.shape
    out, half = rows, 1
    while half < width:
        pairs = out.reshape(n, -1, 2, half)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        half *= 2
    return out[:, _sequency(width)]


def _sequency(width: int) -> np.ndarray:
    """Places of the coefficients by the number of sign changes of their basis vector."""
    i = np.arange(width)
    bits = i[:, None] & i[None, :]
    parity = np.zeros_like(bits)
    while bits.any():
        parity ^= bits & 1
        bits >>= 1
    return np.argsort((parity[:, 1:] != parity[:, :-1]).sum(1), kind="stable")


def _padded(rows: np.ndarray) -> np.ndarray:
    """Zeros up to the next power of two: they change no distance."""
    width = 1 << max(rows.shape[1] - 1, 0).bit_length()
    return np.concatenate([rows, np.zeros((len(rows), width - rows.shape[1]), rows.dtype)], axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray, left: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance of each vector.

    ``left``: gets the pairs of vector and centroid that are alive behind each step.
    """
    most = max(int(np.abs(r).max(initial=0)) for r in (vectors, centroids))
    x, c = _padded(vectors), _padded(centroids)
    n, k, width = len(x), len(c), x.shape[1]
    if (2 * most * width) ** 2 >= 1 << 63:  # no 64 bits for the sum of squares: Python's integers
        x, c = x.astype(object), c.astype(object)
    x, c = transform(x), transform(c)
    row, which = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = np.zeros(n * k, x.dtype)
    edges = sorted({0, *(max(1, int(width * s)) for s in STEPS)})
    for first, last in pairwise(edges):
        step = x[row, first:last] - c[which, first:last]
        total = total + (step * step).sum(1)
        starts = np.searchsorted(row, np.arange(n))
        least = np.minimum.reduceat(total, starts)
        lead = np.flatnonzero(total == least[row])
        lead = lead[np.unique(row[lead], return_index=True)[1]]  # the first of each vector
        if last < width:
            rest = x[:, last:] - c[which[lead], last:]
            bound = least + (rest * rest).sum(1)
            alive = total <= bound[row]
            row, which, total = row[alive], which[alive], total[alive]
        if left is not None:
            left.append(len(row))
    return which[lead], least // width


def _rows(batch: pa.RecordBatch, vector: str, width: int) -> np.ndarray:
    return pc.list_flatten(batch[vector]).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def sums(vectors: DataFrame, centroids: list[list[int]], vector: str) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has a vector: how many, and the sum of each component."""
    width, k = len(centroids[0]), len(centroids)
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        middle = np.array(held.value, np.int64)
        counts, added = [0] * k, np.zeros((k, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = _rows(batch.slice(at, AT_ONCE), vector, width)
                found, _ = nearest(rows, middle)
                wide = rows if np.abs(rows).max(initial=0) <= NARROW else rows.astype(object)
                for c in np.unique(found).tolist():
                    counts[c] += int((found == c).sum())
                    added[c] += wide[found == c].sum(0).astype(object)
        some = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c in some for _ in range(width)], pa.int32()),
                pa.array([d for _ in some for d in range(width)], pa.int32()),
                pa.array([counts[c] for c in some for _ in range(width)], pa.int64()),
                pa.array([Decimal(int(v)) for c in some for v in added[c]], pa.decimal128(38, 0)),
            ],
            ["cluster", "dimension", "n", "total"],
        )

    each = vectors.select(vector).mapInArrow(run, "cluster int, dimension int, n bigint, total decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out.setdefault(r["cluster"], (r["n"], [0] * width))[1][r["dimension"]] = int(r["total"])
    return out


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, key: str = "vec_id", vector: str = "vector") -> list[list[int]]:
    """Centroids after so many rounds, each the floor of its vectors' mean; empty ones stay as they are.

    They start as the k vectors with the smallest sha256 of seed and id (a null id is an empty one), in
    that order; of equal ids the smaller vector comes first. Fewer vectors give fewer centroids.
    """
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.select(name.alias("name"), F.col(vector).alias("v")).orderBy("name", "v").limit(k)
    centroids = [list(r["v"]) for r in first.collect()]
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in sums(vectors, centroids, vector).items():
            centroids[c] = [t // n for t in total]
    return centroids


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, key: str = "vec_id", vector: str = "vector", width: int = 64
) -> DataFrame:
    """The key, cluster, distance (squared), cluster_inertia, inertia and centroid of each vector.

    ``vector`` is an array of integers. Rows without a vector, with another width or a null component take
    no part; repeated rows are vectors of their own, null ids too. Other columns are left out. No vector:
    no row. The table is read once a round and twice more: one that is dear to make is best written first.
    A distance or an inertia that doesn't fit 64 bits fails.
    """
    ship(vectors.sparkSession)
    whole = F.col(vector).cast("array<bigint>")
    good = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())
    vectors = vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(key), whole.alias(vector))
    centroids = fit(vectors, k, rounds, seed, key, vector)
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        middle = np.array(held.value, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found, distance = nearest(_rows(part, vector, width), middle)
                yield pa.RecordBatch.from_arrays([part[key], pa.array(found, pa.int32()), pa.array(distance.tolist(), pa.int64())], [key, "cluster", "distance"])

    fields = [vectors.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    found = materialize(vectors.mapInArrow(run, T.StructType(fields)), "clusters")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    whole = sum(inertia.values())
    facts = [(c, inertia.get(c), whole, centroid) for c, centroid in enumerate(centroids)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return found.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """sha256 of the components as decimal integers, comma-joined."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The registered query in DuckDB SQL: every distance, a step for each round."""
    steps = [
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS INTEGER) AS c, v FROM v
            ORDER BY c LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
            SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT v.row, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - w.v[i]) * (v.v[i] - w.v[i]))) AS BIGINT) AS d FROM v, c{i} w)
            GROUP BY row)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (
            SELECT c, list(m ORDER BY i) AS v FROM (
                SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
                    SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v.v) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{i} USING (row)) GROUP BY c, i))
            GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, w.v) AS v FROM c{i} w LEFT JOIN m{i} m USING (c))"""
            )
    return f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    {", ".join(steps)}
    SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN v USING (row) JOIN c{rounds} w USING (c)
    """
