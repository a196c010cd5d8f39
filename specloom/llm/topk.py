"""Exact top-k search by inner product, dimension block by dimension block.

Vectors of integers are turned onto the principal axes of a bounded sample, largest first, which changes
no inner product but puts most of it into the first dimensions. Candidates are held in blocks in
vertical layout: one array per block of dimensions, so that a step reads only the dimensions it adds. For
a block of queries against a block of candidates:

1. The first dimensions of all pairs are added up in one matrix product.
2. What the remaining dimensions can add is at most the product of the two remaining lengths (their
   mass). A candidate whose partial score plus this bound is below the query's k-th best so far is
   dropped for good, the survivors are compacted, and the next dimensions are added for them alone.
3. The k-th best so far is known before: a first pass searches a sample of all candidates, of
   SAMPLE_LEAST rows or a SAMPLE_SHARE of them, and its k-th best score of a query bounds it in every
   block.

Turned vectors are in double precision and their bounds have a margin for rounding; scores of the
survivors are products of the integers themselves, in double precision as long as no sum can pass 2^53,
else in 64 bits. So the result is exact. Every pair of blocks is one row, k rows per query leave it.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import ship
from specloom.workspace import materialize

#: Rows of a block of queries, most rows of a block of candidates, dimensions of a step.
QUERIES_IN_BLOCK, CANDIDATES_IN_BLOCK, DIMENSIONS = 1024, 32_768, 16
#: Candidates whose scores give the first bounds: so many, or such a share of all if that is more.
SAMPLE_LEAST, SAMPLE_SHARE = 4096, 1 / 64
#: Rows that the axes are computed from.
AXES_ROWS = 4096


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, infinite or not a number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def best(
    queries: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    names: np.ndarray,
    k: int,
    own: bool,
    axes: np.ndarray | None = None,
    least: np.ndarray | None = None,
    alive_after: list | None = None,
) -> list[tuple[int, int, int]]:
    """(row of the query, id, score) of the k best candidates of each query, ties to the smaller id.

    queries, vectors: integers, a row each; ``names``, ``ids``: their ids; ``own``: whether a candidate
    with a query's id is left out; ``axes``: an orthogonal matrix; ``least``: scores that a query's k-th
    best reaches at least. ``alive_after``: gets the candidates of all queries that are alive behind each
    step.
    """
    turned_q, turned = (x.astype(float) if axes is None else x @ axes for x in (queries, vectors))
    edges = [*range(0, vectors.shape[1], DIMENSIONS), vectors.shape[1]]
    vertical = [np.ascontiguousarray(turned[:, a:b].T) for a, b in pairwise(edges)]
    mass, query_mass = ([np.sqrt((x[:, e:] ** 2).sum(1)) for e in edges] for x in (turned, turned_q))
    margin = 1e-9 * query_mass[0][:, None] * mass[0].max(initial=0) + 1e-6
    first = turned_q[:, : edges[1]] @ vertical[0]
    out = []
    for q in range(len(queries)):
        bound = -np.inf if least is None else least[q] - float(margin[q, 0])
        alive, score = np.arange(len(ids)), first[q]
        for i in range(1, len(edges)):
            good = score + query_mass[i][q] * mass[i][alive] >= bound
            alive, score = alive[good], score[good]
            if alive_after is not None:
                alive_after.append((i, len(alive)))
            if i < len(vertical):
                score = score + turned_q[q, edges[i] : edges[i + 1]] @ vertical[i][:, alive]
        if own:
            alive, score = (x[ids[alive] != names[q]] for x in (alive, score))
        if len(alive) > k:  # those that rounding could put among the k best
            near = score >= np.partition(score, -k)[-k] - 2 * float(margin[q, 0])
            alive = alive[near]
        real = vectors[alive] @ queries[q]
        order = np.lexsort((ids[alive], -real))[:k]
        out += [(q, int(ids[alive[o]]), int(real[o])) for o in order]
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which no inner product of their rows loses a digit."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most >= 2**63:
        raise ValueError("inner products don't fit 64 bits")
    return (a.astype(float), b.astype(float)) if most < 2**53 else (a, b)


def _blocks(vectors: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """Vectors (id, v) in blocks of about that many rows and one width, and the number of blocks."""
    number = -(-vectors.count() // rows) or 1
    dealt = vectors.withColumn("width", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(name)), F.lit(number)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        width = table["width"][0].as_py()
        values = pc.list_flatten(table["v"]).to_numpy().astype("<i8").reshape(-1, width)
        most = int(np.abs(values).max(initial=0))
        kind = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)  # as narrow as the numbers allow
        return pa.table(
            {
                "width": table["width"][:1],
                "block": table["block"][:1],
                "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                "kind": pa.array([kind]),
                "values": pa.array([values.astype(kind).tobytes()], pa.binary()),
            }
        )

    made = dealt.groupBy("width", "block").applyInArrow(run, "width int, block int, ids binary, kind string, values binary")
    return materialize(made, f"{name}-blocks"), number


def axes_of(vectors: DataFrame, rows: int = AXES_ROWS) -> dict[int, np.ndarray]:
    """Principal axes by width, of the ``rows`` vectors with the smallest hash; each an orthogonal matrix."""
    chosen = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(rows)
    by_width: dict[int, list] = {}
    for r in chosen.collect():
        by_width.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for width, held in by_width.items():
        x = np.array(held, float)
        x /= max(float(np.abs(x).max()), 1.0)
        out[width] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def _searched(asked: DataFrame, held: DataFrame, number: int, k: int, own: bool, axes: dict[int, np.ndarray]) -> DataFrame:
    """(width, query_row, query_id, found, score): the k best of each query in each block of candidates.

    Only numbers of blocks are multiplied; vectors follow by a join with either side. ``asked`` may have
    a column ``least``: doubles as bytes.
    """
    spark = asked.sparkSession
    turns = spark.sparkContext.broadcast(axes)
    pairs = asked.select("width", "query_block", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("block"))
    met = pairs.join(held, ["width", "block"]).join(asked, ["width", "query_block"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch[n][i].as_py() for n in batch.schema.names}
                ids, names = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                q = np.frombuffer(row["q_values"], row["q_kind"]).reshape(-1, row["width"]).astype(np.int64)
                c = np.frombuffer(row["values"], row["kind"]).reshape(-1, row["width"]).astype(np.int64)
                q, c = exact(q, c)
                least = np.frombuffer(row["least"], "<f8") if row.get("least") else None
                found = best(q, ids, c, names, k, own, turns.value.get(row["width"]), least)
                at = np.array([f[0] for f in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["width"]] * len(found), pa.int32()),
                        pa.array([(row["query_block"] << 32) + a for a in at.tolist()], pa.int64()),
                        pa.array(names[at]),
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int64()),
                    ],
                    ["width", "query_row", "query_id", "found", "score"],
                )

    return met.mapInArrow(run, "width int, query_row bigint, query_id bigint, found bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("width", "query_row").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bounds(asked: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """``asked`` with ``least``: of each of its queries the k-th best score of a first search, or nothing."""
    kth = _ranked(first, k).filter(F.col("rank") == k).select(
        "width", F.shiftright("query_row", 32).cast("int").alias("query_block"), (F.col("query_row") % (1 << 32)).cast("int").alias("row"), "score"
    )
    of_block = kth.groupBy("width", "query_block").agg(F.array_sort(F.collect_list(F.struct("row", "score"))).alias("known"))  # a block's rows at most

    def run(batches):
        for batch in batches:
            filled = []
            for ids, known in zip(batch["q_ids"].to_pylist(), batch["known"].to_pylist(), strict=True):
                least = np.full(len(ids) // 8, -np.inf)
                for pair in known or ():
                    least[pair["row"]] = pair["score"]
                filled.append(least.astype("<f8").tobytes())
            columns = [batch[n] for n in batch.schema.names if n != "known"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(filled, pa.binary())], [*(n for n in batch.schema.names if n != "known"), "least"])

    met = asked.join(of_block, ["width", "query_block"], "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema.fields if f.name != "known")
    return materialize(met.mapInArrow(run, f"{schema}, least binary"), "bounds")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "vector", own: bool = True) -> DataFrame:
    """query_id, rank (from 1), the id found, score: the k highest inner products of each query.

    Both tables have the key and an array of integers. Ties go to the smaller id; a query gets fewer
    rows if there are fewer candidates. ``own``: rows with the query's id aren't candidates. Null ids
    and vectors, vectors with a null component and empty ones take no part; equal rows count once; rows
    of one id with different vectors are answered each (told apart by nothing but their rows). Vectors
    meet those of their width. An inner product that could pass 64 bits fails.
    """
    spark = vectors.sparkSession
    ship(spark)

    def taken(frame: DataFrame) -> DataFrame:
        frame = frame.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("v"))
        good = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
        return frame.filter(F.coalesce(good, F.lit(False))).distinct()

    all_ = taken(vectors)
    total = all_.count()
    rows = min(CANDIDATES_IN_BLOCK, max(-(-total // (2 * spark.sparkContext.defaultParallelism)), CANDIDATES_IN_BLOCK // 16, 1))
    axes = axes_of(all_)
    asked, _ = _blocks(taken(queries), QUERIES_IN_BLOCK, "queries")
    asked = asked.withColumnsRenamed({"block": "query_block", "ids": "q_ids", "kind": "q_kind", "values": "q_values"})
    held, number = _blocks(all_, rows, "candidates")
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE_LEAST / max(total, 1)))
    sample = all_.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    seeds, some = _blocks(sample, rows, "sample")
    asked = bounds(asked, _searched(asked, seeds, some, k, own, axes), k)
    ranked = _ranked(_searched(asked, held, number, k, own, axes), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(key), "score")
