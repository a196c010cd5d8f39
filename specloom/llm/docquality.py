"""Quality of documents by boosted trees over statistics of their texts.

Labelled documents, a bounded sample of each class, become rows of statistics inside the tasks and meet
the driver as those; the forest is trained there and sent to the tasks as three flat arrays of fixed
size. Every whole text is scored by array operations, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.llm import boosting, textstats
from specloom.llm.bpe import small_batches
from specloom.llm.common import ship
from specloom.workspace import materialize

#: Labelled documents of each class that are learned from, those with the smallest hash of their id.
SAMPLE = 8_000
#: Least score of a document that is predicted to be good.
THRESHOLD = 0.3


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [t or b"" for t in batch[text].cast(pa.string()).cast(pa.binary()).to_pylist()]


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """The table without its texts, and an array of the numbers that ``textstats.NAMES`` lists."""
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], text, textstats.PIECE):
                rows = textstats.statistics(_texts(batch, text))
                yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(list(rows), pa.list_(pa.float64()))], [*(f.name for f in kept), out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
    settings: boosting.Settings = boosting.Settings(),
) -> boosting.Forest:
    """A forest from the documents that are labelled 1 or 0.

    Each class is learned from ``sample`` ids at most and weighs what its ids do among all labelled ones,
    so scores are shares of the whole. Other labels and null ids are left out; an id with both labels is
    learned from as either; of several rows of one id the one with the least statistics counts.
    """
    given = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct()
    order = F.xxhash64(F.col("_key").cast("string"))
    first = [given.filter(F.col("_label") == c).orderBy(order, "_key").limit(sample) for c in (0, 1)]
    chosen = materialize(first[0].unionByName(first[1]), "labelled")  # 2 * sample rows at most
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    rows = with_statistics(found).groupBy("_key", "_label").agg(F.min("statistics").alias("s"))
    rows = sorted((r["_label"], r["s"]) for r in rows.select("_label", "s").collect())
    positive = np.array([y == 1 for y, _ in rows], bool)
    share = {r["_label"]: r["n"] for r in given.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = {c: int((positive == bool(c)).sum()) for c in (0, 1)}
    scale = sum(taken.values()) / max(1, sum(share.get(c, 0) for c in (0, 1) if taken[c]))
    weights = np.array([share[y] / taken[y] * scale for y, _ in rows])
    return boosting.fit(np.array([s for _, s in rows]).reshape(len(rows), len(textstats.NAMES)), positive, weights, settings)


def score(docs: DataFrame, forest: boosting.Forest, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on, else 0).

    Of the text alone; a null text is an empty one and has the score of its statistics, which are all 0.
    Rows are scored one by one, so repeated rows, null ids and ties change nothing; columns of these names
    are replaced. Without any label every score is one half.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score", "predicted")
    held = spark.sparkContext.broadcast(forest)

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], text, textstats.PIECE):
                found = held.value.scores(textstats.statistics(_texts(batch, text)))
                columns = [pa.array(found, pa.float64()), pa.array(found >= threshold).cast(pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "score", "predicted"])

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
