"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.workspace import materialize

HOT_SHARE = 0.001
HOT_ROWS = 10_000_000
ROWS_PER_SALT = 1_000_000
MIN_SALTS = 8
MAX_SALTS = 10_000
GROUP_LIMIT = 1_000_000


def hot_keys(frame: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of the rows or HOT_ROWS, with the number of parts to split them in.

    At most ``1 / share`` by the first rule; by the second at most rows / HOT_ROWS, 100,000 of 10^12
    rows: a size that is safe to broadcast.
    """
    rows = frame.count()
    sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / ROWS_PER_SALT)
    bounded = F.least(F.greatest(parts, F.lit(MIN_SALTS)), F.lit(MAX_SALTS)).cast("int")
    return sizes.filter(F.col("n") > max(min(rows * share, HOT_ROWS), 1)).select(*keys, bounded.alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "left",
    share: float = HOT_SHARE,
) -> DataFrame:
    """Equi-join with a right side that has one row (or a few) per key.

    Rows of hot left keys are spread over tasks by a hash of the ``spread`` columns, the more the
    hotter the key, and the right rows of those keys are repeated as often. Only the bounded list
    of hot keys is broadcast.
    """
    hot = F.broadcast(hot_keys(left.select(*keys), keys, share))
    salts = F.col("_salts")
    salt = F.pmod(F.xxhash64(*spread), salts).cast("int")
    salted = (
        left.join(hot, keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    )
    every = F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def with_positions(
    frame: DataFrame, group: list[str], order: list, out: str = "pos", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Number the rows of every group 1, 2, ... by ``order`` (which must be total).

    While the largest group is small, this is a window. Otherwise rows are range-partitioned by
    group and order, numbered inside each partition, and shifted by the sizes of the partitions
    before: no task ever holds a whole large group. Counts the table once; pass one that is cheap
    to read.
    """
    sizes = frame.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    if (largest or 0) <= limit:
        window = Window.partitionBy(*group).orderBy(*order)
        return frame.withColumn(out, F.row_number().over(window).cast("long"))

    partitions = max(2, -(-2 * rows // limit))
    ranged = materialize(
        frame.repartitionByRange(partitions, *group, *order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranged",
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    numbered = ranged.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_rn") + F.col("_before"))
        .drop("_part", "_rn", "_before")
    )
