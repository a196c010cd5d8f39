"""Shared by the operators: the code on the workers, vocabulary files, look-ups that are written once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: White space as the contracts have it: space, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Give the workers the package; once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    archive = os.path.join(tempfile.mkdtemp(prefix="specloom-llm-"), "specloom_llm.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, files in os.walk(_PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(archive)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column that is named twice inside a lambda may be put in by the optimizer and computed for
    each element; an array of one element binds it.
    """
    return F.transform(F.array(value), body)[0]


def boxed(frame: DataFrame, *replaced: str) -> DataFrame:
    """The table as one column ``row``, without the columns that are made anew.

    Helper columns beside it can't clash with the table's own; ``row.*`` brings those back.
    """
    return frame.drop(*replaced).select(F.struct("*").alias("row"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(frame: DataFrame, rows: int, per_partition: int) -> int:
    """Partitions for a shuffle of so many rows: the session's number, or more where rows ask for it."""
    configured = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, -(-rows // per_partition))
