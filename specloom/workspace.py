"""Session facts: where intermediate tables go, when they are deleted, and how a size is checked before a broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, or its context's checkpoint folder.

    Every executor has to see it. There is no default: who starts a session chooses the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return folder


# Folders made since each of the open blocks of ``tidy`` began.
_blocks: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/specloom/{name}-{uuid.uuid4().hex}"
    for made in _blocks:
        made.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def total_bytes(spark: SparkSession, files: Iterable[str]) -> int:
    """Size of files, given as ``inputFiles`` names them."""
    jvm, conf, total = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for file in files:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        total += target.getFileSystem(conf).getFileStatus(target).getLen()
    return total


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it in the place of another in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(fresh)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    files.rename(fresh, target, how)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(frame: DataFrame) -> None:
    """Delete a table that ``materialize`` gave."""
    delete_folder(frame.sparkSession, frame._written)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the intermediate tables that are written inside the block when it ends.

    Tables of ``materialize`` that are put in the list that the block gives stay. ::

        with tidy(spark) as kept:
            kept.append(materialize(operator(table), "result"))
    """
    made: list[str] = []
    results: list[DataFrame] = []
    _blocks.append(made)
    try:
        yield results
    finally:
        _blocks[:] = [block for block in _blocks if block is not made]
        read = {frame._written for frame in results}
        for path in made:
            if path not in read:
                delete_folder(spark, path)


def materialize(frame: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives lost executors, keeps later column pruning and gives the planner
    real sizes. ``tidy`` deletes it.
    """
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found._written = path
    return found


def broadcast_if_small(frame: DataFrame, *sized: str) -> DataFrame:
    """Hint a materialized table for broadcast when its rows and string bytes are few.

    Beyond the limit the table is returned as it is and the join shuffles.
    """
    total = F.lit(0)
    for column in sized:
        total = total + F.coalesce(F.sum(F.octet_length(column)), F.lit(0))
    rows, size = frame.agg(F.count(F.lit(1)), total).first()
    return F.broadcast(frame) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else frame
