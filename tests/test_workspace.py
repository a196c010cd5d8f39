"""Intermediate tables in the shared folder."""

import os

from pyspark.sql import functions as F

from checks import views
from specloom import workspace as w


def tables(spark):
    folder = f"{w.shared_folder(spark).removeprefix('file:')}/specloom"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tidy_deletes_what_the_block_wrote(spark):
    before = tables(spark)
    outside = w.materialize(spark.range(3), "outside")
    with w.tidy(spark) as kept:
        first = w.materialize(spark.range(10), "first")
        with w.tidy(spark) as inner:
            second = w.materialize(first.withColumn("x", F.col("id") * 2), "second")
            inner.append(w.materialize(second.filter("x > 4"), "third"))
        assert len(tables(spark) - before) == 3  # outside, first and third
        kept.append(w.materialize(inner[0].select("x"), "result"))
    assert len(tables(spark) - before) == 2
    assert kept[0].count() == 7 and outside.count() == 3
    w.drop(kept[0])
    w.drop(outside)
    assert tables(spark) == before


def test_a_block_that_fails_leaves_nothing(spark):
    before = tables(spark)
    try:
        with w.tidy(spark):
            w.materialize(spark.range(10), "first")
            raise ValueError
    except ValueError:
        pass
    assert tables(spark) == before


def test_views_are_spread_by_bytes(spark, tmp_path, monkeypatch):
    """A table of one file is read in more tasks than there are cores once it is large."""
    path = str(tmp_path / "a table")
    spark.range(2000).coalesce(1).write.parquet(path)
    frame = spark.read.parquet(path)
    size = w.total_bytes(spark, frame.inputFiles())
    cores = spark.sparkContext.defaultParallelism
    assert size > 0 and views.spread(frame).rdd.getNumPartitions() == cores
    monkeypatch.setattr(views, "BYTES_PER_TASK", size // (3 * cores))
    spread = views.spread(frame)
    assert spread.rdd.getNumPartitions() >= 3 * cores
    assert sorted(r["id"] for r in spread.collect()) == list(range(2000))


def test_given_tables_are_spread_before_texts_are_planted(spark, tmp_path):
    """The rows of a view are far wider than those it is made of."""
    rows = [(i, i % 5, "O", "1-URGENT") for i in range(200)]
    columns = "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_orderpriority STRING"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    frame = views.view(spark, str(tmp_path), "spec_docs", early=True)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition", 1)
    assert "openapi" in above and "openapi" not in below
    assert frame.count() == 200 and frame.filter("spec_json LIKE '{\"openapi\"%'").count() == 200 - 16
    assert not spark.catalog.listTables()
