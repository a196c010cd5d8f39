"""The extraction cache: a table of results by content hash, entries valid for a while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import patterns as p
from specloom.operators.skew import salted_join


def is_fresh(created_at: Column, now: Column, ttl_seconds: int = p.CACHE_TTL_SECONDS) -> Column:
    """An entry expires when it is older than the limit; exactly at the limit it is still good."""
    return created_at >= now - F.make_dt_interval(secs=F.lit(ttl_seconds))


def fixed_time(spark: SparkSession, now: Column | None = None) -> Column:
    """A time that is the same in all jobs of a run, taken once."""
    given = F.current_timestamp() if now is None else now
    micros = spark.range(1).select(F.unix_micros(given.cast("timestamp"))).first()[0]
    return F.timestamp_micros(F.lit(micros))


def newest_entries(cache: DataFrame, kind: str) -> DataFrame:
    """The newest entry per content hash."""
    newest = cache.filter(F.col("kind") == kind).groupBy("content_hash").agg(
        F.max_by(F.struct("created_at", "payload"), F.struct("created_at", "payload")).alias("e")
    )
    return newest.select("content_hash", "e.*")


def cache_lookup(
    documents: DataFrame,
    cache: DataFrame,
    now: Column,
    ttl_seconds: int = p.CACHE_TTL_SECONDS,
    kind: str = "llm",
    spread=("site", "url"),
) -> DataFrame:
    """Add ``payload`` and ``created_at`` of the newest fresh entry; null is a miss.

    Only the newest entry counts: like a file that is overwritten, older ones are gone. Copies of
    one document may be a large share of the table, hence the salted join.
    """
    # When any entry of a key is fresh, so is the newest: the age test can go to the scan.
    fresh = newest_entries(cache.filter(is_fresh(F.col("created_at"), now, ttl_seconds)), kind)
    return salted_join(documents, fresh, ["content_hash"], list(spread), how="left")


def cache_stats(cache: DataFrame, ttl_seconds: int = p.CACHE_TTL_SECONDS) -> DataFrame:
    """One row: entries and megabytes per kind and in total, time to live in hours."""
    entry, size = F.col("kind"), F.octet_length("payload")

    def megabytes(flag):
        return F.coalesce(F.sum(F.when(flag, size)), F.lit(0)) / 1048576

    return cache.agg(
        F.count_if(entry == "http").alias("http_cache_count"),
        F.count_if(entry == "llm").alias("llm_cache_count"),
        megabytes(entry == "http").alias("http_cache_size_mb"),
        megabytes(entry == "llm").alias("llm_cache_size_mb"),
        megabytes(entry.isin("http", "llm")).alias("total_size_mb"),
        F.lit(ttl_seconds / 3600).alias("cache_ttl_hours"),
    )
