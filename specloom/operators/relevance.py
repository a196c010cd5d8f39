"""Ranking endpoints against keyword queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom import patterns as p
from specloom.functions.relevance import keywords, literal_keywords, query_keywords, relevance
from specloom.operators.skew import salted_join
from specloom.schemas import PAGE_ORDER


def _scored(endpoints: DataFrame, found: Column) -> DataFrame:
    score = relevance(
        F.col("path"), F.col("summary"), F.col("description"), F.col("tags"), found
    )
    return endpoints.withColumn("score", score)


def score_endpoints(endpoints: DataFrame, query: str) -> DataFrame:
    """Add the ``score`` of every endpoint for one query; a projection without shuffle."""
    return _scored(endpoints, literal_keywords(query_keywords(query)))


def score_site_queries(endpoints: DataFrame, queries: DataFrame, spread=PAGE_ORDER) -> DataFrame:
    """Score against the queries (site, query) of each endpoint's own site."""
    prepared = queries.select("site", "query", keywords(F.col("query")).alias("_keywords"))
    joined = salted_join(endpoints, prepared, ["site"], list(spread), how="inner")
    return _scored(joined, F.col("_keywords")).drop("_keywords")


def filter_endpoints(
    endpoints: DataFrame, query: str, threshold: float = p.RELEVANCE_THRESHOLD
) -> DataFrame:
    """Endpoints that reach the threshold, with their score."""
    return score_endpoints(endpoints, query).filter(F.col("score") >= threshold)


def rank_endpoints(scored: DataFrame, order=PAGE_ORDER) -> DataFrame:
    """Highest score first; equal scores keep their order."""
    return scored.orderBy(F.col("score").desc(), "site", *order)


def top_matches(
    scored: DataFrame, group=("site",), n: int = p.TOP_MATCHES, order=PAGE_ORDER
) -> DataFrame:
    """The first ``n`` of each group, with their ``rank``."""
    window = Window.partitionBy(*group).orderBy(F.col("score").desc(), *order)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def filter_summary(
    endpoints: DataFrame,
    query: str,
    threshold: float = p.RELEVANCE_THRESHOLD,
    group=("site",),
    order=PAGE_ORDER,
) -> DataFrame:
    """Per group: counts before and after, mean, highest and lowest score, best matches."""
    group = list(group)
    scored = score_endpoints(endpoints, query)
    kept = F.col("score") >= threshold

    def of_kept(aggregate):
        return F.coalesce(aggregate(F.when(kept, F.col("score"))), F.lit(0.0))

    counts = scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("original_count"),
        F.count_if(kept).alias("filtered_count"),
        of_kept(F.avg).alias("average_score"),
        of_kept(F.max).alias("max_score"),
        of_kept(F.min).alias("min_score"),
    )
    fields = ["rank", "path", "method", "summary", "score"]
    best = (
        top_matches(scored.filter(kept), group, order=order)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("top"))
    )
    matches = F.transform("top", lambda m: F.struct(*[m[f].alias(f) for f in fields[1:]]))
    return counts.join(best, group, "left").select(
        *group,
        "original_count",
        "filtered_count",
        F.lit(query).alias("query"),
        F.lit(threshold).alias("threshold"),
        "average_score",
        "max_score",
        "min_score",
        F.when(F.col("top").isNotNull(), matches)
        .otherwise(F.array().cast("array<struct<path:string,method:string,summary:string,score:double>>"))
        .alias("top_matches"),
    )
