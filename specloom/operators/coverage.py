"""Coverage and quality of the endpoints of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom import schemas
from specloom.functions.jsontext import is_truthy


def has_example(parameters: Column, request_body: Column, responses: Column) -> Column:
    """A parameter, the body or a response carries an example that is not empty."""
    return (
        F.exists(parameters, lambda q: is_truthy(q["example"]))
        | F.coalesce(is_truthy(request_body["example"]), F.lit(False))
        | F.exists(responses, lambda r: is_truthy(r["example"]))
    )


def coverage_report(endpoints: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Counts, confidence distribution, mean confidence and quality per site, in one aggregation.

    Run it on all endpoints, before deduplication. ``sites`` adds rows for sites without any.
    """
    level = F.col("confidence")
    counts = endpoints.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_endpoints"),
        F.count_if(F.size("parameters") > 0).alias("endpoints_with_parameters"),
        F.count_if(F.col("request_body").isNotNull()).alias("endpoints_with_request_body"),
        F.count_if(F.size("responses") > 0).alias("endpoints_with_responses"),
        F.count_if(
            has_example(F.col("parameters"), F.col("request_body"), F.col("responses"))
        ).alias("endpoints_with_examples"),
        *[F.count_if(level == name).alias(f"confidence_{name}") for name in schemas.CONFIDENCE_LEVELS],
    )
    if sites is not None:
        counts = sites.select("site").distinct().join(counts, "site", "left").fillna(0)
    return with_quality(counts)


def with_quality(counts: DataFrame) -> DataFrame:
    """Add mean confidence, the two coverage percentages and the quality score (0 to 100)."""
    total = F.col("total_endpoints")

    def share(column):
        return F.when(total == 0, 0.0).otherwise(column / total)

    score = sum(
        (F.col(f"confidence_{name}") * value for name, value in schemas.CONFIDENCE_SCORE.items()),
        F.lit(0.0),
    )
    parts = {
        "parameters": share(F.col("endpoints_with_parameters")),
        "request_body": share(F.col("endpoints_with_request_body")),
        "responses": share(F.col("endpoints_with_responses")),
        "examples": share(F.col("endpoints_with_examples")),
        "confidence": F.col("average_confidence"),
    }
    quality = sum((parts[name] * w for name, w in schemas.QUALITY_WEIGHTS.items()), F.lit(0.0))
    if "average_confidence" not in counts.columns:
        counts = counts.withColumn("average_confidence", share(score))
    return counts.select(
        "*",
        (parts["parameters"] * 100).alias("parameter_coverage"),
        (parts["responses"] * 100).alias("response_coverage"),
        F.when(total == 0, 0.0).otherwise(quality * 100).alias("quality_score"),
    )


def run_summary(sites: DataFrame, documents: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per site: success (some endpoint was found), documents, endpoints, quality."""
    pages = documents.groupBy("site").agg(F.count(F.lit(1)).alias("doc_urls"))
    quality = coverage.select("site", "total_endpoints", "quality_score")
    joined = sites.select("site").distinct().join(pages, "site", "left").join(quality, "site", "left")
    found = F.coalesce("total_endpoints", F.lit(0))
    return joined.select(
        "site",
        (found > 0).alias("success"),
        F.coalesce("doc_urls", F.lit(0)).alias("doc_urls"),
        found.alias("endpoints"),
        F.when(found > 0, F.col("quality_score")).alias("quality"),
    )


def success_rate(summary: DataFrame) -> DataFrame:
    """One row: sites, successes and their share in percent."""
    return summary.agg(
        F.count(F.lit(1)).alias("sites"),
        F.count_if("success").alias("successes"),
        (F.count_if("success") / F.count(F.lit(1)) * 100).alias("success_rate"),
    )
