"""From page results to the endpoints, schemes and metadata of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom import schemas
from specloom.operators.skew import with_positions

PAGE_ORDER = schemas.PAGE_ORDER


def explode_rows(frame: DataFrame, column: str) -> DataFrame:
    """One row per element of an array of structs: (other columns, seq, fields).

    The outer form, with the empty rows dropped behind it: from the plain form the optimizer infers
    a filter on the array, pushes it down and so computes the array several times.
    """
    rest = [c for c in frame.columns if c != column]
    rows = frame.select(*rest, F.posexplode_outer(column).alias("seq", "_e"))
    return rows.filter(F.col("seq").isNotNull()).select(*rest, "seq", "_e.*")


def flatten_endpoints(results: DataFrame) -> DataFrame:
    """One row per endpoint: (site, url, seq, endpoint fields)."""
    return explode_rows(results.select("site", "url", F.col("endpoints").alias("e")), "e")


def flatten_security_schemes(results: DataFrame) -> DataFrame:
    """One row per security scheme: (site, url, seq, scheme fields)."""
    return explode_rows(results.select("site", "url", F.col("security_schemes").alias("s")), "s")


def concat_results(*results: DataFrame) -> DataFrame:
    """Bag union of page results."""
    first, *others = results
    for other in others:
        first = first.unionByName(other)
    return first


def confidence_rank(level: Column) -> Column:
    rank = F.lit(0)
    for name, value in schemas.CONFIDENCE_RANK.items():
        rank = F.when(level == name, value).otherwise(rank)
    return rank


def normalize_path(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def operation_id(method: Column, path: Column) -> Column:
    """``get /users/{id}/profile`` -> ``get_users_by_id_profile``."""
    name = F.regexp_replace(path, r"\A/+|/+\z", "")
    name = F.regexp_replace(name, r"(?d)\{.*?\}", "by_id")
    name = F.regexp_replace(name, r"[^a-zA-Z0-9]+", "_")
    return F.lower(F.concat(method, F.lit("_"), name))


def dedup_endpoints(endpoints: DataFrame, order=PAGE_ORDER) -> DataFrame:
    """The best endpoint per (site, path, method): highest confidence, then the earliest.

    "First row per key" is planned with a group limit before the shuffle, so each task sends at
    most one row per key: copies of one endpoint never gather in one task.
    """
    best = Window.partitionBy("site", "path", "method").orderBy(
        confidence_rank(F.col("confidence")).desc(), *order
    )
    ranked = endpoints.withColumn("_rn", F.row_number().over(best))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def resolve_path_collisions(endpoints: DataFrame, order=PAGE_ORDER) -> DataFrame:
    """Give deduplicated endpoints their ``norm_path``; of two that now coincide the later stays.

    ``path_order`` is the place of the path: that of its first endpoint, kept or not; likewise
    ``method_order`` for the operation. The groups are the few operations of one path.
    """
    of_path = Window.partitionBy("site", "norm_path")
    latest = Window.partitionBy("site", "norm_path", "method").orderBy(
        *[F.col(c).desc() for c in order]
    )
    of_operation = Window.partitionBy("site", "norm_path", "method")
    place = F.min(F.struct(*order))
    placed = (
        endpoints.withColumn("norm_path", normalize_path(F.col("path")))
        .withColumn("path_order", place.over(of_path))
        .withColumn("method_order", place.over(of_operation))
        .withColumn("_rn", F.row_number().over(latest))
    )
    return placed.filter(F.col("_rn") == 1).drop("_rn")


def first_non_empty_metadata(results: DataFrame) -> DataFrame:
    """Per site the first non-empty title, description and base url, each on its own."""

    def first(name):
        return F.min_by(name, F.when(F.col(name) != "", F.col("url"))).alias(name)

    return results.groupBy("site").agg(
        first("api_title"), first("api_description"), first("base_url")
    )


def number_security_schemes(schemes: DataFrame, dedup: bool = False) -> DataFrame:
    """Name the schemes of a site ``security_1`` ... in page order.

    Pages repeating a scheme repeat it here; ``dedup`` keeps the first of equal ones.
    """
    if dedup:
        same = ["site", "type", "name", "location", "scheme", "bearer_format"]
        first = Window.partitionBy(*same).orderBy("url", "seq")
        schemes = schemes.withColumn("_rn", F.row_number().over(first))
        schemes = schemes.filter(F.col("_rn") == 1).drop("_rn")
    numbered = with_positions(schemes, ["site"], ["url", "seq"])
    return numbered.withColumn(
        "scheme_name", F.concat(F.lit("security_"), F.col("pos").cast("string"))
    )


def last_response_per_status(responses: Column) -> Column:
    """Responses with each status once: the last one, in the place of the first."""
    statuses = F.array_distinct(F.transform(responses, lambda r: r["status_code"]))
    return F.transform(
        statuses,
        lambda code: F.element_at(F.filter(responses, lambda r: r["status_code"] == code), -1),
    )


def distinct_tags(endpoints: DataFrame) -> DataFrame:
    """(site, tag): the tags in use on a site."""
    return endpoints.select("site", F.explode("tags").alias("tag")).distinct()


def path_count(endpoints: DataFrame) -> DataFrame:
    """(site, path_count): distinct normalized paths."""
    paths = endpoints.select("site", normalize_path(F.col("path")).alias("p")).distinct()
    return paths.groupBy("site").agg(F.count(F.lit(1)).alias("path_count"))


def total_endpoints(results: DataFrame) -> DataFrame:
    """(site, total_endpoints): endpoints of all pages, copies included."""
    return results.groupBy("site").agg(
        F.sum(F.size("endpoints")).cast("long").alias("total_endpoints")
    )
